"""Metrics over prediction sets (row_uid, gold, pred) or decoded grids (row_uid, aspect, sentiment, target, p).

Ratios with an empty denominator are 0 unless a function says otherwise. Counts are summed first and divided once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.labels import pair_aspects, pair_sentiments, split_first
from larkspur.functions.scores import f1, harmonic, ratio
from larkspur.operators.prefix import running
from larkspur.plans.taxonomy import strings

_C = F.col


def counts(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """With tp, fp, fn, n_gold, n_pred of each row, from sets without repeats."""
    g, p = F.array_distinct(gold), F.array_distinct(pred)
    tp = F.size(F.array_intersect(g, p)).cast("long")
    return rows.withColumns({"tp": tp, "n_gold": F.size(g).cast("long"), "n_pred": F.size(p).cast("long")}).withColumns({"fp": _C("n_pred") - _C("tp"), "fn": _C("n_gold") - _C("tp")})


def _multilabel(prefix: str = "") -> dict[str, Column]:
    n, total = F.count("*"), lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    tp, fp, fn = total("tp"), total("fp"), total("fn")
    on = lambda c: total(c.cast("int"))
    eg, ep = _C("n_gold") == 0, _C("n_pred") == 0
    made = {
        "micro_f1": f1(tp, fp, fn), "micro_precision": ratio(tp, tp + fp), "micro_recall": ratio(tp, tp + fn),
        "samples_f1": F.coalesce(F.avg(ratio(2 * _C("tp"), _C("n_gold") + _C("n_pred"))), F.lit(0.0)),
        "label_tp": tp, "label_fp": fp, "label_fn": fn, "predicted_label_count": total("n_pred"), "gold_label_count": total("n_gold"),
        "empty_gold_rows": on(eg), "empty_prediction_rows": on(ep), "empty_gold_and_prediction_rows": on(eg & ep),
        "false_positive_rows": on(eg & ~ep), "false_negative_rows": on(~eg & ep),
        "false_positive_rows_per_100": ratio(on(eg & ~ep) * 100, n), "false_positive_labels_per_100": ratio(fp * 100, n),
        "false_negative_rows_per_100": ratio(on(~eg & ep) * 100, n), "exact_match_rate": ratio(on((_C("fp") == 0) & (_C("fn") == 0)), n),
    }
    return {prefix + k: v for k, v in made.items()}


def class_counts(rows: DataFrame, classes, by: tuple[str, ...] = ()) -> DataFrame:
    """(label, tp, fp, fn[, by]) for every class, absent ones too."""
    cell = rows.select(*by, F.explode(strings(classes)).alias("label"), "gold", "pred")
    g, p = F.array_contains("gold", _C("label")), F.array_contains("pred", _C("label"))
    total = lambda c, n: F.sum(c.cast("long")).alias(n)
    return cell.groupBy(*by, "label").agg(total(g & p, "tp"), total(~g & p, "fp"), total(g & ~p, "fn"))


def multilabel(rows: DataFrame, classes, by: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """One row (of each group `by`) with micro, macro and samples scores, row and label counts."""
    main = counts(rows).groupBy(*by).agg(*(v.alias(k) for k, v in _multilabel(prefix).items()))
    macro = class_counts(rows, classes, by).groupBy(*by).agg(F.avg(f1(_C("tp"), _C("fp"), _C("fn"))).alias(f"{prefix}macro_f1"))
    return main.join(macro, list(by)) if by else main.crossJoin(macro)  # one row beside one row


def presence(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A row's non-empty set as a binary task; true negatives are counted, and left out of precision, recall and F1."""
    g, p = F.size("gold") > 0, F.size("pred") > 0
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    tp, fp, fn, tn, n = total(g & p), total(~g & p), total(g & ~p), total(~g & ~p), F.count("*")
    return rows.groupBy(*by).agg(
        ratio(tp, tp + fp).alias("presence_precision"), ratio(tp, tp + fn).alias("presence_recall"), f1(tp, fp, fn).alias("presence_f1"),
        tp.alias("presence_tp_rows"), fp.alias("presence_fp_rows"), fn.alias("presence_fn_rows"), tn.alias("presence_tn_rows"),
        ratio(tp + fn, n).alias("presence_prevalence"), ratio(fp * 100, n).alias("presence_false_positive_rows_per_100"), ratio(fn * 100, n).alias("presence_false_negative_rows_per_100"),
    )


def sentiment_when_aspect(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of gold pairs whose aspect is predicted, the share whose sentiment is predicted for it too."""
    aspect = lambda x: split_first(x)[0]
    hit = F.filter("gold", lambda x: F.array_contains(_C("pred_aspects"), aspect(x)))
    held = rows.withColumn("pred_aspects", pair_aspects(_C("pred"))).select(*by, F.size(hit).cast("long").alias("n"), F.size(F.array_intersect(hit, "pred")).cast("long").alias("ok"))
    n, ok = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("ok"), F.lit(0))
    return held.groupBy(*by).agg(ratio(ok, n).alias("sentiment_accuracy_when_gold_aspect_predicted"), ok.alias("sentiment_correct_when_gold_aspect_predicted"), n.alias("sentiment_evaluated_gold_aspects"))


def by_aspect_sets(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"gold": pair_aspects(_C("gold")), "pred": pair_aspects(_C("pred"))})


def report(rows: DataFrame, classes) -> DataFrame:
    """Per-class precision, recall, F1 and support, with micro, macro, weighted and samples averages."""
    per = class_counts(rows, classes).select("label", ratio(_C("tp"), _C("tp") + _C("fp")).alias("precision"), ratio(_C("tp"), _C("tp") + _C("fn")).alias("recall"), f1(_C("tp"), _C("fp"), _C("fn")).alias("f1"), (_C("tp") + _C("fn")).alias("support"), "tp", "fp", "fn")
    tp, fp, fn, s = F.sum("tp"), F.sum("fp"), F.sum("fn"), F.sum("support")
    weighted = lambda c: ratio(F.sum(_C(c) * _C("support")), s)
    row = lambda label, *v: F.struct(F.lit(label).alias("label"), *(x.alias(n) for x, n in zip(v, ("precision", "recall", "f1", "support"))))
    made = F.array(
        row("micro avg", ratio(tp, tp + fp), ratio(tp, tp + fn), f1(tp, fp, fn), s),
        row("macro avg", F.avg("precision"), F.avg("recall"), F.avg("f1"), s),
        row("weighted avg", weighted("precision"), weighted("recall"), weighted("f1"), s),
    )
    summary = per.agg(made.alias("a")).select(F.explode("a").alias("r")).select("r.*")
    c = counts(rows)
    samples = c.agg(F.avg(ratio(_C("tp"), _C("n_pred"))).alias("precision"), F.avg(ratio(_C("tp"), _C("n_gold"))).alias("recall"), F.avg(ratio(2 * _C("tp"), _C("n_gold") + _C("n_pred"))).alias("f1"), F.sum("n_gold").alias("support")).select(F.lit("samples avg").alias("label"), "*")
    return per.drop("tp", "fp", "fn").unionByName(summary).unionByName(samples)


def reliability(rows: DataFrame, classes) -> DataFrame:
    """Class counts with precision (1 where nothing was predicted), recall, F1, support and predicted."""
    precision, recall = ratio(_C("tp"), _C("tp") + _C("fp"), 1.0), ratio(_C("tp"), _C("tp") + _C("fn"))
    return class_counts(rows, classes).withColumns({"precision": precision, "recall": recall, "support": _C("tp") + _C("fn"), "predicted": _C("tp") + _C("fp")}).withColumn("f1", harmonic(_C("precision"), _C("recall")))


def axis(rows: DataFrame, which: str) -> DataFrame:
    """Prediction sets seen by pair, aspect or sentiment."""
    make = {"pair": lambda c: F.array_distinct(c), "aspect": pair_aspects, "sentiment": pair_sentiments}[which]
    return rows.withColumns({"gold": make(_C("gold")), "pred": make(_C("pred"))})


def label_errors(rows: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1, support) of labels that occur; precision is 0 where nothing was predicted."""
    tag = lambda c, n: F.transform(c, lambda x: F.struct(x.alias("label"), F.lit(n).alias("kind")))
    every = F.concat(tag(F.array_intersect("gold", "pred"), "tp"), tag(F.array_except("pred", "gold"), "fp"), tag(F.array_except("gold", "pred"), "fn"))
    total = lambda k: F.sum((_C("kind") == k).cast("long")).alias(k)
    made = rows.select(F.explode(every).alias("x")).select("x.*").groupBy("label").agg(total("tp"), total("fp"), total("fn"))
    return made.withColumns({"precision": ratio(_C("tp"), _C("tp") + _C("fp")), "recall": ratio(_C("tp"), _C("tp") + _C("fn")), "f1": f1(_C("tp"), _C("fp"), _C("fn")), "support": _C("tp") + _C("fn")})


def confusion(decoded: DataFrame, *by: str) -> DataFrame:
    """(row_uid, tp, fp, fn, gold, predicted[, by]): additive, so the point at which to keep evidence."""
    total = lambda c, n: F.sum(c.cast("long")).alias(n)
    t, p = _C("target"), _C("p")
    return decoded.groupBy("row_uid", *by).agg(total(t * p, "tp"), total((1 - t) * p, "fp"), total(t * (1 - p), "fn"), total(t, "gold"), total(p, "predicted"))


def pooled(decoded: DataFrame, *by: str) -> DataFrame:
    """Precision, recall and F1 of pooled counts in one aggregation, by groups."""
    total = lambda c: F.sum(c.cast("long"))
    t, p = _C("target"), _C("p")
    tp, fp, fn = total(t * p), total((1 - t) * p), total(t * (1 - p))
    return decoded.groupBy(*by).agg(ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))


def partitions(decoded: DataFrame, folds) -> DataFrame:
    """Rows once for each fold and partition (overall, and seen or heldout), after decoding: no join, one explode of literals."""
    table = F.array(*(F.struct(F.lit(f.fold_id).alias("fold_id"), strings(f.heldout).alias("held")) for f in folds))
    exploded = decoded.withColumn("f", F.explode(table))
    tags = F.array(F.lit("overall"), F.when(F.array_contains("f.held", _C("aspect")), "heldout").otherwise("seen"))
    return exploded.withColumn("partition", F.explode(tags)).withColumn("fold_id", _C("f.fold_id")).drop("f")


def average_precision(scored: DataFrame, score: str, target: str, *by: str) -> DataFrame:
    """Sum over distinct scores, descending, of recall gained times precision; the mean target if only one class occurs."""
    at = scored.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(target).cast("long")).alias("t"), F.count("*").alias("n"))
    step = running(at.withColumns({"ct": _C("t"), "cn": _C("n")}), "s", ["ct", "cn"], *by)
    return step.groupBy(*by).agg(F.sum("t").alias("positives"), F.sum("n").alias("rows"), F.sum(_C("t") * _C("ct") / _C("cn")).alias("x")).select(
        *by, "positives", "rows", F.when((_C("positives") == 0) | (_C("positives") == _C("rows")), _C("positives") / _C("rows")).otherwise(_C("x") / _C("positives")).alias("average_precision")
    )


def error_tags(rows: DataFrame) -> DataFrame:
    """(row_uid, tags, category): all error tags of a row, and the one of five exclusive categories."""
    ga, pa = pair_aspects(_C("gold")), pair_aspects(_C("pred"))
    fp, fn = F.array_except("pred", "gold"), F.array_except("gold", "pred")
    made = rows.withColumns({"ga": ga, "pa": pa, "n_fp": F.size(fp), "n_fn": F.size(fn)}).withColumns({"a_fn": F.size(F.array_except("ga", "pa")), "a_fp": F.size(F.array_except("pa", "ga"))})
    of = lambda labels, a: F.filter(labels, lambda x: split_first(x)[0] == a)
    wrong = F.size(F.filter(F.array_intersect("ga", "pa"), lambda a: F.size(F.array_intersect(of(_C("gold"), a), of(_C("pred"), a))) == 0))
    made = made.withColumn("wrong", wrong)
    exact = (_C("n_fp") == 0) & (_C("n_fn") == 0)
    tags = F.array_compact(F.array(
        F.when(exact, "exact"), F.when(F.size("pred") == 0, "missed_all"), F.when(_C("a_fn") > 0, "aspect_miss"), F.when(_C("a_fp") > 0, "aspect_overpredict"), F.when(_C("wrong") > 0, "sentiment_error"),
        F.when((_C("n_fp") > 0) & (_C("n_fn") > 0) & (_C("a_fp") == 0) & (_C("a_fn") == 0) & (_C("wrong") == 0), "pair_mismatch"),
    ))
    category = F.when(exact, "exact").when(F.size("pred") == 0, "missed_all").when(F.size("gold") == 0, "false_alarm").when((_C("a_fn") == 0) & (_C("a_fp") == 0), "sentiment_only").otherwise("aspect_error")
    return made.select("row_uid", tags.alias("tags"), category.alias("category"))


def loo_influence(folds: DataFrame, value: str, *by: str) -> DataFrame:
    """With the mean of the other folds and its change against the mean of all; null with one fold."""
    w = Window.partitionBy(*by)
    n, s = F.count("*").over(w), F.sum(value).over(w)
    return folds.withColumn("mean_without", F.when(n > 1, (s - F.col(value)) / (n - 1))).withColumn("influence", F.col("mean_without") - s / n)


def spread(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, median (linear interpolation), population and sample deviation, least, greatest and their distance."""
    v = F.col(value)
    return rows.groupBy(*by).agg(F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.stddev_pop(v).alias("sd_pop"), F.stddev_samp(v).alias("sd_samp"), F.min(v).alias("least"), F.max(v).alias("greatest"), (F.max(v) - F.min(v)).alias("spread"))


def tuned(observations: DataFrame, complexity: dict[str, float], folds: list[str], metrics: list[tuple[str, str]]) -> DataFrame:
    """(candidate_id, mean_<metric>..., rank): registered candidates by their metrics' means over folds; rank 1 is selected.

    metrics are (name, "desc" or "asc") in the order that decides; then the less complex candidate wins, then its name. A
    candidate or fold that isn't registered, is missing or comes twice, and a metric that isn't finite, are errors.
    """
    known = observations.sparkSession.createDataFrame(list(complexity.items()), "candidate_id string, complexity double")
    bad = F.lit(False)
    for n, _ in metrics:
        bad = bad | _C(n).isNull() | F.isnan(n) | (F.abs(_C(n)) == float("inf"))
    per = observations.groupBy("candidate_id").agg(*(F.avg(n).alias(f"mean_{n}") for n, _ in metrics), F.count("*").alias("__n"), F.count_distinct("fold_id").alias("__f"), F.sum((~F.col("fold_id").isin(*folds)).cast("int")).alias("__u"), F.max(bad.cast("int")).alias("__b"))
    both = known.join(per, "candidate_id", "full")
    wrong = F.coalesce((_C("__n") != len(folds)) | (_C("__f") != len(folds)) | (_C("__u") > 0) | (_C("__b") > 0), F.lit(True)) | _C("complexity").isNull()
    fail = F.raise_error(F.concat(F.lit("observations of "), "candidate_id", F.lit(" aren't what is registered"))).cast("string")
    made = both.withColumn("candidate_id", F.when(wrong, fail).otherwise(_C("candidate_id")))
    keys = [(F.desc if way == "desc" else F.asc)(F.round(f"mean_{n}", 12)) for n, way in metrics]
    rank = F.row_number().over(Window.orderBy(*keys, "complexity", "candidate_id"))  # a row for each candidate
    return made.withColumn("rank", rank).select("candidate_id", *(f"mean_{n}" for n, _ in metrics), "rank")
