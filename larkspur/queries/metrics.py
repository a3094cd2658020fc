"""Metrics of predictions (AG, W2)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scores import f1, harmonic, ratio
from larkspur.operators import decode as D
from larkspur.operators import metrics as M
from larkspur.plans.adapter import grid, table, with_views
from larkspur.plans.taxonomy import ASPECTS, SENTIMENTS, SEPARATOR, folds
from larkspur.queries.registry import GATE, SECOND, SETS, query

CLASSES = [f"{a}{SEPARATOR}{s}" for a in ASPECTS for s in SENTIMENTS]


def decoded(spark, sf_dir: str, salt: str = "a") -> DataFrame:
    return D.capped_two(grid(spark, sf_dir, salt), GATE, SECOND)


def predictions(spark, sf_dir: str, salt: str = "a") -> DataFrame:
    return D.sets(decoded(spark, sf_dir, salt))


def _with(*salts: str) -> str:
    return with_views(*(f"pred_{s}" for s in salts)) + ", " + ", ".join(f"sets_{s} AS MATERIALIZED ({SETS.format(f'pred_{s}')}), n_{s} AS (SELECT *, len(list_intersect(gold, pred)) AS tp, len(gold) AS ng, len(pred) AS np FROM sets_{s})" for s in salts)


_A = _with("a")
_AB = _with("a", "b")
_R = "coalesce({} / nullif({}, 0), 0)"
_PRF = "round(coalesce({tp}::DOUBLE / nullif({n}, 0), 0), 9) AS precision, round(coalesce({tp}::DOUBLE / nullif({g}, 0), 0), 9) AS recall, round(coalesce(2.0 * {tp} / nullif({n} + {g}, 0), 0), 9) AS f1"
_SUM = _PRF.format(tp="sum(target * p)", n="sum(p)", g="sum(target)")
_FOLDS = """, fold AS (SELECT 'L1-' || printf('%02d', a_ord + 1) AS fold_id, aspect AS held FROM aspect_dim)"""


@query(with_views("pred_a") + _FOLDS + f""", x AS (SELECT fold_id, unnest(['overall', CASE WHEN aspect = held THEN 'heldout' ELSE 'seen' END]) AS partition, target, p FROM pred_a, fold)
SELECT fold_id, partition, {_SUM}, sum(target * p)::BIGINT AS tp, sum((1 - target) * p)::BIGINT AS fp, sum(target * (1 - p))::BIGINT AS fn FROM x GROUP BY fold_id, partition""")
def capped_two_fold_metrics(spark, sf_dir):
    """The flagship (DK6, JN1, JN7, W1, FL7, AG13, AG29): pooled metrics by fold and partition, folds as rows."""
    by_aspect = M.confusion(decoded(spark, sf_dir).withColumn("row_uid", F.lit(0)), "aspect").drop("row_uid")  # additive: six rows before the folds
    cells = M.partitions(by_aspect, [f for f in folds() if f.level == "L1"]).groupBy("fold_id", "partition").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cells.select("fold_id", "partition", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1"), "tp", "fp", "fn")


_MULTI = """round(coalesce(2.0 * sum(tp) / nullif(sum(ng + np), 0), 0), 9) AS micro_f1, round(coalesce(sum(tp)::DOUBLE / nullif(sum(np), 0), 0), 9) AS micro_precision, round(coalesce(sum(tp)::DOUBLE / nullif(sum(ng), 0), 0), 9) AS micro_recall,
  round(avg(CASE WHEN ng + np = 0 THEN 0 ELSE 2.0 * tp / (ng + np) END), 9) AS samples_f1, sum(tp)::BIGINT AS label_tp, sum(np - tp)::BIGINT AS label_fp, sum(ng - tp)::BIGINT AS label_fn, sum(np)::BIGINT AS predicted_label_count, sum(ng)::BIGINT AS gold_label_count,
  sum((ng = 0)::INT)::BIGINT AS empty_gold_rows, sum((np = 0)::INT)::BIGINT AS empty_prediction_rows, sum((ng = 0 AND np = 0)::INT)::BIGINT AS empty_gold_and_prediction_rows, sum((ng = 0 AND np > 0)::INT)::BIGINT AS false_positive_rows,
  sum((ng > 0 AND np = 0)::INT)::BIGINT AS false_negative_rows, round(sum((ng = 0 AND np > 0)::INT) * 100.0::DOUBLE / count(*), 9) AS false_positive_rows_per_100, round(sum(np - tp) * 100.0::DOUBLE / count(*), 9) AS false_positive_labels_per_100,
  round(sum((ng > 0 AND np = 0)::INT) * 100.0::DOUBLE / count(*), 9) AS false_negative_rows_per_100, round(avg((tp = ng AND tp = np)::INT), 9) AS exact_match_rate"""
_CLASS = "SELECT aspect, sentiment, sum(target * p) AS tp, sum((1 - target) * p) AS fp, sum(target * (1 - p)) AS fn FROM pred_a GROUP BY ALL"


@query(_A + f", c AS ({_CLASS}) SELECT {_MULTI}, (SELECT round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END), 9) FROM c) AS macro_f1 FROM n_a")
def multilabel_scores(spark, sf_dir):
    """AG1: all nineteen outputs; macro F1 over the whole class list."""
    return M.multilabel(predictions(spark, sf_dir), CLASSES)


@query(_A + """, x AS (SELECT row_uid, list_distinct(list_transform(gold, lambda v: split_part(v, ' | ', 1))) AS g, list_distinct(list_transform(pred, lambda v: split_part(v, ' | ', 1))) AS q FROM sets_a),
m AS (SELECT len(list_intersect(g, q)) AS tp, len(g) AS ng, len(q) AS np FROM x) SELECT """ + _MULTI + """, (SELECT round(avg(CASE WHEN t + n = 0 THEN 0 ELSE 2.0 * k / (t + n) END), 9) FROM (
  SELECT aspect, sum(t) AS t, sum(n) AS n, sum(t * n) AS k FROM (SELECT row_uid, aspect, max(target) AS t, max(p) AS n FROM pred_a GROUP BY ALL) GROUP BY aspect)) AS macro_f1 FROM m""")
def aspect_scores(spark, sf_dir):
    """AG3: the same by aspect."""
    return M.multilabel(M.by_aspect_sets(predictions(spark, sf_dir)), ASPECTS)


@query(_A + """, b AS (SELECT sum((ng > 0 AND np > 0)::INT) AS tp, sum((ng = 0 AND np > 0)::INT) AS fp, sum((ng > 0 AND np = 0)::INT) AS fn, sum((ng = 0 AND np = 0)::INT) AS tn, count(*) AS n FROM n_a)
SELECT round(tp::DOUBLE / (tp + fp), 9) AS presence_precision, round(tp::DOUBLE / (tp + fn), 9) AS presence_recall, round(2.0 * tp / (2 * tp + fp + fn), 9) AS presence_f1, tp::BIGINT AS presence_tp_rows, fp::BIGINT AS presence_fp_rows, fn::BIGINT AS presence_fn_rows,
  tn::BIGINT AS presence_tn_rows, round((tp + fn)::DOUBLE / n, 9) AS presence_prevalence, round(fp * 100.0::DOUBLE / n, 9) AS presence_false_positive_rows_per_100, round(fn * 100.0::DOUBLE / n, 9) AS presence_false_negative_rows_per_100 FROM b""")
def presence_scores(spark, sf_dir):
    """AG2, AG31."""
    return M.presence(predictions(spark, sf_dir))


@query(with_views("pred_a") + """, x AS (SELECT target, p, max(p) OVER (PARTITION BY row_uid, aspect) AS hp FROM pred_a WHERE TRUE), y AS (SELECT sum((target = 1 AND hp = 1)::INT) AS n, sum((target = 1 AND p = 1)::INT) AS k FROM x)
SELECT round(coalesce(k::DOUBLE / nullif(n, 0), 0), 9) AS sentiment_accuracy_when_gold_aspect_predicted, k::BIGINT AS sentiment_correct_when_gold_aspect_predicted, n::BIGINT AS sentiment_evaluated_gold_aspects FROM y""")
def pair_and_aspect(spark, sf_dir):
    """AG3: sentiments of gold aspects that are predicted."""
    return M.sentiment_when_aspect(predictions(spark, sf_dir))


@query(_A + f""", c AS ({_CLASS}), k AS (SELECT aspect || ' | ' || sentiment AS label, tp, fp, fn, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp + fn AS support FROM c),
u AS (SELECT label, precision, recall, f1, support FROM k UNION ALL SELECT 'micro avg', sum(tp)::DOUBLE / sum(tp + fp), sum(tp)::DOUBLE / sum(tp + fn), 2.0 * sum(tp) / sum(2 * tp + fp + fn), sum(support) FROM k
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM k UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM k
  UNION ALL SELECT 'samples avg', avg(coalesce(tp::DOUBLE / nullif(np, 0), 0)), avg(coalesce(tp::DOUBLE / nullif(ng, 0), 0)), avg(coalesce(2.0 * tp / nullif(ng + np, 0), 0)), sum(ng) FROM n_a)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support::BIGINT AS support FROM u""")
def per_class_report(spark, sf_dir):
    """AG4."""
    return M.report(predictions(spark, sf_dir), CLASSES)


_REL = "round(pr, 9) AS precision, round(rc, 9) AS recall, (tp + fn)::BIGINT AS support, (tp + fp)::BIGINT AS predicted, round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 9) AS f1, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn"


@query(with_views("pred_a") + f""", a AS (SELECT row_uid, 'aspect' AS axis, aspect AS label, max(target) AS t, max(p) AS q FROM pred_a GROUP BY ALL UNION ALL SELECT row_uid, 'sentiment', sentiment, max(target), max(p) FROM pred_a GROUP BY ALL
  UNION ALL SELECT row_uid, 'pair', aspect || ' | ' || sentiment, target, p FROM pred_a), c AS (SELECT axis, label, sum(t * q) AS tp, sum((1 - t) * q) AS fp, sum(t * (1 - q)) AS fn FROM a GROUP BY ALL),
r AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 1) AS pr, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS rc FROM c) SELECT axis, label, {_REL} FROM r""")
def label_reliability(spark, sf_dir):
    """AG5: by pair, aspect and sentiment; precision is 1 where nothing was predicted."""
    rows = predictions(spark, sf_dir)
    made = [M.reliability(M.axis(rows, k), c).withColumn("axis", F.lit(k)) for k, c in (("pair", CLASSES), ("aspect", ASPECTS), ("sentiment", SENTIMENTS))]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query(with_views("pred_a") + """, c AS (SELECT aspect || ' | ' || sentiment AS label, sum(target * p) AS tp, sum((1 - target) * p) AS fp, sum(target * (1 - p)) AS fn FROM pred_a GROUP BY ALL)
SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1, (tp + fn)::BIGINT AS support FROM c WHERE tp + fp + fn > 0""")
def label_errors(spark, sf_dir):
    """AG6."""
    return M.label_errors(predictions(spark, sf_dir))


@query(with_views("pred_a") + "SELECT row_uid, sum(target * p)::BIGINT AS tp, sum((1 - target) * p)::BIGINT AS fp, sum(target * (1 - p))::BIGINT AS fn, sum(target)::BIGINT AS gold, sum(p)::BIGINT AS predicted FROM pred_a GROUP BY row_uid")
def review_confusion(spark, sf_dir):
    """AG11."""
    return M.confusion(decoded(spark, sf_dir))


@query(_A + """SELECT row_uid AS cluster, tp::BIGINT AS tp, (np - tp)::BIGINT AS fp, (ng - tp)::BIGINT AS fn, 1::BIGINT AS rows, round(CASE WHEN ng + np = 0 THEN 0 ELSE 2.0 * tp / (ng + np) END, 9) AS sample_f1, (tp = ng AND tp = np)::BIGINT AS exact,
  (ng = 0 AND np > 0)::BIGINT AS false_positive_rows, (ng > 0 AND np = 0)::BIGINT AS false_negative_rows, (ng > 0 AND np > 0)::BIGINT AS presence_tp, (ng = 0 AND np > 0)::BIGINT AS presence_fp, (ng > 0 AND np = 0)::BIGINT AS presence_fn FROM n_a""")
def cluster_stats(spark, sf_dir):
    """AG12."""
    from larkspur.operators.stats import cluster_statistics

    return cluster_statistics(M.counts(predictions(spark, sf_dir)))


@query(with_views("pred_a") + f"SELECT split, count(DISTINCT row_uid) AS reviews, {_SUM}, round(sum(p)::DOUBLE / count(DISTINCT row_uid), 9) AS mean_set_size FROM pred_a GROUP BY split")
def metric_record(spark, sf_dir):
    """AG13: by split, two levels."""
    per = M.confusion(decoded(spark, sf_dir), "split")
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return per.groupBy("split").agg(F.count("*").alias("reviews"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1"), (F.sum("predicted") / F.count("*")).alias("mean_set_size"))


@query(with_views("pred_a") + f"SELECT aspect, {_SUM}, sum(target * p)::BIGINT AS tp, sum((1 - target) * p)::BIGINT AS fp, sum(target * (1 - p))::BIGINT AS fn FROM pred_a GROUP BY aspect")
def per_aspect(spark, sf_dir):
    """AG14."""
    return M.pooled(decoded(spark, sf_dir), "aspect")


@query(with_views("pred_a") + f"SELECT sentiment, {_SUM}, sum(target * p)::BIGINT AS tp, sum((1 - target) * p)::BIGINT AS fp, sum(target * (1 - p))::BIGINT AS fn FROM pred_a GROUP BY sentiment")
def per_sentiment(spark, sf_dir):
    """AG14."""
    return M.pooled(decoded(spark, sf_dir), "sentiment")


_SEEN = with_views("pred_a") + _FOLDS + """, x AS (SELECT fold_id, aspect = held AS h, sum(target * p) AS tp, sum(p) AS n, sum(target) AS g FROM pred_a, fold GROUP BY ALL), s AS (SELECT fold_id, max(CASE WHEN NOT h THEN 2.0 * tp / (n + g) END) AS seen, max(CASE WHEN h THEN 2.0 * tp / (n + g) END) AS heldout FROM x GROUP BY fold_id)"""


def _seen_heldout(spark, sf_dir, salt: str = "a") -> DataFrame:
    by_aspect = M.confusion(decoded(spark, sf_dir, salt).withColumn("row_uid", F.lit(0)), "aspect").drop("row_uid")
    cells = M.partitions(by_aspect, [f for f in folds() if f.level == "L1"]).where("partition <> 'overall'").groupBy("fold_id", "partition").agg(f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("f1"))
    return cells.groupBy("fold_id").pivot("partition", ["seen", "heldout"]).agg(F.max("f1"))


@query(_SEEN + "SELECT fold_id, round(seen, 9) AS seen, round(heldout, 9) AS heldout, round(2 * seen * heldout / (seen + heldout), 9) AS harmonic FROM s")
def seen_unseen_harmonic(spark, sf_dir):
    """AG15, FL7."""
    return _seen_heldout(spark, sf_dir).withColumn("harmonic", harmonic(F.col("seen"), F.col("heldout")))


@query(_SEEN + """, t AS (SELECT *, avg(heldout) OVER () AS m, sum(heldout) OVER () AS s, count(*) OVER () AS n FROM s) SELECT fold_id, round(heldout, 9) AS heldout, round((s - heldout) / (n - 1), 9) AS mean_without, round((s - heldout) / (n - 1) - m, 9) AS influence FROM t""")
def loo_influence(spark, sf_dir):
    """AG30."""
    return M.loo_influence(_seen_heldout(spark, sf_dir).select("fold_id", "heldout"), "heldout")


@query(_SEEN + """SELECT round(avg(heldout), 9) AS mean, round(quantile_cont(heldout, 0.5), 9) AS median, round(stddev_pop(heldout), 9) AS sd_pop, round(stddev_samp(heldout), 9) AS sd_samp, round(min(heldout), 9) AS least, round(max(heldout), 9) AS greatest, round(max(heldout) - min(heldout), 9) AS spread FROM s""")
def fold_stats(spark, sf_dir):
    """AG18, AG19."""
    return M.spread(_seen_heldout(spark, sf_dir), "heldout")


_CONTRAST = with_views("pred_a", "pred_b") + """, x AS (SELECT aspect, 'a' AS c, sum(target * p) AS tp, sum(p) AS n, sum(target) AS g FROM pred_a GROUP BY aspect UNION ALL SELECT aspect, 'b', sum(target * p), sum(p), sum(target) FROM pred_b GROUP BY aspect),
f AS (SELECT aspect, max(CASE WHEN c = 'a' THEN 2.0 * tp / (n + g) END) AS native, max(CASE WHEN c = 'b' THEN 2.0 * tp / (n + g) END) AS described FROM x GROUP BY aspect)"""


def _two(spark, sf_dir, by: str = "aspect") -> DataFrame:
    both = [M.pooled(decoded(spark, sf_dir, s), by).select(by, "f1", F.lit(n).alias("c")) for s, n in (("a", "native"), ("b", "described"))]
    return both[0].unionByName(both[1]).groupBy(by).pivot("c", ["native", "described"]).agg(F.max("f1"))


@query(_CONTRAST + "SELECT aspect, round(native, 9) AS native, round(described, 9) AS described, round(described - native, 9) AS delta, CASE WHEN abs(described - native) <= 1e-12 THEN 'tied' WHEN described > native THEN 'improved' ELSE 'worsened' END AS outcome FROM f")
def condition_contrast(spark, sf_dir):
    """AG20, AG35, AG37, AG41: conditions side by side, with deltas and outcomes."""
    d = F.col("described") - F.col("native")
    return _two(spark, sf_dir).withColumns({"delta": d, "outcome": F.when(F.abs(d) <= 1e-12, "tied").when(d > 0, "improved").otherwise("worsened")})


@query(_CONTRAST + """SELECT count(*) AS units, round(avg(described - native) * 100, 9) AS points, round(avg(described - native) / nullif(avg(native), 0), 9) AS relative_change, sum((described - native > 1e-12)::INT)::BIGINT AS wins, sum((abs(described - native) <= 1e-12)::INT)::BIGINT AS ties, sum((described - native < -1e-12)::INT)::BIGINT AS losses FROM f""")
def reference_comparison(spark, sf_dir):
    """AG36, AG46: percentage points, relative change (null on 0), wins, ties, losses."""
    d, on = F.col("described") - F.col("native"), lambda c: F.sum(c.cast("long"))
    return _two(spark, sf_dir).agg(F.count("*").alias("units"), (F.avg(d) * 100).alias("points"), (F.avg(d) / F.nullif(F.avg("native"), F.lit(0.0))).alias("relative_change"), on(d > 1e-12).alias("wins"), on(F.abs(d) <= 1e-12).alias("ties"), on(d < -1e-12).alias("losses"))


@query(_CONTRAST + ", r AS (SELECT aspect, described - native AS gain FROM f) SELECT aspect, round(gain, 9) AS gain, gain > 0 AS promoted, row_number() OVER (ORDER BY round(gain, 12) DESC, aspect)::INT AS rank FROM r")
def promotion_table(spark, sf_dir):
    """AG48 without its interval: gains with a rank; see `promotion_by_interval`."""
    made = _two(spark, sf_dir).select("aspect", (F.col("described") - F.col("native")).alias("gain"))
    return made.withColumns({"promoted": F.col("gain") > 0, "rank": F.row_number().over(Window.orderBy(F.desc(F.round("gain", 12)), "aspect"))})  # one row for each aspect


@query(with_views("ranked_a") + """, x AS (SELECT *, sum(target) OVER (PARTITION BY row_uid, aspect) AS g FROM ranked_a), t AS (SELECT * FROM x WHERE rn = 1 AND g > 0)
SELECT round(avg(target), 9) AS accuracy_all, round(avg(CASE WHEN g = 1 THEN target END), 9) AS accuracy_single, count(*) AS gold_instances, sum((g = 1)::INT)::BIGINT AS single_instances, sum((g > 1)::INT)::BIGINT AS multi_instances FROM t""")
def conditional_sentiment(spark, sf_dir):
    """AG16: the best sentiment of gold aspects."""
    g = F.sum("target").over(Window.partitionBy("row_uid", "aspect"))
    t = D.ranked(grid(spark, sf_dir)).withColumn("g", g).where("rn = 1 and g > 0")
    return t.agg(F.avg("target").alias("accuracy_all"), F.avg(F.when(F.col("g") == 1, F.col("target"))).alias("accuracy_single"), F.count("*").alias("gold_instances"), F.sum((F.col("g") == 1).cast("long")).alias("single_instances"), F.sum((F.col("g") > 1).cast("long")).alias("multi_instances"))


@query(with_views("ranked_a") + """, x AS (SELECT *, sum(target) OVER (PARTITION BY row_uid, aspect) AS g FROM ranked_a) SELECT round(avg(target), 9) AS accuracy, count(*) AS n FROM x WHERE rn = 1 AND g > 0 AND aspect_score >= 0.5""")
def pipeline_sentiment(spark, sf_dir):
    """AG40: selected and gold aspects."""
    g = F.sum("target").over(Window.partitionBy("row_uid", "aspect"))
    return D.ranked(grid(spark, sf_dir)).withColumn("g", g).where("rn = 1 and g > 0").where(F.col("aspect_score") >= GATE).agg(F.avg("target").alias("accuracy"), F.count("*").alias("n"))


@query(with_views("grid_a") + """, x AS (SELECT *, sum(target) OVER (PARTITION BY row_uid, aspect) AS g FROM grid_a) SELECT row_uid, aspect, sentiment, target FROM x WHERE g <= 1""")
def single_gold_frame(spark, sf_dir):
    """AG44."""
    return grid(spark, sf_dir).withColumn("g", F.sum("target").over(Window.partitionBy("row_uid", "aspect"))).where("g <= 1").select("row_uid", "aspect", "sentiment", "target")


@query(with_views("grid_a") + """, s AS (SELECT aspect, score, sum(target) AS t, count(*) AS n FROM grid_a GROUP BY ALL), c AS (SELECT *, sum(t) OVER (PARTITION BY aspect ORDER BY score DESC) AS ct, sum(n) OVER (PARTITION BY aspect ORDER BY score DESC) AS cn FROM s)
SELECT aspect, sum(t)::BIGINT AS positives, sum(n)::BIGINT AS rows, round(sum(t * ct::DOUBLE / cn) / sum(t), 9) AS average_precision FROM c GROUP BY aspect""")
def average_precision(spark, sf_dir):
    """AG17, AG34, AG38: stepwise, ties together."""
    return M.average_precision(grid(spark, sf_dir), "score", "target", "aspect")


@query("""WITH x AS (SELECT l.quality AS target, d.n_chars AS score FROM labels l JOIN documents d USING (doc_id)), s AS (SELECT score, sum(target) AS t, count(*) AS n FROM x GROUP BY score),
c AS (SELECT *, sum(t) OVER (ORDER BY score DESC) AS ct, sum(n) OVER (ORDER BY score DESC) AS cn FROM s) SELECT sum(t)::BIGINT AS positives, sum(n)::BIGINT AS rows, round(sum(t * ct::DOUBLE / cn) / sum(t), 9) AS average_precision FROM c""")
def average_precision_labels(spark, sf_dir):
    """AG17 on labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return M.average_precision(table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id"), "n_chars", "quality")


_ERR = """, t AS (SELECT row_uid, gold, pred, list_distinct(list_transform(gold, lambda v: split_part(v, ' | ', 1))) AS ga, list_distinct(list_transform(pred, lambda v: split_part(v, ' | ', 1))) AS pa, len(list_intersect(gold, pred)) AS k FROM sets_a),
e AS (SELECT *, len(pred) - k AS nfp, len(gold) - k AS nfn, len(ga) - len(list_intersect(ga, pa)) AS afn, len(pa) - len(list_intersect(ga, pa)) AS afp,
  len(list_filter(list_intersect(ga, pa), lambda a: len(list_filter(list_intersect(gold, pred), lambda v: split_part(v, ' | ', 1) = a)) = 0)) AS wrong FROM t),
g AS (SELECT row_uid, list_filter([CASE WHEN nfp = 0 AND nfn = 0 THEN 'exact' END, CASE WHEN len(pred) = 0 THEN 'missed_all' END, CASE WHEN afn > 0 THEN 'aspect_miss' END, CASE WHEN afp > 0 THEN 'aspect_overpredict' END,
  CASE WHEN wrong > 0 THEN 'sentiment_error' END, CASE WHEN nfp > 0 AND nfn > 0 AND afn = 0 AND afp = 0 AND wrong = 0 THEN 'pair_mismatch' END], lambda x: x IS NOT NULL) AS tags,
  CASE WHEN nfp = 0 AND nfn = 0 THEN 'exact' WHEN len(pred) = 0 THEN 'missed_all' WHEN len(gold) = 0 THEN 'false_alarm' WHEN afn = 0 AND afp = 0 THEN 'sentiment_only' ELSE 'aspect_error' END AS category FROM e)"""


@query(_A + _ERR + "SELECT tag, count(*) AS rows FROM (SELECT unnest(tags) AS tag FROM g) GROUP BY tag")
def error_tags(spark, sf_dir):
    """AG24."""
    return M.error_tags(predictions(spark, sf_dir)).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("rows"))


@query(_A + _ERR + "SELECT category, count(*) AS rows, round(count(*)::DOUBLE / (SELECT count(*) FROM g), 9) AS share FROM g GROUP BY category")
def row_category(spark, sf_dir):
    """AG25."""
    per = M.error_tags(predictions(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("rows"))
    return per.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy()))  # five rows


@query(_AB + """SELECT count(*) AS rows, sum((fa > fb)::INT)::BIGINT AS a_wins, sum((fb > fa)::INT)::BIGINT AS b_wins, sum((fa = fb)::INT)::BIGINT AS ties, sum((ea AND eb)::INT)::BIGINT AS both_exact, sum((ea AND NOT eb)::INT)::BIGINT AS only_a_exact, sum((eb AND NOT ea)::INT)::BIGINT AS only_b_exact, round(avg(fa - fb), 9) AS mean_delta
FROM (SELECT CASE WHEN a.ng + a.np = 0 THEN 0 ELSE 2.0 * a.tp / (a.ng + a.np) END AS fa, CASE WHEN b.ng + b.np = 0 THEN 0 ELSE 2.0 * b.tp / (b.ng + b.np) END AS fb, a.tp = a.ng AND a.tp = a.np AS ea, b.tp = b.ng AND b.tp = b.np AS eb FROM n_a a JOIN n_b b USING (row_uid))""")
def model_wins(spark, sf_dir):
    """AG26, AG42: two systems row by row."""
    one = lambda s: M.counts(predictions(spark, sf_dir, s)).select("row_uid", ratio(2 * F.col("tp"), F.col("n_gold") + F.col("n_pred")).alias(f"f{s}"), ((F.col("fp") == 0) & (F.col("fn") == 0)).alias(f"e{s}"))
    both, on = one("a").join(one("b"), "row_uid"), lambda c: F.sum(c.cast("long"))
    fa, fb, ea, eb = F.col("fa"), F.col("fb"), F.col("ea"), F.col("eb")
    return both.agg(F.count("*").alias("rows"), on(fa > fb).alias("a_wins"), on(fb > fa).alias("b_wins"), on(fa == fb).alias("ties"), on(ea & eb).alias("both_exact"), on(ea & ~eb).alias("only_a_exact"), on(eb & ~ea).alias("only_b_exact"), F.avg(fa - fb).alias("mean_delta"))


@query(_AB + """, x AS (SELECT row_uid, 'a' AS system, CASE WHEN ng + np = 0 THEN 0 ELSE 2.0 * tp / (ng + np) END AS f FROM n_a UNION ALL SELECT row_uid, 'b', CASE WHEN ng + np = 0 THEN 0 ELSE 2.0 * tp / (ng + np) END FROM n_b),
s AS (SELECT row_uid, max(f) - min(f) AS span FROM x GROUP BY row_uid) SELECT CASE WHEN span = 0 THEN 'agree' WHEN span < 0.5 THEN 'near' ELSE 'far' END AS tag, count(*) AS rows, round(avg(span), 9) AS mean_span FROM s GROUP BY 1""")
def disagreement(spark, sf_dir):
    """AG27: spans between systems."""
    one = lambda s: M.counts(predictions(spark, sf_dir, s)).select("row_uid", ratio(2 * F.col("tp"), F.col("n_gold") + F.col("n_pred")).alias("f"))
    span = one("a").unionByName(one("b")).groupBy("row_uid").agg((F.max("f") - F.min("f")).alias("span"))
    return span.groupBy(F.when(F.col("span") == 0, "agree").when(F.col("span") < 0.5, "near").otherwise("far").alias("tag")).agg(F.count("*").alias("rows"), F.avg("span").alias("mean_span"))


@query(_A + "SELECT np AS predicted, count(*) AS rows, sum((ng = 0)::INT)::BIGINT AS empty_gold, round(avg(ng), 9) AS mean_gold FROM n_a GROUP BY np")
def prediction_cardinality(spark, sf_dir):
    """AG23, AG39."""
    made = M.counts(predictions(spark, sf_dir))
    return made.groupBy(F.col("n_pred").alias("predicted")).agg(F.count("*").alias("rows"), F.sum((F.col("n_gold") == 0).cast("long")).alias("empty_gold"), F.avg("n_gold").alias("mean_gold"))


@query(with_views("pred_a") + """, g AS (SELECT row_uid, aspect, sum(p) AS np, sum(target) AS ng, sum(p * target) AS k FROM pred_a GROUP BY ALL)
SELECT round(sum(np)::DOUBLE / sum((np > 0)::INT), 9) AS sentiments_per_aspect, round(sum((np > 1)::INT)::DOUBLE / sum((np > 0)::INT), 9) AS multi_rate, round(sum(CASE WHEN ng > 1 THEN k END)::DOUBLE / sum(CASE WHEN ng > 1 THEN ng END), 9) AS multi_gold_recall FROM g""")
def decoder_diagnostics(spark, sf_dir):
    """AG43."""
    g = decoded(spark, sf_dir).groupBy("row_uid", "aspect").agg(F.sum("p").alias("np"), F.sum("target").alias("ng"), F.sum(F.col("p") * F.col("target")).alias("k"))
    on = lambda c: F.sum(c.cast("long"))
    multi = F.col("ng") > 1
    return g.agg(ratio(F.sum("np"), on(F.col("np") > 0)).alias("sentiments_per_aspect"), ratio(on(F.col("np") > 1), on(F.col("np") > 0)).alias("multi_rate"), ratio(F.sum(F.when(multi, F.col("k"))), F.sum(F.when(multi, F.col("ng")))).alias("multi_gold_recall"))


@query(with_views("pred_a", "pred_b") + f""", x AS (SELECT 'a' AS method, aspect, target, p FROM pred_a UNION ALL SELECT 'b', aspect, target, p FROM pred_b), y AS (SELECT method, aspect, {_PRF.format(tp='sum(target * p)', n='sum(p)', g='sum(target)')} , sum(target * p) AS tp, sum(p) AS n, sum(target) AS g FROM x GROUP BY ALL)
SELECT method, round(avg(2.0 * tp / (n + g)), 9) AS fold_mean_f1, {_PRF.format(tp='sum(tp)', n='sum(n)', g='sum(g)')} FROM y GROUP BY method""")
def l2_summary(spark, sf_dir):
    """AG33, AG45, AG47: fold means beside pooled values."""
    both = decoded(spark, sf_dir, "a").withColumn("method", F.lit("a")).unionByName(decoded(spark, sf_dir, "b").withColumn("method", F.lit("b")))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return M.pooled(both, "method", "aspect").groupBy("method").agg(F.avg("f1").alias("fold_mean_f1"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1"))


@query(with_views("pred_a", "pred_b") + """, x AS (SELECT row_uid, bool_and(CASE WHEN aspect IN ('Size: LARGE', 'Size: MEDIUM') AND target = 1 THEN p = 1 ELSE TRUE END) AS r, sum(CASE WHEN aspect IN ('Size: LARGE', 'Size: MEDIUM') THEN target ELSE 0 END) AS g, sum(CASE WHEN aspect IN ('Size: LARGE', 'Size: MEDIUM') THEN p ELSE 0 END) AS n FROM pred_a GROUP BY row_uid)
SELECT round(sum((g > 0 AND r)::INT)::DOUBLE / nullif(sum((g > 0)::INT), 0), 9) AS both_recall, round(sum((g = 0 AND n > 0)::INT)::DOUBLE / nullif(sum((g = 0)::INT), 0), 9) AS neither_fpr FROM x""")
def dual_aspect_diagnostics(spark, sf_dir):
    """AG21, JN10: two held-out aspects at once; undefined rates are null."""
    held = F.col("aspect").isin("Size: LARGE", "Size: MEDIUM")
    t, p = F.col("target"), F.col("p")
    x = decoded(spark, sf_dir).groupBy("row_uid").agg(F.min(F.when(held & (t == 1), p).otherwise(1)).alias("r"), F.sum(F.when(held, t).otherwise(0)).alias("g"), F.sum(F.when(held, p).otherwise(0)).alias("n"))
    on = lambda c: F.sum(c.cast("long"))
    g, n = F.col("g"), F.col("n")
    return x.agg((on((g > 0) & (F.col("r") == 1)) / F.nullif(on(g > 0), F.lit(0))).alias("both_recall"), (on((g == 0) & (n > 0)) / F.nullif(on(g == 0), F.lit(0))).alias("neither_fpr"))


@query(with_views("grid_a") + """, a AS (SELECT row_uid, aspect, aspect_score, max(target) AS t FROM grid_a GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY row_uid ORDER BY aspect_score DESC, aspect) AS rk FROM a)
SELECT round(avg(rk), 9) AS mean_rank, round(quantile_cont(rk::DOUBLE, 0.5), 9) AS median_rank, round(avg(1.0 / rk), 9) AS mrr, round(avg((rk = 1)::INT), 9) AS top_1, round(avg((rk <= 3)::INT), 9) AS top_3 FROM r WHERE t = 1""")
def aspect_rank_mrr(spark, sf_dir):
    """W2."""
    rk = F.row_number().over(Window.partitionBy("row_uid").orderBy(F.desc("aspect_score"), "aspect"))
    r = D.oracle_lines(grid(spark, sf_dir)).withColumn("rk", rk).where("target = 1")
    return r.agg(F.avg("rk").alias("mean_rank"), F.percentile("rk", F.lit(0.5)).alias("median_rank"), F.avg(1 / F.col("rk")).alias("mrr"), F.avg((F.col("rk") == 1).cast("int")).alias("top_1"), F.avg((F.col("rk") <= 3).cast("int")).alias("top_3"))


@query(with_views("grid_a") + """, t AS (SELECT unnest([0.5, 0.6, 0.7])::DOUBLE AS th), o AS (SELECT th, aspect, sum((score >= th AND target = 1)::INT) AS tp, sum((score >= th)::INT) AS n, sum(target) AS g FROM grid_a, t GROUP BY ALL),
m AS (SELECT 'threshold ' || th AS candidate_id, avg(coalesce(2.0::DOUBLE * tp / nullif(n + g, 0), 0)) AS f, avg(coalesce(tp::DOUBLE / nullif(n, 0), 0)) AS p FROM o GROUP BY th)
SELECT candidate_id, round(f, 9) AS mean_f1, round(p, 9) AS mean_precision, row_number() OVER (ORDER BY round(f, 12) DESC, round(p, 12) DESC, candidate_id)::INT AS rank FROM m""")
def tuning_selection(spark, sf_dir):
    """AG28: registered candidates (thresholds) over folds (aspects), ranked; the first is selected."""
    from larkspur.operators.sweep import grid_sweep

    swept = grid_sweep(grid(spark, sf_dir), F.col("score"), [0.5, 0.6, 0.7], "aspect")
    seen = swept.select(F.concat(F.lit("threshold "), F.col("threshold").cast("string")).alias("candidate_id"), F.col("aspect").alias("fold_id"), "f1", "precision")
    return M.tuned(seen, {f"threshold {t}": 0.0 for t in (0.5, 0.6, 0.7)}, list(ASPECTS), [("f1", "desc"), ("precision", "desc")])
