"""Exact threshold sweeps as prefix sums, and the selection of thresholds.

Every pair that enters the prediction as a threshold falls is an event at its score; events are summed by distinct score,
thresholds are rows among them, and running sums over falling values give each threshold the sums of all events at or above
it. The running sums have two levels: over ranges of values, which are few, and within each range, so that no group's
distinct scores meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scores import f1, ratio
from larkspur.operators.prefix import following, running

_C = F.col


def candidates(scores: DataFrame, score: str, *by: str) -> DataFrame:
    """(threshold[, by]): 0.01 to 0.99, and the midpoints of neighbouring distinct scores, within [0, 1], to 12 places."""
    distinct = scores.select(*by, F.col(score).alias("s")).distinct()
    mid = following(distinct, "s", "next", *by).select(*by, ((_C("s") + _C("next")) / 2).alias("threshold")).where("threshold is not null")
    regular = F.transform(F.sequence(F.lit(1), F.lit(99)), lambda i: i / 100.0)
    grid = (distinct.select(*by).distinct() if by else scores.sparkSession.range(1).select()).select(*by, F.explode(regular).alias("threshold"))
    return mid.unionByName(grid).where("threshold between 0 and 1").select(*by, F.round("threshold", 12).alias("threshold")).distinct()


def events(ranked: DataFrame, score: str, gold: Column, order: list[Column], predicted: Column, correct: Column, *by: str) -> DataFrame:
    """ranked with what each event adds: n, tp, samples (to the sum of samples F1) and fp_row (a first prediction without gold).

    A review's events run in falling order of score, with `order` to make the order total; events with one score are summed
    together, so that ties among them don't matter.
    """
    w = Window.partitionBy(*by, "row_uid").orderBy(F.desc(score), *order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    made = ranked.withColumns({"n": predicted.cast("long"), "tp": correct.cast("long"), "g": gold.cast("long")})
    made = made.withColumns({"k": F.sum("n").over(upto), "c": F.sum("tp").over(upto)})
    before = ratio(2 * (_C("c") - _C("tp")), _C("g") + _C("k") - _C("n"))
    return made.withColumns({"samples": ratio(2 * _C("c"), _C("g") + _C("k")) - before, "fp_row": ((_C("g") == 0) & (_C("k") == _C("n")) & (_C("n") > 0)).cast("long")})


def sweep(found: DataFrame, thresholds: DataFrame, totals: DataFrame, score: str, *by: str) -> DataFrame:
    """(threshold, pair_micro_f1, pair_samples_f1, pair_micro_precision, fp_rows_per_100, predicted, tp[, by]) of each threshold.

    totals has a row for each group with gold (pairs) and rows (reviews).
    """
    at = found.groupBy(*by, F.col(score).alias("v")).agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"), F.sum("samples").alias("samples"), F.sum("fp_row").alias("fp_row"), F.count("*").alias("groups"))
    zero = F.lit(0).cast("long")
    marks = thresholds.select(*by, F.col("threshold").alias("v"), zero.alias("n"), zero.alias("tp"), F.lit(0.0).alias("samples"), zero.alias("fp_row"), zero.alias("groups"), F.lit(1).alias("kind"))
    sums = running(at.withColumn("kind", F.lit(0)).unionByName(marks), "v", ["n", "tp", "samples", "fp_row", "groups"], *by, then=("kind",)).where("kind = 1")
    joined = sums.join(totals, list(by)) if by else sums.crossJoin(F.broadcast(totals))  # totals is one row
    return joined.select(
        *by, F.col("v").alias("threshold"), f1(_C("tp"), _C("n") - _C("tp"), _C("gold") - _C("tp")).alias("pair_micro_f1"), F.round(_C("samples") / _C("rows"), 12).alias("pair_samples_f1"),
        ratio(_C("tp"), _C("n")).alias("pair_micro_precision"), (_C("fp_row") * 100 / _C("rows")).alias("fp_rows_per_100"), _C("n").alias("predicted"), "tp", "groups",
    )


def totals(grid: DataFrame, *by: str) -> DataFrame:
    """(gold, rows[, by]): gold pairs and reviews; two-level, so that reviews are counted without a distinct."""
    per = grid.groupBy(*by, "row_uid").agg(F.sum("target").alias("g"))
    return per.groupBy(*by).agg(F.sum("g").alias("gold"), F.count("*").alias("rows"))


def _gold(*by: str) -> Column:
    return F.sum("target").over(Window.partitionBy(*by, "row_uid"))


def pair_sweep(grid: DataFrame, *by: str, score: str = "score") -> DataFrame:
    """Every threshold of the independent decoder."""
    made = grid.withColumn("gold_row", _gold(*by))
    found = events(made, score, _C("gold_row"), [_C("aspect"), _C("ord")], F.lit(1), _C("target"), *by)
    return sweep(found, candidates(grid, score, *by), totals(grid, *by), score, *by)


def best_sentiments(grid: DataFrame, *by: str, rank: str = "sentiment_score") -> DataFrame:
    """The best sentiment of each review and aspect, with the review's gold pairs."""
    return _ranked(grid, rank, *by).withColumn("gold_row", _gold(*by)).where("rn = 1")


def _ranked(grid: DataFrame, rank: str, *by: str) -> DataFrame:
    """With rn, the sentiment's rank within its review and aspect, unless the grid comes with it."""
    if rank == "sentiment_score" and "rn" in grid.columns:
        return grid
    return grid.withColumn("rn", F.row_number().over(Window.partitionBy(*by, "row_uid", "aspect").orderBy(F.desc(rank), "ord")))


def hierarchical_sweep(grid: DataFrame, *by: str) -> DataFrame:
    best = best_sentiments(grid, *by, rank="score")
    return sweep(events(best, "score", _C("gold_row"), [_C("aspect")], F.lit(1), _C("target"), *by), candidates(best, "score", *by), totals(grid, *by), "score", *by)


def two_stage_sweep(grid: DataFrame, *by: str) -> DataFrame:
    best = best_sentiments(grid, *by)
    return sweep(events(best, "aspect_score", _C("gold_row"), [_C("aspect")], F.lit(1), _C("target"), *by), candidates(best, "aspect_score", *by), totals(grid, *by), "aspect_score", *by)


def group_sweep(decoded: DataFrame, *by: str) -> DataFrame:
    """Aspect thresholds for decoded sentiments p: an aspect enters with all its predictions at once."""
    groups = decoded.groupBy(*by, "row_uid", "aspect", "aspect_score").agg(F.sum("p").alias("np"), F.sum(_C("p") * _C("target")).alias("ntp"), F.sum("target").alias("ng"))
    groups = groups.withColumn("gold_row", F.sum("ng").over(Window.partitionBy(*by, "row_uid")))
    found = events(groups, "aspect_score", _C("gold_row"), [_C("aspect")], _C("np"), _C("ntp"), *by)
    made = sweep(found, candidates(groups, "aspect_score", *by), totals(decoded, *by), "aspect_score", *by)
    return made.withColumn("sentiments_per_aspect", ratio(_C("predicted"), _C("groups")))


def runner_up_sweep(grid: DataFrame, gate: float | Column, *by: str) -> DataFrame:
    """Thresholds for the second sentiment of gated aspects, whose first one is always predicted."""
    open_ = _ranked(grid, "sentiment_score", *by).withColumn("gold_row", _gold(*by)).where(_C("aspect_score") >= gate)
    first = F.sum((_C("rn") == 1).cast("long")).over(Window.partitionBy(*by, "row_uid"))
    first_tp = F.sum(((_C("rn") == 1) & (_C("target") == 1)).cast("long")).over(Window.partitionBy(*by, "row_uid"))
    held = open_.withColumns({"n1": first, "t1": first_tp}).where("rn <= 2")
    w = Window.partitionBy(*by, "row_uid").orderBy(F.desc("sentiment_score"), "aspect").rowsBetween(Window.unboundedPreceding, 0)
    second = held.where("rn = 2").withColumns({"k": F.count("*").over(w), "c": F.sum("target").over(w)})
    now = ratio(2 * (_C("t1") + _C("c")), _C("gold_row") + _C("n1") + _C("k"))
    was = ratio(2 * (_C("t1") + _C("c") - _C("target")), _C("gold_row") + _C("n1") + _C("k") - 1)
    found = second.withColumns({"n": F.lit(1).cast("long"), "tp": _C("target").cast("long"), "samples": now - was, "fp_row": F.lit(0).cast("long")})
    base = held.where("rn = 1").groupBy(*by, "row_uid", "gold_row").agg(F.count("*").alias("n"), F.sum("target").alias("t"))
    base = base.groupBy(*by).agg(F.sum("n").alias("n0"), F.sum("t").alias("t0"), F.sum(ratio(2 * _C("t"), _C("gold_row") + _C("n"))).alias("s0"))
    top = F.max("sentiment_score")
    above = second.groupBy(*by).agg(top.alias("m")).select(*by, (_C("m") + 1e-9).alias("threshold"))  # nothing reaches it
    made = sweep(found, candidates(second, "sentiment_score", *by).unionByName(above), totals(grid, *by), "sentiment_score", *by).drop("pair_micro_f1", "pair_micro_precision", "fp_rows_per_100", "groups")
    full = totals(grid, *by)
    joined = made.join(base, list(by)).join(full, list(by)) if by else made.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(full))  # one row each
    tp, n = _C("tp") + _C("t0"), _C("predicted") + _C("n0")
    return joined.select(*by, "threshold", f1(tp, n - tp, _C("gold") - tp).alias("pair_micro_f1"), F.round(_C("pair_samples_f1") + _C("s0") / _C("rows"), 12).alias("pair_samples_f1"), ratio(tp, n).alias("pair_micro_precision"), ratio(_C("predicted"), _C("n0")).alias("second_rate"))


ORDER = ["pair_micro_f1 desc", "pair_samples_f1 desc", "pair_micro_precision desc", "fp_rows_per_100 asc", "threshold desc"]


def select(swept: DataFrame, *by: str, order: list[str] = ORDER) -> DataFrame:
    """The best threshold of each group in the registered order; the highest wins ties."""
    keys = [F.desc(c) if way == "desc" else F.asc(c) for c, way in (x.split() for x in order)]
    if not by:
        return swept.orderBy(*keys).limit(1)
    return swept.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).where("__n = 1").drop("__n")


def f1_boundary(scored: DataFrame, score: str, target: str, *by: str) -> DataFrame:
    """(threshold, f1[, by]): the distinct score that maximises the F1 of what reaches it; the highest among ties."""
    at = scored.groupBy(*by, F.col(score).alias("threshold")).agg(F.sum(F.col(target).cast("long")).alias("t"), F.count("*").alias("n"))
    g = at.groupBy(*by).agg(F.sum("t").alias("g"))
    sums = running(at.withColumnsRenamed({"t": "ct", "n": "cn"}), "threshold", ["ct", "cn"], *by)
    sums = sums.join(g, list(by)) if by else sums.crossJoin(F.broadcast(g))  # one row
    best = F.max(F.struct(ratio(2 * _C("ct"), _C("cn") + _C("g")).alias("f1"), "threshold")).alias("best")
    return sums.groupBy(*by).agg(best).where("best is not null").select(*by, "best.threshold", "best.f1")


def grid_sweep(scored: DataFrame, score: Column, thresholds: list[float], *by: str) -> DataFrame:
    """Pooled counts for each of a short list of thresholds, as conditional sums of one aggregation, then a row for each."""
    total = lambda c: F.sum(c.cast("long"))
    sums = [F.struct(F.lit(t).alias("threshold"), total((score >= t) & (F.col("target") == 1)).alias("tp"), total(score >= t).alias("n"), total(F.col("target") == 1).alias("g")) for t in thresholds]
    made = scored.groupBy(*by).agg(F.array(*sums).alias("a")).select(*by, F.explode("a").alias("x")).select(*by, "x.*")
    return made.withColumns({"precision": ratio(_C("tp"), _C("n")), "recall": ratio(_C("tp"), _C("g")), "f1": ratio(2 * _C("tp"), _C("n") + _C("g"))})


def shared_threshold(chosen: DataFrame, name: str, tolerance: float = 1e-12) -> DataFrame:
    """(threshold, conditions, spread) of a row for each condition; thresholds that differ, or are missing, are an error."""
    made = chosen.agg(F.max(name).alias("threshold"), (F.max(name) - F.min(name)).alias("spread"), F.count("*").alias("conditions"), F.count(name).alias("__k"))
    bad = F.coalesce((_C("spread") > tolerance) | (_C("__k") < _C("conditions")), F.lit(True))
    return made.withColumn("threshold", F.when(bad, F.raise_error(F.lit("conditions don't share a threshold")).cast("double")).otherwise(_C("threshold"))).drop("__k")
