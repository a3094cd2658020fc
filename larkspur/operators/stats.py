"""Paired inference: cluster bootstraps, exact sign flips, step-down adjustment, contrasts.

Evidence is a table (cluster, v): for each cluster an array of additive statistics, of all systems, folds and partitions that
are to be resampled together. `resampled` gives the sums of such arrays for every draw; all metrics, contrasts and intervals
are expressions over these sums.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scores import f1, ratio

_C = F.col
#: Clusters that one task resamples; draws that it holds at a time; clusters that one stream of random numbers may have.
PART, BATCH, STREAM = 4096, 100, 1 << 20


def _shares(sizes: np.ndarray, part: int, draws: int, seed: int) -> np.ndarray:
    """How many clusters of each draw fall into a part: one multinomial draw over all parts, which every task makes alike.

    It is halved down to the part, each half's share by a binomial of its own stream, so a task looks at a few halves only.
    """
    ends = np.concatenate([[0], np.cumsum(sizes)])
    low, high, count = 0, len(sizes), np.full(draws, ends[-1], np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left, whole = ends[middle] - ends[low], ends[high] - ends[low]
        first = np.random.default_rng([seed, 1, low, high]).binomial(count, left / whole if whole else 0.0)
        count, low, high = (first, low, middle) if part < middle else (count - first, middle, high)
    return count


def _weights(n: int, counts: np.ndarray, rng: np.random.Generator):
    """Weights (draws x clusters) of draws of so many among n clusters, BATCH draws at a time."""
    for begin in range(0, len(counts), BATCH):
        part = counts[begin : begin + BATCH]
        drawn = rng.integers(0, n, part.sum()) + np.repeat(np.arange(len(part)) * n, part)
        yield np.bincount(drawn, minlength=len(part) * n).reshape(len(part), n)


def _stream(n: int, draws: int, seed: int, form: str, batch: int):
    """Weights from one stream, in the call form that is named: forms aren't interchangeable."""
    rng = np.random.default_rng(seed)
    for begin in range(0, draws, batch):
        size = min(batch, draws - begin)
        if form == "multinomial":
            yield rng.multinomial(n, np.full(n, 1 / n), size=size)
        else:
            yield np.stack([np.bincount(d, minlength=n) for d in rng.integers(0, n, size=(size, n))])


def _parts(evidence: DataFrame, part: int) -> tuple[np.ndarray, Column]:
    """(clusters of each part, the part of a cluster): runs of hash buckets with about `part` clusters each; one pass over the clusters' names."""
    buckets = 256
    while True:
        found = evidence.groupBy(F.pmod(F.xxhash64("cluster"), F.lit(buckets)).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()  # a number for each bucket
        counts = np.zeros(buckets, np.int64)
        for r in found:
            counts[r["b"]] = r["n"]
        if counts.max() <= 2 * part or buckets >= 1 << 20:
            break
        buckets = 1 << int(np.ceil(np.log2(2 * counts.sum() / part)))
    # a bucket goes to the part in which its middle falls, if all clusters stand in one line
    which = ((np.cumsum(counts) - counts / 2) // part).astype(int)
    known, which = np.unique(which, return_inverse=True)
    starts = [int(np.argmax(which == k)) for k in range(len(known))]  # parts are runs, so a part is how many of them begin up to a bucket
    b = F.pmod(F.xxhash64("cluster"), F.lit(buckets))
    if len(starts) <= 64:
        place = reduce(Column.__add__, [(b >= k).cast("int") for k in starts[1:]], F.lit(0))
    else:
        place = F.element_at(F.array(*(F.lit(int(k)) for k in which)), (b + 1).cast("int"))
    return np.bincount(which, counts, len(known)).astype(np.int64), place


def resampled(evidence: DataFrame, draws: int = 20_000, seed: int = 13, form: str | None = None, batch: int = 200, part: int = PART, width: int | None = None) -> DataFrame:
    """(draw, v): for each draw the sums of the arrays of as many clusters as there are, drawn with replacement.

    Draw -1 takes each cluster once. Clusters are dealt into parts by hash. Every task makes its part's share of each draw from
    the seed, and sums its own clusters; the parts' sums are added by draw. Neither evidence nor weights are on the driver.

    width is the length of the arrays; without it, it is read from the evidence.

    With a form (multinomial, in batches; or indices), the weights are those of one stream of numpy's generator over the
    clusters in their order, as published intervals have them; one task makes them, so clusters are bounded by STREAM.
    """
    if draws < 1 or form not in (None, "multinomial", "indices"):
        raise ValueError("draws must be positive, and the form multinomial, indices or None")
    sizes, bucket = _parts(evidence, part)
    total = int(sizes.sum())
    if form:
        if total > STREAM:
            raise ValueError(f"a single stream is for {STREAM} clusters at most, and there are {total}")
        sizes, bucket = np.array([total]), F.lit(0)
    parts = len(sizes)
    held = evidence.select(bucket.alias("part"), "cluster", "v")

    def sums(table: pa.Table) -> pa.Table:
        table = table.sort_by("cluster")
        k, n = table.column("part")[0].as_py(), table.num_rows
        own = table.column("v").combine_chunks()
        own = own.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
        weights = _stream(n, draws, seed, form, batch) if form else _weights(n, _shares(sizes, k, draws, seed), np.random.default_rng([seed, 2, k]))
        found = np.concatenate([own.sum(0, keepdims=True), *(w @ own for w in weights)])
        at = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
        return pa.table({"draw": pa.array(np.arange(-1, len(found) - 1, dtype=np.int32)), "v": pa.ListArray.from_arrays(at, pa.array(found.ravel()))})

    made = held.groupBy("part").applyInArrow(sums, "draw int, v array<double>")
    if parts == 1:
        return made
    # adding arrays place by place; the sums of a task's parts are added before the shuffle
    width = width or evidence.select(F.size("v").alias("n")).first()["n"]
    return made.groupBy("draw").agg(F.array(*(F.sum(_C("v")[i]) for i in range(width))).alias("v"))


def evidence(rows: DataFrame, cells: list[dict], parts: tuple[str, ...] = ("tp", "fp", "fn")) -> DataFrame:
    """(cluster, v): for each row_uid the sums of the parts in each cell, a cell being {column: value}; see `cell`."""
    inside = lambda c: reduce(Column.__and__, [_C(k) == v for k, v in c.items()])
    cell = reduce(lambda made, c: made.when(inside(c[1]), c[0]), enumerate(cells), F.when(F.lit(False), 0))
    sums = [F.sum(F.when(_C("__cell") == i, _C(p))) for i in range(len(cells)) for p in parts]
    numbered = rows.select(_C("row_uid").alias("cluster"), cell.alias("__cell"), *parts)
    return numbered.groupBy("cluster").agg(F.array(*(F.coalesce(s, F.lit(0)).cast("double") for s in sums)).alias("v"))


def cell_f1(at: int | list[int]) -> Column:
    """F1 of a cell of v, or of several pooled."""
    places = [at] if isinstance(at, int) else at
    return f1(*(reduce(Column.__add__, [_C("v")[3 * i + k] for i in places]) for k in range(3)))


def balanced_f1(cells: list[int]) -> Column:
    """F1 averaged over cells."""
    return reduce(Column.__add__, [cell_f1(i) for i in cells]) / len(cells)


def estimates(samples: DataFrame, values: dict[str, Column], name: str = "estimate") -> DataFrame:
    """(estimate, point, ci_lower, ci_upper, draws): each value at all clusters once, and its 2.5 and 97.5 percentiles over draws."""
    cells = F.array(*(F.struct(F.lit(n).alias(name), c.alias("value")) for n, c in values.items()))
    rows = samples.select("draw", F.explode(cells).alias("x")).select("draw", "x.*")
    on = _C("draw") >= 0
    q = F.percentile(F.when(on, _C("value")), F.array(F.lit(0.025), F.lit(0.975)))
    made = rows.groupBy(name).agg(F.max(F.when(~on, _C("value"))).alias("point"), q.alias("q"), F.sum(on.cast("int")).alias("draws"))
    return made.select(name, "point", _C("q")[0].alias("ci_lower"), _C("q")[1].alias("ci_upper"), "draws")


#: The additive statistics of a review, before those of its classes.
REVIEW = ("pair_tp", "pair_fp", "pair_fn", "rows", "sample_f1", "exact", "false_positive_rows", "false_negative_rows", "presence_tp", "presence_fp", "presence_fn")


def review_evidence(decoded: DataFrame, classes: list[tuple[str, str]], *by: str) -> DataFrame:
    """(cluster, v): the REVIEW statistics of each row_uid, then tp, fp and fn of each class (aspect, sentiment).

    by splits a review into several observations (folds, units), whose statistics are added.
    """
    t, p = _C("target"), _C("p")
    kind = reduce(lambda made, c: made.when((_C("aspect") == c[1][0]) & (_C("sentiment") == c[1][1]), c[0]), enumerate(classes), F.when(F.lit(False), 0))
    marked = decoded.select("row_uid", *by, kind.alias("__k"), "target", "p", (t * p).alias("x0"), ((1 - t) * p).alias("x1"), (t * (1 - p)).alias("x2"))
    per = marked.groupBy("row_uid", *by).agg(
        F.sum("x0").alias("tp"), F.sum(t).alias("g"), F.sum(p).alias("n"), *(F.coalesce(F.sum(F.when(_C("__k") == i, _C(f"x{k}"))), F.lit(0)).alias(f"c{i}_{k}") for i in range(len(classes)) for k in range(3)),
    )
    tp, g, n = _C("tp"), _C("g"), _C("n")
    own = [tp, n - tp, g - tp, F.lit(1), ratio(2 * tp, g + n), (tp == g) & (tp == n), (g == 0) & (n > 0), (g > 0) & (n == 0), (g > 0) & (n > 0), (g == 0) & (n > 0), (g > 0) & (n == 0)]
    own += [_C(f"c{i}_{k}") for i in range(len(classes)) for k in range(3)]
    return per.groupBy(_C("row_uid").alias("cluster")).agg(F.array(*(F.sum(c.cast("double")) for c in own)).alias("v"))


def review_metrics(classes: int) -> dict[str, Column]:
    """The eleven metrics of review_evidence's sums."""
    at = {n: _C("v")[i] for i, n in enumerate(REVIEW)}
    each = [f1(*(_C("v")[len(REVIEW) + 3 * i + k] for k in range(3))) for i in range(classes)]
    tp, fp, fn = at["pair_tp"], at["pair_fp"], at["pair_fn"]
    a, b, c = at["presence_tp"], at["presence_fp"], at["presence_fn"]
    return {
        "pair_micro_precision": ratio(tp, tp + fp), "pair_micro_recall": ratio(tp, tp + fn), "pair_micro_f1": f1(tp, fp, fn), "pair_samples_f1": ratio(at["sample_f1"], at["rows"]),
        "pair_exact_match_rate": ratio(at["exact"], at["rows"]), "pair_false_positive_rows_per_100": 100 * ratio(at["false_positive_rows"], at["rows"]),
        "pair_false_negative_rows_per_100": 100 * ratio(at["false_negative_rows"], at["rows"]), "pair_macro_f1": reduce(Column.__add__, each) / classes,
        "presence_precision": ratio(a, a + b), "presence_recall": ratio(a, a + c), "presence_f1": f1(a, b, c),
    }


def side_by_side(one: DataFrame, other: DataFrame) -> DataFrame:
    """(cluster, v): both systems' arrays, one after the other; a cluster that one of them lacks is an error."""
    both = one.join(other.select("cluster", _C("v").alias("w")), "cluster", "full")
    fail = F.raise_error(F.concat(F.lit("clusters differ: "), _C("cluster").cast("string"))).cast("array<double>")
    return both.select("cluster", F.when(_C("v").isNull() | _C("w").isNull(), fail).otherwise(F.concat("v", "w")).alias("v"))


def weighted_f1(confusion: DataFrame, weights: DataFrame, *by: str) -> DataFrame:
    """F1 and its parts under cluster weights (draw, cluster, w): a join and one aggregation."""
    total = lambda c: F.sum(_C("w") * _C(c))
    made = confusion.join(weights, "cluster").groupBy("draw", *by).agg(total("tp").alias("tp"), total("fp").alias("fp"), total("fn").alias("fn"), total("rows").alias("rows"), total("sample_f1").alias("s"), total("exact").alias("e"))
    return made.select("draw", *by, ratio(_C("tp"), _C("tp") + _C("fp")).alias("pair_micro_precision"), ratio(_C("tp"), _C("tp") + _C("fn")).alias("pair_micro_recall"), f1(_C("tp"), _C("fp"), _C("fn")).alias("pair_micro_f1"), ratio(_C("s"), _C("rows")).alias("pair_samples_f1"), ratio(_C("e"), _C("rows")).alias("pair_exact_match_rate"))


def sign_flip(differences: DataFrame, *by: str, tolerance: float = 1e-15) -> DataFrame:
    """(units, mean_difference, p_value[, by]): the share of all 2^n sign patterns whose mean is as far from 0; n <= 20.

    The patterns are an explode of a range beside each group's array of differences.
    """
    held = differences.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("unit", "d"))), lambda x: x.d).alias("ds"))
    n = F.size("ds")
    safe = F.when(n <= 20, n).otherwise(F.raise_error(F.lit("exact sign flips are for 20 units at most")).cast("int"))
    at = held.withColumn("mask", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), safe).cast("long") - 1)))
    flipped = F.aggregate(F.zip_with("ds", F.sequence(F.lit(0), n - 1), lambda d, i: d * (1 - 2 * F.getbit(_C("mask"), i).cast("double"))), F.lit(0.0), lambda a, x: a + x) / n
    mean = F.aggregate("ds", F.lit(0.0), lambda a, x: a + x) / n
    made = at.select(*by, n.alias("units"), mean.alias("mean_difference"), (F.abs(flipped) >= F.abs(mean) - tolerance).cast("double").alias("far"))
    return made.groupBy(*by).agg(F.first("units").alias("units"), F.first("mean_difference").alias("mean_difference"), F.avg("far").alias("p_value"))


def paired_units(a: DataFrame, b: DataFrame, unit: str, value: str, tolerance: float = 1e-12) -> DataFrame:
    """(unit, d): a minus b on equal units; a unit that one side lacks is an error."""
    left, right = a.select(_C(unit).alias("unit"), _C(value).alias("x")), b.select(_C(unit).alias("unit"), _C(value).alias("y"))
    both = left.join(right, "unit", "full")
    fail = F.raise_error(F.concat(F.lit("units differ: "), _C("unit").cast("string"))).cast("double")
    return both.select("unit", F.when(_C("x").isNull() | _C("y").isNull(), fail).otherwise(_C("x") - _C("y")).alias("d"))


def outcomes(differences: DataFrame, *by: str, tolerance: float = 1e-12) -> DataFrame:
    d, on = _C("d"), lambda c: F.sum(c.cast("long"))
    return differences.groupBy(*by).agg(F.count("*").alias("units"), F.avg(d).alias("mean_difference"), F.percentile(d, F.lit(0.5)).alias("median_difference"), on(d > tolerance).alias("wins"), on(F.abs(d) <= tolerance).alias("ties"), on(d < -tolerance).alias("losses"))


def pilot_gate(enhanced: DataFrame, control: DataFrame, unit: str, least_gain: float = 0.02, least_wins: int = 2, recall_share: float = 0.5) -> DataFrame:
    """(mean_delta, wins, recall_floor_passed, passed) of two tables (unit, f1, recall) with the same units."""
    side = lambda df, n: df.select(unit, _C("f1").alias(f"f{n}"), _C("recall").alias(f"r{n}"))
    both = side(enhanced, 0).join(side(control, 1), unit, "full")
    fail = F.raise_error(F.lit("enhanced and control units differ")).cast("double")
    d = F.when(_C("f0").isNull() | _C("f1").isNull(), fail).otherwise(_C("f0") - _C("f1"))
    made = both.agg(F.avg(d).alias("mean_delta"), F.sum((d > 0).cast("long")).alias("wins"), F.min(_C("r0") >= recall_share * _C("r1")).alias("recall_floor_passed"))
    return made.withColumn("passed", (_C("mean_delta") >= least_gain) & (_C("wins") >= least_wins) & _C("recall_floor_passed"))


def promoted(estimated: DataFrame, name: str = "estimate") -> DataFrame:
    """Estimated gains (point, ci_lower) with promoted, decision and rank: promoted if gain and interval are above 0."""
    on = (_C("point") > 0) & (_C("ci_lower") > 0)
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("point", 12)), name))  # a row for each system
    return estimated.withColumns({"promoted": on, "decision": F.when(on, "promote").otherwise("do_not_promote"), "rank": rank})


def holm(tests: DataFrame, p: str, order: str, *family: str) -> DataFrame:
    """With p_holm: step-down adjusted within each family, running maximum, 1 at most."""
    by = Window.partitionBy(*family)
    ranked = tests.withColumn("__r", F.row_number().over(by.orderBy(p, order))).withColumn("__m", F.count("*").over(by))
    step = F.least(F.lit(1.0), (_C("__m") - _C("__r") + 1) * _C(p))
    return ranked.withColumn("p_holm", F.max(step).over(by.orderBy(p, order).rowsBetween(Window.unboundedPreceding, 0))).drop("__r", "__m")


def gatekeeping(tests: DataFrame, p: str, order: str, alpha: float = 0.05) -> DataFrame:
    """With confirmed: in fixed order, a hypothesis counts only if it and all before it are below alpha."""
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # a handful of hypotheses
    return tests.withColumn("confirmed", F.max((_C(p) >= alpha).cast("int")).over(upto) == 0)


def contrasts(samples: DataFrame, terms: DataFrame, value: str, *by: str) -> DataFrame:
    """(contrast, value[, by]): sums of coefficients times systems' values, terms being (contrast, system, coefficient)."""
    return samples.join(F.broadcast(terms), "system").groupBy("contrast", *by).agg(F.sum(_C("coefficient") * _C(value)).alias("value"))  # terms are written by hand


def cluster_statistics(rows: DataFrame, *by: str) -> DataFrame:
    """One row for each cluster: additive parts of every metric, from rows with tp, fp, fn, n_gold, n_pred."""
    total = lambda c, n: F.sum(c.cast("long")).alias(n)
    g, p = _C("n_gold") > 0, _C("n_pred") > 0
    return rows.groupBy(_C("row_uid").alias("cluster"), *by).agg(
        total(_C("tp"), "tp"), total(_C("fp"), "fp"), total(_C("fn"), "fn"), F.count("*").alias("rows"), F.sum(ratio(2 * _C("tp"), _C("n_gold") + _C("n_pred"))).alias("sample_f1"),
        total((_C("fp") == 0) & (_C("fn") == 0), "exact"), total(~g & p, "false_positive_rows"), total(g & ~p, "false_negative_rows"),
        total(g & p, "presence_tp"), total(~g & p, "presence_fp"), total(g & ~p, "presence_fn"),
    )
