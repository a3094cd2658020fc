"""Resampling and inference (RS, W12-W13)."""

from pyspark.sql import functions as F

from larkspur.functions.scores import harmonic
from larkspur.operators import decode as D
from larkspur.operators import metrics as M
from larkspur.operators import stats as R
from larkspur.plans.adapter import grid, table, with_views
from larkspur.plans.taxonomy import ASPECTS, SENTIMENTS, parent
from larkspur.queries.metrics import _AB, _two, decoded, predictions
from larkspur.queries.registry import GATE, SECOND, query

_F = with_views("pred_a", "pred_b") + """, x AS (SELECT aspect, 'a' AS c, sum(target * p) AS tp, sum(p) AS n, sum(target) AS g FROM pred_a GROUP BY aspect UNION ALL SELECT aspect, 'b', sum(target * p), sum(p), sum(target) FROM pred_b GROUP BY aspect),
f AS (SELECT aspect AS unit, max(CASE WHEN c = 'a' THEN 2.0::DOUBLE * tp / (n + g) END) - max(CASE WHEN c = 'b' THEN 2.0::DOUBLE * tp / (n + g) END) AS d FROM x GROUP BY aspect)"""
_FLIP = """, u AS (SELECT d, row_number() OVER (ORDER BY unit) - 1 AS i FROM f), k AS (SELECT count(*) AS n, avg(d) AS m FROM u), s AS (SELECT mask, sum(CASE WHEN (mask >> i) & 1 = 1 THEN -d ELSE d END) / max(n) AS v FROM u, k, range(0, 64) r(mask) GROUP BY mask)"""


def _differences(spark, sf_dir):
    return _two(spark, sf_dir).select(F.col("aspect").alias("unit"), (F.col("native") - F.col("described")).alias("d"))


@query(_F + _FLIP + " SELECT max(n)::INT AS units, round(max(m), 9) AS mean_difference, round(avg((abs(v) >= abs(m) - 1e-15)::INT), 9) AS p_value FROM s, k")
def sign_flip_exact(spark, sf_dir):
    """RS8, RS9: all sign patterns."""
    return R.sign_flip(_differences(spark, sf_dir))


@query(_F + """ SELECT count(*) AS units, round(avg(d), 9) AS mean_difference, round(quantile_cont(d, 0.5), 9) AS median_difference, sum((d > 1e-12)::INT)::BIGINT AS wins, sum((abs(d) <= 1e-12)::INT)::BIGINT AS ties, sum((d < -1e-12)::INT)::BIGINT AS losses FROM f""")
def paired_units(spark, sf_dir):
    """RS8, JN9."""
    two = _two(spark, sf_dir)
    return R.outcomes(R.paired_units(two.select("aspect", F.col("native").alias("v")), two.select("aspect", F.col("described").alias("v")), "aspect", "v"))


@query("""WITH t AS (SELECT n_regionkey AS family, n_nationkey AS id, (n_nationkey * 7 % 23 + 1) / 100.0::DOUBLE AS p FROM nation), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS k, count(*) OVER (PARTITION BY family) AS m FROM t)
SELECT family, id, p, round(max(least(1, (m - k + 1) * p)) OVER (PARTITION BY family ORDER BY p, id ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM r""")
def holm(spark, sf_dir):
    """W12."""
    t = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("family"), F.col("n_nationkey").alias("id"), ((F.col("n_nationkey") * 7 % 23 + 1) / F.lit(100.0)).alias("p"))
    return R.holm(t, "p", "id", "family")


@query("""SELECT r_regionkey AS id, (r_regionkey + 1) / 100.0::DOUBLE AS p, max(((r_regionkey + 1) / 100.0 >= 0.04)::INT) OVER (ORDER BY r_regionkey ROWS UNBOUNDED PRECEDING) = 0 AS confirmed FROM region""")
def gatekeeping(spark, sf_dir):
    """W13: fixed order."""
    return R.gatekeeping(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), ((F.col("r_regionkey") + 1) / F.lit(100.0)).alias("p")), "p", "id", 0.04)


@query(_AB + """, w AS (SELECT row_uid AS cluster, d AS draw, (('0x' || substr(sha256(d || '|' || row_uid), 1, 8))::UBIGINT % 3)::INT AS w FROM sets_a, range(0, 3) r(d)), s AS (SELECT draw, w, tp, ng, np, CASE WHEN ng + np = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (ng + np) END AS f, (tp = ng AND tp = np)::INT AS e FROM n_a JOIN w ON cluster = row_uid)
SELECT draw::INT AS draw, round(sum(w * tp)::DOUBLE / sum(w * np), 9) AS pair_micro_precision, round(sum(w * tp)::DOUBLE / sum(w * ng), 9) AS pair_micro_recall, round(2.0 * sum(w * tp) / sum(w * (np + ng)), 9) AS pair_micro_f1, round(sum(w * f) / sum(w), 9) AS pair_samples_f1, round(sum(w * e)::DOUBLE / sum(w), 9) AS pair_exact_match_rate FROM s GROUP BY draw""")
def weighted_metric(spark, sf_dir):
    """RS4: metrics under a table of cluster weights."""
    from larkspur.plans.adapter import prefix

    stats = R.cluster_statistics(M.counts(predictions(spark, sf_dir)))
    w = stats.select("cluster", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("draw")).withColumn("w", (prefix(F.sha2(F.concat_ws("|", F.col("draw").cast("string"), "cluster"), 256)) % 3).cast("int"))
    return R.weighted_f1(stats, w)


@query(_F.replace("f AS (SELECT aspect AS unit", "f0 AS (SELECT aspect AS unit") + """, t AS (SELECT * FROM (VALUES ('difference', 'a', 1.0), ('difference', 'b', -1.0), ('mean', 'a', 0.5), ('mean', 'b', 0.5)) v(contrast, c, k))
SELECT contrast, aspect, round(sum(k * 2.0::DOUBLE * tp / (n + g)), 9) AS value FROM x JOIN t USING (c) GROUP BY ALL""")
def linear_contrasts(spark, sf_dir):
    """RS12."""
    one = lambda s: M.pooled(decoded(spark, sf_dir, s), "aspect").select("aspect", F.col("f1").alias("v"), F.lit(s).alias("system"))
    terms = spark.createDataFrame([("difference", "a", 1.0), ("difference", "b", -1.0), ("mean", "a", 0.5), ("mean", "b", 0.5)], "contrast string, system string, coefficient double")
    return R.contrasts(one("a").unionByName(one("b")), terms, "v", "aspect")


PAIRS = [(a, s) for a in ASPECTS for s in SENTIMENTS]
#: Cells of evidence: every aspect of system a, then of system b.
CELLS = [{"system": s, "aspect": a} for s in ("a", "b") for a in ASPECTS]
_FOR = {"a": list(range(len(ASPECTS))), "b": list(range(len(ASPECTS), 2 * len(ASPECTS)))}


def _test(spark, sf_dir, salt):
    """Decoded test reviews of a system."""
    return D.capped_two(grid(spark, sf_dir, salt, "test"), GATE, SECOND)


def _counts(spark, sf_dir):
    """(system, row_uid, aspect, tp, fp, fn) of the test reviews."""
    made = [M.confusion(_test(spark, sf_dir, s), "aspect").withColumn("system", F.lit(s)) for s in ("a", "b")]
    return made[0].unionByName(made[1])


def _samples(spark, sf_dir):
    return R.resampled(R.evidence(_counts(spark, sf_dir), CELLS), width=3 * len(CELLS))


_POINT = with_views("pred_a", "pred_b") + """, u AS (SELECT 'a' AS system, aspect, target, p FROM pred_a WHERE split = 'test' UNION ALL SELECT 'b', aspect, target, p FROM pred_b WHERE split = 'test'),
c AS (SELECT system, aspect, sum(target * p) AS tp, sum(p) AS n, sum(target) AS g FROM u GROUP BY ALL), f AS (SELECT *, coalesce(2.0::DOUBLE * tp / nullif(n + g, 0), 0) AS f1 FROM c)"""


@query(_POINT + """ SELECT system || ' balanced' AS estimate, round(avg(f1), 9) AS point FROM f GROUP BY system UNION ALL SELECT system || ' pooled', round(2.0::DOUBLE * sum(tp) / sum(n + g), 9) FROM f GROUP BY system
UNION ALL SELECT 'harmonic ' || h.aspect, round(coalesce(2 * h.f1 * s.f1 / nullif(h.f1 + s.f1, 0), 0), 9) FROM f h JOIN (SELECT o.aspect, 2.0::DOUBLE * sum(x.tp) / sum(x.n + x.g) AS f1 FROM f o JOIN f x ON o.aspect <> x.aspect WHERE o.system = 'a' AND x.system = 'a' GROUP BY o.aspect) s USING (aspect) WHERE h.system = 'a'""")
def bootstrap_points(spark, sf_dir):
    """RS1, RS6: what the intervals are around, from the same evidence."""
    made = R.resampled(R.evidence(_counts(spark, sf_dir), CELLS), draws=1)
    return R.estimates(made, _systems() | _harmonics()).select("estimate", "point")


def _systems():
    return {f"{s} balanced": R.balanced_f1(_FOR[s]) for s in _FOR} | {f"{s} pooled": R.cell_f1(_FOR[s]) for s in _FOR}


def _harmonics():
    return {f"harmonic {a}": harmonic(R.cell_f1(i), R.cell_f1([j for j in _FOR["a"] if j != i])) for i, a in enumerate(ASPECTS)}


@query()
def bootstrap_systems(spark, sf_dir):
    """RS1, RS2: 20,000 synchronised draws of test reviews; each system's F1, averaged over aspects and pooled, with intervals."""
    return R.estimates(_samples(spark, sf_dir), _systems())


@query()
def bootstrap_difference(spark, sf_dir):
    """RS3: the difference of two systems' aspect-balanced F1, and whether the first is superior."""
    a, b = R.balanced_f1(_FOR["a"]), R.balanced_f1(_FOR["b"])
    return R.estimates(_samples(spark, sf_dir), {"a - b": a - b}).withColumn("superior", F.col("ci_lower") > 0)


@query()
def promotion_by_interval(spark, sf_dir):
    """AG48: aspects' gains of one system over another, promoted if the gain and its interval are above 0, and ranked."""
    return R.promoted(R.estimates(_samples(spark, sf_dir), {a: R.cell_f1(_FOR["b"][i]) - R.cell_f1(_FOR["a"][i]) for i, a in enumerate(ASPECTS)}, "aspect"), "aspect")


@query()
def cluster_intervals(spark, sf_dir):
    """RS5: all eleven metrics of one system."""
    return R.estimates(R.resampled(R.review_evidence(_test(spark, sf_dir, "a"), PAIRS), width=len(R.REVIEW) + 3 * len(PAIRS)), R.review_metrics(len(PAIRS)))


@query()
def harmonic_intervals(spark, sf_dir):
    """RS6: the harmonic mean of seen and unseen F1, for each aspect held out."""
    return R.estimates(_samples(spark, sf_dir), _harmonics())


def _paired(one, other):
    """(draw, v) with the differences of all metrics between two decoded tables, whose reviews are resampled together; their names."""
    both = R.side_by_side(R.review_evidence(one, PAIRS), R.review_evidence(other, PAIRS))
    width, metrics = len(R.REVIEW) + 3 * len(PAIRS), R.review_metrics(len(PAIRS))
    samples = R.resampled(both, width=2 * width).select("draw", F.slice("v", 1, width).alias("v"), F.slice("v", 1 + width, width).alias("w"))
    first = samples.select("draw", F.array(*metrics.values()).alias("one"), F.col("w").alias("v"))
    second = first.select("draw", "one", F.array(*metrics.values()).alias("other"))
    return second.select("draw", F.zip_with("one", "other", lambda x, y: x - y).alias("v")), list(metrics)


@query()
def paired_difference(spark, sf_dir):
    """RS7: two systems on the same grid; the difference of every metric."""
    samples, names = _paired(_test(spark, sf_dir, "a"), _test(spark, sf_dir, "b"))
    return R.estimates(samples, {n: F.col("v")[i] for i, n in enumerate(names)}, "metric")


@query()
def protocol_comparisons(spark, sf_dir):
    """RS7, RS13: a matched comparison of two systems, and one of a harder with an easier grid over the same reviews.

    Only matched grids have paired units, and so a sign flip test.
    """
    a, b = _test(spark, sf_dir, "a"), _test(spark, sf_dir, "b")
    out = []
    for design, one, other in (("matched_identical_task_grid", a, b), ("different_task_grids_shared_review_resampling", a, a.where(F.col("aspect").startswith("Size")))):
        samples, names = _paired(one, other)
        out.append(R.estimates(samples, {design: F.col("v")[names.index("pair_micro_f1")]}, "design"))
    units = R.paired_units(*(M.pooled(x, "aspect").select("aspect", F.col("f1").alias("v")) for x in (a, b)), "aspect", "v")
    flips = R.sign_flip(units).select(F.lit("matched_identical_task_grid").alias("design"), "units", "p_value")
    return out[0].unionByName(out[1]).join(flips, "design", "left")


@query()
def mean_difference_interval(spark, sf_dir):
    """RS8, RS10: the mean of paired units' differences, units drawn with replacement from one stream of indices."""
    d = _differences(spark, sf_dir).select(F.col("unit").alias("cluster"), F.array("d", F.lit(1.0)).alias("v"))
    return R.estimates(R.resampled(d, form="indices", batch=512), {"mean difference": F.col("v")[0] / F.col("v")[1]})


@query()
def parent_group_table(spark, sf_dir):
    """RS14: each system's F1 on each held-out parent group, with intervals, reviews and those with a label in the group."""
    groups = {p: [i for i, a in enumerate(ASPECTS) if parent(a) == p] for p in dict.fromkeys(map(parent, ASPECTS))}
    values = {f"{s} | {p}": R.cell_f1([_FOR[s][i] for i in at]) for s in _FOR for p, at in groups.items()}
    made = R.estimates(_samples(spark, sf_dir), values, "key")
    parts = F.split("key", r" \| ")
    support = _test(spark, sf_dir, "a").groupBy("row_uid", F.split("aspect", ":")[0].alias("parent_group")).agg(F.max("target").alias("on")).groupBy("parent_group").agg(F.count("*").alias("reviews"), F.sum("on").alias("positive_reviews"))
    return made.withColumns({"system": parts[0], "parent_group": parts[1]}).drop("key").join(support, "parent_group")


_ABC = with_views("pred_a", "pred_b", "pred_c") + """, u AS (SELECT 'a' AS s, aspect, target, p FROM pred_a UNION ALL SELECT 'b', aspect, target, p FROM pred_b UNION ALL SELECT 'c', aspect, target, p FROM pred_c), f AS (SELECT s, aspect, coalesce(2.0::DOUBLE * sum(target * p) / nullif(sum(target + p), 0), 0) AS v FROM u GROUP BY ALL),
d AS (SELECT x.s || ' - ' || y.s AS comparison, x.aspect, x.v - y.v AS d, row_number() OVER (PARTITION BY x.s, y.s ORDER BY x.aspect) - 1 AS i FROM f x JOIN f y ON x.aspect = y.aspect AND x.s < y.s), k AS (SELECT comparison, count(*) AS n, avg(d) AS m, sum((d > 1e-12)::INT) AS wins, sum((d < -1e-12)::INT) AS losses FROM d GROUP BY comparison),
fl AS (SELECT d.comparison, mask, sum(CASE WHEN (mask >> i) & 1 = 1 THEN -d ELSE d END) / max(n) AS v, max(m) AS m FROM d JOIN k USING (comparison), range(0, 64) r(mask) GROUP BY d.comparison, mask), pv AS (SELECT comparison, round(avg((abs(v) >= abs(m) - 1e-15)::INT), 9) AS p FROM fl GROUP BY comparison),
rk AS (SELECT *, row_number() OVER (ORDER BY p, comparison) AS r, count(*) OVER () AS m2 FROM pv)
SELECT comparison, n::INT AS units, round(m, 9) AS mean_difference, wins::BIGINT AS wins, (n - wins - losses)::BIGINT AS ties, losses::BIGINT AS losses, p AS p_value, round(max(least(1, (m2 - r + 1) * p)) OVER (ORDER BY p, comparison ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM rk JOIN k USING (comparison)"""


@query(_ABC)
def comparison_table(spark, sf_dir):
    """RS11: all pairs of three systems over aspects, with exact sign flips, adjusted step by step."""
    one = {s: M.pooled(decoded(spark, sf_dir, s), "aspect").select("aspect", F.col("f1").alias("v")) for s in ("a", "b", "c")}
    made = [R.paired_units(one[x], one[y], "aspect", "v").withColumn("comparison", F.lit(f"{x} - {y}")) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))]
    d = made[0].unionByName(made[1]).unionByName(made[2])
    tests = R.sign_flip(d, "comparison").select("comparison", F.round("p_value", 9).alias("p_value"))
    return R.outcomes(d, "comparison").drop("median_difference").withColumn("units", F.col("units").cast("int")).join(R.holm(tests, "p_value", "comparison"), "comparison")


_GATE = with_views("pred_a", "pred_b") + """, u AS (SELECT 'a' AS s, aspect, target, p FROM pred_a UNION ALL SELECT 'b', aspect, target, p FROM pred_b), f AS (SELECT s, aspect, coalesce(2.0::DOUBLE * sum(target * p) / nullif(sum(target + p), 0), 0) AS f1, coalesce(sum(target * p)::DOUBLE / nullif(sum(target), 0), 0) AS rec FROM u GROUP BY ALL),
j AS (SELECT x.f1 - y.f1 AS d, x.rec AS r, y.rec AS c FROM f x JOIN f y USING (aspect) WHERE x.s = 'a' AND y.s = 'b')
SELECT round(avg(d), 9) AS mean_delta, sum((d > 0)::INT)::BIGINT AS wins, bool_and(r >= 0.5 * c) AS recall_floor_passed, avg(d) >= -0.02 AND sum((d > 0)::INT) >= 2 AND bool_and(r >= 0.5 * c) AS passed FROM j"""


@query(_GATE)
def pilot_gate(spark, sf_dir):
    """RS15: enough gain, enough wins, and no recall below a share of the control's."""
    side = {s: M.pooled(decoded(spark, sf_dir, s), "aspect") for s in ("a", "b")}
    return R.pilot_gate(side["a"], side["b"], "aspect", least_gain=-0.02)


@query()
def duplicate_removal_sensitivity(spark, sf_dir):
    """RS16: a threshold chosen anew, and evaluated, without rows that repeat a training label set."""
    from larkspur.functions.labels import pairs
    from larkspur.operators import sweep as W
    from larkspur.operators.splits import duplicates_of_training
    from larkspur.plans.adapter import reviews, scored_grid

    rows = reviews(spark, sf_dir).withColumn("normal", F.array_join(pairs(F.col("labels")), ";"))
    marked = duplicates_of_training(rows.where("split = 'train'"), rows.where("split = 'validation'"))
    out = [W.select(W.pair_sweep(scored_grid(part.select("row_uid", "split", "labels")))).withColumn("rows", F.lit(name)) for name, part in (("all", marked), ("without_duplicates", marked.where("not is_duplicate")))]
    return out[0].unionByName(out[1])
