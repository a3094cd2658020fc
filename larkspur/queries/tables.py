"""Comparison tables: conditions, decoders, folds and systems side by side (AG21, AG27, AG32, AG36-AG41, AG45, AG47, DK16, DK17, ML11, RT5, SC11, SM9, SM14)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions.scores import f1, ratio
from larkspur.operators import decode as D
from larkspur.operators import metrics as M
from larkspur.operators import sampling as S
from larkspur.operators import sweep as W
from larkspur.plans.adapter import grid, reviews, with_views
from larkspur.plans.taxonomy import ASPECTS, strings
from larkspur.queries.metrics import _AB, decoded, predictions
from larkspur.queries.registry import GATE, SECOND, query

_C = F.col
#: Decoded cells of both systems, in SQL.
_BOTH = with_views("pred_a", "pred_b") + ", u AS (SELECT 'a' AS system, * FROM pred_a UNION ALL SELECT 'b', * FROM pred_b)"
_F1 = "coalesce(2.0::DOUBLE * sum(target * p) / nullif(sum(target + p), 0), 0)"


def _both(spark, sf_dir):
    return decoded(spark, sf_dir, "a").withColumn("system", F.lit("a")).unionByName(decoded(spark, sf_dir, "b").withColumn("system", F.lit("b")))


def _on(c):
    return F.sum(c.cast("long"))


_HELD = "('Size: LARGE', 'Size: MEDIUM')"


@query(_BOTH + f""", x AS (SELECT system, row_uid, bool_and(CASE WHEN aspect IN {_HELD} AND target = 1 THEN p = 1 ELSE TRUE END) AS r, sum(CASE WHEN aspect IN {_HELD} THEN target ELSE 0 END) AS g, sum(CASE WHEN aspect IN {_HELD} THEN p ELSE 0 END) AS n FROM u GROUP BY ALL),
d AS (SELECT system, sum((g > 0 AND r)::INT)::DOUBLE / nullif(sum((g > 0)::INT), 0) AS both_recall, sum((g = 0 AND n > 0)::INT)::DOUBLE / nullif(sum((g = 0)::INT), 0) AS neither_fpr, avg((n > 0)::INT) AS selection_rate FROM x GROUP BY system)
SELECT a.system AS reference, b.system AS condition, round(b.both_recall - a.both_recall, 9) AS both_recall_delta, round(b.neither_fpr - a.neither_fpr, 9) AS neither_fpr_delta, round(b.selection_rate - a.selection_rate, 9) AS selection_rate_delta FROM d a JOIN d b ON a.system = 'a' AND b.system = 'b'""")
def dual_aspect_deltas(spark, sf_dir):
    """AG21: two held-out aspects at once, one condition against the other; undefined rates are null."""
    held, t, p = _C("aspect").isin("Size: LARGE", "Size: MEDIUM"), _C("target"), _C("p")
    x = _both(spark, sf_dir).groupBy("system", "row_uid").agg(F.min(F.when(held & (t == 1), p).otherwise(1)).alias("r"), F.sum(F.when(held, t).otherwise(0)).alias("g"), F.sum(F.when(held, p).otherwise(0)).alias("n"))
    g, n = _C("g"), _C("n")
    names = ("both_recall", "neither_fpr", "selection_rate")
    d = x.groupBy("system").agg((_on((g > 0) & (_C("r") == 1)) / F.nullif(_on(g > 0), F.lit(0))).alias(names[0]), (_on((g == 0) & (n > 0)) / F.nullif(_on(g == 0), F.lit(0))).alias(names[1]), F.avg((n > 0).cast("int")).alias(names[2]))
    of = lambda s, c: F.max(F.when(_C("system") == s, _C(c)))
    return d.agg(*((of("b", c) - of("a", c)).alias(f"{c}_delta") for c in names)).select(F.lit("a").alias("reference"), F.lit("b").alias("condition"), "*")


@query(_AB + """, s AS (SELECT 'a' AS system, * FROM n_a UNION ALL SELECT 'b', * FROM n_b), f AS (SELECT *, CASE WHEN ng + np = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (ng + np) END AS f FROM s), w AS (SELECT *, max(f) OVER (PARTITION BY row_uid) - min(f) OVER (PARTITION BY row_uid) AS span FROM f),
t AS (SELECT row_uid, system, span, unnest(list_filter([CASE WHEN np = 0 AND ng > 0 THEN 'empty_abstention' END, CASE WHEN np - tp > 0 AND np > ng THEN 'overprediction' END,
  CASE WHEN len(list_filter(gold, lambda x: x LIKE '% | neutral')) > 0 AND len(list_filter(pred, lambda x: x LIKE '% | neutral')) = 0 THEN 'neutral_under_recall' END], lambda x: x IS NOT NULL)) AS tag FROM w)
SELECT tag, system, count(*) AS rows, round(avg(span), 9) AS mean_span, round(max(span), 9) AS widest_span FROM t GROUP BY tag, system""")
def row_tags(spark, sf_dir):
    """AG27: tags of each system's rows, and how far the systems are apart on them."""
    sets = [M.counts(predictions(spark, sf_dir, s)).withColumn("system", F.lit(s)) for s in ("a", "b")]
    both = sets[0].unionByName(sets[1]).withColumn("f", ratio(2 * _C("tp"), _C("n_gold") + _C("n_pred")))
    w = Window.partitionBy("row_uid")
    neutral = lambda c: F.exists(c, lambda x: x.endswith(" | neutral"))
    tags = F.array_compact(F.array(
        F.when((_C("n_pred") == 0) & (_C("n_gold") > 0), "empty_abstention"), F.when((_C("fp") > 0) & (_C("n_pred") > _C("n_gold")), "overprediction"),
        F.when(neutral("gold") & ~neutral("pred"), "neutral_under_recall"),
    ))
    made = both.withColumn("span", F.max("f").over(w) - F.min("f").over(w)).select("system", "span", F.explode(tags).alias("tag"))
    return made.groupBy("tag", "system").agg(F.count("*").alias("rows"), F.avg("span").alias("mean_span"), F.max("span").alias("widest_span"))


@query(with_views("review", "gold", "aspect_dim") + """, t AS (SELECT g.row_uid, g.aspect FROM gold g JOIN review r USING (row_uid) WHERE split = 'train' GROUP BY ALL), h AS (SELECT DISTINCT row_uid FROM t WHERE aspect = 'Size: LARGE')
SELECT a.aspect, count(t.row_uid) AS masked, count(t.row_uid) FILTER (WHERE h.row_uid IS NULL) AS filtered, count(t.row_uid) FILTER (WHERE h.row_uid IS NOT NULL) AS lost, round(count(t.row_uid) FILTER (WHERE h.row_uid IS NOT NULL)::DOUBLE / nullif(count(t.row_uid), 0), 9) AS share_lost
FROM aspect_dim a LEFT JOIN t USING (aspect) LEFT JOIN h USING (row_uid) WHERE a.aspect <> 'Size: LARGE' GROUP BY a.aspect""")
def support_change(spark, sf_dir):
    """AG32: training reviews of each seen aspect when a held-out label is masked, and when its reviews are left out."""
    own = F.array_distinct(F.transform("labels", lambda x: x.aspect))
    train = reviews(spark, sf_dir).where("split = 'train'").select(own.alias("own"))
    rows = train.select(F.array_contains("own", "Size: LARGE").alias("held"), F.explode("own").alias("aspect")).where("aspect <> 'Size: LARGE'")
    found = rows.groupBy("aspect").agg(F.count("*").alias("masked"), _on(~_C("held")).alias("filtered"), _on(_C("held")).alias("lost"))
    every = spark.range(1).select(F.explode(strings([a for a in ASPECTS if a != "Size: LARGE"])).alias("aspect"))
    made = every.join(found, "aspect", "left").fillna(0)
    return made.withColumn("share_lost", _C("lost") / F.nullif(_C("masked"), F.lit(0)))


@query(with_views("pred_a") + f""", f AS (SELECT aspect, split, {_F1} AS f FROM pred_a WHERE split <> 'train' GROUP BY ALL)
SELECT v.aspect, round(v.f, 9) AS validation_f1, round(t.f, 9) AS test_f1, round(t.f - v.f, 9) AS change, CASE WHEN abs(t.f - v.f) <= 1e-12 THEN 'same' WHEN t.f > v.f THEN 'higher' ELSE 'lower' END AS outcome FROM f v JOIN f t USING (aspect) WHERE v.split = 'validation' AND t.split = 'test'""")
def validation_versus_test(spark, sf_dir):
    """AG36: each fold's F1 on both splits."""
    made = M.pooled(decoded(spark, sf_dir).where("split <> 'train'"), "aspect", "split").groupBy("aspect").pivot("split", ["validation", "test"]).agg(F.max("f1"))
    d = _C("test") - _C("validation")
    return made.select("aspect", _C("validation").alias("validation_f1"), _C("test").alias("test_f1"), d.alias("change"), F.when(F.abs(d) <= 1e-12, "same").when(d > 0, "higher").otherwise("lower").alias("outcome"))


@query(_BOTH + f""", g AS (SELECT *, max(target) OVER (PARTITION BY system, row_uid, aspect) AS has FROM u), f AS (SELECT aspect, system, {_F1} AS f, coalesce(2.0::DOUBLE * sum(target * p * has) / nullif(sum(has * (target + p)), 0), 0) AS fp FROM g GROUP BY ALL)
SELECT a.aspect, round(a.f, 9) AS f1_a, round(b.f, 9) AS f1_b, CASE WHEN abs(a.f - b.f) <= 1e-12 THEN 'tie' WHEN a.f > b.f THEN 'a' ELSE 'b' END AS winner, round(abs(a.f - b.f), 9) AS gap, round(a.fp, 9) AS positive_f1_a, round(b.fp, 9) AS positive_f1_b, round(a.fp - a.f, 9) AS positive_gap_a FROM f a JOIN f b USING (aspect) WHERE a.system = 'a' AND b.system = 'b'""")
def aspect_winners(spark, sf_dir):
    """AG37: which system is better on each aspect, and how much better each is on reviews that have the aspect."""
    has = F.max("target").over(Window.partitionBy("system", "row_uid", "aspect"))
    rows = _both(spark, sf_dir).withColumn("has", has)
    total = lambda c, on: F.sum((c * (_C("has") if on else F.lit(1))).cast("long"))
    t, p = _C("target"), _C("p")
    value = lambda on: f1(total(t * p, on), total((1 - t) * p, on), total(t * (1 - p), on))
    per = rows.groupBy("aspect", "system").agg(value(False).alias("f"), value(True).alias("fp"))
    of = lambda s, c: F.max(F.when(_C("system") == s, _C(c)))
    made = per.groupBy("aspect").agg(of("a", "f").alias("f1_a"), of("b", "f").alias("f1_b"), of("a", "fp").alias("positive_f1_a"), of("b", "fp").alias("positive_f1_b"))
    d = _C("f1_a") - _C("f1_b")
    return made.withColumns({"winner": F.when(F.abs(d) <= 1e-12, "tie").when(d > 0, "a").otherwise("b"), "gap": F.abs(d), "positive_gap_a": _C("positive_f1_a") - _C("f1_a")})


_SIMILAR = with_views("pred_a") + """, c AS (SELECT row_uid, aspect, max(aspect_score) AS s, max(target) AS t, max(CASE WHEN rn = 1 THEN target END) AS hit FROM pred_a GROUP BY row_uid, aspect), d AS (SELECT aspect, s, sum(t) AS t, count(*) AS n FROM c GROUP BY aspect, s),
e AS (SELECT *, sum(t) OVER (PARTITION BY aspect ORDER BY s DESC) AS ct, sum(n) OVER (PARTITION BY aspect ORDER BY s DESC) AS cn FROM d), ap AS (SELECT aspect, sum(t * ct::DOUBLE / cn) / sum(t) AS ap FROM e GROUP BY aspect),
o AS (SELECT aspect, sum((t = 1 AND s >= 0.5)::INT)::DOUBLE / nullif(sum(t), 0) AS coverage, sum(CASE WHEN t = 1 THEN hit END)::DOUBLE / nullif(sum(t), 0) AS oracle FROM c GROUP BY aspect)"""


@query(_SIMILAR + """ SELECT round(avg(ap), 9) AS presence_ap_mean, round(stddev_pop(ap), 9) AS presence_ap_sd, round(avg(coverage), 9) AS detection_coverage_mean, round(stddev_pop(coverage), 9) AS detection_coverage_sd, round(avg(oracle), 9) AS oracle_sentiment_mean, round(stddev_pop(oracle), 9) AS oracle_sentiment_sd, count(*) AS folds FROM ap JOIN o USING (aspect)""")
def similarity_evaluation(spark, sf_dir):
    """AG38: how well aspect scores find reviews with the aspect, and the best sentiment given the aspect; over folds, with deviations of a population."""
    g = D.ranked(grid(spark, sf_dir))
    c = g.groupBy("row_uid", "aspect").agg(F.max("aspect_score").alias("s"), F.max("target").alias("t"), F.max(F.when(_C("rn") == 1, _C("target"))).alias("hit"))
    ap = M.average_precision(c, "s", "t", "aspect").select("aspect", _C("average_precision").alias("presence_ap"))
    found = F.nullif(F.sum("t"), F.lit(0))
    per = c.groupBy("aspect").agg((_on((_C("t") == 1) & (_C("s") >= GATE)) / found).alias("detection_coverage"), (F.sum(F.when(_C("t") == 1, _C("hit"))) / found).alias("oracle_sentiment"))
    names = ("presence_ap", "detection_coverage", "oracle_sentiment")
    return per.join(ap, "aspect").agg(*(x for n in names for x in (F.avg(n).alias(f"{n}_mean"), F.stddev_pop(n).alias(f"{n}_sd"))), F.count("*").alias("folds"))


_DECODERS = with_views("ranked_a") + """, d AS (SELECT row_uid, aspect, target, (score >= 0.5)::INT AS p1, (rn = 1 AND aspect_score >= 0.5)::INT AS p2, (aspect_score >= 0.5 AND (rn = 1 OR (rn = 2 AND sentiment_score >= 0.6)))::INT AS p3, (aspect_score >= 0.5 AND rn <= 2)::INT AS p4 FROM ranked_a),
u AS (SELECT 'pair' AS decoder, row_uid, aspect, target, p1 AS p FROM d UNION ALL SELECT 'two_stage', row_uid, aspect, target, p2 FROM d UNION ALL SELECT 'capped_two', row_uid, aspect, target, p3 FROM d UNION ALL SELECT 'top_2', row_uid, aspect, target, p4 FROM d),"""


def _decoders(spark, sf_dir):
    g = D.ranked(grid(spark, sf_dir))
    gate, rn = _C("aspect_score") >= GATE, _C("rn")
    cells = F.array(*(F.struct(F.lit(n).alias("decoder"), c.cast("int").alias("p")) for n, c in (("pair", _C("score") >= GATE), ("two_stage", (rn == 1) & gate), ("capped_two", gate & ((rn == 1) | ((rn == 2) & (_C("sentiment_score") >= SECOND)))), ("top_2", gate & (rn <= 2)))))
    return g.select("row_uid", "aspect", "target", F.explode(cells).alias("d")).select("row_uid", "aspect", "target", "d.*")


@query(_DECODERS + f""" f AS (SELECT decoder, aspect, {_F1} AS f FROM u GROUP BY ALL), c AS (SELECT decoder, row_uid, aspect, sum(p) AS np, sum(target) AS ng, sum(p * target) AS k FROM u GROUP BY ALL),
m AS (SELECT decoder, sum(CASE WHEN ng > 1 THEN k END)::DOUBLE / nullif(sum(CASE WHEN ng > 1 THEN ng END), 0) AS multi_gold_recall, min(CASE WHEN np > 0 THEN np END)::BIGINT AS least_sentiments, max(np)::BIGINT AS most_sentiments, sum((np > 0)::INT)::BIGINT AS selected_aspects FROM c GROUP BY decoder)
SELECT x.decoder, r.decoder AS reference, round(avg(x.f - r.f), 9) AS mean_delta, sum((x.f - r.f > 1e-12)::INT)::BIGINT AS wins, sum((abs(x.f - r.f) <= 1e-12)::INT)::BIGINT AS ties, sum((x.f - r.f < -1e-12)::INT)::BIGINT AS losses,
  round(any_value(multi_gold_recall), 9) AS multi_gold_recall, any_value(least_sentiments) AS least_sentiments, any_value(most_sentiments) AS most_sentiments, any_value(selected_aspects) AS selected_aspects
FROM f x JOIN f r ON x.aspect = r.aspect AND r.decoder IN ('pair', 'two_stage') JOIN m ON m.decoder = x.decoder GROUP BY x.decoder, r.decoder""")
def decoder_matched(spark, sf_dir):
    """AG39: decoders against two references on the same folds, with what they select."""
    u = _decoders(spark, sf_dir)
    f = M.pooled(u, "decoder", "aspect").select("decoder", "aspect", "f1")
    c = u.groupBy("decoder", "row_uid", "aspect").agg(F.sum("p").alias("np"), F.sum("target").alias("ng"), F.sum(_C("p") * _C("target")).alias("k"))
    multi = _C("ng") > 1
    m = c.groupBy("decoder").agg((F.sum(F.when(multi, _C("k"))) / F.nullif(F.sum(F.when(multi, _C("ng"))), F.lit(0))).alias("multi_gold_recall"), F.min(F.when(_C("np") > 0, _C("np"))).alias("least_sentiments"), F.max("np").alias("most_sentiments"), _on(_C("np") > 0).alias("selected_aspects"))
    refs = f.where(_C("decoder").isin("pair", "two_stage")).select("aspect", _C("decoder").alias("reference"), _C("f1").alias("r"))
    d = _C("f1") - _C("r")
    made = f.join(refs, "aspect").groupBy("decoder", "reference").agg(F.avg(d).alias("mean_delta"), _on(d > 1e-12).alias("wins"), _on(F.abs(d) <= 1e-12).alias("ties"), _on(d < -1e-12).alias("losses"))
    return made.join(m, "decoder")


@query(_BOTH + f""", fold AS (SELECT aspect AS held FROM aspect_dim), x AS (SELECT held, system, unnest(['overall', CASE WHEN aspect = held THEN 'heldout' ELSE 'seen' END]) AS partition, target, p FROM u, fold), f AS (SELECT held, system, partition, {_F1} AS f FROM x GROUP BY ALL)
SELECT a.partition, round(avg(a.f), 9) AS mean_a, round(stddev_samp(a.f), 9) AS sd_a, round(avg(b.f), 9) AS mean_b, round(stddev_samp(b.f), 9) AS sd_b, round(avg(b.f - a.f), 9) AS mean_delta, round(stddev_samp(b.f - a.f), 9) AS sd_delta, count(*) AS folds FROM f a JOIN f b USING (held, partition) WHERE a.system = 'a' AND b.system = 'b' GROUP BY a.partition""")
def variant_deltas(spark, sf_dir):
    """AG41: two variants by partition over folds, and their paired differences."""
    from larkspur.plans.taxonomy import folds

    by = M.confusion(_both(spark, sf_dir).withColumn("row_uid", F.lit(0)), "aspect", "system").drop("row_uid")  # additive: twelve rows before the folds
    cells = M.partitions(by, [f for f in folds() if f.level == "L1"]).groupBy("fold_id", "partition", "system").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    per = cells.withColumn("f", f1(_C("tp"), _C("fp"), _C("fn"))).groupBy("fold_id", "partition").pivot("system", ["a", "b"]).agg(F.max("f"))
    d = _C("b") - _C("a")
    return per.groupBy("partition").agg(F.avg("a").alias("mean_a"), F.stddev_samp("a").alias("sd_a"), F.avg("b").alias("mean_b"), F.stddev_samp("b").alias("sd_b"), F.avg(d).alias("mean_delta"), F.stddev_samp(d).alias("sd_delta"), F.count("*").alias("folds"))


@query(_BOTH + """, r AS (SELECT system, aspect, row_uid, sum(target) AS g, sum(p) AS n, sum(target * p) AS k FROM u GROUP BY ALL)
SELECT system, aspect, round(coalesce(sum(k)::DOUBLE / nullif(sum(n), 0), 0), 9) AS precision, round(coalesce(sum(k)::DOUBLE / nullif(sum(g), 0), 0), 9) AS recall, round(coalesce(2.0::DOUBLE * sum(k) / nullif(sum(n + g), 0), 0), 9) AS f1,
  round(100.0::DOUBLE * sum((g = 0 AND n > 0)::INT) / count(*), 9) AS false_positive_rows_per_100, round(100.0::DOUBLE * sum((g > 0 AND n = 0)::INT) / count(*), 9) AS false_negative_rows_per_100, round(avg(n), 9) AS mean_set_size FROM r GROUP BY system, aspect""")
def fold_errors(spark, sf_dir):
    """AG45: errors of each fold from the cube of counts by system, aspect and review."""
    r = M.confusion(_both(spark, sf_dir), "system", "aspect")
    tp, fp, fn, g, n = (F.sum(c) for c in ("tp", "fp", "fn", "gold", "predicted"))
    return r.groupBy("system", "aspect").agg(
        ratio(tp, n).alias("precision"), ratio(tp, g).alias("recall"), f1(tp, fp, fn).alias("f1"), (100 * _on((_C("gold") == 0) & (_C("predicted") > 0)) / F.count("*")).alias("false_positive_rows_per_100"),
        (100 * _on((_C("gold") > 0) & (_C("predicted") == 0)) / F.count("*")).alias("false_negative_rows_per_100"), F.avg("predicted").alias("mean_set_size"),
    )


@query(with_views("pred_a", "pred_b") + f""", j AS (SELECT a.aspect, a.target, a.p, b.p AS q, CASE WHEN a.aspect_score < 0.6 THEN 0.5 * a.aspect_score / 0.6 ELSE 0.5 + 0.5 * (a.aspect_score - 0.6) / (1 - 0.6) END AS s FROM pred_a a JOIN pred_b b USING (row_uid, aspect, sentiment)),
t AS (SELECT *, ((s < 0.5 AND abs(s - 0.5) <= 0.1 + 1e-15) OR (s >= 0.5 AND abs(s - 0.5) <= 0.05 + 1e-15))::INT AS routed FROM j),
u AS (SELECT 'a' AS method, aspect, target, p, NULL::INT AS routed FROM t UNION ALL SELECT 'b', aspect, target, q, NULL FROM t UNION ALL SELECT 'router', aspect, target, CASE WHEN routed = 1 THEN q ELSE p END, routed FROM t),
f AS (SELECT method, aspect, {_F1} AS f, sum(target * p) AS k, sum(p) AS n, sum(target) AS g, avg(routed) AS rate FROM u GROUP BY ALL)
SELECT method, round(avg(f), 9) AS balanced_f1, round(2.0::DOUBLE * sum(k) / sum(n + g), 9) AS pooled_f1, round(avg(rate), 9) AS call_rate FROM f GROUP BY method""")
def router_summary(spark, sf_dir):
    """AG47: the router beside its components, balanced over folds and pooled; components make no calls."""
    from larkspur.operators import routing as R

    b = decoded(spark, sf_dir, "b").select("row_uid", "aspect", "sentiment", _C("p").alias("other_p"))
    both = decoded(spark, sf_dir, "a").join(b, ["row_uid", "aspect", "sentiment"]).withColumn("threshold", F.lit(0.6))
    routed = R.band_route(both, 0.1, 0.05)
    cells = F.array(*(F.struct(F.lit(n).alias("method"), p.cast("int").alias("p"), r.cast("int").alias("routed")) for n, p, r in (("a", _C("p"), F.lit(None)), ("b", _C("other_p"), F.lit(None)), ("router", _C("p_routed"), _C("routed")))))
    u = routed.select("row_uid", "aspect", "target", F.explode(cells).alias("c")).select("row_uid", "aspect", "target", "c.*")
    t, p = _C("target"), _C("p")
    per = u.groupBy("method", "aspect").agg(F.sum(t * p).alias("tp"), F.sum((1 - t) * p).alias("fp"), F.sum(t * (1 - p)).alias("fn"), F.avg("routed").alias("rate"))
    return per.groupBy("method").agg(F.avg(f1(_C("tp"), _C("fp"), _C("fn"))).alias("balanced_f1"), f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("pooled_f1"), F.avg("rate").alias("call_rate"))


@query(_SIMILAR + f""", k AS (SELECT aspect, {_F1} AS f FROM pred_a GROUP BY aspect), s1 AS (SELECT aspect, coalesce(2.0::DOUBLE * sum(t * (s >= 0.5)::INT) / nullif(sum(t + (s >= 0.5)::INT), 0), 0) AS f FROM c GROUP BY aspect),
rk AS (SELECT aspect, avg(r) AS mean_rank FROM (SELECT aspect, t, row_number() OVER (PARTITION BY row_uid ORDER BY s DESC, aspect) AS r FROM c) WHERE t = 1 GROUP BY aspect)
SELECT aspect, round(ap, 9) AS stage1_ap, round(s1.f, 9) AS stage1_f1, round(mean_rank, 9) AS mean_rank, round(oracle, 9) AS oracle_stage2_accuracy, round(k.f, 9) AS end_to_end_f1 FROM ap JOIN o USING (aspect) JOIN k USING (aspect) JOIN s1 USING (aspect) JOIN rk USING (aspect)""")
def condition_view(spark, sf_dir):
    """DK16: a held-out aspect's two stages and the whole: scores of presence, ranks, sentiments given the aspect, and pairs."""
    g = decoded(spark, sf_dir)
    c = g.groupBy("row_uid", "aspect").agg(F.max("aspect_score").alias("s"), F.max("target").alias("t"), F.max(F.when(_C("rn") == 1, _C("target"))).alias("hit"))
    rank = F.row_number().over(Window.partitionBy("row_uid").orderBy(F.desc("s"), "aspect"))
    held, t = c.withColumn("r", rank), _C("t")
    on = (_C("s") >= GATE).cast("int")
    per = held.groupBy("aspect").agg(f1(F.sum(t * on), F.sum((1 - t) * on), F.sum(t * (1 - on))).alias("stage1_f1"), F.avg(F.when(t == 1, _C("r"))).alias("mean_rank"), (F.sum(F.when(t == 1, _C("hit"))) / F.nullif(F.sum(t), F.lit(0))).alias("oracle_stage2_accuracy"))
    ap = M.average_precision(c, "s", "t", "aspect").select("aspect", _C("average_precision").alias("stage1_ap"))
    return per.join(ap, "aspect").join(M.pooled(g, "aspect").select("aspect", _C("f1").alias("end_to_end_f1")), "aspect")


@query("SELECT 2::BIGINT AS conditions, TRUE AS shared, 0.0::DOUBLE AS spread")
def shared_threshold(spark, sf_dir):
    """DK17: the threshold selected on seen aspects is the same under both conditions, asserted in the plan."""
    seen = grid(spark, sf_dir, split="validation").where("aspect not like 'Size%'")
    chosen = [W.select(W.two_stage_sweep(seen)).select(F.lit(c).alias("condition"), "threshold") for c in ("N", "D")]
    made = W.shared_threshold(chosen[0].unionByName(chosen[1]), "threshold")
    return made.select("conditions", (_C("threshold") >= 0).alias("shared"), "spread")


@query(_AB + """, rw AS (SELECT a.row_uid, a.gold, a.pred AS l, b.pred AS o, len(a.pred) AS v FROM sets_a a JOIN sets_b b USING (row_uid)), n AS (SELECT count(*) AS n FROM rw), p AS (SELECT 'pred_count' AS feature, r AS rate, m AS mode FROM (SELECT unnest([0.1, 0.1, 0.25])::DOUBLE AS r), (SELECT unnest(['replace', 'union']) AS m))
SELECT feature, rate, mode, round_even(rate * n, 0)::BIGINT AS calls FROM (SELECT DISTINCT * FROM p), n""")
def cascade_policies(spark, sf_dir):
    """RT5: the grid of rank policies without repeats, and how many calls each makes."""
    from larkspur.operators import routing as R

    listed = R.distinct_policies([{"feature": "pred_count", "rate": r, "mode": m} for r in (0.1, 0.1, 0.25) for m in ("replace", "union")])
    n = predictions(spark, sf_dir).agg(F.count("*").alias("n"))
    made = spark.createDataFrame([(p["feature"], p["rate"], p["mode"]) for p in listed], "feature string, rate double, mode string")
    return made.crossJoin(F.broadcast(n)).select("feature", "rate", "mode", F.bround(_C("rate") * _C("n")).cast("long").alias("calls"))  # one row


_ROWS = with_views("review", "gold", "aspect_dim") + """, tr AS (SELECT row_uid FROM review WHERE split = 'train'), own AS (SELECT DISTINCT row_uid, aspect FROM gold), c AS (SELECT tr.row_uid, a.aspect, (own.row_uid IS NOT NULL)::INT AS target FROM tr CROSS JOIN aspect_dim a LEFT JOIN own ON own.row_uid = tr.row_uid AND own.aspect = a.aspect),
w AS (SELECT row_uid, sum(target) AS k, count(*) - sum(target) AS pool, greatest(1, sum(target)) * 0.5 AS want FROM c GROUP BY row_uid), q AS (SELECT row_uid, least(pool, floor(want) + ((('0x' || substr(sha256('13' || chr(31) || 'fraction' || chr(31) || row_uid), 1, 8))::UBIGINT::DOUBLE / 4294967296 < want - floor(want))::INT))::INT AS n FROM w),
r AS (SELECT c.*, row_number() OVER (PARTITION BY row_uid, target ORDER BY sha256('13' || chr(31) || 'singleton' || chr(31) || row_uid || chr(31) || aspect)) AS k FROM c)
SELECT r.row_uid, aspect, target, sha256('13' || chr(31) || 'order' || chr(31) || r.row_uid || chr(31) || aspect) AS place FROM r JOIN q USING (row_uid) WHERE target = 1 OR k <= n"""


@query(_ROWS)
def singleton_rows(spark, sf_dir):
    """SM9: a row for each aspect of a review, and half as many absent ones, fractions by hash; in a hashed order."""
    return S.singletons(reviews(spark, sf_dir).where("split = 'train'"), ASPECTS, 0.5, 13)


@query(with_views("review") + """SELECT split, count(*) AS rows, sha256(array_to_string(list_sort(list(row_uid)), chr(10))) AS uids_sha256, (SELECT count(*) FROM (SELECT row_uid FROM review GROUP BY row_uid HAVING count(DISTINCT split) > 1)) AS shared_rows FROM review GROUP BY split""")
def split_manifest(spark, sf_dir):
    """SM14, PR39: each split's rows and the SHA-256 of its sorted uids, with the rows that splits share."""
    from larkspur.operators.splits import manifest

    return manifest(reviews(spark, sf_dir))


@query(with_views("grid_a", "grid_b") + """, s AS (SELECT 'D' AS interface, aspect, target, score FROM grid_a UNION ALL SELECT 'max', a.aspect, a.target, greatest(a.score, b.score) FROM grid_a a JOIN grid_b b USING (row_uid, aspect, sentiment) UNION ALL SELECT 'mean', a.aspect, a.target, (a.score + b.score) / 2 FROM grid_a a JOIN grid_b b USING (row_uid, aspect, sentiment)),
d AS (SELECT interface, aspect, score, sum(target) AS t, count(*) AS n FROM s GROUP BY ALL), e AS (SELECT *, sum(t) OVER w AS ct, sum(n) OVER w AS cn FROM d WINDOW w AS (PARTITION BY interface, aspect ORDER BY score DESC)), ap AS (SELECT interface, aspect, sum(t * ct::DOUBLE / cn) / sum(t) AS ap FROM e GROUP BY ALL),
m AS (SELECT x.interface, avg(x.ap - y.ap) AS delta FROM ap x JOIN ap y ON x.aspect = y.aspect AND y.interface = 'D' WHERE x.interface <> 'D' GROUP BY x.interface), nr AS (SELECT *, delta >= max(delta) OVER () - 0.005 - 1e-12 AS near FROM m)
SELECT interface, round(delta, 9) AS mean_delta, near, near AND (interface = 'mean' OR NOT max(near::INT) FILTER (WHERE interface = 'mean') OVER () = 1) AS selected FROM nr""")
def rich_interface_selection(spark, sf_dir):
    """ML11: one interface for all aspects, by the mean gain in average precision; of near ties the simplest."""
    from larkspur.operators.lexical import select_interface

    b = grid(spark, sf_dir, "b").select("row_uid", "aspect", "sentiment", _C("score").alias("y"))
    both = grid(spark, sf_dir, "a").join(b, ["row_uid", "aspect", "sentiment"])
    cells = F.array(*(F.struct(F.lit(n).alias("interface"), c.alias("s")) for n, c in (("D", _C("score")), ("max", F.greatest("score", "y")), ("mean", (_C("score") + _C("y")) / 2))))
    scored = both.select("aspect", "target", F.explode(cells).alias("c")).select("aspect", "target", "c.*")
    return select_interface(M.average_precision(scored, "s", "target", "interface", "aspect"), "D", ["mean", "max"])
