"""Threshold sweeps and selection (W3-W6, DK11-DK14, DK17-DK18, DK22)."""

from pyspark.sql import functions as F

from larkspur.operators import decode as D
from larkspur.operators import metrics as M
from larkspur.operators import sweep as W
from larkspur.plans.adapter import grid, hash_bucket, table, with_views
from larkspur.queries.registry import query

_V = with_views("grid_a")
#: Sweeps run on the validation split, as calibration does.
_CAL = ", c AS (SELECT * FROM grid_a WHERE split = 'validation')"
# in SQL: of each distinct score the sums of its events, and of each threshold the sums at or above it
_SWEEP = """, th AS (SELECT DISTINCT round(t, 12) AS threshold FROM (SELECT (s + lead(s) OVER (ORDER BY s)) / 2 AS t FROM (SELECT DISTINCT s FROM ev) UNION ALL SELECT i / 100.0::DOUBLE FROM range(1, 100) r(i)) WHERE t BETWEEN 0 AND 1),
w AS (SELECT *, sum(n) OVER x AS k, sum(tp) OVER x AS q FROM ev WINDOW x AS (PARTITION BY row_uid ORDER BY s DESC, o1, o2 ROWS UNBOUNDED PRECEDING)),
e AS (SELECT s, sum(n) AS n, sum(tp) AS tp, sum(coalesce(2.0::DOUBLE * q / nullif(g + k, 0), 0) - coalesce(2.0::DOUBLE * (q - tp) / nullif(g + k - n, 0), 0)) AS d, sum((g = 0 AND k = n AND n > 0)::INT) AS fr, count(*) AS gr FROM w GROUP BY s),
m AS (SELECT threshold, kind, sum(n) OVER y AS n, sum(tp) OVER y AS tp, sum(d) OVER y AS d, sum(fr) OVER y AS fr, sum(gr) OVER y AS gr FROM (SELECT s AS threshold, 0 AS kind, n, tp, d, fr, gr FROM e UNION ALL SELECT threshold, 1, 0, 0, 0, 0, 0 FROM th) WINDOW y AS (ORDER BY threshold DESC, kind ROWS UNBOUNDED PRECEDING)),
tot AS (SELECT sum(target) AS g, count(DISTINCT row_uid) AS r FROM c),
sw AS (SELECT threshold, coalesce(2.0 * tp / nullif(n + g, 0), 0)::DOUBLE AS f1, round(d / r, 12) AS sf, coalesce(tp::DOUBLE / nullif(n, 0), 0) AS pr, fr * 100.0::DOUBLE / r AS fp, n, tp, gr FROM m, tot WHERE kind = 1)"""
_OUT = " SELECT threshold, round(f1, 9) AS pair_micro_f1, round(sf, 9) AS pair_samples_f1, round(pr, 9) AS pair_micro_precision, round(fp, 9) AS fp_rows_per_100, n::BIGINT AS predicted, tp::BIGINT AS tp, gr::BIGINT AS groups FROM sw"
_BEST = " ORDER BY f1 DESC, sf DESC, pr DESC, fp, threshold DESC LIMIT 1"
_EV_PAIR = ", ev AS (SELECT row_uid, score AS s, 1 AS n, target AS tp, sum(target) OVER (PARTITION BY row_uid) AS g, aspect AS o1, ord AS o2 FROM c)"
_EV_HIER = ", ev AS (SELECT row_uid, score AS s, 1 AS n, target AS tp, g, aspect AS o1, 0 AS o2 FROM (SELECT *, sum(target) OVER (PARTITION BY row_uid) AS g, row_number() OVER (PARTITION BY row_uid, aspect ORDER BY score DESC, ord) AS rn FROM c) WHERE rn = 1)"
_EV_TWO = ", ev AS (SELECT row_uid, aspect_score AS s, 1 AS n, target AS tp, g, aspect AS o1, 0 AS o2 FROM (SELECT *, sum(target) OVER (PARTITION BY row_uid) AS g, row_number() OVER (PARTITION BY row_uid, aspect ORDER BY sentiment_score DESC, ord) AS rn FROM c) WHERE rn = 1)"
_EV_GROUP = """, d AS (SELECT *, row_number() OVER (PARTITION BY row_uid, aspect ORDER BY sentiment_score DESC, ord) AS rn FROM c), gr0 AS (SELECT row_uid, aspect, aspect_score, sum((rn <= 2)::INT) AS n, sum((rn <= 2)::INT * target) AS tp, sum(target) AS ng FROM d GROUP BY ALL),
ev AS (SELECT row_uid, aspect_score AS s, n, tp, sum(ng) OVER (PARTITION BY row_uid) AS g, aspect AS o1, 0 AS o2 FROM gr0)"""


#: The same by fold: events `ev` and calibration rows `c2` have a column fold; `best` has each fold's choice.
_BY_FOLD = """, th AS (SELECT DISTINCT fold, round(t, 12) AS threshold FROM (SELECT fold, (s + lead(s) OVER (PARTITION BY fold ORDER BY s)) / 2 AS t FROM (SELECT DISTINCT fold, s FROM ev) UNION ALL SELECT fold, i / 100.0::DOUBLE FROM (SELECT DISTINCT fold FROM ev), range(1, 100) r(i)) WHERE t BETWEEN 0 AND 1),
w AS (SELECT *, sum(n) OVER x AS k, sum(tp) OVER x AS q FROM ev WINDOW x AS (PARTITION BY fold, row_uid ORDER BY s DESC, o1, o2 ROWS UNBOUNDED PRECEDING)),
e AS (SELECT fold, s, sum(n) AS n, sum(tp) AS tp, sum(coalesce(2.0::DOUBLE * q / nullif(g + k, 0), 0) - coalesce(2.0::DOUBLE * (q - tp) / nullif(g + k - n, 0), 0)) AS d, sum((g = 0 AND k = n AND n > 0)::INT) AS fr, count(*) AS gr FROM w GROUP BY fold, s),
m AS (SELECT fold, threshold, kind, sum(n) OVER y AS n, sum(tp) OVER y AS tp, sum(d) OVER y AS d, sum(fr) OVER y AS fr, sum(gr) OVER y AS gr FROM (SELECT fold, s AS threshold, 0 AS kind, n, tp, d, fr, gr FROM e UNION ALL SELECT fold, threshold, 1, 0, 0, 0, 0, 0 FROM th) WINDOW y AS (PARTITION BY fold ORDER BY threshold DESC, kind ROWS UNBOUNDED PRECEDING)),
tot AS (SELECT fold, sum(target) AS g, count(DISTINCT row_uid) AS r FROM c2 GROUP BY fold),
sw AS (SELECT fold, threshold, coalesce(2.0 * tp / nullif(n + g, 0), 0)::DOUBLE AS f1, round(d / r, 12) AS sf, coalesce(tp::DOUBLE / nullif(n, 0), 0) AS pr, fr * 100.0::DOUBLE / r AS fp, n, tp, gr FROM m JOIN tot USING (fold) WHERE kind = 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, sf DESC, pr DESC, fp, threshold DESC) AS kk FROM sw) WHERE kk = 1)"""
_EV_PAIR_FOLD = ", ev AS (SELECT fold, row_uid, score AS s, 1 AS n, target AS tp, sum(target) OVER (PARTITION BY fold, row_uid) AS g, aspect AS o1, ord AS o2 FROM c2)"
_EV_TWO_FOLD = ", ev AS (SELECT fold, row_uid, aspect_score AS s, 1 AS n, target AS tp, g, aspect AS o1, 0 AS o2 FROM (SELECT *, sum(target) OVER (PARTITION BY fold, row_uid) AS g, row_number() OVER (PARTITION BY fold, row_uid, aspect ORDER BY sentiment_score DESC, ord) AS rn FROM c2) WHERE rn = 1)"


def _crossfit(name: str, events: str, predicted: str) -> str:
    """SQL: each part's counts under the threshold that the other parts chose."""
    return _V + f""", c AS (SELECT *, (('0x' || substr(sha256(row_uid || '|part'), 1, 16))::UBIGINT % 5)::INT AS part, row_number() OVER (PARTITION BY row_uid, aspect ORDER BY sentiment_score DESC, ord) AS rk FROM grid_a WHERE split = 'validation'),
c2 AS (SELECT f::INT AS fold, c.* FROM c, range(0, 5) r(f) WHERE part <> f){events}{_BY_FOLD}, h AS (SELECT c.part, c.target, ({predicted})::INT AS p FROM c JOIN best ON best.fold = c.part)
SELECT '{name}' AS decoder, part, round(coalesce(sum(target * p)::DOUBLE / nullif(sum(p), 0), 0), 9) AS precision, round(coalesce(sum(target * p)::DOUBLE / nullif(sum(target), 0), 0), 9) AS recall, round(coalesce(2.0::DOUBLE * sum(target * p) / nullif(sum(p + target), 0), 0), 9) AS f1,
  sum(target * p)::BIGINT AS tp, sum((1 - target) * p)::BIGINT AS fp, sum(target * (1 - p))::BIGINT AS fn FROM h GROUP BY part"""


def _cal(spark, sf_dir):
    return grid(spark, sf_dir, split="validation")


@query(_V + _CAL + _EV_PAIR + _SWEEP + _OUT)
def sweep_pairs(spark, sf_dir):
    """W3: every threshold of the independent decoder."""
    return W.pair_sweep(_cal(spark, sf_dir))


@query(_V + _CAL + _EV_HIER + _SWEEP + _OUT)
def sweep_hierarchical(spark, sf_dir):
    """W3."""
    return W.hierarchical_sweep(_cal(spark, sf_dir))


@query(_V + _CAL + _EV_TWO + _SWEEP + _OUT)
def sweep_two_stage(spark, sf_dir):
    """W3."""
    return W.two_stage_sweep(_cal(spark, sf_dir))


@query(_V + _CAL + _EV_GROUP + _SWEEP + _OUT.replace(" FROM sw", ", round(coalesce(n::DOUBLE / nullif(gr, 0), 0), 9) AS sentiments_per_aspect FROM sw"))
def sweep_groups(spark, sf_dir):
    """W4, W6: aspects enter with their two best sentiments."""
    return W.group_sweep(D.top_k(_cal(spark, sf_dir), 0.0, 2))


@query(_V + _CAL + _EV_PAIR + _SWEEP + _OUT + _BEST)
def select_pair_threshold(spark, sf_dir):
    """DK11."""
    return W.select(W.pair_sweep(_cal(spark, sf_dir)))


@query(_V + _CAL + _EV_TWO + _SWEEP + _OUT + _BEST)
def select_two_stage_threshold(spark, sf_dir):
    """DK11, DK17."""
    return W.select(W.two_stage_sweep(_cal(spark, sf_dir)))


@query(_V + _CAL.replace("'validation'", "'validation' AND aspect <> 'Size: LARGE'") + _EV_PAIR + _SWEEP + _OUT + _BEST)
def select_strict_seen(spark, sf_dir):
    """DK11: thresholds from seen aspects only."""
    return W.select(W.pair_sweep(_cal(spark, sf_dir).where("aspect <> 'Size: LARGE'")))


@query(with_views("grid_a", "aspect_dim") + _CAL + ", c2 AS (SELECT a.aspect AS fold, c.* FROM c, aspect_dim a WHERE c.aspect <> a.aspect)" + _EV_PAIR_FOLD + _BY_FOLD + _OUT.replace("SELECT threshold", "SELECT fold, threshold").replace("FROM sw", "FROM best"))
def select_threshold_by_fold(spark, sf_dir):
    """DK11 for all folds at once: the fold is a column of one sweep."""
    from larkspur.plans.taxonomy import ASPECTS, strings

    made = _cal(spark, sf_dir).withColumn("fold", F.explode(strings(ASPECTS))).where("aspect <> fold")
    return W.select(W.pair_sweep(made, "fold"), "fold")


@query(_V + _CAL + """, x AS (SELECT *, sum(target) OVER (PARTITION BY row_uid) AS g, row_number() OVER (PARTITION BY row_uid, aspect ORDER BY sentiment_score DESC, ord) AS rn FROM c),
o AS (SELECT *, sum((rn = 1)::INT) OVER (PARTITION BY row_uid) AS n1, sum((rn = 1 AND target = 1)::INT) OVER (PARTITION BY row_uid) AS t1 FROM x WHERE aspect_score >= 0.5),
s2 AS (SELECT row_uid, g, n1, t1, sentiment_score AS s, target, count(*) OVER z AS k, sum(target) OVER z AS q FROM o WHERE rn = 2 WINDOW z AS (PARTITION BY row_uid ORDER BY sentiment_score DESC, aspect ROWS UNBOUNDED PRECEDING)),
e AS (SELECT s, count(*) AS n, sum(target) AS tp, sum(2.0::DOUBLE * (t1 + q) / (g + n1 + k) - 2.0::DOUBLE * (t1 + q - target) / (g + n1 + k - 1)) AS d FROM s2 GROUP BY s),
th AS (SELECT DISTINCT round(t, 12) AS threshold FROM (SELECT (s + lead(s) OVER (ORDER BY s)) / 2 AS t FROM e UNION ALL SELECT i / 100.0::DOUBLE FROM range(1, 100) r(i)) WHERE t BETWEEN 0 AND 1 UNION ALL SELECT max(s) + 1e-9 FROM e),
m AS (SELECT threshold, kind, sum(n) OVER y AS n, sum(tp) OVER y AS tp, sum(d) OVER y AS d FROM (SELECT s AS threshold, 0 AS kind, n, tp, d FROM e UNION ALL SELECT threshold, 1, 0, 0, 0 FROM th) WINDOW y AS (ORDER BY threshold DESC, kind ROWS UNBOUNDED PRECEDING)),
b AS (SELECT sum(n) AS n0, sum(t) AS t0, sum(2.0::DOUBLE * t / (g + n)) AS s0 FROM (SELECT row_uid, g, count(*) AS n, sum(target) AS t FROM o WHERE rn = 1 GROUP BY ALL)), tot AS (SELECT sum(target) AS gg, count(DISTINCT row_uid) AS r FROM c),
z AS (SELECT threshold, 2.0 * (tp + t0) / (n + n0 + gg) AS f1, round(round(d / r, 12) + s0 / r, 12) AS sf, (tp + t0)::DOUBLE / (n + n0) AS pr, n::DOUBLE / n0 AS sr FROM m, b, tot WHERE kind = 1)
SELECT threshold, round(f1, 9) AS pair_micro_f1, round(sf, 9) AS pair_samples_f1, round(pr, 9) AS pair_micro_precision, round(sr, 9) AS second_rate FROM z ORDER BY f1 DESC, sf DESC, pr DESC, sr, threshold DESC LIMIT 1""")
def select_runner_up(spark, sf_dir):
    """DK12."""
    order = ["pair_micro_f1 desc", "pair_samples_f1 desc", "pair_micro_precision desc", "second_rate asc", "threshold desc"]
    return W.select(W.runner_up_sweep(_cal(spark, sf_dir), 0.5), order=order)


@query(_V + _CAL + """, qs AS (SELECT DISTINCT unnest(quantile_cont(sentiment_score, [""" + ", ".join(str(i / 16) for i in range(17)) + """])) AS fold FROM c), rk AS (SELECT *, row_number() OVER (PARTITION BY row_uid, aspect ORDER BY sentiment_score DESC, ord) AS k1 FROM c),
c2 AS (SELECT fold, rk.*, (k1 = 1 OR sentiment_score >= fold)::INT AS pp FROM rk, qs), g0 AS (SELECT fold, row_uid, aspect, aspect_score, sum(pp) AS n, sum(pp * target) AS tp, sum(target) AS ng FROM c2 GROUP BY ALL),
ev AS (SELECT fold, row_uid, aspect_score AS s, n, tp, sum(ng) OVER (PARTITION BY fold, row_uid) AS g, aspect AS o1, 0 AS o2 FROM g0)""" + _BY_FOLD + """ SELECT threshold, round(f1, 9) AS pair_micro_f1, round(sf, 9) AS pair_samples_f1, round(pr, 9) AS pair_micro_precision, round(fp, 9) AS fp_rows_per_100, n::BIGINT AS predicted, tp::BIGINT AS tp, gr::BIGINT AS groups, round(coalesce(n::DOUBLE / nullif(gr, 0), 0), 9) AS sentiments_per_aspect, round(fold, 9) AS second
FROM sw ORDER BY f1 DESC, sf DESC, pr DESC, fp, coalesce(n::DOUBLE / nullif(gr, 0), 0), threshold DESC, fold DESC LIMIT 1""")
def select_joint(spark, sf_dir):
    """DK13: sentiment thresholds at quantiles, each with its own sweep of aspect thresholds, in one job."""
    cal = _cal(spark, sf_dir)
    q = cal.agg(F.percentile("sentiment_score", F.array(*(F.lit(i / 16) for i in range(17)))).alias("q")).first()["q"]
    marked = cal.withColumn("second", F.explode(F.array(*(F.lit(x) for x in sorted(set(q))))))
    made = D.multi_sentiment(marked, 0.0, F.col("second"))
    order = [*W.ORDER[:4], "sentiments_per_aspect asc", "threshold desc", "second desc"]
    return W.select(W.group_sweep(made, "second"), order=order)


@query(_V + """, a AS (SELECT row_uid, aspect, aspect_score AS s, max(target) AS t FROM grid_a GROUP BY ALL), b AS (SELECT aspect, s, sum(t) AS t, count(*) AS n FROM a GROUP BY ALL),
c AS (SELECT *, sum(t) OVER x AS ct, sum(n) OVER x AS cn, sum(t) OVER (PARTITION BY aspect) AS g FROM b WINDOW x AS (PARTITION BY aspect ORDER BY s DESC ROWS UNBOUNDED PRECEDING)), f AS (SELECT aspect, s, 2.0::DOUBLE * ct / (cn + g) AS f1 FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY aspect ORDER BY f1 DESC, s DESC) AS k FROM f) SELECT aspect, s AS threshold, round(f1, 9) AS f1 FROM r WHERE k = 1""")
def select_f1_boundary(spark, sf_dir):
    """W5, by aspect."""
    return W.f1_boundary(D.oracle_lines(grid(spark, sf_dir)), "aspect_score", "target", "aspect")


@query(_V + """, t AS (SELECT i / 20.0::DOUBLE AS threshold FROM range(1, 20) r(i)), x AS (SELECT threshold, sum((score >= threshold AND target = 1)::INT) AS tp, sum((score >= threshold)::INT) AS n, sum(target) AS g FROM grid_a, t GROUP BY threshold)
SELECT threshold, tp::BIGINT AS tp, n::BIGINT AS n, g::BIGINT AS g, round(coalesce(tp::DOUBLE / nullif(n, 0), 0), 9) AS precision, round(tp::DOUBLE / g, 9) AS recall, round(2.0 * tp / (n + g), 9) AS f1 FROM x""")
def grid_thresholds(spark, sf_dir):
    """DK18, DK22: a short list of thresholds as conditional sums, one pass and no explode of the grid."""
    return W.grid_sweep(grid(spark, sf_dir), F.col("score"), [i / 20 for i in range(1, 20)])


@query(f"""SELECT * FROM ({_crossfit("pair", _EV_PAIR_FOLD, "score >= threshold")}) UNION ALL SELECT * FROM ({_crossfit("two_stage", _EV_TWO_FOLD, "rk = 1 AND aspect_score >= threshold")})""")
def crossfit_compare(spark, sf_dir):
    """DK14: thresholds chosen on four fifths and used on the fifth, for two decoders, all folds in one job."""
    base = _cal(spark, sf_dir).withColumn("part", hash_bucket(F.concat("row_uid", F.lit("|part")), 5))
    train = base.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("part <> fold")
    out = []
    for name, sweep, decode in (("pair", W.pair_sweep, D.independent), ("two_stage", W.two_stage_sweep, D.two_stage)):
        chosen = W.select(sweep(train, "fold"), "fold").select(F.col("fold").alias("part"), F.col("threshold").alias("t"))
        held = base.join(F.broadcast(chosen), "part")  # five rows
        out.append(M.pooled(decode(held, F.col("t")), "part").withColumn("decoder", F.lit(name)))
    return out[0].unionByName(out[1])


@query("""WITH x AS (SELECT n_chars AS s, quality AS t FROM labels JOIN documents USING (doc_id)), b AS (SELECT s, sum(t) AS t, count(*) AS n FROM x GROUP BY s),
c AS (SELECT *, sum(t) OVER w AS ct, sum(n) OVER w AS cn, sum(t) OVER () AS g FROM b WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) SELECT s AS threshold, round(2.0 * ct / (cn + g), 9) AS f1 FROM c ORDER BY 2.0::DOUBLE * ct / (cn + g) DESC, s DESC LIMIT 1""")
def select_f1_labels(spark, sf_dir):
    """W5 on labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return W.f1_boundary(table(spark, sf_dir, "labels").join(docs, "doc_id"), "n_chars", "quality")
