"""Decoders (DK1-DK10, DK15-DK16, W1)."""

from pyspark.sql import functions as F

from larkspur.operators import decode as D
from larkspur.operators import metrics as M
from larkspur.plans.adapter import grid, with_views
from larkspur.queries.registry import GATE, SECOND, query

_R = with_views("ranked_a")
_OUT = "SELECT row_uid, aspect, sentiment FROM {} WHERE {}"


def _on(frame):
    return frame.where("p = 1").select("row_uid", "aspect", "sentiment")


@query(_R + _OUT.format("grid_a", "score >= 0.5"))
def decode_pair(spark, sf_dir):
    """DK1."""
    return _on(D.independent(grid(spark, sf_dir), GATE))


@query(_R + ", h AS (SELECT *, row_number() OVER (PARTITION BY row_uid, aspect ORDER BY score DESC, ord) AS k FROM grid_a) " + _OUT.format("h", "k = 1 AND score >= 0.5"))
def decode_hierarchical(spark, sf_dir):
    """DK2, JN13."""
    return _on(D.hierarchical(grid(spark, sf_dir), GATE))


@query(_R + _OUT.format("ranked_a", "rn = 1 AND aspect_score >= 0.5"))
def decode_two_stage(spark, sf_dir):
    """DK3, W1."""
    return _on(D.two_stage(grid(spark, sf_dir), GATE))


@query(_R + ", m AS (SELECT *, max(sentiment_score) OVER (PARTITION BY row_uid, aspect) AS top FROM ranked_a) " + _OUT.format("m", "aspect_score >= 0.5 AND (sentiment_score >= 0.6 OR (top < 0.6 AND rn = 1))"))
def decode_multi(spark, sf_dir):
    """DK4."""
    return _on(D.multi_sentiment(grid(spark, sf_dir), GATE, SECOND))


@query(_R + _OUT.format("ranked_a", "aspect_score >= 0.5 AND rn <= 2"))
def decode_topk(spark, sf_dir):
    """DK5."""
    return _on(D.top_k(grid(spark, sf_dir), GATE, 2))


@query(_R + _OUT.format("ranked_a", "aspect_score >= 0.5 AND (rn = 1 OR (rn = 2 AND sentiment_score >= 0.6))"))
def decode_capped_two(spark, sf_dir):
    """DK6."""
    return _on(D.capped_two(grid(spark, sf_dir), GATE, SECOND))


@query(_R + ", m AS (SELECT *, max(target) OVER (PARTITION BY row_uid, aspect) AS h FROM ranked_a) " + _OUT.format("m", "h = 1 AND (rn = 1 OR (rn = 2 AND sentiment_score >= 0.6))"))
def decode_oracle_gate(spark, sf_dir):
    """DK7."""
    return _on(D.oracle_gate(grid(spark, sf_dir), SECOND))


@query(_R + "SELECT sentiment, count(*) AS n FROM ranked_a WHERE rn = 1 OR (rn = 2 AND sentiment_score >= 0.6) GROUP BY sentiment")
def decode_sentiment_only(spark, sf_dir):
    """DK8."""
    return D.sentiment_only(grid(spark, sf_dir), SECOND).where("p = 1").groupBy("sentiment").agg(F.count("*").alias("n"))


@query(with_views("grid_a") + """, a AS (SELECT *, row_number() OVER (PARTITION BY row_uid ORDER BY score DESC, aspect, ord) AS rb, row_number() OVER (PARTITION BY row_uid, aspect ORDER BY score DESC, ord) AS k FROM grid_a),
b AS (SELECT *, (score >= 0.8 OR rb = 1) AND k <= 1 AS hit FROM a), c AS (SELECT *, sum(hit::INT) OVER (PARTITION BY row_uid ORDER BY rb ROWS UNBOUNDED PRECEDING) AS m FROM b) SELECT row_uid, aspect, sentiment FROM c WHERE hit AND m <= 3""")
def decode_ensure_one(spark, sf_dir):
    """DK9."""
    return _on(D.ensure_one(grid(spark, sf_dir), 0.8))


@query(with_views("ranked_a") + """SELECT row_uid, aspect, coalesce(max(CASE WHEN rn = 1 AND sentiment_score >= 0.4 THEN sentiment END), 'neutral') AS sentiment FROM ranked_a WHERE aspect_score >= 0.7 GROUP BY row_uid, aspect""")
def decode_lookup(spark, sf_dir):
    """DK10."""
    return D.lookup(grid(spark, sf_dir), 0.7, 0.4)


_SUM = "round(coalesce(sum(target * {0})::DOUBLE / nullif(sum({0}), 0), 0), 9)"


@query(_R + """, d AS (SELECT target, (score >= 0.5)::INT AS p1, (rn = 1 AND aspect_score >= 0.5)::INT AS p2, (aspect_score >= 0.5 AND (rn = 1 OR (rn = 2 AND sentiment_score >= 0.6)))::INT AS p3, (aspect_score >= 0.5 AND rn <= 2)::INT AS p4 FROM ranked_a),
u AS (SELECT 'pair' AS decoder, target, p1 AS p FROM d UNION ALL SELECT 'two_stage', target, p2 FROM d UNION ALL SELECT 'capped_two', target, p3 FROM d UNION ALL SELECT 'top_2', target, p4 FROM d)
SELECT decoder, round(sum(target * p)::DOUBLE / sum(p), 9) AS precision, round(sum(target * p)::DOUBLE / sum(target), 9) AS recall, round(2.0 * sum(target * p) / (sum(p) + sum(target)), 9) AS f1, sum(target * p)::BIGINT AS tp, sum((1 - target) * p)::BIGINT AS fp, sum(target * (1 - p))::BIGINT AS fn FROM u GROUP BY decoder""")
def decoder_comparison(spark, sf_dir):
    """DK15, DK16, AG39: four decoders over one ranked grid."""
    g = D.ranked(grid(spark, sf_dir))
    gate, rn = F.col("aspect_score") >= GATE, F.col("rn")
    cells = F.array(*(F.struct(F.lit(n).alias("decoder"), c.cast("int").alias("p")) for n, c in (("pair", F.col("score") >= GATE), ("two_stage", (rn == 1) & gate), ("capped_two", gate & ((rn == 1) | ((rn == 2) & (F.col("sentiment_score") >= SECOND)))), ("top_2", gate & (rn <= 2)))))
    return M.pooled(g.select("target", F.explode(cells).alias("d")).select("target", "d.*"), "decoder")
