"""Grids, joins, contracts and the score cache (JN, SC11-SC12, ST3-ST6)."""

from pyspark.sql import functions as F

from larkspur.operators import contracts as K
from larkspur.operators import grids as G
from larkspur.plans.adapter import grid, reviews, table, with_views
from larkspur.queries.registry import query

_T = with_views("grid_a")


@query(_T + "SELECT row_uid, aspect, sentiment, target FROM grid_a")
def pair_grid(spark, sf_dir):
    """JN1, JN5, JN6: reviews by candidate pairs, the truth table."""
    return G.pair_grid(reviews(spark, sf_dir))


@query(_T + "SELECT row_uid, aspect, sentiment, target FROM grid_a WHERE aspect = 'Offer: PROMO'")
def target_aspect_grid(spark, sf_dir):
    """JN2: one aspect by three sentiments."""
    return G.pair_grid(reviews(spark, sf_dir), ("Offer: PROMO",))


@query(_T + "SELECT row_uid, aspect, sentiment FROM grid_a")
def unlabelled_grid(spark, sf_dir):
    """JN4: no labels in the schema."""
    return K.require_forbidden(G.pair_grid(reviews(spark, sf_dir), labelled=False), "target", "labels")


@query(_T + "SELECT row_uid, aspect, max(target) AS target FROM grid_a GROUP BY row_uid, aspect")
def aspect_grid(spark, sf_dir):
    """JN3."""
    return G.aspect_grid(reviews(spark, sf_dir))


@query(_T + ", h AS (SELECT *, max(target) OVER (PARTITION BY row_uid, aspect) AS h FROM grid_a) SELECT row_uid, aspect, sentiment, target FROM h WHERE h = 1")
def sentiment_grid_gold_only(spark, sf_dir):
    """JN3, JN13: a semi join with a review's own aspects."""
    return G.sentiment_grid(reviews(spark, sf_dir))


@query(_T + "SELECT row_uid, aspect, sentiment, target, aspect_score FROM grid_a")
def score_join(spark, sf_dir):
    """JN7, JN8: aspect scores many to one; a missing one is an error."""
    scored = grid(spark, sf_dir)
    scores = scored.where("ord = 0").select("row_uid", "aspect", "aspect_score")
    return G.join_scores(scored.select("row_uid", "aspect", "sentiment", "target"), scores, ["row_uid", "aspect"], "aspect_score")


@query("""SELECT o_orderkey AS key, 'missing' AS problem FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)
UNION ALL SELECT l_orderkey, 'unexpected' FROM lineitem WHERE l_linenumber = 1 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def coverage_anti_join(spark, sf_dir):
    """JN14, ST5, SK4."""
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return K.coverage(expected, table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("key")), "key")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus || (l_quantity::INT % 10) AS claim FROM lineitem) SELECT l_orderkey, l_linenumber, claim, length(claim)::INT AS score FROM c""")
def unique_claims(spark, sf_dir):
    """JN15, SC12: each distinct claim is scored once."""
    claims = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus", (F.col("l_quantity").cast("int") % 10).cast("string")).alias("claim"))
    return G.unique_claims(claims, ["claim"], F.length("claim"))


@query(with_views("grid_a", "grid_b") + "SELECT a.row_uid, a.aspect, a.sentiment, a.aspect_score, b.sentiment_score FROM grid_a a JOIN grid_b b USING (row_uid, aspect, sentiment)")
def stage_composition(spark, sf_dir):
    """JN16: aspect scores of one system with sentiment scores of another."""
    return G.compose(grid(spark, sf_dir, "a"), grid(spark, sf_dir, "b")).select("row_uid", "aspect", "sentiment", "aspect_score", "sentiment_score")


@query(with_views("grid_a", "grid_b") + """SELECT row_uid, aspect, sentiment, 'N' AS condition, sentiment_score FROM grid_b WHERE aspect <> 'Size: LARGE' UNION ALL SELECT row_uid, aspect, sentiment, 'N', sentiment_score FROM grid_a WHERE aspect = 'Size: LARGE'""")
def nd_share(spark, sf_dir):
    """JN17, ST3: seen rows of one condition serve another."""
    columns = ["row_uid", "aspect", "sentiment", "condition", "sentiment_score"]
    n, d = grid(spark, sf_dir, "a").withColumn("condition", F.lit("N")).select(columns), grid(spark, sf_dir, "b").withColumn("condition", F.lit("D")).select(columns)
    return G.share_seen(n, d, "Size: LARGE")


@query(with_views("grid_a", "grid_b") + "SELECT a.row_uid, a.aspect, a.sentiment, a.target, a.score, b.score AS other_score FROM grid_a a JOIN grid_b b USING (row_uid, aspect, sentiment)")
def aligned_pairs(spark, sf_dir):
    """JN9, JN11: rows of two systems by key, equal targets or an error."""
    key = ["row_uid", "aspect", "sentiment"]
    keep = lambda s: grid(spark, sf_dir, s).select(*key, "target", "score")
    return K.aligned(keep("a"), keep("b"), key, "target")


@query(with_views("grid_a") + """, m AS (SELECT row_uid, aspect, max(CASE WHEN ord = 0 THEN score END) AS negative, max(CASE WHEN ord = 1 THEN score END) AS neutral, max(CASE WHEN ord = 2 THEN score END) AS positive FROM grid_a GROUP BY ALL) SELECT * FROM m""")
def score_matrix(spark, sf_dir):
    """JN19: one row with a column for each sentiment."""
    return grid(spark, sf_dir).groupBy("row_uid", "aspect").pivot("sentiment", ["negative", "neutral", "positive"]).agg(F.max("score"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    """ST6."""
    return K.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag DESC, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1""")
def keep_first(spark, sf_dir):
    """ST4: the first row of each key in a total order."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_returnflag"), "l_linenumber", "l_partkey"))
    return table(spark, sf_dir, "lineitem").withColumn("n", n).where("n = 1").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH c AS (SELECT l_returnflag || l_linestatus || (l_quantity::INT % 10) AS claim FROM lineitem), k AS (SELECT claim, count(*) AS n FROM c GROUP BY claim)
SELECT sum(n)::BIGINT AS requests, count(*) AS unique_keys, sum((claim LIKE 'A%')::INT)::BIGINT AS hits, sum((claim NOT LIKE 'A%')::INT)::BIGINT AS misses FROM k""")
def cache_hit_plan(spark, sf_dir):
    """SC11-SC13: requests, distinct keys, hits and misses against a table of known scores."""
    claims = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus", (F.col("l_quantity").cast("int") % 10).cast("string")).alias("claim"))
    held = claims.where("claim like 'A%'").distinct().withColumn("hit", F.lit(1))
    per = claims.groupBy("claim").agg(F.count("*").alias("n")).join(held, "claim", "left")
    return per.agg(F.sum("n").alias("requests"), F.count("*").alias("unique_keys"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.sum(1 - F.coalesce("hit", F.lit(0))).alias("misses"))


@query("""WITH k AS (SELECT DISTINCT ON (l_suppkey) l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey % 3 <> 0 ORDER BY l_suppkey, l_orderkey, l_linenumber) SELECT * FROM k""")
def first_missing_positions(spark, sf_dir):
    """FL13: the first position of each key that isn't known yet."""
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    made = table(spark, sf_dir, "lineitem").join(known, "l_suppkey", "left_anti").groupBy("l_suppkey").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("f"))
    return made.select("l_suppkey", "f.*")
