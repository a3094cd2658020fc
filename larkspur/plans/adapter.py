"""The test tables as reviews with labels and scores: one view, written alike in Spark and in SQL.

A review is an order; its gold pairs are the distinct (part type, return flag) of its lines; its split, and the scores of
each candidate, are rationals of SHA-256 prefixes, so that they are equal in every engine. Orders without lines are reviews
without labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.plans.taxonomy import ASPECTS, SENTIMENTS, strings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_bucket(key: Column, n: int) -> Column:
    """The first 8 bytes of SHA-256, big-endian, modulo n."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(n)).cast("int")


def prefix(digest: Column, at: int = 1) -> Column:
    """Eight hex digits of a digest, from place `at`, as a number."""
    return F.conv(F.substring(digest, at, 8), 16, 10).cast("long")


def split_name(bucket: Column) -> Column:
    return F.when(bucket <= 6, "train").when(bucket == 7, "validation").otherwise("test")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_uid, labels): sorted distinct (aspect, sentiment) of each order with lines; one shuffle on the order."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(F.col("p_type").isin("ECONOMY", "STANDARD"), "Grade: ").when(F.col("p_type") == "PROMO", "Offer: ").otherwise("Size: "), "p_type").alias("aspect"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.when(F.col("l_returnflag") == "A", "negative").when(F.col("l_returnflag") == "N", "neutral").otherwise("positive").alias("sentiment"))
    pair = F.struct("aspect", "sentiment")
    return lines.join(part, lines.l_partkey == part.p_partkey).groupBy("l_orderkey").agg(F.array_sort(F.collect_set(pair)).alias("labels"))


def reviews(spark: SparkSession, sf_dir: str, facts: bool = False) -> DataFrame:
    """(row_uid, split, labels[, org, industry, data_source]), a row for each order."""
    columns = ["o_orderkey", *(["o_custkey", "o_orderpriority"] if facts else [])]
    made = table(spark, sf_dir, "orders").select(*columns).join(gold(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    uid = F.col("o_orderkey").cast("string")
    none = F.array().cast("array<struct<aspect:string,sentiment:string>>")
    chosen = [uid.alias("row_uid"), split_name(hash_bucket(uid, 10)).alias("split"), F.coalesce("labels", none).alias("labels")]
    if facts:
        customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        made = made.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        chosen += [F.col("c_nationkey").alias("org"), F.col("c_mktsegment").alias("industry"), F.col("o_orderpriority").alias("data_source")]
    return made.select(*chosen)


def scored_grid(rows: DataFrame, salt: str = "a") -> DataFrame:
    """Every review with every candidate pair: row_uid, split, aspect, sentiment, ord, target, aspect_score, sentiment_score, score, rn.

    The product is an explode of the literal aspects, and of each one's sentiments, ranked in an array (rn): it needs no
    join, no window and no shuffle. Targets are set membership.
    """
    cell = rows.select("row_uid", "split", "labels", F.explode(strings(ASPECTS)).alias("aspect"))
    digest = lambda *parts: F.sha2(F.concat_ws("|", F.lit(salt), "row_uid", *parts), 256)
    own = F.transform(F.filter("labels", lambda x: x.aspect == F.col("aspect")), lambda x: x.sentiment)
    whole = cell.withColumn("own", own).withColumn("aspect_score", (prefix(digest("aspect")) % 6000 + 250 + 3500 * (F.size("own") > 0).cast("int")) / F.lit(10000.0))
    every = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(s).alias("sentiment"), F.array_contains("own", s).cast("int").alias("target"), digest("aspect", F.lit(s)).alias("d")) for k, s in enumerate(SENTIMENTS)))
    scored = F.transform(every, lambda x: F.struct(
        (-(prefix(x.d) % 6500 + 3000 * x.target)).alias("by"), x.ord.alias("ord"), x.sentiment.alias("sentiment"), x.target.alias("target"), (prefix(x.d, 9) % 6500 + 3000 * x.target).alias("score")))
    ranked = whole.select("row_uid", "split", "aspect", "aspect_score", F.posexplode(F.array_sort(scored)).alias("k", "c"))
    return ranked.select(
        "row_uid", "split", "aspect", "c.sentiment", "c.ord", "c.target", "aspect_score",
        (-F.col("c.by") / F.lit(10000.0)).alias("sentiment_score"), (F.col("c.score") / F.lit(10000.0)).alias("score"), (F.col("k") + 1).alias("rn"),
    )


def scored_columns(rows: DataFrame, *salts: str) -> DataFrame:
    """rows with the scored grid's numbers as columns, for work within reviews: no explode, no sort and no shuffle.

    Of aspect i and sentiment k: t_i_k is the target, <salt>_i the aspect's score, and <salt>_i_k a key that orders an aspect's
    sentiments as rn does, the greatest first; `key_score` gives the sentiment's score.
    """
    own = {(i, k): F.array_contains("labels", F.struct(F.lit(a).alias("aspect"), F.lit(s).alias("sentiment"))).cast("int") for i, a in enumerate(ASPECTS) for k, s in enumerate(SENTIMENTS)}
    made = rows.withColumns({f"t_{i}_{k}": c for (i, k), c in own.items()})
    digest = lambda salt, *parts: F.sha2(F.concat_ws("|", F.lit(salt), "row_uid", *map(F.lit, parts)), 256)
    held = {}
    for salt in salts:
        for i, a in enumerate(ASPECTS):
            has = F.greatest(*(F.col(f"t_{i}_{k}") for k in range(len(SENTIMENTS))))
            held[f"{salt}_{i}"] = (prefix(digest(salt, a)) % 6000 + 250 + 3500 * has) / F.lit(10000.0)
            for k, s in enumerate(SENTIMENTS):
                held[f"{salt}_{i}_{k}"] = (prefix(digest(salt, a, s)) % 6500 + 3000 * F.col(f"t_{i}_{k}")) * 4 + (len(SENTIMENTS) - 1 - k)
    return made.withColumns(held)


def key_score(key: Column) -> Column:
    return F.shiftright(key, 2) / F.lit(10000.0)


def grid(spark: SparkSession, sf_dir: str, salt: str = "a", split: str | None = None) -> DataFrame:
    rows = reviews(spark, sf_dir)
    return scored_grid(rows.where(F.col("split") == split) if split else rows, salt)


#: The same views in SQL, by name; each needs those that its text names.
SQL = {
    "aspect_dim": "SELECT * FROM (VALUES ('Grade: ECONOMY', 0), ('Grade: STANDARD', 1), ('Offer: PROMO', 2), ('Size: LARGE', 3), ('Size: MEDIUM', 4), ('Size: SMALL', 5)) t(aspect, a_ord)",
    "sentiment_dim": "SELECT * FROM (VALUES ('negative', 0), ('neutral', 1), ('positive', 2)) t(sentiment, ord)",
    "gold": """SELECT DISTINCT l_orderkey::VARCHAR AS row_uid,
  (CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'Grade: ' WHEN p_type = 'PROMO' THEN 'Offer: ' ELSE 'Size: ' END) || p_type AS aspect,
  CASE l_returnflag WHEN 'A' THEN 'negative' WHEN 'N' THEN 'neutral' ELSE 'positive' END AS sentiment
  FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "review": """SELECT o_orderkey::VARCHAR AS row_uid, c_nationkey AS org, c_mktsegment AS industry, o_orderpriority AS data_source,
  CASE WHEN b <= 6 THEN 'train' WHEN b = 7 THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 16))::UBIGINT % 10 AS b FROM orders) LEFT JOIN customer ON o_custkey = c_custkey""",
}
for _s in ("a", "b", "c"):
    SQL[f"grid_{_s}"] = f"""SELECT row_uid, split, aspect, sentiment, ord, target,
  ((('0x' || substr(d1, 1, 8))::UBIGINT::BIGINT % 6000) + 250 + 3500 * has) / 10000.0::DOUBLE AS aspect_score,
  ((('0x' || substr(d2, 1, 8))::UBIGINT::BIGINT % 6500) + 3000 * target) / 10000.0::DOUBLE AS sentiment_score,
  ((('0x' || substr(d2, 9, 8))::UBIGINT::BIGINT % 6500) + 3000 * target) / 10000.0::DOUBLE AS score
  FROM (SELECT r.row_uid, r.split, a.aspect, s.sentiment, s.ord, (g.row_uid IS NOT NULL)::INT AS target,
      (max((g.row_uid IS NOT NULL)::INT) OVER (PARTITION BY r.row_uid, a.aspect))::INT AS has,
      sha256('{_s}|' || r.row_uid || '|' || a.aspect) AS d1, sha256('{_s}|' || r.row_uid || '|' || a.aspect || '|' || s.sentiment) AS d2
    FROM review r CROSS JOIN aspect_dim a CROSS JOIN sentiment_dim s
    LEFT JOIN gold g ON g.row_uid = r.row_uid AND g.aspect = a.aspect AND g.sentiment = s.sentiment)"""
    SQL[f"ranked_{_s}"] = f"SELECT *, row_number() OVER (PARTITION BY row_uid, aspect ORDER BY sentiment_score DESC, ord) AS rn FROM grid_{_s}"
    SQL[f"pred_{_s}"] = f"SELECT *, (aspect_score >= 0.5 AND (rn = 1 OR (rn = 2 AND sentiment_score >= 0.6)))::INT AS p FROM ranked_{_s}"
_NEEDS = {"grid": ["aspect_dim", "sentiment_dim", "gold", "review"], "ranked": ["grid"], "pred": ["ranked"]}


def with_views(*names: str) -> str:
    """`WITH ...,` for SQL: the named views and those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        kind, _, salt = name.partition("_")
        for need in _NEEDS.get(kind, []) if salt in ("a", "b", "c") else []:
            add(need if need in SQL else f"{need}_{salt}")
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in order)
