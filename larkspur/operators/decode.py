"""Decoders: scored grids (row_uid, aspect, sentiment, ord, aspect_score, sentiment_score, score) to a prediction column p.

Thresholds are inclusive. Within a review and aspect, sentiments rank by score, then in canonical order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = ["row_uid", "aspect"]


def ranked(grid: DataFrame, by: str = "sentiment_score", name: str = "rn") -> DataFrame:
    """With the sentiment's rank within its review and aspect; grids that come with rn, by sentiment score, need no window."""
    if by == "sentiment_score" and name in grid.columns:
        return grid
    return grid.withColumn(name, F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc(by), "ord")))


def independent(grid: DataFrame, threshold: float | Column) -> DataFrame:
    return grid.withColumn("p", (F.col("score") >= threshold).cast("int"))


def hierarchical(grid: DataFrame, threshold: float | Column) -> DataFrame:
    """The best sentiment of each aspect, where its score reaches the threshold."""
    return ranked(grid, "score").withColumn("p", ((F.col("rn") == 1) & (F.col("score") >= threshold)).cast("int"))


def two_stage(grid: DataFrame, threshold: float | Column) -> DataFrame:
    """The best sentiment of each aspect whose own score reaches the threshold."""
    return ranked(grid).withColumn("p", ((F.col("rn") == 1) & (F.col("aspect_score") >= threshold)).cast("int"))


def multi_sentiment(grid: DataFrame, gate: float | Column, threshold: float | Column) -> DataFrame:
    """All sentiments that reach the threshold, or else the best one, of each gated aspect.

    The best one is in either way: if any reaches the threshold, it does.
    """
    chosen = (F.col("sentiment_score") >= threshold) | (F.col("rn") == 1)
    return ranked(grid).withColumn("p", ((F.col("aspect_score") >= gate) & chosen).cast("int"))


def top_k(grid: DataFrame, gate: float | Column, k: int) -> DataFrame:
    return ranked(grid).withColumn("p", ((F.col("aspect_score") >= gate) & (F.col("rn") <= k)).cast("int"))


def sentiment_only(grid: DataFrame, second: float | Column) -> DataFrame:
    """The best sentiment, and the runner-up where it reaches the threshold, whatever the aspect's score."""
    return ranked(grid).withColumn("p", ((F.col("rn") == 1) | ((F.col("rn") == 2) & (F.col("sentiment_score") >= second))).cast("int"))


def capped_two(grid: DataFrame, gate: float | Column, second: float | Column) -> DataFrame:
    """As sentiment_only, for aspects whose score reaches the gate; never a third sentiment."""
    return sentiment_only(grid, second).withColumn("p", (F.col("p") * (F.col("aspect_score") >= gate).cast("int")).cast("int"))


def oracle_gate(grid: DataFrame, second: float | Column) -> DataFrame:
    """As sentiment_only, for aspects that the review has."""
    has = F.max("target").over(Window.partitionBy(*GROUP))
    return sentiment_only(grid, second).withColumn("p", (F.col("p") * has).cast("int"))


def ensure_one(grid: DataFrame, threshold: float | Column, per_aspect: int = 1, per_row: int = 3) -> DataFrame:
    """Pairs that reach the threshold, the best pair of a review in any case, capped by aspect and by review."""
    best = F.row_number().over(Window.partitionBy("row_uid").orderBy(F.desc("score"), "aspect", "ord"))
    within = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("score"), "ord"))
    marked = grid.withColumns({"rb": best, "rn": within})
    marked = marked.withColumn("on", ((F.col("score") >= threshold) | (F.col("rb") == 1)) & (F.col("rn") <= per_aspect))
    cap = F.sum(F.col("on").cast("int")).over(Window.partitionBy("row_uid").orderBy("rb").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("p", (F.col("on") & (cap <= per_row)).cast("int")).drop("rb", "on")


def lookup(grid: DataFrame, gate: float | Column, threshold: float | Column) -> DataFrame:
    """(row_uid, aspect, sentiment): each predicted aspect with its best sentiment, if that reaches the threshold, else neutral.

    Aspects and sentiments are of one ranked grid, which has one best sentiment for each aspect: no join is needed.
    """
    on = ranked(grid).where((F.col("rn") == 1) & (F.col("aspect_score") >= gate))
    return on.select(*GROUP, F.when(F.col("sentiment_score") >= threshold, F.col("sentiment")).otherwise("neutral").alias("sentiment"))


def sets(decoded: DataFrame, *carry: str) -> DataFrame:
    """(row_uid, gold, pred[, carry]): sorted pair texts of each review; every review has a row."""
    pair = F.concat("aspect", F.lit(" | "), "sentiment")
    gold = F.array_sort(F.collect_list(F.when(F.col("target") == 1, pair))).alias("gold")
    return decoded.groupBy("row_uid", *carry).agg(gold, F.array_sort(F.collect_list(F.when(F.col("p") == 1, pair))).alias("pred"))


def oracle_lines(grid: DataFrame) -> DataFrame:
    """Aspect rows of a grid: (row_uid, aspect, aspect_score, target of the aspect)."""
    return grid.groupBy("row_uid", "aspect", "aspect_score").agg(F.max("target").alias("target"))
