"""Candidate grids and the joins of scores to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.plans.taxonomy import ASPECTS, SENTIMENTS, candidates, strings

_C = F.col
PAIR = ["row_uid", "aspect", "sentiment"]


def pair_grid(rows: DataFrame, aspects=ASPECTS, sentiments=SENTIMENTS, labelled: bool = True) -> DataFrame:
    """Every review with every candidate pair: an explode of literals, not a join. Unlabelled grids carry no target."""
    made = rows.select("row_uid", "labels", F.explode(candidates(tuple(aspects), tuple(sentiments))).alias("c"))
    target = F.array_contains("labels", F.struct(_C("c.aspect").alias("aspect"), _C("c.sentiment").alias("sentiment"))).cast("int").alias("target")
    return made.select("row_uid", "c.aspect", "c.sentiment", *([target] if labelled else []))


def aspect_grid(rows: DataFrame, aspects=ASPECTS) -> DataFrame:
    made = rows.select("row_uid", "labels", F.explode(strings(aspects)).alias("aspect"))
    return made.select("row_uid", "aspect", F.exists("labels", lambda x: x.aspect == _C("aspect")).cast("int").alias("target"))


def sentiment_grid(rows: DataFrame, aspects=ASPECTS, gold_only: bool = True) -> DataFrame:
    """Pairs of a review's own aspects only, or of all."""
    made = pair_grid(rows, aspects)
    return made.join(aspect_grid(rows, aspects).where("target = 1").select("row_uid", "aspect"), ["row_uid", "aspect"], "left_semi") if gold_only else made


def join_scores(grid: DataFrame, scores: DataFrame, key: list[str], score: str) -> DataFrame:
    """grid with the score of its key; a missing score is an error, and so is a key with two scores."""
    one = scores.groupBy(*key).agg(F.max(score).alias(score), F.count("*").alias("__n"))
    joined = grid.join(one, key, "left")
    bad = _C("__n").isNull() | (_C("__n") > 1)
    return joined.withColumn(score, F.when(bad, F.raise_error(F.lit("a score is missing or repeated")).cast("double")).otherwise(_C(score))).drop("__n")


def unique_claims(conditions: DataFrame, key: list[str], score: Column, name: str = "score") -> DataFrame:
    """conditions with scores, each distinct key scored once and joined back: for scorers that cost more than a join."""
    scored = conditions.select(*key).distinct().withColumn(name, score)
    return conditions.join(scored, key)


def compose(a: DataFrame, b: DataFrame) -> DataFrame:
    """Aspect scores from one system, sentiment scores from another, on equal keys."""
    return a.drop("sentiment_score", "rn").join(b.select(*PAIR, "sentiment_score"), PAIR)


def share_seen(native: DataFrame, described: DataFrame, heldout: str) -> DataFrame:
    """The N condition from D's rows of seen aspects, relabelled, and N's own rows of the held-out one."""
    seen = described.where(_C("aspect") != heldout).withColumn("condition", F.lit("N"))
    return seen.unionByName(native.where(_C("aspect") == heldout))
