"""Sinks and stores: score tables by shard, a score cache, reports. Writing over what exists is an error."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.plans.adapter import hash_bucket
from larkspur.sources.bundles import exists, read_text, write_text

UNIT = ["method", "level", "fold_id", "condition"]


def write_scores(scores: DataFrame, path: str, shards: int) -> None:
    """Score rows by unit and hash shard of their review; a review is never split."""
    made = scores.withColumn("shard", hash_bucket(F.col("row_uid"), shards))
    made.repartition(*UNIT, "shard").write.mode("errorifexists").partitionBy(*UNIT, "shard").parquet(path)


def read_scores(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def resume_state(expected: DataFrame, path: str, schema: str, *key: str) -> DataFrame:
    """(unit, state): missing, complete or corrupt by comparing the expected keys with those that are stored."""
    spark = expected.sparkSession
    if not exists(spark, path):
        return expected.select(*UNIT).distinct().withColumn("state", F.lit("missing"))
    stored = read_scores(spark, path, schema).groupBy(*UNIT, *key).agg(F.count("*").alias("n"))
    both = expected.select(*UNIT, *key).withColumn("e", F.lit(1)).join(stored, [*UNIT, *key], "full")
    found = both.groupBy(*UNIT).agg(F.sum(F.coalesce("e", F.lit(0))).alias("want"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0) * F.coalesce("e", F.lit(0))).alias("good"), F.sum(F.coalesce("n", F.lit(0))).alias("have"))
    return found.select(*UNIT, F.when(F.col("have") == 0, "missing").when((F.col("want") == F.col("good")) & (F.col("have") == F.col("want")), "complete").otherwise("corrupt").alias("state"))


class ScoreCache:
    """A table of scores by key: only keys that it lacks are scored, and are appended.

    A cache is made under a contract (model, prompt, parameters); opening it under another one is an error. A read-only cache
    never scores: a key that it lacks is an error.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], contract: dict | None = None, read_only: bool = False):
        self.spark, self.path, self.key, self.read_only = spark, f"{path}/data", key, read_only
        held, wanted = f"{path}/contract.json", json.dumps({"key": key, "contract": contract or {}}, sort_keys=True)
        if exists(spark, held):
            if read_text(spark, held) != wanted:
                raise ValueError(f"{path} was made under another contract")
        elif read_only:
            raise FileNotFoundError(path)
        else:
            write_text(spark, held, wanted)

    def table(self, like: DataFrame) -> DataFrame:
        """The scores; a key that came twice with different scores is an error."""
        schema = like.select(*self.key).schema.add("score", "double")
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        per = self.spark.read.schema(schema).parquet(self.path).groupBy(*self.key).agg(F.min("score").alias("score"), F.max("score").alias("__most"))
        same = F.col("score").eqNullSafe(F.col("__most"))
        return per.select(*self.key, F.when(same, F.col("score")).otherwise(F.raise_error(F.lit("a key has two scores")).cast("double")).alias("score"))

    def misses(self, claims: DataFrame) -> DataFrame:
        return claims.select(*self.key).distinct().join(self.table(claims), self.key, "left_anti")

    def score(self, claims: DataFrame, scorer: Column | None = None) -> DataFrame:
        """claims with scores. What the scorer makes is written first, so that it runs once for each key."""
        if self.read_only:
            lacking = F.raise_error(F.lit("a key isn't in the read-only cache")).cast("double")
            return claims.join(self.table(claims).withColumn("__hit", F.lit(1)), self.key, "left").withColumn("score", F.when(F.col("__hit").isNull(), lacking).otherwise(F.col("score"))).drop("__hit")
        self.misses(claims).withColumn("score", scorer).write.mode("append").parquet(self.path)
        return claims.join(self.table(claims), self.key)

    def statistics(self, claims: DataFrame) -> DataFrame:
        """(requests, unique_keys, hits, misses)."""
        requests = claims.groupBy(*self.key).agg(F.count("*").alias("n"))
        held = self.table(claims).select(*self.key).withColumn("hit", F.lit(1))
        return requests.join(held, self.key, "left").agg(F.sum("n").alias("requests"), F.count("*").alias("unique_keys"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.sum(1 - F.coalesce("hit", F.lit(0))).alias("misses"))


def write_once(frame: DataFrame, path: str, form: str = "parquet") -> None:
    """parquet, csv or json; an existing path is an error, and a job that fails leaves none of its rows readable."""
    writer = frame.write.mode("errorifexists")
    {"parquet": writer.parquet, "csv": lambda p: writer.option("header", True).csv(p), "json": writer.json}[form](path)


def markdown(frame: DataFrame, most: int = 1000) -> str:
    """A report's rows as a table; frames of more than `most` rows are an error, as a report isn't a dataset."""
    rows = frame.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of over {most} rows")
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    head = [f"| {' | '.join(frame.columns)} |", f"|{'---|' * len(frame.columns)}"]
    return "\n".join(head + [f"| {' | '.join(show(v) for v in r)} |" for r in rows]) + "\n"
