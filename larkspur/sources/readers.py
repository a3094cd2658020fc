"""Sources: review splits in CSV, JSON lines, validated aggregates, and score files, all with explicit schemas."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.labels import aspects, pairs, parse_label_codes, parse_labels_json

SPLITS = ("train", "validation", "test")
REVIEW = "id string, org_index int, data_source string, industry string, text string, labels_json string, label_codes string"


def default_dir() -> str:
    """Where splits lie unless a path is given: the setting LARKSPUR_DATA, else `data`."""
    return os.environ.get("LARKSPUR_DATA", "data")


def load_splits(spark: SparkSession, splits: list[str] | tuple[str, ...] = SPLITS, path: str | None = None) -> DataFrame:
    """The named splits as one frame; files of other splits aren't opened. An unknown split is an error."""
    if unknown := sorted(set(splits) - set(SPLITS)):
        raise ValueError(f"unknown splits: {unknown}")
    base = path or default_dir()
    raw = None
    for name in splits:
        one = spark.read.schema(REVIEW).option("header", True).option("multiLine", True).option("escape", '"').csv(f"{base}/{name}.csv").withColumn("original_split", F.lit(name))
        raw = one if raw is None else raw.unionByName(one)
    labels = parse_labels_json(F.col("labels_json"))
    made = raw.withColumns({"text": F.coalesce("text", F.lit("")), "labels": labels, "label_codes_list": parse_label_codes(F.col("label_codes")), "row_uid": F.concat_ws(":", "original_split", "id")})
    return made.withColumns({"pair_labels": pairs(F.col("labels")), "aspect_labels": aspects(F.col("labels"))})


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; empty lines are skipped, malformed ones are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def object_of(text: str, name: str) -> dict:
    """A text's JSON object; anything else is an error."""
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{name} is no JSON object")
    return found


def read_config(path: str) -> dict:
    """A JSON object; anything else is an error."""
    with open(path, encoding="utf-8") as f:
        return object_of(f.read(), path)


def _finite(frame: DataFrame) -> DataFrame:
    """frame; a double that is null, NaN or infinite is an error."""
    for name, kind in frame.dtypes:
        if kind == "double":
            bad = F.col(name).isNull() | F.isnan(F.col(name)) | (F.abs(F.col(name)) == float("inf"))
            frame = frame.withColumn(name, F.when(bad, F.raise_error(F.lit(f"{name} isn't finite")).cast("double")).otherwise(F.col(name)))
    return frame


def read_aggregates(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV of numbers: its header must match, its rows be complete, its numbers finite."""
    return _finite(spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path))


def read_scores(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Score files (CSV, or CSV in gzip) of a glob, with the file each row is from; broken rows and numbers are an error."""
    return _finite(spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(pattern)).withColumn("source_file", F.input_file_name())


def read_evidence(spark: SparkSession, pattern: str, schema: str, unit: list[str], expected: DataFrame) -> DataFrame:
    """The evidence files of a glob as one frame, checked against the units that are expected.

    A unit that is missing, unknown, or in two files is an error, and so is one whose rows differ in number from `rows` of
    expected (unit columns, rows). The check is a join of counts, and is part of the plan.
    """
    found = read_scores(spark, pattern, schema)
    held = found.groupBy(*unit).agg(F.count("*").alias("have"), F.count_distinct("source_file").alias("files"))
    both = expected.select(*unit, "rows").join(held, unit, "full")
    bad = F.coalesce((F.col("have") != F.col("rows")) | (F.col("files") != 1), F.lit(True))
    name = F.concat_ws(", ", *(F.col(c).cast("string") for c in unit))
    checked = both.select(*unit, F.when(bad, F.raise_error(F.concat(F.lit("evidence of "), name, F.lit(" isn't what is expected"))).cast("long")).otherwise(F.col("rows")).alias("rows"))
    total = checked.agg(F.sum("rows").alias("__rows"))  # one row, which looks at every unit
    return found.crossJoin(F.broadcast(total)).where("__rows >= 0").drop("__rows")
