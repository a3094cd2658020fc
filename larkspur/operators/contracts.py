"""Contracts of frames: each is one aggregation, and raises with what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(frame: DataFrame, *names: str) -> DataFrame:
    if missing := sorted(set(names) - set(frame.columns)):
        raise ValueError(f"missing columns: {missing}")
    return frame


def require_forbidden(frame: DataFrame, *names: str) -> DataFrame:
    if found := sorted(set(names) & set(frame.columns)):
        raise ValueError(f"columns that must not be here: {found}")
    return frame


def few(frame: DataFrame, most: int = 10_000) -> DataFrame:
    """The frame, to be broadcast; more than `most` rows are an error."""
    n = frame.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows to broadcast")
    return F.broadcast(frame)


def duplicates(frame: DataFrame, *key: str) -> DataFrame:
    """(key, n) of keys with several rows."""
    return frame.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def audit(frame: DataFrame, key: list[str], scores: list[str] = (), expected_rows: int | None = None) -> dict[str, int]:
    """Rows, distinct keys, null keys and non-finite or out-of-range scores, in one pass; raises if any is wrong."""
    bad = [F.sum((F.col(s).isNull() | F.isnan(F.col(s)) | (F.col(s) < 0) | (F.col(s) > 1)).cast("long")).alias(f"bad_{s}") for s in scores]
    null = F.sum(F.greatest(*(F.col(k).isNull().cast("int") for k in key), F.lit(0))).alias("null_keys")
    got = frame.agg(F.count("*").alias("rows"), F.count_distinct(*key).alias("keys"), null, *bad).first().asDict()
    got = {k: v or 0 for k, v in got.items()}
    wrong = [k for k, v in got.items() if (k.startswith("bad_") or k == "null_keys") and v]
    if got["rows"] != got["keys"]:
        wrong.append("repeated keys")
    if expected_rows is not None and got["rows"] != expected_rows:
        wrong.append(f"{got['rows']} rows instead of {expected_rows}")
    if wrong:
        raise ValueError(f"contract broken: {wrong}")
    return got


def coverage(expected: DataFrame, observed: DataFrame, *key: str) -> DataFrame:
    """(key, problem): keys that are missing or unexpected, by anti joins both ways."""
    missing = expected.select(*key).join(observed.select(*key), list(key), "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(observed.select(*key).join(expected.select(*key), list(key), "left_anti").withColumn("problem", F.lit("unexpected")))


def registry_problems(registry: DataFrame, source: DataFrame, order: list[str], retired: list[str], terms: list[str], values: list[float], tolerance: float = 1e-12) -> DataFrame:
    """(method_id, problem) of a registry (place, method_id, value, formulation) against its source (method_id, value).

    Problems: missing, not in the registered order, retired, a retired formulation or value, a value that isn't finite, and
    one that disagrees with its source.
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col("method_id"))
    none = F.lit(None).cast("string")
    v = F.col("value")
    bad_term = F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower("formulation"), F.lower(t))) if terms else F.lit(False)
    bad_value = F.exists(F.array(*map(F.lit, values)), lambda x: F.abs(v - x) <= 5e-7) if values else F.lit(False)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    found = registry.join(source.select("method_id", F.col("value").alias("source")), "method_id", "left")
    problems = F.array_compact(F.array(
        F.when(place != F.col("place"), "not in the registered order").otherwise(none), F.when(F.col("method_id").isin(*retired), "retired").otherwise(none), F.when(bad_term, "retired formulation").otherwise(none),
        F.when(bad_value, "retired value").otherwise(none), F.when(~finite, "not finite").otherwise(none), F.when(finite & ~F.coalesce(F.abs(v - F.col("source")) <= tolerance, F.lit(False)), "disagrees with its source").otherwise(none),
    ))
    wrong = found.select("method_id", F.explode(problems).alias("problem"))
    listed = registry.sparkSession.createDataFrame([(m,) for m in order], "method_id string")
    return wrong.unionByName(listed.join(registry.select("method_id"), "method_id", "left_anti").withColumn("problem", F.lit("missing")))


def aligned(left: DataFrame, right: DataFrame, key: list[str], same: str) -> DataFrame:
    """Rows of both sides by key; a key that one side lacks, or values of `same` that differ, are errors."""
    renamed = right.withColumnsRenamed({c: f"other_{c}" for c in right.columns if c not in key})
    both = left.withColumn("__l", F.lit(1)).join(renamed.withColumn("__r", F.lit(1)), key, "full")
    lacks = F.col("__l").isNull() | F.col("__r").isNull()
    fail = F.raise_error(F.concat(F.lit("rows don't align: "), F.concat_ws(",", *(F.col(k).cast("string") for k in key))))
    checked = F.when(lacks | ~F.col(same).eqNullSafe(F.col(f"other_{same}")), fail.cast(dict(left.dtypes)[same])).otherwise(F.col(same))
    return both.withColumn(same, checked).drop("__l", "__r", f"other_{same}")


def fingerprint(frame: DataFrame, *columns: str) -> DataFrame:
    """(rows, digest): independent of the order of rows, and additive: SHA-256 of each row, summed by 32-bit parts."""
    digest = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    part = lambda i: F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")) % F.lit(1 << 32)
    return frame.agg(F.count("*").alias("rows"), *(part(i).cast("long").alias(f"p{i}") for i in range(4))).select("rows", F.concat_ws("-", *(F.col(f"p{i}").cast("string") for i in range(4))).alias("digest"))


class Scorer:
    """What gives candidates a probability: a column expression over a grid; implementations may be pandas UDFs."""

    def score(self, grid: DataFrame):
        raise NotImplementedError

    def checked(self, grid: DataFrame, name: str = "score") -> DataFrame:
        """grid with scores; one that is null, NaN or outside [0, 1] is an error."""
        x = self.score(grid)
        bad = x.isNull() | F.isnan(x) | (x < 0) | (x > 1)
        return grid.withColumn(name, F.when(bad, F.raise_error(F.lit("scores must be probabilities")).cast("double")).otherwise(x))


class ColumnScorer(Scorer):
    def __init__(self, make):
        self.make = make

    def score(self, grid: DataFrame):
        return self.make(grid)
