"""Running sums and neighbours over values, in two levels: over ranges of values, and within each range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_C = F.col
#: Ranges of values in 1: each is summed by itself.
RANGES = 4096


def running(frame: DataFrame, value: str, sums: list[str], *by: str, then: tuple[str, ...] = ()) -> DataFrame:
    """frame with the columns `sums` summed over all rows of the group with a greater value, and with this one up to this row.

    Rows of equal value run in the order of `then`.
    """
    held = frame.withColumn("__r", F.floor(_C(value) * RANGES))
    per = held.groupBy(*by, "__r").agg(*(F.sum(c).alias(f"__{c}") for c in sums))
    above = Window.partitionBy(*by).orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    base = per.select(*by, "__r", *(F.coalesce(F.sum(f"__{c}").over(above), F.lit(0)).alias(f"__{c}") for c in sums))
    within = Window.partitionBy(*by, "__r").orderBy(F.desc(value), *then).rowsBetween(Window.unboundedPreceding, 0)
    made = held.join(base, [*by, "__r"]).withColumns({c: _C(f"__{c}") + F.sum(c).over(within) for c in sums})
    return made.drop("__r", *(f"__{c}" for c in sums))


def following(distinct: DataFrame, value: str, name: str, *by: str) -> DataFrame:
    """distinct values with the next greater one of the group, null for the greatest."""
    held = distinct.withColumn("__r", F.floor(_C(value) * RANGES))
    firsts = held.groupBy(*by, "__r").agg(F.min(value).alias("__f")).withColumn("__f", F.lead("__f").over(Window.partitionBy(*by).orderBy("__r")))
    within = F.lead(value).over(Window.partitionBy(*by, "__r").orderBy(value))
    return held.join(firsts, [*by, "__r"]).withColumn(name, F.coalesce(within, "__f")).drop("__r", "__f")
