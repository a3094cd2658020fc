"""The registry, and what queries share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Places to which doubles are rounded, here and in the SQL.
PLACES = 9
#: The decoder's thresholds in queries that need predictions.
GATE, SECOND = 0.5, 0.6
#: A review's predictions as sorted texts, for SQL that has a view `pred_a` or `pred_b`.
SETS = """SELECT row_uid, coalesce(list_sort(list(aspect || ' | ' || sentiment) FILTER (WHERE target = 1)), []) AS gold,
  coalesce(list_sort(list(aspect || ' | ' || sentiment) FILTER (WHERE p = 1)), []) AS pred FROM {} GROUP BY row_uid"""


def rounded(frame: DataFrame) -> DataFrame:
    return frame.select(*((F.round(F.col(f"`{c}`"), PLACES).alias(c) if t == "double" else F.col(f"`{c}`")) for c, t in frame.dtypes))


def query(sql: str | None = None):
    """Register a query under its function's name, doubles rounded, with its SQL."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return wrap
