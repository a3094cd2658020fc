"""All pairs within groups of any size, in tasks of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of a group that meet in one task at most, about.
CHUNK = 2048


def chunk_cells(members: DataFrame, group: list[str], order: Column, chunk: int = CHUNK, weight: Column | None = None) -> DataFrame:
    """members with columns side ('a' or 'b'), i and j: every two members of a group meet in one cell (group, i, j).

    A group of n members is dealt into g = ceil(n / chunk) chunks by the hash of `order`; chunk i meets chunk j >= i in the
    cell (i, j), where the members of i are side a and those of j side b (i = j: side a only). A member is sent to g cells,
    and no cell gets more than about two chunks. Groups of one member are left out. Cells are dealt over all tasks. With a
    weight, n is the sum of the members' weights.
    """
    size = F.count("*") if weight is None else F.sum(weight)
    sizes = members.groupBy(*group).agg(F.count("*").alias("__m"), F.greatest(F.lit(1), size).alias("__n")).where("__m > 1").drop("__m")
    dealt = members.join(sizes, group).withColumn("__g", F.ceil(F.col("__n") / F.lit(chunk)).cast("int")).withColumn("__k", F.pmod(F.xxhash64(order), F.col("__g")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("__g") - 1), lambda x: F.struct(F.least(x, F.col("__k")).alias("i"), F.greatest(x, F.col("__k")).alias("j"), F.when(x < F.col("__k"), "b").otherwise("a").alias("side")))
    made = dealt.withColumn("__cell", F.explode(cells)).select("*", "__cell.*").drop("__cell", "__n", "__g", "__k")
    # dealt anew by cell: what is dealt by group alone would leave all cells of a group to one task
    return made.repartition(*group, "i", "j")
