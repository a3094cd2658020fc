"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u > v); a node's least neighbour is found by partial aggregation, so hubs don't gather."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        joined = both.join(least, "u").select("v", F.least("m", "u").alias("m"), "u").where("v > u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        # an edge to a lower neighbour is kept as seen from the higher end
        return moved.where("u > v").distinct()
    moved = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u > v").distinct()


def _starry(edges: DataFrame) -> bool:
    """Whether edges (u > v) are stars already: each u has one v, and no v is a u. One aggregation; a boolean comes to the driver."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not per.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (src, dst): component is the least node reachable.

    Loops and repeated edges are fine, null ends are ignored. Each round is written to the shared folder; rounds grow with
    the logarithm of the longest chain, and edges that are stars need none. No edge or node comes to the driver.
    """
    now = Scratch(edges.where("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if _starry(now.df):
            break
        then = Scratch(_stars(_stars(now.df, True), False), "edges")
        now.drop()
        now = then
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    # now each node has one edge, to its component's least node
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
