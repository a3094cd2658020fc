"""Sharding by balanced label propagation: equal texts move together, and shards differ by one row at most.

Documents with equal texts (equal MD5 of their UTF-8) are linked to each other. Rows start in a shard by hash. In each round
every group of linked rows moves towards the shard where most of its rows are (the lowest, if several), as far as that
shard's quota goes, larger groups first; what doesn't fit goes where there is room, in one run, so that few shards share it.
Rounds go on as long as the number of cut pairs falls. Then rows without links fill the shards up to their quotas:
floor(n / SHARDS) rows each, and one more in the first n mod SHARDS.

The rounds work on counts of rows by group and shard, joined to the groups' targets, not on rows. Where a group stands in its
shard's line is the sum of all larger groups, of those of its size with a lesser hash prefix, and of those before it under its
prefix: three sums, of which no group or shard is gathered in one task. Rows are numbered within buckets of about BUCKET rows.
All of it is DataFrame functions.

Null texts are linked with nothing and have no bytes; empty texts are equal texts. Repeated rows and null ids are rows like
others. An empty table gives an empty result. Columns other than doc_id and text are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, freeing

SHARDS, ROW_BYTES = 40, 16
#: Rows of a group, of no group, and of a shard that are numbered together, about, and the least number of buckets.
BUCKET, BUCKETS = 20_000, 64


def _quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def _by_shard(state: DataFrame, shards: int, column: str = "n") -> list[int]:
    found = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum(column).alias("n")).collect()}  # a row for each shard
    return [int(found.get(s, 0)) for s in range(shards)]


def _pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), index + 1)


def _running(values: list[int]) -> list[int]:
    return [sum(values[:i]) for i in range(len(values) + 1)]


def _cut(state: DataFrame) -> int:
    """Pairs of linked rows in different shards."""
    whole = state.groupBy("g").agg(F.sum("n").alias("n"))
    pairs = lambda d: d.agg(F.sum(F.col("n").cast("decimal(38,0)") * (F.col("n") - 1) / 2)).first()[0] or 0
    return int(pairs(whole) - pairs(state))


def _sum_before(column: str, keys: list[str], order: Column) -> Column:
    """The column's sum over the rows before this one within keys."""
    return F.coalesce(F.sum(column).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _before(wanted: DataFrame) -> DataFrame:
    """wanted (g, shard, n) with before: the rows that stand in front of a group in its shard's line, larger groups first, then by g."""
    held = wanted.withColumn("p", F.substring("g", 1, 3))
    by_prefix = held.groupBy("shard", "n", "p").agg(F.sum("n").alias("k"))
    by_size = by_prefix.groupBy("shard", "n").agg(F.sum("k").alias("k"))
    larger = by_size.select("shard", "n", _sum_before("k", ["shard"], F.desc("n")).alias("b1"))  # as many rows as there are sizes
    lesser = by_prefix.select("shard", "n", "p", _sum_before("k", ["shard", "n"], F.col("p")).alias("b2"))  # as many as there are prefixes
    own = held.withColumn("b3", _sum_before("n", ["shard", "n", "p"], F.col("g")))
    made = own.join(lesser, ["shard", "n", "p"]).join(larger, ["shard", "n"])
    return made.select("g", "shard", "n", (F.col("b1") + F.col("b2") + F.col("b3")).alias("before"))


def _round(state: DataFrame, quotas: list[int]) -> DataFrame:
    """state (g, shard, n) after one round; no shard is above its quota."""
    shards = len(quotas)
    target = state.groupBy("g").agg(F.max(F.struct("n", (-F.col("shard")).alias("s"))).alias("most"), F.sum("n").alias("n"))
    wanted = _before(target.select("g", (-F.col("most.s")).alias("shard"), "n"))
    quota, before = _pick(quotas, F.col("shard")), F.col("before")
    fits = F.greatest(F.lit(0), F.least(F.col("n"), quota - before))
    placed = Scratch(wanted.withColumn("in", fits).withColumn("left", F.col("n") - F.col("in")), "placed").df
    rooms = [q - k for q, k in zip(quotas, _by_shard(placed, shards, "in"))]
    starts, offsets = _running(rooms), _running(_by_shard(placed, shards, "left"))
    stay = placed.where(F.col("in") > 0).select("g", "shard", F.col("in").alias("n"))
    # the rows that are left, in one line, over the rooms, in one line; of what stands before, the quota's worth has found its place
    a = F.greatest(F.lit(0), before - quota) + _pick(offsets, F.col("shard"))
    line = placed.where(F.col("left") > 0).withColumn("a", a).withColumn("b", F.col("a") + F.col("left"))
    table = F.array(*(F.struct(F.lit(s).alias("shard"), F.lit(starts[s]).cast("long").alias("lo"), F.lit(starts[s + 1]).cast("long").alias("hi")) for s in range(shards)))
    over = line.withColumn("to", F.explode(F.filter(table, lambda x: (x.lo < F.col("b")) & (x.hi > F.col("a")) & (x.lo < x.hi))))
    moved = over.select("g", F.col("to.shard").alias("shard"), (F.least("b", "to.hi") - F.greatest("a", "to.lo")).alias("n"))
    return stay.unionByName(moved).groupBy("g", "shard").agg(F.sum("n").alias("n"))


def _numbered(rows: DataFrame, keys: list[str], bucket: Column, name: str) -> DataFrame:
    """rows with a number from 0 without gaps within keys: numbered in buckets, and the buckets before are added.

    The buckets' sums are a row for each bucket and key.
    """
    dealt = rows.withColumn("__b", bucket)
    counts = dealt.groupBy(*keys, "__b").agg(F.count("*").alias("__c"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("__o", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    own = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy("__row")) - 1
    return dealt.withColumn("__k", own).join(base, [*keys, "__b"]).withColumn(name, F.col("__k") + F.col("__o")).drop("__b", "__k", "__o")


def propagated(counts: DataFrame, quotas: list[int]) -> DataFrame:
    """(g, shard, n) of linked rows: counts (g, shard, n) after as many rounds as make the cut less."""
    groups = Scratch(counts.groupBy("g").agg(F.sum("n").alias("rows")).where("rows > 1"), "groups").df
    state = Scratch(counts.join(groups, "g").select("g", "shard", "n"), "state").df
    cut = None
    while cut != 0:
        then = Scratch(_round(state, quotas), "state").df
        now = _cut(then)
        if cut is not None and now >= cut:
            break
        state, cut = then, now
    return state


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    data = F.col("text").cast("binary")
    base = docs.select(
        "doc_id", (F.coalesce(F.octet_length(data), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(data, F.lit("").cast("binary"))).alias("text_crc32"), F.md5(data).alias("g"),
    )
    with freeing():
        held = Scratch(base.withColumn("__row", F.monotonically_increasing_id()), "rows").keep().df
        total = held.count()
        quotas, buckets = _quotas(total, shards), max(BUCKETS, -(-total // BUCKET))
        start = F.pmod(F.xxhash64("__row", F.lit("start")), F.lit(shards)).cast("int")
        counts = Scratch(held.where("g is not null").groupBy("g", start.alias("shard")).agg(F.count("*").alias("n")), "counts").df
        state = propagated(counts, quotas)
        bucket = F.pmod(F.xxhash64("__row"), F.lit(buckets))
        # rows of a group and bucket are numbered together; where the group's buckets before end is their offset
        group = Window.partitionBy("g")
        spans = state.withColumn("hi", F.sum("n").over(group.orderBy("shard"))).withColumn("lo", F.col("hi") - F.col("n"))
        spans = spans.groupBy("g").agg(F.collect_list(F.struct("lo", "hi", "shard")).alias("spans"))  # a span for each shard at most
        dealt = held.withColumn("b", bucket)
        places = dealt.where("g is not null").groupBy("g", "b").agg(F.count("*").alias("c"))
        places = places.withColumn("rows", F.sum("c").over(group)).withColumn("base", F.sum("c").over(group.orderBy("b")) - F.col("c")).where("rows > 1")
        places = places.join(spans, "g").select("g", "b", "base", "spans")
        marked = Scratch(dealt.join(places, ["g", "b"], "left"), "marked").keep().df
        starts = _running([q - k for q, k in zip(quotas, _by_shard(state, shards))])
    rank = F.col("base") + F.row_number().over(Window.partitionBy("g", "b").orderBy("__row")) - 1
    linked = marked.where("base is not null").withColumn("rank", rank)
    linked = linked.withColumn("shard", F.filter("spans", lambda x: (x.lo <= F.col("rank")) & (F.col("rank") < x.hi))[0].shard)
    # rows without links fill the rest, numbered within buckets too
    lone = _numbered(marked.where("base is null"), [], F.col("b"), "rank")
    lone = lone.withColumn("shard", reduce(Column.__add__, ((F.col("rank") >= s).cast("int") for s in starts[1:shards]), F.lit(0)))
    columns = ["doc_id", "size", "text_crc32", "__row", "shard"]
    made = _numbered(linked.select(columns).unionByName(lone.select(columns)), ["shard"], bucket, "slot")
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
