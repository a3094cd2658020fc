"""Near-duplicate embeddings by a subspace pigeonhole join.

Vectors of one label are scaled to length 1 and turned by a fixed random rotation; their coordinates are split into blocks
of BLOCK dimensions. Cosine >= THRESHOLD is a squared distance of at most 2 - 2 * THRESHOLD, of which each block gets a share
in proportion to its dimensions; two vectors within the whole budget are within some block's. The vectors of a label are
dealt into cells of bounded size, in which every two of them meet. There each block is a range join: all of its coordinates
are cut into slices of a STEPS-th of its radius, and for each slice a bitmap has the vectors that are no farther than the
radius may reach; of a vector's neighbours in a block only those are tested whose bits are set in all of its coordinates'
bitmaps. Those that pass the block's squared distance are verified by their cosine in double precision. A pair counts in the
first block whose budget it meets, so the blocks' union has it once. Cells return counts and a forest, not pairs.

Equal vectors of one label are one node, with a count. Vectors that are null, zero or hold null or non-finite components, or
whose label is null, link with nothing; nor do vectors of different dimensions. Rows repeated under one vec_id are vectors of
their own; a null vec_id is a vector too, and names a component only if that has no other id. kept marks vec_id =
component_id. An empty table gives an empty result. Columns other than vec_id, label and embedding are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.cells import chunk_cells
from larkspur.llm.common import Scratch, freeing
from larkspur.llm.components import components

THRESHOLD, BLOCK, STEPS, SEED = 0.93, 8, 6, 11
#: Vectors of a label that meet in one task, about twice as many at most; those that are joined at a time.
CHUNK, ROWS = 4096, 256
#: What rounding may add to a squared distance; pairs that are verified at a time.
SLACK, PAIRS = 1e-7, 100_000


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def turned(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, rotated, on a grid of 2 ** -30, so that a row has the same coordinates in every task."""
    return np.round(x / np.linalg.norm(x, axis=1, keepdims=True) @ rotation(x.shape[1]) * 2**30) / 2**30


def budgets(dims: int, threshold: float = THRESHOLD) -> np.ndarray:
    """Squared distance of each block."""
    sizes = np.array([min(BLOCK, dims - i) for i in range(0, dims, BLOCK)])
    return (2 - 2 * threshold) * sizes / dims + SLACK


class Ranges:
    """For one block of some vectors: which of them may be within its radius of another vector, as bits."""

    def __init__(self, block: np.ndarray, budget: float):
        self.width = np.sqrt(budget) / STEPS
        codes = np.floor(block / self.width).astype(np.int64)
        self.low = codes.min(0)
        known = np.arange(int((codes.max(0) - self.low).max(initial=0)) + 1)
        # dimensions x slices x bits of the vectors: those whose slice is no more than STEPS away
        near = np.abs(codes.T[:, None, :] - (known[None, :, None] + self.low[:, None, None])) <= STEPS
        self.bits = np.packbits(near, axis=2)

    def near(self, block: np.ndarray) -> np.ndarray:
        """Bits of those that may be near each row; rows beyond all slices are put into the nearest one, which is as wide."""
        codes = np.clip(np.floor(block / self.width).astype(np.int64) - self.low, 0, self.bits.shape[1] - 1)
        found = self.bits[0][codes[:, 0]]
        for k in range(1, block.shape[1]):
            found &= self.bits[k][codes[:, k]]
        return found


def pairs(x: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(u, v, tested) of turned vectors x: places in a and b that some block's range join brings together, each pair once.

    If a is b, u comes before v. tested says how many pairs met in a block.
    """
    dims, allowed = x.shape[1], budgets(x.shape[1], threshold)
    blocks = [slice(i, min(i + BLOCK, dims)) for i in range(0, dims, BLOCK)]
    ranges = [Ranges(x[b, at], allowed[k] + SLACK) for k, at in enumerate(blocks)]
    alone = a is b
    for begin in range(0, len(a), ROWS):
        ai = a[begin : begin + ROWS]
        for k, at in enumerate(blocks):
            bits = np.unpackbits(ranges[k].near(x[ai, at]), axis=1, count=len(b))
            p, q = np.nonzero(bits)
            if alone:
                on = p + begin < q
                p, q = p[on], q[on]
            for i in range(0, len(p), PAIRS):
                u, v = ai[p[i : i + PAIRS]], b[q[i : i + PAIRS]]
                fits = ((x[u, at] - x[v, at]) ** 2).sum(1) <= allowed[k]
                u, v = u[fits], v[fits]
                by_block = np.add.reduceat((x[u] - x[v]) ** 2, np.arange(0, dims, BLOCK), axis=1)
                first = (by_block <= allowed).argmax(1) == k
                yield u[first], v[first], len(fits)


def _cell(table: pa.Table, threshold: float) -> pa.Table:
    """Of one cell: each linked node with the copies it is linked to here, and the least node it is connected to here."""
    table = table.combine_chunks()
    raw = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1)
    x, node, copies = turned(raw), table.column("node").to_numpy(), table.column("copies").to_numpy()
    norm, side = np.linalg.norm(raw, axis=1), np.array(table.column("side").to_pylist()) == "a"
    a = np.nonzero(side)[0]
    b = a if table.column("i")[0].as_py() == table.column("j")[0].as_py() else np.nonzero(~side)[0]
    links, least, edges = np.zeros(len(node), np.int64), np.arange(len(node)), []
    order = np.argsort(node, kind="stable")
    rank = np.empty(len(node), np.int64)
    rank[order] = np.arange(len(node))
    for u, v, _ in pairs(x, a, b, threshold) if len(a) and len(b) else ():
        on = np.einsum("ij,ij->i", raw[u], raw[v]) / (norm[u] * norm[v]) >= threshold
        u, v = u[on], v[on]
        np.add.at(links, u, copies[v])
        np.add.at(links, v, copies[u])
        edges.append(np.stack([rank[u], rank[v]]))
    u, v = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
    while True:  # least label over links, with pointer jumping
        new = least.copy()
        np.minimum.at(new, u, least[v])
        np.minimum.at(new, v, least[u])
        new = new[new]
        if (new == least).all():
            break
        least = new
    on = np.nonzero(links)[0]
    return pa.table({"node": pa.array(node[on], pa.int64()), "links": pa.array(links[on], pa.int64()), "least": pa.array(node[order][least[rank[on]]], pa.int64())})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors."""
    e = F.col("embedding")
    # an infinite or NaN component minus itself is NaN
    sound = e.isNotNull() & F.col("label").isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v - v)) & F.exists(e, lambda v: v != 0)
    keyed = vectors.select("vec_id", "label", "embedding").withColumn("__row", F.monotonically_increasing_id()).withColumn("sound", F.coalesce(sound, F.lit(False)))
    keyed = keyed.withColumn("k1", F.xxhash64("label", "embedding")).withColumn("k2", F.xxhash64(F.lit(1), "embedding", "label"))
    first = F.min(F.struct(F.col("vec_id").isNull().alias("no_id"), "vec_id")).alias("first")
    with freeing():
        held = Scratch(keyed, "vectors").keep().df
        groups = Scratch(held.where("sound").groupBy("k1", "k2").agg(F.min("__row").alias("node"), F.count("*").alias("copies"), first), "groups").df
        nodes = held.where("sound").join(groups.select(F.col("node").alias("__row"), "copies"), "__row").select("label", F.size("embedding").alias("dims"), F.col("__row").alias("node"), "copies", "embedding")
        keys = ["label", "dims"]
        cell = chunk_cells(nodes, keys, F.col("node"), CHUNK)
        found = Scratch(cell.groupBy(*keys, "i", "j").applyInArrow(lambda table: _cell(table, threshold), "node long, links long, least long"), "links").df
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        connected = components(found.select(F.col("node").alias("src"), F.col("least").alias("dst")))
        known = groups.join(links, "node", "left").join(connected, "node", "left").withColumn("component", F.coalesce("component", "node"))
        known = Scratch(known, "known").df
        least = known.groupBy("component").agg(F.min("first").alias("least"))
        by_key = known.join(least, "component").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("least.vec_id").alias("component_id"))
        by_key = Scratch(by_key, "classes").keep().df
    linked = held.where("sound").join(by_key, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    rest = held.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
