"""Near-duplicates by SimHash: pigeonhole blocks of the fingerprints, joined, and verified by Hamming distance.

A fingerprint of 64 bits is cut into BLOCKS = 5 blocks. Two that differ in at most RADIUS = 3 bits agree in two blocks at
least, so a join on each of the ten pairs of blocks (25 or 26 bits) finds every link. Documents with the same fingerprint
are one node, and only nodes that share a key with another are joined. Keys with more than HOT nodes are compared in
bounded cells that return stars, not pairs, so no link is lost and no group is sent out as all its pairs.

Null and empty texts, and texts of white space, have the fingerprint zero and link like any other. Rows repeated under one
doc_id stay, with one class. A null doc_id keeps its fingerprint; its class is the smallest id that is not null among those
reachable, or null. An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.cells import chunk_cells
from larkspur.llm.common import Scratch, add_columns, freeing, without
from larkspur.llm.components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: (shift, width) of the blocks; RADIUS + 2 of them, so that two agree.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Nodes with one key that are still joined as pairs.
HOT = 64


def _blocks(text: bytes, most: int) -> Iterator[bytes]:
    """The text in parts of about `most` bytes, cut at spaces or line ends."""
    begin = 0
    while len(text) - begin > most:
        cut = max(text.rfind(b" ", begin, begin + most), text.rfind(b"\n", begin, begin + most))
        if cut <= begin:  # a word that long: up to where it ends
            ends = [x for x in (text.find(b" ", begin + most), text.find(b"\n", begin + most)) if x >= 0]
            if not ends:
                break
            cut = min(ends)
        yield text[begin:cut]
        begin = cut
    yield text[begin:]


def fingerprint(text: bytes, k: int = SHINGLE, most: int = 1 << 20) -> int:
    """Of the XXH64 of the k-word shingles, repeats included, the bits that are set in over half; in bounded memory.

    Fewer words are one shingle, and no words give 0.
    """
    x, votes, n, kept = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for block in _blocks(text, most):
        words = kept + block.lower().split()
        hashes = [x(b" ".join(g), SEED) for g in zip(*(words[i:] for i in range(k)))]
        kept = words[-(k - 1) :]
        if hashes:
            n += len(hashes)
            votes += np.unpackbits(np.array(hashes, dtype=np.uint64).astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    if not n:
        return x(b" ".join(kept), SEED) if kept else 0
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, name: str = "__fp", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """docs with a long column of fingerprints."""

    def make(texts: pa.Array) -> list[pa.Array]:
        found = np.fromiter((fingerprint(x.as_buffer().to_pybytes(), k) for x in texts), np.uint64, len(texts))
        return [pa.array(found.view(np.int64))]

    return add_columns(docs, text, make, [T.StructField(name, T.LongType())])


def _keys(fp):
    parts = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in BLOCKS]
    pairs = list(combinations(range(len(BLOCKS)), 2))
    return F.array(*(F.shiftleft(F.lit(n).cast("long"), 26) + F.shiftleft(parts[a], 13) + parts[b] for n, (a, b) in enumerate(pairs)))


def near(bits: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A forest that connects what Hamming distances within the radius connect, as pairs of places.

    A fingerprint is compared with those that it isn't connected to yet, so memory is that of the fingerprints, and a group of
    near ones costs a look at each.
    """
    left, a, b = np.arange(len(bits)), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = np.bitwise_count(bits[left] ^ bits[x]) <= radius
            found, left = left[hit], left[~hit]
            queue += found.tolist()
            a.append(np.full(len(found), x))
            b.append(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def _stars(cell: pd.DataFrame) -> pd.DataFrame:
    """Links within a cell as a forest."""
    nodes = np.unique(cell["fp"].to_numpy(np.int64))
    a, b = near(nodes.view(np.uint64))
    return pd.DataFrame({"src": nodes[b], "dst": nodes[a]})


def links(nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) over distinct fingerprints (fp) that connect exactly what links at RADIUS bits connect."""
    keyed = nodes.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = Scratch(keyed.join(sizes, "key"), "blocks").df
    few, many = met.where(F.col("n") <= HOT).select("key", "fp"), met.where(F.col("n") > HOT).select("key", "fp")
    other = few.select("key", F.col("fp").alias("dst"))
    pairs = few.withColumnRenamed("fp", "src").join(other, "key").where((F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= RADIUS)).select("src", "dst")
    stars = chunk_cells(many, ["key"], F.col("fp")).groupBy("key", "i", "j").applyInPandas(_stars, "src long, dst long")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs, without the columns of drop, and with fingerprint (16 hex digits), component_id and kept, row by row.

    kept marks one row of each class: the first with the smallest doc_id. Columns of docs with these names make way for them.
    """
    docs = without(docs, "fingerprint", "component_id", "kept", "__row", "__least", "__node")
    marked = with_fingerprints(docs, "__fp").drop(*drop).withColumn("__row", F.monotonically_increasing_id())
    with freeing():
        held = Scratch(marked, "fingerprints").keep().df  # the row numbers hold from here on
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row")).alias("first")
        nodes = Scratch(held.groupBy(F.col("__fp").alias("fp")).agg(first), "nodes").df
        found = components(links(nodes)).withColumnRenamed("node", "fp")
        joined = Scratch(nodes.join(found, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "classes").keep().df
    known = joined.join(joined.groupBy("component").agg(F.min("first").alias("__least")), "component").select(F.col("fp").alias("__node"), "__least")
    made = held.join(known, F.col("__fp") == F.col("__node"))
    return made.select(
        *(F.col(f"`{c}`") for c in docs.columns if c not in drop and c != "__fp"),
        F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"),
        F.col("__least.doc_id").alias("component_id"),
        (F.col("__row") == F.col("__least.__row")).alias("kept"),
    )
