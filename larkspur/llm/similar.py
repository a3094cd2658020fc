"""Similar texts by SimHash: wide fingerprints cut into blocks, joined on lines of blocks, verified bit by bit and word by word.

Texts are words (what stands between ASCII white space, A-Z lower-cased) and their sets of SHINGLE-word shingles; a text of
fewer words is one shingle. Two texts are linked if the Jaccard similarity of their sets is SIMILARITY or more, and classes
are what links connect. Links are found in four steps:

* Texts of the same words are one node.
* A fingerprint is POINTS = 62 blocks of WIDTH = 7 bits, each bit the majority of its shingles' hashes. Two nodes meet if they
  agree in one of 186 triples of blocks (21 bits), and if the sizes of their sets allow the similarity. Each block is in nine
  triples, so 20 blocks that differ leave some triple whole: fingerprints that differ in at most 20 bits surely meet. Beyond
  that they are likely to: of pairs at a similarity of 0.8 to 0.85 about 99 in 100 do, and nearly all above
  (tests/llm/test_similar.py measures it).
* Nodes that meet are compared by the Hamming distance of 64 more bits of their fingerprints. What is within RADIUS, which is
  more than three deviations beyond a similarity of 0.8, is connected, and everything connected is a candidate group.
* Within candidate groups, Jaccard similarities are exact, from whole texts. A node is compared with those that it isn't
  connected to yet, so a group of copies costs a look at each, not one at each pair.

Triples that more than RUN nodes share, and candidate groups of more than CHUNK bytes of text, are dealt into cells of bounded size.
No link between verified candidates is lost, and no group is sent out as all its pairs.

Null texts, empty ones and those of white space have no words, and are one class. Rows repeated under one doc_id stay, with
one class. A null doc_id names a class only if no other id is reachable. An empty table gives an empty result. Columns
other than doc_id and text are kept as they are; those named component_id or kept make way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.brown import hashes, tokens
from larkspur.llm.cells import chunk_cells
from larkspur.llm.common import Scratch, add_columns, freeing, without
from larkspur.llm.components import components
from larkspur.llm.simhash import near

SHINGLE, SIMILARITY, POINTS, WIDTH, RADIUS = 5, 0.8, 62, 7, 20
#: Nodes of a triple that one task compares; bytes of text of a cell's side; shingles whose bits are counted at a time.
RUN, CHUNK, PART = 1 << 16, 4 << 20, 255
#: Rows of texts with others in their class that may be broadcast (five numbers: below 100 bytes each).
BROADCAST_ROWS = 200_000
#: Blocks i, i + a, i + a + b around a circle; no two blocks are together in two triples.
TRIPLES = np.array([(i, (i + a) % POINTS, (i + a + b) % POINTS) for a, b in ((1, 3), (2, 6), (5, 9)) for i in range(POINTS)])
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)

_WORDS = _ODD[2] * np.arange(8, dtype=np.uint64)
#: Each byte's bits in the eight bytes of a number: up to 255 of them add up without a carry.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _mixed(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * by
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def _sequences(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word sequences, in order."""
    made = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        made = _mixed(made ^ words[i : len(words) - k + 1 + i], _ODD[0])
    return made


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """The set of hashes of all k-word shingles; fewer words are one, none are none."""
    return np.unique(_sequences(words, min(k, len(words)))) if len(words) else words


def fingerprint(shingle_set: np.ndarray) -> tuple[np.ndarray, int]:
    """(blocks, 64 more bits): a bit is 1 if it is set in over half of the shingles' hashes."""
    votes, used = np.zeros(512, np.int64), POINTS * WIDTH
    for at in range(0, len(shingle_set), PART):
        wide = _mixed(shingle_set[at : at + PART, None] + _WORDS, _ODD[3])
        votes += _LANES[wide.view(np.uint8)].sum(0).view(np.uint8)
    bits = votes * 2 > len(shingle_set)
    blocks = bits[:used].reshape(POINTS, WIDTH) @ (1 << np.arange(WIDTH))
    return blocks.astype(np.uint8), int(np.packbits(bits[used : used + 64]).view(np.int64)[0])


def shingled(texts: pa.Array, k: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words' hashes, shingles) of each text (strings without nulls)."""
    offsets, words, codes = tokens(texts)
    hashed = hashes(words).view(np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)
    # over all texts at once; a text's own are those that don't reach into the next one
    every = _sequences(hashed, k) if len(hashed) >= k else hashed[:0]
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield hashed[a:b], np.unique(every[a : b - k + 1]) if b - a >= k else shingles(hashed[a:b], k)


def _marks(texts: pa.Array) -> list[pa.Array]:
    keys, blocks, bits, sizes = [], [], [], []
    for words, own in shingled(texts):
        key = xxhash.xxh3_128_digest(words.tobytes())
        keys.append(np.frombuffer(key, np.int64))
        b, first = fingerprint(own)
        blocks.append(b.tobytes())
        bits.append(first)
        sizes.append(len(own))
    k = np.array(keys, np.int64).reshape(-1, 2)
    return [pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(blocks, pa.binary()), pa.array(bits, pa.int64()), pa.array(sizes, pa.int64())]


def _tier(n: np.ndarray) -> np.ndarray:
    """Of sizes: the power of 4 that they reach."""
    return (np.frexp(n.astype(float))[1] + 1) // 2


def triple_keys(blocks: np.ndarray, sizes: np.ndarray, similarity: float = SIMILARITY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys): the triples of each row's blocks, with the tiers of sizes in which it can have a similar one as large or larger."""
    b, width = blocks.astype(np.int64), 3 * WIDTH
    triple = b[:, TRIPLES[:, 0]] << 2 * WIDTH | b[:, TRIPLES[:, 1]] << WIDTH | b[:, TRIPLES[:, 2]] | np.arange(len(TRIPLES)) << width
    own, most = _tier(sizes), _tier(np.floor(sizes / similarity + 1e-9))
    for tier, rows in ((own, np.arange(len(b))), (most, np.nonzero(most > own)[0])):
        keys = triple[rows] | tier[rows, None] << width + 8
        yield np.repeat(rows, len(TRIPLES)), keys.ravel()


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            blocks = np.frombuffer(b"".join(batch.column("blocks").to_pylist()), np.uint8).reshape(-1, POINTS)
            for rows, keys in triple_keys(blocks, batch.column("size").to_numpy()):
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("node").take(take), batch.column("bits").take(take)], names=["key", "node", "bits"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their keys: pairs that connect near nodes of a key, and the rows of keys with over RUN nodes."""
    hot, names = None, ["src", "dst", "key", "bits"]
    key, node, bits = (np.zeros(0, np.int64),) * 3

    def pairs(src: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.nulls(len(src), pa.int64()), pa.nulls(len(src), pa.int64())], names=names)

    def rows(at: slice) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.nulls(len(node[at]), pa.int64()), pa.array(key[at]), pa.array(bits[at])], names=names)

    def over(starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = ends - starts
        two = starts[size == 2]
        two = two[np.bitwise_count(bits[two].view(np.uint64) ^ bits[two + 1].view(np.uint64)) <= RADIUS]
        src, dst = [node[two]], [node[two + 1]]
        for a, b in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
            if key[a] == hot or b - a > RUN:
                yield rows(slice(a, b))
            else:
                p, q = near(bits[a:b].view(np.uint64), RADIUS)
                src.append(node[a:b][p])
                dst.append(node[a:b][q])
        if sum(map(len, src)):
            yield pairs(np.concatenate(src), np.concatenate(dst))

    for batch in batches:
        key, node, bits = (np.concatenate([x, batch.column(n).to_numpy()]) for x, n in ((key, "key"), (node, "node"), (bits, "bits")))
        if not len(key):
            continue
        cuts = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1])
        yield from over(cuts[:-1], cuts[1:])
        last = int(cuts[-1])
        if key[last] == hot or len(key) - last > RUN:  # its rows go on as they come
            hot = key[last]
            yield rows(slice(last, None))
            last = len(key)
        key, node, bits = key[last:].copy(), node[last:].copy(), bits[last:].copy()
    if len(key):
        yield from over(np.array([0]), np.array([len(key)]))


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b = near(pdf["bits"].to_numpy().view(np.uint64), RADIUS)
    node = pdf["node"].to_numpy()
    return pd.DataFrame({"src": node[a], "dst": node[b]})


def linked(sets: list[np.ndarray], similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """A forest that connects exactly what Jaccard similarities of at least this connect, as pairs of places."""
    sizes = np.array([len(x) for x in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if sizes.sum() else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    owner, known = np.repeat(np.arange(len(sets)), sizes), np.zeros(flat.max(initial=0) + 1, bool)
    left, a, b = np.ones(len(sets), bool), [], []
    rest, at, n_rest = owner, flat, len(sets)  # the shingles of what was left when it was last looked over
    for root in range(len(sets)):
        queue = [root] if left[root] else []
        left[root] = False
        while queue and (n_left := np.count_nonzero(left)):
            if 2 * n_left < n_rest:
                on = left[rest]
                rest, at, n_rest = rest[on], at[on], n_left
            x = queue.pop()
            own = flat[starts[x] : starts[x + 1]]
            known[own] = True
            both = np.bincount(rest[known[at]], minlength=len(sets))
            known[own] = False
            found = np.nonzero(left & (both > 0) & (both >= similarity * (sizes + sizes[x] - both)))[0]
            left[found] = False
            queue += found.tolist()
            a.append(np.full(len(found), x))
            b.append(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def _verified(table: pa.Table) -> pa.Table:
    sets = [own for chunk in table.column("text").chunks for _, own in shingled(chunk)]
    a, b = linked(sets)
    node = table.column("node").to_numpy()
    return pa.table({"src": pa.array(node[a], pa.int64()), "dst": pa.array(node[b], pa.int64())})


def _rooted(forests: DataFrame) -> DataFrame:
    """Edges that connect what the forests of all keys connect: each node's least root, and that root's edges to its other ones.

    A node has a root for each of its keys at most, and mostly the same one.
    """
    per = forests.groupBy("dst").agg(F.min("src").alias("least"), F.collect_set("src").alias("roots"))
    roots = per.select(F.explode("roots").alias("dst"), F.col("least").alias("src")).where("dst <> src").distinct()
    return per.select(F.col("least").alias("src"), "dst").unionByName(roots.select("src", "dst"))


def candidates(nodes: DataFrame) -> DataFrame:
    """(node, component) of nodes (node, blocks, bits, size) that share a triple of blocks and 64 bits within RADIUS with another, in groups."""
    keyed = nodes.select("node", "blocks", "bits", "size").mapInArrow(_keyed, "key long, node long, bits long")
    # in the order of nodes, the forests of a group's keys have the same roots, and so mostly the same edges
    met = Scratch(keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_met, "src long, dst long, key long, bits long"), "met").df
    hot = met.where("dst is null").select("key", F.col("src").alias("node"), "bits")
    cells = chunk_cells(hot, ["key"], F.col("node"), RUN // 2).groupBy("key", "i", "j").applyInPandas(_cell, "src long, dst long")
    return components(_rooted(met.where("dst is not null").select("src", "dst").unionByName(cells)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with component_id and kept: kept marks one row of each class, the first with the smallest doc_id."""
    docs = without(docs, "component_id", "kept", "__row", "__k1", "__k2", "__blocks", "__bits", "__size", "__least")
    long = T.LongType()
    fields = [T.StructField(n, long) for n in ("__k1", "__k2")] + [T.StructField("__blocks", T.BinaryType()), T.StructField("__bits", long), T.StructField("__size", long)]
    with freeing():
        held = Scratch(add_columns(docs, "text", _marks, fields).withColumn("__row", F.monotonically_increasing_id()), "marks").keep().df
        key = ["__k1", "__k2"]
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("__row").alias("row")))
        same = held.groupBy(*key).agg(F.min("__row").alias("node"), first.alias("first"), F.count("*").alias("rows"), *(F.min(f"__{c}").alias(c) for c in ("blocks", "bits", "size")))
        nodes = Scratch(same, "nodes").df
        groups = Scratch(candidates(nodes.where("size > 0")).select("node", F.col("component").alias("group")), "groups").df
        texts = held.select(F.col("__row").alias("node"), "text").join(groups, "node")
        cells = chunk_cells(texts, ["group"], F.col("node"), CHUNK, F.octet_length("text"))
        links = cells.groupBy("group", "i", "j").applyInArrow(_verified, "src long, dst long")
        found = components(links)
        classes = Scratch(nodes.drop("blocks", "bits", "size").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "classes").df
        least = classes.groupBy("component").agg(F.min("first").alias("__least"), F.sum("rows").alias("rows"))
        # rows that are alone in their class need no look
        known = classes.drop("rows").join(least.where("rows > 1"), "component").select(*key, "__least")
        known = Scratch(known, "known").keep().df
        known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    made = held.join(known, key, "left")
    return made.select(
        *(F.col(f"`{c}`") for c in docs.columns), F.when(F.col("__least").isNull(), F.col("doc_id")).otherwise(F.col("__least.doc_id")).alias("component_id"),
        (F.col("__least").isNull() | (F.col("__row") == F.col("__least.row"))).alias("kept"),
    )
