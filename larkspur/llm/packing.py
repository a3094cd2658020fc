"""Best-fit packing of token sequences.

Documents are encoded with a public byte-level BPE (`tokenizers`; a path is the parameter) and end with one more id. Only
documents of more than CAPACITY ids are cut: into pieces of CAPACITY ids, the first piece shorter if they don't come out
even. A full piece is a sequence by itself; all others are packed by best-fit decreasing: longest first, each into the open
sequence with the least room that still holds it, found by a segment tree over the room left.

Pieces of one length are alike, so the packing is worked out on the driver over the counts of the CAPACITY lengths: the tree
finds the tightest room, and as many pieces as are left of a length go, in one step, into as many sequences as have that
room (see `plan`). What comes out is what best-fit decreasing makes of all pieces, one by one, in one group. The pieces are
then numbered within their lengths, in buckets, so that no length is gathered in one task, and each finds its place by its number.

Null and empty texts are one id long. Repeated rows and null ids are packed like others. An empty table gives an empty
result. Columns other than doc_id and text are dropped.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, text_slices

CAPACITY, END_ID = 1024, 2
#: Pieces that are numbered together, about; bytes of text of a slice that is encoded at once; units a worker remembers; units it has seen
#: lately, of which those that come again are remembered.
BUCKET, SLICE, REMEMBERED, LATELY = 20_000, 8 << 20, 250_000, 400_000
#: Texts in which each space starts a unit of its own: plain characters, and no space between white space or at the end
#: after it, where the vocabulary's pattern keeps runs of white space together. Others are encoded as a whole.
ODD = "[^\t\n\r -~\u00a1-\u024f]|[ \t\n\r] (?:[ \t\n\r]|\\z)"
#: Where it doesn't match, each line end is a unit of its own, and the next unit has no space in front of it.
BREAKS = "[ \\t\\r\\n]\\n|\\n[ \\t\\r\\n]"
#: Units that are encoded in one call, each on a line of its own.
LINES = 2000


class Encoder:
    """Ids of texts. A text is cut before its spaces; each distinct unit of a slice is encoded once, common ones only once at all."""

    held: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # texts that hold the string of an added token are encoded as a whole: it is one id, wherever it stands
        self.added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.line = self._ids(["\n"])[0]
        # remembered units with their ids one after the other, and units that came once
        self.known, self.lately = pa.array([], pa.large_string()), pa.array([], pa.large_string())
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all units, where each one's start, how many they are). Units without line ends or tabs are encoded many in a call, a line each."""
        size, parts = np.zeros(len(units), np.int64), []
        odd = pc.or_(pc.match_substring_regex(units, "[\t\n\r]"), pc.less_equal(pc.utf8_length(units), 1)).to_numpy(zero_copy_only=False) | (len(self.line) != 1)
        clean, rest = np.nonzero(~odd)[0], np.nonzero(odd)[0]
        words = units.take(pa.array(clean)).to_pylist()
        for a in range(0, len(words), LINES):
            part = words[a : a + LINES]
            ids = self._ids(["\n".join(part)])[0]
            ends = ids == self.line[0]
            parts.append(ids[~ends])
            cut = np.nonzero(ends)[0]
            if len(cut) != len(part) - 1:
                raise ValueError("a unit has a line end in it")
            size[clean[a : a + LINES]] = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
        parts += (alone := self._ids(units.take(pa.array(rest)).to_pylist()))
        size[rest] = [len(x) for x in alone]
        # the clean ones' ids come first
        order = np.concatenate([clean, rest])
        start = np.zeros(len(units), np.int64)
        start[order] = np.concatenate([[0], np.cumsum(size[order])])[:-1]
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), start, size

    def _remember(self, units: pa.Array, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Keep the ids of units that came lately, as far as there is room."""
        room = REMEMBERED - len(self.known)
        if not room:
            return
        again = pc.is_in(units, value_set=self.lately)
        kept = np.nonzero(again.to_numpy(zero_copy_only=False))[0][:room]
        self.lately = pa.concat_arrays([self.lately, units.filter(pc.invert(again))])[-LATELY:]
        n = size[kept]
        ends = np.cumsum(n)
        self.known = pa.concat_arrays([self.known, units.take(pa.array(kept))])
        self.start = np.concatenate([self.start, len(self.flat) + ends - n])
        self.size = np.concatenate([self.size, n])
        self.flat = np.concatenate([self.flat, flat[np.repeat(start[kept] - (ends - n), n) + np.arange(n.sum())]])
        if len(self.known) == REMEMBERED:
            self.lately = self.lately[:0]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (an array of strings without nulls)."""
        texts = pc.cast(texts, pa.large_string())
        odd = pc.match_substring_regex(texts, f"{ODD}|{self.added}" if self.added else ODD)
        found: list[np.ndarray | None] = [None] * len(texts)
        for i, ids in zip(np.nonzero(odd.to_numpy(zero_copy_only=False))[0], self._ids(texts.filter(odd).to_pylist())):
            found[i] = ids
        plain = np.nonzero(~odd.to_numpy(zero_copy_only=False))[0]
        if not len(plain):
            return found
        # one more space in front sets a text's first unit apart from what precedes it
        empty, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        held = texts.take(pa.array(plain))
        marked = pc.if_else(pc.match_substring_regex(held, BREAKS), held, pc.replace_substring(held, "\n", " \x00 "))
        split = pc.split_pattern(pc.binary_join_element_wise(empty, marked, space), " ")
        ends = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        breaks = pc.equal(words, "\x00")
        after = np.nonzero(breaks.to_numpy(zero_copy_only=False)[codes])[0] + 1
        bare = np.concatenate([ends[:-1] + 1, after])  # units without a space of their own
        starters, again = np.unique(codes[bare], return_inverse=True)
        codes[bare] = len(words) + again
        spaced = pc.if_else(breaks, pa.scalar("\n", pa.large_string()), pc.binary_join_element_wise(empty, words, space))
        units = pa.concat_arrays([spaced, words.take(pa.array(starters))])
        at = pc.fill_null(pc.index_in(units, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        new, old = np.nonzero(at < 0)[0], np.nonzero(at >= 0)[0]
        fresh = units.take(pa.array(new))
        flat, start_new, size_new = self._units(fresh)
        start, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        start[old], size[old] = self.start[at[old]], self.size[at[old]]
        start[new], size[new] = start_new + len(self.flat), size_new
        every = np.concatenate([self.flat, flat])
        self._remember(fresh, flat, start_new, size_new)
        sizes = size[codes]
        sizes[ends[:-1]] = 0  # what is before the space that was put in front
        out_start = np.concatenate([[0], np.cumsum(sizes)])
        out = every[np.repeat(start[codes] - out_start[:-1], sizes) + np.arange(out_start[-1])]
        for i, a, b in zip(plain, ends[:-1], ends[1:]):
            found[i] = out[out_start[a] : out_start[b]]
        return found


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder.of(tokenizer)
    for whole in batches:
        for batch in text_slices(whole, most=SLICE):
            rows, piece, start, flat = [], [], [], []
            for row, ids in enumerate(encoder.encode(pc.fill_null(batch.column("text"), ""))):
                ids = np.append(ids, np.uint32(END_ID))
                cuts = list(range(len(ids) % capacity or capacity, len(ids), capacity))
                cuts = [0, *cuts] if len(ids) > capacity else [0]
                rows += [row] * len(cuts)
                piece += range(len(cuts))
                start += cuts
                flat.append((ids, cuts))
            ends = np.cumsum([0] + [n for ids, cuts in flat for n in np.diff([*cuts, len(ids)])])
            held = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([x for x, _ in flat]).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(np.diff(ends)), held], names=["doc_id", "piece", "start", "length", "ids"])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, then=None, schema: str = "ids array<int>") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids (an array of ints).

    then, if given, makes record batches of others, in the same pass, with the columns of schema in place of ids.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _pieces(batches, tokenizer, capacity)
        return then(made) if then else made

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, {schema}")


class Rooms:
    """A segment tree over the room left, 0 to capacity: at each room the runs of open sequences with it, in its nodes how many runs."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.base)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.runs[room].append((first, n))
            k = self.base + room
            while k:
                self.count[k] += 1
                k >>= 1

    def take(self, least: int) -> tuple[int, int, int] | None:
        """(room, first sequence, sequences): the latest run of the least room that is `least` or more, removed; None if there is none."""
        k, count = self.base + least, self.count
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):  # up, until there is a right neighbour with runs
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.base:
                k = 2 * k if count[2 * k] else 2 * k + 1
        room = k - self.base
        first, n = self.runs[room].pop()
        while k:
            count[k] -= 1
            k >>= 1
        return room, first, n


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing of so many pieces of each length (1 to capacity), in steps.

    A row for each step: length, number of its first piece within the length, first sequence, pieces in each sequence, offset
    of the first of them. Pieces of one length go into the tightest sequence until it holds no more of them, and then into
    the next one; sequences of equal room are filled alike, so a step covers all that have the same room.
    """
    rooms, steps, n = Rooms(capacity), [], 0
    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            found = rooms.take(length)
            # new sequences are as many as are needed
            room, first, bins = found or (capacity, n, -(-left // (capacity // length)))
            each = room // length
            whole = min(bins, left // each)
            # so many sequences take as many pieces as they hold, and one more what is left, if that is fewer
            for m, k in ((each, whole), (left - whole * each, 1)):
                if m and k and bins:
                    steps.append((length, done, first, m, capacity - room))
                    rooms.put(room - m * length, first, k)
                    first, bins, done, left = first + k, bins - k, done + m * k, left - m * k
            if found:
                rooms.put(room, first, bins)
            else:
                n = first
    return np.array(steps, np.int64).reshape(-1, 5)


def pack(found: DataFrame, capacity: int = CAPACITY, bucket: int = BUCKET) -> DataFrame:
    """found, a written table with a column length and row numbers __row, with sequence_id and offset in place of __row."""
    columns = [c for c in found.columns if c != "__row"]
    full = found.where(F.col("length") == capacity).select(*columns, (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = found.where(F.col("length") < capacity)
    counts = {r["length"]: r["n"] for r in part.groupBy("length").agg(F.count("*").alias("n")).collect()}  # as many rows as there are lengths
    steps = plan(counts, capacity)
    buckets = max(1, -(-sum(counts.values()) // bucket))
    dealt = part.withColumn("__b", F.pmod(F.xxhash64("__row"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy("length", "__b").orderBy("__row")) - 1
    numbered = dealt.withColumn("__own", own).join(base, ["length", "__b"]).select(*columns, (F.col("__base") + F.col("__own")).alias("sequence_id"))
    starts = steps[:, 0] << 40 | steps[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(starts)
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("sequence_id").to_numpy()
            at = order[np.searchsorted(starts[order], length << 40 | number, side="right") - 1]
            _, first, sequence, each, offset = steps[at].T
            nth, within = np.divmod(number - first, each)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence + nth), pa.array(offset + within * length)], names=[*batch.schema.names, "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields)
    return full.unionByName(numbered.mapInArrow(place, f"{schema}, offset long"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flat = b.column("ids").values.to_numpy().astype("<u4", copy=False)
        at = b.column("ids").offsets.to_numpy()
        crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(crc, pa.int64())], names=[*b.schema.names[:4], "ids_crc32"])


def packed(docs: DataFrame, tokenizer: str) -> DataFrame:
    """For each piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    small = pieces(docs, tokenizer, then=_digests, schema="ids_crc32 long")
    return pack(Scratch(small.withColumn("__row", F.monotonically_increasing_id()), "pieces").df)
