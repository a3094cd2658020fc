"""Benchmark decontamination.

Texts are words (runs of letters and digits, lower-cased) and their 5-word shingles; a text of fewer words is one shingle.
Items are put into classes of nearly equal length (at most LIKE times the shortest), and documents are cut into windows as
long as a class's items, a STEP-th of that length apart. The SimHash of a window's shingles is compared with those of the
class's items: fingerprints are cut into 4 blocks of 16 bits, and an index has, for each block, every value within 4 bits
of an item's, so that every fingerprint within RADIUS = 17 bits is found by one block at least (17 < 4 * 5). For each window
within the radius, windows of exactly the item's length around it are compared with the item, and the best weighted Jaccard
similarity of shingles (weights: how often a shingle occurs; the sum of lesser over the sum of greater weights) decides:
THRESHOLD = 0.8 or more is a link. Where a document is shorter than an item, it is one window.

A verbatim passage differs from the nearest window by about 7 bits (about 9 at worst), a passage of similarity 0.8 by about
11, each with a deviation of 3: what lies beyond 17 bits is missed, as it is by any index of that radius. The blocks pass most
windows once a class has a few dozen items, as 17 of 64 bits is far; each window is then compared with all items of its class,
an XOR and a count of bits each, COMPARED at a time.

Items are a broadcast index: BOUND says how many bytes of item text are allowed, and beyond it items are searched in rounds
of as much, each a pass over the documents. Null and empty texts and items have no words and link with nothing. Items with
equal texts are all reported. Repeated documents are each reported. Empty tables give an empty result. Columns other than
doc_id and text, item_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import add_columns, arrow_type, text_slices, without

SHINGLE, THRESHOLD, RADIUS, BLOCK, NEAR = 5, 0.8, 17, 16, 4
#: Windows of L words are max(1, L // STEP) apart; lengths of one class differ by this factor at most.
STEP, LIKE = 9, 1.12
#: Words that are searched at once, about.
CHUNK = 32_768
#: Bytes of item text in one broadcast index; windows times items that are compared at once.
BOUND, COMPARED = 32 << 20, 1 << 21
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, 64-bit hash of each word): words are runs of letters and digits, lower-cased."""
    lowered = pc.utf8_lower(pc.cast(texts, pa.large_string()))
    # beyond ASCII, letters and digits need no table of separators; texts with other characters there get the slow way
    odd = pc.match_substring_regex(lowered, r"[^\x00-\x7f\pL\pN]").to_numpy(zero_copy_only=False)
    spaced = [None if o else x.as_buffer().to_pybytes().translate(_PLAIN) for x, o in zip(lowered, odd)]
    if odd.any():
        slow = pc.replace_substring_regex(lowered.filter(pa.array(odd)), r"[^\pL\pN]+", " ")
        for i, x in zip(np.nonzero(odd)[0], slow):
            spaced[i] = x.as_buffer().to_pybytes()
    split = pc.ascii_split_whitespace(pa.array(spaced, pa.large_binary()).cast(pa.large_string()))
    flat = split.flatten()
    offsets = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    full = pc.greater(pc.binary_length(flat), 0)
    mask = full.to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(mask)])[offsets]
    coded = flat.filter(full).dictionary_encode()
    x = xxhash.xxh64_intdigest
    hashed = np.fromiter((x(w) for w in pc.cast(coded.dictionary, pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return offsets, hashed[coded.indices.to_numpy()]


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all 5-word shingles in order; fewer words are one shingle, none are none."""
    return _sequences(words, min(SHINGLE, len(words))) if len(words) else words


def _sequences(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all sequences of k words, 5 at most."""
    n = len(words)
    mixed = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        mixed = (mixed ^ words[i : n - k + 1 + i]) * _MIX[i]
        mixed ^= mixed >> np.uint64(29)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[1]
    return mixed ^ (mixed >> np.uint64(29))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity; 0 if both are empty."""
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / (a.total() + b.total() - both) if both else 0.0


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    votes = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


class _Class:
    """Items of nearly equal length, with the index of their fingerprints' blocks."""

    def __init__(self, items: list[tuple[int, int, int]], near: np.ndarray):
        lengths = [n for _, n, _ in items]
        self.size = round((min(lengths) + max(lengths)) / 2)
        self.step = max(1, self.size // STEP)
        self.spread = max(self.size - min(lengths), max(lengths) - self.size) + self.step
        self.items = np.array([i for i, _, _ in items])
        self.fps = np.array([fp for _, _, fp in items], np.uint64)
        self.blocks = np.zeros((4, 1 << BLOCK), bool)
        for b in range(4):
            value = ((self.fps >> np.uint64(BLOCK * b)) & np.uint64(0xFFFF)).astype(np.uint32)
            self.blocks[b, (value[:, None] ^ near[None, :]).ravel()] = True

    def near(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first words, items) of windows within the radius; sums are the running votes of each bit over shingles."""
        k = self.size - SHINGLE + 1
        votes = (sums[:, k :: self.step] - sums[:, : -k : self.step]) > k // 2
        bits = votes.view(np.uint8)
        found, hit = [], None
        for b in range(4):
            value = bits[16 * b].astype(np.uint16)
            for i in range(1, 16):
                value |= bits[16 * b + i].astype(np.uint16) << np.uint16(i)
            found.append(value)
            here = self.blocks[b][value]
            hit = here if hit is None else hit | here
        at = np.flatnonzero(hit)
        fps = np.zeros(len(at), np.uint64)
        for b in range(4):
            fps |= found[b][at].astype(np.uint64) << np.uint64(BLOCK * b)
        found = []
        for begin in range(0, len(at), rows := max(1, COMPARED // len(self.fps))):
            w, item = np.divmod(np.flatnonzero(np.bitwise_count(fps[begin : begin + rows, None] ^ self.fps[None, :]) <= RADIUS), len(self.fps))
            found.append((at[w + begin] * self.step, self.items[item]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (at, at)


class Items:
    """Items (item_id, hashed words) as they are sent out, with their index, which a worker builds once."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.items, self.built = items, None

    def index(self) -> Index:
        if self.built is None:
            self.built = Index(self.items)
        return self.built


class Index:
    """Items (item_id, hashed words), searched for in the hashed words of documents."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        near = np.array([0, *(sum(1 << b for b in c) for r in range(1, NEAR + 1) for c in combinations(range(BLOCK), r))], np.uint32)
        self.ids, self.words = [i for i, _ in items], [w for _, w in items]
        self.own = [shingles(w) for _, w in items]
        self.counts = [Counter(x.tolist()) for x in self.own]
        self.sets = [set(c) for c in self.counts]
        long = sorted((len(w), i) for i, w in enumerate(self.words) if len(w) >= SHINGLE)
        self.classes, part = [], []
        for n, i in [*long, (None, None)]:
            if part and (n is None or n > part[0][0] * LIKE):
                self.classes.append(_Class([(j, m, fingerprint(self.own[j])) for m, j in part], near))
                part = []
            part.append((n, i))
        #: Items of fewer words than a shingle, by length: the hash of all their words.
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, w in enumerate(self.words):
            if 0 < len(w) < SHINGLE:
                self.short[len(w)][int(self.own[i][0])].append(i)
        #: Running votes wrap around, which their differences don't show as long as a window's votes fit.
        longest = max([c.size for c in self.classes], default=0)
        self.kind = np.int8 if longest < 128 else np.int16 if longest < 1 << 15 else np.int32
        self.pad = max([c.size + 2 * c.spread for c in self.classes], default=0) + SHINGLE

    def search(self, words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, object, int, int, float]]:
        """(document, item, first word, words, similarity): the best window of each document for each item."""
        begin = 0
        for end in range(1, len(offsets)):
            if end == len(offsets) - 1 or offsets[end + 1] - offsets[begin] > CHUNK:
                part = words[offsets[begin] : offsets[end]]
                if len(part) <= 2 * CHUNK:
                    found = self._chunk(part, offsets[begin : end + 1] - offsets[begin])
                else:  # one long document
                    found = self._long(part)
                for doc, item, at, n, s in found:
                    yield begin + doc, self.ids[item], at, n, s
                begin = end

    def _long(self, words: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """A document in parts that overlap by more than any window, for memory."""
        best: dict[int, tuple[int, int, int, int, float]] = {}
        for a in range(0, len(words), CHUNK):
            part = words[a : a + CHUNK + 2 * self.pad]
            for _, item, at, n, s in self._chunk(part, np.array([0, len(part)])):
                if item not in best or s > best[item][4]:
                    best[item] = (0, item, a + at, n, s)
        return list(best.values())

    def _chunk(self, words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        if not len(words):
            return
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        # documents stand one after the other; windows over their edges are candidates too, and are verified within one
        padded = np.concatenate([words, np.zeros(self.pad, np.uint64)])
        own = shingles(padded)
        sums = np.zeros((64, len(own) + 1), self.kind)
        by_byte = np.ascontiguousarray(own.astype("<u8").view(np.uint8).reshape(-1, 8).T)
        for bit in range(64):
            votes = (by_byte[bit >> 3] >> np.uint8(bit & 7)) & np.uint8(1)
            np.cumsum(votes.view(np.int8).astype(self.kind, copy=False), dtype=self.kind, out=sums[bit, 1:])
        listed = own.tolist()
        for c in self.classes:
            starts, items = c.near(sums)
            docs = np.searchsorted(offsets, np.minimum(starts + c.size // 2, len(words) - 1), side="right") - 1
            for start, item, doc in zip(starts.tolist(), items.tolist(), docs.tolist()):
                self._verify(best, listed, doc, int(offsets[doc]), int(offsets[doc + 1]), item, start, c.spread)
        for length, known in self.short.items():
            if len(words) >= length:
                hashed = _sequences(words, length)
                for at in np.nonzero(np.isin(hashed, np.array(list(known), np.uint64)))[0].tolist():
                    doc = int(np.searchsorted(offsets, at, side="right")) - 1
                    if at + length <= offsets[doc + 1]:
                        for item in known[int(hashed[at])]:
                            best.setdefault((doc, item), (1.0, at - int(offsets[doc]), length))
        for (doc, item), (s, at, n) in best.items():
            yield doc, item, at, n, s

    def _verify(self, best: dict, own: list[int], doc: int, a: int, b: int, item: int, start: int, spread: int) -> None:
        n, count = len(self.words[item]), self.counts[item]
        if b - a < SHINGLE or best.get((doc, item), (0.0,))[0] == 1.0:
            return
        size = min(n, b - a)
        first, last = max(a, min(start - spread, b - size)), min(b - size, max(start + spread, a))
        # of the item's shingles, those that any of these windows could have
        reach = self.sets[item].intersection(own[first : last + size - SHINGLE + 1])
        if len(reach) < THRESHOLD * len(count) and sum(count[x] for x in reach) < THRESHOLD * len(self.own[item]):
            return
        for at in range(first, last + 1):
            s = similarity(Counter(own[at : at + size - SHINGLE + 1]), count)
            if s >= THRESHOLD and s > best.get((doc, item), (0.0,))[0]:
                best[doc, item] = (s, at - a, size)


def _rounds(items: DataFrame) -> Iterator[Broadcast]:
    """The items with their hashed words, in broadcasts of BOUND bytes of text, about."""
    rows = items.select("item_id", "text").where("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rounds = -(-total // BOUND) or 1
    for r in range(rounds):
        part = rows if rounds == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == r)
        held = part.orderBy("item_id", "text").collect()
        offsets, words = word_codes(pa.array([x["text"] for x in held], pa.large_string()))
        yield items.sparkSession.sparkContext.broadcast(Items([(x["item_id"], words[offsets[i] : offsets[i + 1]]) for i, x in enumerate(held)]))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): the best window of each document for each item it holds."""
    return reduce(DataFrame.unionByName, (_search(docs, sent, items) for sent in _rounds(items)))


def marked(docs: DataFrame, items: DataFrame, name: str = "contaminated") -> DataFrame:
    """docs with a boolean column: whether a row's text holds an item. No row leaves its place, so nothing is shuffled."""
    docs, hits = without(docs, name), []
    for sent in _rounds(items):

        def make(texts: pa.Array, sent: Broadcast = sent) -> list[pa.Array]:
            offsets, words = word_codes(texts)
            hit = np.zeros(len(texts), bool)
            hit[[i for i, *_ in sent.value.index().search(words, offsets)]] = True
            return [pa.array(hit)]

        hits.append(f"__hit{len(hits)}")
        docs = add_columns(docs, "text", make, [T.StructField(hits[-1], T.BooleanType())])
    return without(docs.withColumn(name, reduce(Column.__or__, map(F.col, hits))), *hits)


def _search(docs: DataFrame, sent: Broadcast, items: DataFrame) -> DataFrame:
    doc, item = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType
    kind = arrow_type(item)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value.index()
        for whole in batches:
            for batch in text_slices(whole):
                at, words = word_codes(pc.fill_null(batch.column("text"), ""))
                found = list(index.search(words, at))
                if found:
                    row, ids, begin, size, s = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(ids, kind), pa.array(begin, pa.int64()), pa.array(size, pa.int64()), pa.array(s, pa.float64())], names=["doc_id", "item_id", "start_word", "n_words", "similarity"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc}, item_id {item.simpleString()}, start_word long, n_words long, similarity double")
