"""Language-model scoring by Brown class bigrams.

P(text) is the product over tokens of P(class | class before) * P(word | class). Every word of the training text has a class
that its own neighbours chose. The exchange algorithm (Martin, Liermann, Ney, 1998) assigns units to CLASSES classes by the
class bigrams of the whole training text: units are the UNITS most frequent words, and for all other words their endings
(the last two bytes). One pass then places each of the other words by itself: from the counts of the classes to its left and
right, it moves to the class in which the likelihood of the class bigrams is highest (see `place`). Class bigrams are counted
anew over these classes, and interpolated with the class's share of all tokens. In a class the frequent words have their
shares of its tokens, and the other words divide the rest, by (c + 1). Only words that training lacks go by their ending: to its class, where each ending has one share of that rest for them. Endings
that training lacks share one unit.

Words are held as 64-bit hashes (XXH64). Two of n distinct words share one with a chance of about n * n / 4e19.

Counts are of the whole training text: counted by partition, then summed by word in Spark. Only the most frequent words (HEAD at most)
and their classes, the number of words with each count, the units' bigrams (at most (UNITS + ENDINGS) squared) and the endings' totals come
to the driver; counts and classes of all other words are joined to the documents that hold them.

Null and empty texts are one token, their end. Documents with a null doc_id are scored, and never learnt from. Repeated rows
count as often as they occur. With no training text each class probability is uniform, and the score is finite. An empty
table gives an empty result; columns other than doc_id and text are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, bucket_of, freeing, text_slices

#: Words that are units of their own; endings that are units; classes (63 at most); words whose counts are sent to every task;
#: bytes of text that are looked at together.
UNITS, ENDINGS, CLASSES, HEAD, SLICE = 1500, 1000, 48, 1 << 17, 4 << 20
#: Rounds of the exchange algorithm over all units; weight of the bigrams against a class's own share.
ROUNDS, BIGRAM = 4, 0.9
#: The hash that stands for a document's end, and the ending's number that stands for all endings without a unit.
END, OTHER = np.int64(-1), -2


def tokens(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(offsets of the texts in codes, distinct words, codes): words are runs of what isn't ASCII white space, lower-cased A-Z."""
    texts = pc.take(texts, pa.array(np.arange(len(texts))))  # a copy, as ascii_lower reads a slice that begins later at wrong offsets
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.cast(texts, pa.large_string())))
    flat, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full).as_py():  # white space at a text's end leaves empty strings
        mask = full.to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(mask)])[offsets]
        flat = flat.filter(full)
    coded = flat.dictionary_encode()
    return offsets, pc.cast(coded.dictionary, pa.large_binary()).to_pylist(), coded.indices.to_numpy()


def hashes(words: list[bytes]) -> np.ndarray:
    x = xxhash.xxh64_intdigest
    found = np.fromiter((x(w) for w in words), np.uint64, len(words)).view(np.int64)
    found[found == END] = 0
    return found


def endings(words: list[bytes]) -> np.ndarray:
    """The last two bytes as a number, and 256 for a byte that is missing."""
    return np.fromiter((w[-1] + 257 * (w[-2] if len(w) > 1 else 256) for w in words), np.int64, len(words))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []

    def out() -> pa.RecordBatch:
        h, e, n = (np.concatenate(x) for x in zip(*held))
        held.clear()
        h, first, at = np.unique(h, return_index=True, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(e[first]), pa.array(np.bincount(at, n).astype(np.int64))], names=["word", "ending", "c"])

    for whole in batches:
        for batch in text_slices(whole, most=SLICE):
            _, words, codes = tokens(pc.fill_null(batch.column("text"), ""))
            held.append((np.append(hashes(words), END), np.append(endings(words), -1), np.append(np.bincount(codes, minlength=len(words)), batch.num_rows)))
            if sum(len(h) for h, _, _ in held) > 1_000_000:
                yield out()
    if held:
        yield out()


class Units:
    """What turns words into units: sorted hashes of the head with counts, and the units of head words and of endings."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, head_endings: np.ndarray, ends: np.ndarray):
        own = np.zeros(len(head), bool)
        own[np.argsort(-counts, kind="stable")[:UNITS]] = True
        self.head, self.counts, self.own, self.ends = head, counts, own, ends
        # unit 0 is a document's end, then the words, then the endings, then other endings
        self.of_head = np.where(own, np.cumsum(own), 0)
        self.first_ending = 1 + int(own.sum())
        self.n = self.first_ending + len(ends) + 1
        rest = ~own
        self.of_head[rest] = self.of_ending(head_endings[rest])

    def of_ending(self, e: np.ndarray) -> np.ndarray:
        if not len(self.ends):
            return np.full(len(e), self.n - 1)
        at = np.minimum(np.searchsorted(self.ends, e), len(self.ends) - 1)
        return np.where(self.ends[at] == e, self.first_ending + at, self.n - 1)

    def look(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, counts, units); the count is -1 for words outside the head."""
        h = hashes(words)
        unit, c = self.of_ending(endings(words)), np.full(len(h), -1, np.int64)
        if len(self.head) and len(h):
            at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
            hit = self.head[at] == h
            c[hit], unit[hit] = self.counts[at[hit]], self.of_head[at[hit]]
        return h, c, unit


def _with_ends(offsets: np.ndarray, values: np.ndarray, end: int) -> np.ndarray:
    return np.insert(values, offsets[1:], end)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(left: np.ndarray, right: np.ndarray, n: np.ndarray, units: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of the units 0 to units - 1 from their bigram counts; unit 0 stays alone in class 0.

    Each round tries every unit, most frequent first, in each class, and moves it to where the likelihood of the class
    bigrams is highest; ties go to the lower class.
    """
    total = np.bincount(right, n, units)
    order = np.argsort(-total[1:], kind="stable") + 1
    of = np.zeros(units, np.int64)
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    pair = np.zeros((classes, classes))
    np.add.at(pair, (of[left], of[right]), n)
    by_l, by_r = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    l_at, r_at = np.searchsorted(left[by_l], np.arange(units + 1)), np.searchsorted(right[by_r], np.arange(units + 1))
    f = _xlogx
    for _ in range(rounds):
        moved = 0
        for u in order:
            if not total[u]:
                continue
            out, into = by_l[l_at[u] : l_at[u + 1]], by_r[r_at[u] : r_at[u + 1]]
            loop = n[out[right[out] == u]].sum()
            row = np.bincount(of[right[out]], n[out] * (right[out] != u), classes)
            col = np.bincount(of[left[into]], n[into] * (left[into] != u), classes)
            was = of[u]
            pair[was, :] -= row
            pair[:, was] -= col
            pair[was, was] -= loop
            rows, cols = pair.sum(1), pair.sum(0)
            base = f(pair)
            grown_r, grown_c = f(pair + row[None, :]), f(pair + col[:, None])
            gain = (grown_r - base).sum(1) + (grown_c - base).sum(0)
            d = np.arange(classes)
            gain += f(pair[d, d] + row + col + loop) - grown_r[d, d] - grown_c[d, d] + base[d, d]
            # wherever u goes, its neighbours' classes gain in their sums
            rows, cols = rows + col, cols + row
            gain -= f(rows + row.sum() + loop) - f(rows) + f(cols + col.sum() + loop) - f(cols)
            gain[0] = -np.inf
            now = int(np.argmax(gain))
            pair[now, :] += row
            pair[:, now] += col
            pair[now, now] += loop
            moved += now != was
            of[u] = now
        if not moved:
            break
    return of


def _arrays(df: DataFrame) -> list[np.ndarray]:
    """The columns of a table of whole numbers that is small enough for the driver."""
    table = df.toArrow()
    return [c.to_numpy().astype(np.int64) for c in table.columns]


def _sorted(*columns: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(columns[0])
    return [c[order] for c in columns]


def steps(moves: np.ndarray) -> np.ndarray:
    """Probabilities of the next class from counts of class bigrams."""
    share = (moves.sum(0) + 1) / (moves.sum() + CLASSES)
    return np.where(moves.sum(1, keepdims=True) > 0, BIGRAM * moves / np.maximum(moves.sum(1, keepdims=True), 1) + (1 - BIGRAM) * share, share)


def fit(train: DataFrame) -> tuple[dict, DataFrame]:
    """The units' model, bounded by the parameters above, and the table of all words' counts (word, ending, c)."""
    counts = Scratch(train.select("text").mapInArrow(_count, "word long, ending long, c long").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("c").alias("c")), "words").df
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words = counts.where(F.col("word") != int(END))
    # how many words have each count says from which count on all words fit into the head
    count, n_words = _arrays(words.groupBy("c").agg(F.count("*").alias("n")))
    order = np.argsort(-count)
    fits = count[order][np.cumsum(n_words[order]) <= HEAD]
    least = int(fits.min()) if len(fits) else 1 << 62
    head, head_endings, head_counts = _sorted(*_arrays(words.where(F.col("c") >= least).select("word", "ending", "c")))
    top = head[np.lexsort((head, -head_counts))][:UNITS]
    # totals of the words that are no units of their own, by ending: at most 257 * 257 rows
    tails = words.where(~F.col("word").isin([int(w) for w in top])) if len(top) else words
    ending, tail_n, tail_v = _arrays(tails.groupBy("ending").agg(F.sum("c").alias("n"), F.count("*").alias("v")))
    ends = np.sort(ending[np.lexsort((ending, -tail_n))][:ENDINGS])
    units = Units(head, head_counts, head_endings, ends)
    inner_n, inner_v = np.zeros(units.n), np.zeros(units.n)
    at = units.of_ending(ending)
    np.add.at(inner_n, at, tail_n)
    np.add.at(inner_v, at, tail_v)

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, n = (np.concatenate(x) for x in zip(*held))
            k, at = np.unique(k, return_inverse=True)
            return k, np.bincount(at, n).astype(np.int64)

        for whole in batches:
            for batch in text_slices(whole, most=SLICE):
                offsets, words, codes = tokens(pc.fill_null(batch.column("text"), ""))
                seq = _with_ends(offsets, units.look(words)[2][codes], 0)
                k = np.concatenate([[0], seq[:-1]]) * units.n + seq
                held.append(np.unique(k, return_counts=True))
                if len(held) > 8:
                    held[:] = [merged()]
        if held:
            k, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["pair", "n"])

    pair, n = _sorted(*_arrays(train.select("text").mapInArrow(bigrams, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))))
    left, right, n = pair // units.n, pair % units.n, n.astype(float)
    of = exchange(left, right, n, units.n)
    moves = np.zeros((CLASSES, CLASSES))
    np.add.at(moves, (of[left], of[right]), n)
    # a unit's share of its class; the word's share of its unit follows by (c + 1) / within
    mass = np.bincount(right, n, units.n) + 1
    in_class = mass / np.bincount(of, mass, CLASSES)[of]
    within = inner_n + inner_v + 1
    model = {"units": units, "of": of, "moves": moves, "step": np.log10(steps(moves)), "emit": np.log10(in_class), "within": np.log10(within), "total": int(total), "distinct": int(distinct), "least": least if len(fits) < len(count) else 0, "ends": int(total and counts.where(F.col("word") == int(END)).first()["c"])}
    return model, words


def place(moves: np.ndarray, was: np.ndarray, word: np.ndarray, slot: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best class of each word: it leaves its class `was`, and goes where the likelihood of the class bigrams is highest.

    The rest say how often (n) a word has a class to its left (slot below CLASSES) or its right (CLASSES + class), every
    word with both. Only these entries are looked at. Ties go to the lower class; class 0 is the end's alone, and
    no word goes to an empty class.
    """
    order = np.lexsort((slot, word))
    word, slot, n = word[order], slot[order], n[order].astype(float)
    sides = np.zeros((2, len(was), CLASSES))
    gain, at = np.zeros((len(was), CLASSES)), np.arange(len(was))
    for side in (0, 1):
        mine = slot // CLASSES == side
        sides[side, word[mine], slot[mine] % CLASSES] = n[mine]
    for side, table in ((0, moves), (1, moves.T)):
        mine = slot // CLASSES == side
        w, j, m = word[mine], slot[mine] % CLASSES, n[mine]
        without = table[j]
        without[np.arange(len(w)), was[w]] -= m
        same = j == was[w]
        without[same] -= sides[1 - side][w[same]]
        without = np.maximum(without, 0)
        gain += np.add.reduceat(_xlogx(without + m[:, None]) - _xlogx(without), np.searchsorted(w, at), axis=0)
        sums = np.tile(table.sum(0), (len(was), 1))
        c = sides[side].sum(1)
        sums[at, was] = np.maximum(sums[at, was] - c, 0)
        gain -= _xlogx(sums + c[:, None]) - _xlogx(sums)
    # a class next to itself is in both sums
    into, out = sides
    both = np.tile(np.diag(moves), (len(was), 1))
    both[at, was] = np.maximum(both[at, was] - into[at, was] - out[at, was], 0)
    gain += _xlogx(both + into + out) - _xlogx(both + into) - _xlogx(both + out) + _xlogx(both)
    gain[:, moves.sum(0) == 0] = -np.inf  # words that choose at the same time would all meet in an empty class
    gain[:, 0] = -np.inf
    return gain.argmax(1)


def placed(train: DataFrame, model: dict) -> DataFrame:
    """(word, c, class) of all words of train that are no units of their own."""
    units, of, moves = model["units"], model["of"], model["moves"]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each word of a slice of texts a row, with its slots and their counts packed: a count times 128, and the slot."""
        width = 2 * CLASSES
        for whole in batches:
            for batch in text_slices(whole, most=SLICE):
                offsets, words, codes = tokens(pc.fill_null(batch.column("text"), ""))
                h, _, unit = units.look(words)
                klass, other = of[unit], unit >= units.first_ending
                code, seq = _with_ends(offsets, codes, -1), _with_ends(offsets, klass[codes], 0)
                on = np.nonzero((code >= 0) & other[code])[0]  # an end follows every text, so there is a next one
                before, after = np.where(on > 0, seq[on - 1], 0), seq[on + 1]
                k, n = np.unique(np.concatenate([code[on] * width + before, code[on] * width + CLASSES + after]), return_counts=True)
                own, first = np.unique(k // width, return_index=True)
                packed = (n << 7 | k % width).astype(np.int32)
                ends = np.append(first, len(k)).astype(np.int32) * 4
                near = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(packed.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(h[own]), pa.array(klass[own].astype(np.int32)), near], names=["word", "was", "near"])

    def chosen(word: np.ndarray, was: np.ndarray, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The classes of words, 2048 at a time; key is a word's number times 2 * CLASSES and a slot, in order and without repeats."""
        width = 2 * CLASSES
        for begin in range(0, len(word), 2048):
            part = slice(*np.searchsorted(key, [begin * width, (begin + 2048) * width]))
            at, slot = np.divmod(key[part] - begin * width, width)
            found = place(moves, was[begin : begin + 2048], at, slot, n[part])
            c = np.bincount(at, n[part] * (slot < CLASSES), len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word[begin : begin + 2048]), pa.array(c), pa.array(found.astype(np.int32))], names=["word", "c", "class"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in the order of their words: each word's counts, summed as its rows come, give its class."""
        width, last = 2 * CLASSES, None  # the last word's rows may go on in the next batch: (word, was, slots, counts)
        for batch in batches:
            if not batch.num_rows:
                continue
            word, was, near = batch.column("word").to_numpy(), batch.column("was").to_numpy(), batch.column("near")
            ends = np.frombuffer(near.buffers()[1], np.int32)[near.offset : near.offset + batch.num_rows + 1] // 4
            packed = np.frombuffer(near.buffers()[2], np.int32)[ends[0] : ends[-1]]
            row, slot, n = np.repeat(np.arange(batch.num_rows), np.diff(ends)), packed & 127, (packed >> 7).astype(np.int64)
            if last:
                word, was = np.append(last[0], word), np.append(last[1], was)
                row, slot, n = np.concatenate([np.zeros(len(last[2]), np.int64), row + 1]), np.concatenate([last[2], slot]), np.concatenate([last[3], n])
            new = np.append(True, word[1:] != word[:-1])
            key, at = np.unique((np.cumsum(new) - 1)[row] * width + slot, return_inverse=True)
            n = np.bincount(at, n).astype(np.int64)
            word, was = word[new], was[new]
            cut = np.searchsorted(key, (len(word) - 1) * width)
            last = (word[-1], was[-1], key[cut:] % width, n[cut:])
            yield from chosen(word[:-1], was[:-1], key[:cut], n[:cut])
        if last:
            yield from chosen(np.array([last[0]]), np.array([last[1]]), last[2], last[3])

    near = train.select("text").mapInArrow(contexts, "word long, was int, near binary").repartition("word").sortWithinPartitions("word")
    return Scratch(near.mapInArrow(choose, "word long, c long, class int"), "placed").df


def shares(model: dict, others: DataFrame) -> np.ndarray:
    """What divides a word's count + 1 in its class, for the units' own words (row 0) and for all others (row 1).

    The other words share what their tokens are of the class by their counts + 1, and each ending has one share more.
    """
    units, of = model["units"], model["of"]
    own, rest = np.zeros(CLASSES), np.zeros(CLASSES)
    np.add.at(own, of[units.of_head[units.own]], units.counts[units.own] + 1)
    inner = np.bincount(of[units.first_ending :], minlength=CLASSES).astype(float)
    klass, n, v = _arrays(others.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")))
    np.add.at(rest, klass, n)
    np.add.at(inner, klass, n + v)
    whole = own + rest + 1
    return np.stack([whole, whole * np.maximum(inner, 1) / (rest + 1)])


def score(docs: DataFrame, held_out: int = 2, of: int = 7) -> DataFrame:
    """For each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; see the module."""
    with freeing():
        return _scored(docs, held_out, of)


def _scored(docs: DataFrame, held_out: int, of: int) -> DataFrame:
    marked = docs.select("doc_id", "text", F.coalesce(bucket_of(F.col("doc_id"), of) == held_out, F.lit(True)).alias("held_out"))
    train = marked.where("not held_out")
    model, _ = fit(train)
    units, per_class, n_total, n_types, n_ends = model["units"], model["of"], model["total"], model["distinct"], model["ends"]
    least = model["least"]  # words below it aren't in the head
    others = placed(train, model)
    divides = np.log10(shares(model, others))
    head_class = per_class[units.of_head]
    word, klass = _arrays(others.where(F.col("c") >= least).select("word", "class")) if len(units.head) else (np.empty(0, np.int64),) * 2
    head_class[np.searchsorted(units.head, word)] = klass

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Classes of all tokens, and the hashes of those outside the head, whose class is that of their ending, less CLASSES."""
        for whole in batches:
            for batch in text_slices(whole, most=SLICE):
                offsets, words, codes = tokens(pc.fill_null(batch.column("text"), ""))
                h, c, unit = units.look(words)
                k, hit = per_class[unit], c >= 0
                if hit.any():
                    k[hit] = head_class[np.searchsorted(units.head, h[hit])]
                known = np.log10(np.maximum(c, 0) + 1.0)
                sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[offsets])
                size, rare = np.diff(offsets), ~hit[codes]
                n_rare = np.concatenate([[0], np.cumsum(rare)])[offsets]
                base = sums(known[codes]) + np.log10(n_ends + 1) - (size + 1) * np.log10(n_total + n_types + 1)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), batch.column("held_out"), pa.array(size + 1), pa.array(size - np.diff(n_rare) + (1 if n_ends else 0)), pa.array(base),
                    pa.array(sums(np.where(hit, known - divides[(unit >= units.first_ending).astype(int), k], 0.0)[codes])),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.where(hit, k, k - CLASSES)[codes].astype(np.int8))),
                    pa.ListArray.from_arrays(pa.array(n_rare.astype(np.int32)), pa.array(h[codes[rare]])),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "classes", "rare"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The classes of joined words in place, and what all words outside the head add to the scores."""
        for batch in batches:
            lists, met = batch.column("classes"), batch.column("met")
            offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            k = lists.flatten().to_numpy().astype(np.int64)
            rare = np.nonzero(k < 0)[0]
            k[rare] += CLASSES
            first = np.searchsorted(rare, offsets[:-1])
            size = pc.fill_null(pc.list_value_length(met), 0).to_numpy()
            place_of, klass, c = (x.to_numpy().astype(np.int64) for x in met.flatten().flatten())
            at = np.repeat(first, size) + place_of
            k[rare[at]] = klass
            known = np.zeros(len(rare))
            known[at] = np.log10(c + 1.0)
            ends = np.append(first, len(rare))
            sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[ends])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), batch.column("n_tokens"), pa.array(batch.column("n_known").to_numpy() + size),
                pa.array(batch.column("base_score").to_numpy() + sums(known)), pa.array(batch.column("score").to_numpy() + sums(known - divides[1, k[rare]])),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(k.astype(np.int8))),
            ], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "classes"])

    def pairs(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(class before * CLASSES + class of all tokens and ends, places after the ends)"""
        offsets = column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py()
        seq = _with_ends(offsets, column.flatten().to_numpy().astype(np.int64), 0)
        return np.concatenate([[0], seq[:-1]]) * CLASSES + seq, np.concatenate([[0], offsets[1:] + np.arange(1, len(offsets))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            n += np.bincount(pairs(batch.column("classes"))[0], minlength=len(n)) if batch.num_rows else 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["pair", "n"])

    kind = marked.schema["doc_id"].dataType.simpleString()
    so_far = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    held = Scratch(marked.mapInArrow(sequences, f"{so_far}, classes array<tinyint>, rare array<long>").withColumn("__row", F.monotonically_increasing_id()), "scored").df
    tail = others.where(F.col("c") < least).select("word", "c", "class")
    met = held.select("__row", F.posexplode("rare").alias("pos", "word")).join(tail, "word").groupBy("__row").agg(F.collect_list(F.struct("pos", "class", "c")).alias("met"))
    full = Scratch(held.drop("rare").join(met, "__row", "left").drop("__row").mapInArrow(fill, f"{so_far}, classes array<tinyint>"), "classes").keep().df
    pair, n = _arrays(full.where("not held_out").select("classes").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    moves = np.bincount(pair, n, CLASSES * CLASSES).reshape(CLASSES, CLASSES)
    step = np.log10(steps(moves)).ravel()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pair, at = pairs(batch.column("classes"))
                made = batch.column("score").to_numpy() + np.diff(np.concatenate([[0.0], np.cumsum(step[pair])])[at])
                total = pa.array(np.full(batch.num_rows, n_total, np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], total, batch.column("base_score"), pa.array(made)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return full.mapInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
