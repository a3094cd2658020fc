"""Language identification by unigrams of pieces, summed over all segmentations.

The pieces are those of a public vocabulary (a sentencepiece model; its path is a parameter) that are letters. For each
language the pieces have probabilities; the probability of a word is the sum, over all ways to cut it into pieces, of the
product of the pieces' probabilities, which a forward pass over the word gives. A text's probability is the product over its
words (runs of letters, lower-cased, with the vocabulary's word mark in front); the languages have equal priors, and the
score is the posterior of the language that is predicted. Piece probabilities are fitted by ROUNDS rounds of expectation and
maximisation (forward-backward) over the words of up to SAMPLE training documents for each language, those with the least
hashes of their ids; SAMPLE is the bound of the sample. Words are whole, however long: over LONGEST letters the sums are of
logarithms, as products would vanish. A letter outside the vocabulary has the same small probability in each language.

Documents with a null doc_id, a null text or a null language are never learnt from. A text that is null or has no letter
is `und` with score 0; with no training documents at all, so is every text. Repeated rows are predicted alike. Ties between
languages go to the first in alphabetical order. Other columns are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import Scratch, add_columns, bucket_of, freeing, text_slices, without

SAMPLE, ROUNDS, LONGEST = 300, 3, 32
#: Probability of a letter without a piece; what is added to each piece's expected count; words a worker remembers.
FLOOR, ADDED, REMEMBERED = 1e-9, 0.02, 200_000
#: Rows of ids that may be broadcast (an id and a language: below 100 bytes each).
BROADCAST_ROWS = 200_000
UNKNOWN = "und"
MARK = "▁"


class Pieces:
    """The vocabulary's letter pieces as a trie in arrays: rows are nodes with children, columns are letters."""

    held: dict[str, Pieces] = {}

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        listed = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
        self.pieces = sorted({p for p in listed if p.lower() == p and p.removeprefix(MARK).isalpha() or p == MARK})
        letters = sorted({c for p in self.pieces for c in p})
        # letter 0: any other
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        inner = sorted({p[:i] for p in self.pieces for i in range(len(p))})
        node = {p: i + 1 for i, p in enumerate(inner)}  # 0: nothing goes on from here, 1: the root
        self.next, self.piece = ({}, {})
        column = {c: i + 1 for i, c in enumerate(letters)}
        width = len(letters) + 1
        keys, self.width = {}, width
        for p in inner[1:]:
            keys[node[p[:-1]] * width + column[p[-1]]] = [node[p], -1]
        for i, p in enumerate(self.pieces):
            keys.setdefault(node[p[:-1]] * width + column[p[-1]], [0, -1])[1] = i
        # rows of a node are apart: a hash table of twice the size, so that a step is one or two looks
        self.bits = int(np.ceil(np.log2(4 * len(keys))))
        size = 1 << self.bits
        self.key, self.to, self.id = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.full(size, -1, np.int32)
        for k, (to, i) in keys.items():
            at = self._slot(np.int64(k))
            while self.key[at] >= 0:
                at = (at + 1) & (size - 1)
            self.key[at], self.to[at], self.id[at] = k, to, i
        self.longest = max(map(len, self.pieces))
        # the farthest that a key sits from its slot
        full = np.nonzero(self.key >= 0)[0]
        self.reach = int(((full - self._slot(self.key[full])) & (size - 1)).max()) + 1

    def _slot(self, k):
        with np.errstate(over="ignore"):
            return ((np.asarray(k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def step(self, node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next nodes, pieces that end here or -1)."""
        k = node.astype(np.int64) * self.width + letter
        at = self._slot(k)
        to, ids = np.zeros(len(k), np.int32), np.full(len(k), -1, np.int32)
        left = np.arange(len(k))
        for _ in range(self.reach):
            here = self.key[at[left]]
            hit = left[here == k[left]]
            to[hit], ids[hit] = self.to[at[hit]], self.id[at[hit]]
            left = left[(here != k[left]) & (here >= 0)]
            if not len(left):
                break
            at[left] = (at[left] + 1) & (len(self.key) - 1)
        return to, ids

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words by their length: (their places, their letters with the mark, a row for each word)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(sizes):
            places = np.nonzero(sizes == n)[0]
            marked = "".join(MARK + words[i] for i in places)
            points = np.frombuffer(marked.encode("utf-32-le"), np.uint32).reshape(len(places), n + 1)
            at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
            yield places, np.where(self.letters[at] == points, at + 1, 0)

    def spans(self, letters: np.ndarray, begin: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, rows, pieces) of the pieces that begin at one place; -1 is a letter without a piece."""
        rows, node = np.arange(len(letters)), np.ones(len(letters), np.int32)
        for end in range(begin + 1, min(letters.shape[1], begin + self.longest) + 1):
            node, ids = self.step(node, letters[rows, end - 1])
            hit = ids >= 0
            if end == begin + 1:
                hit[:] = True
            if hit.any():
                yield begin, end, rows[hit], ids[hit]
            on = node > 0
            rows, node = rows[on], node[on]
            if not len(rows):
                return

    def every_span(self, letters: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        return [span for begin in range(letters.shape[1]) for span in self.spans(letters, begin)]


def _forward(n: int, size: int, spans: list, p: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of each prefix: prefixes x words x languages. p's last row is the FLOOR."""
    alpha = np.zeros((size + 1, n, p.shape[1]))
    alpha[0] = 1
    for begin, end, rows, ids in spans:
        alpha[end, rows] += alpha[begin, rows] * p[ids]
    return alpha


def _long_forward(pieces: Pieces, letters: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Logarithms of the sums that _forward makes."""
    n, size = letters.shape
    alpha = np.full((size + 1, n, logs.shape[1]), -np.inf)
    alpha[0] = 0
    for at in range(size):
        for begin, end, rows, ids in pieces.spans(letters, at):
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[begin, rows] + logs[ids])
    return alpha


def word_scores(pieces: Pieces, words: list[str], p: np.ndarray) -> np.ndarray:
    """Natural logarithm of each word's probability by language."""
    out = np.zeros((len(words), p.shape[1]))
    for places, letters in pieces.groups(words):
        n, size = letters.shape
        if size > LONGEST + 1:
            out[places] = _long_forward(pieces, letters, np.log(p))[size]
        else:
            out[places] = np.log(np.maximum(_forward(n, size, pieces.every_span(letters), p)[size], 1e-300))
    return out


def expected(pieces: Pieces, words: list[str], n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected count of each piece over the segmentations of the words, for one language (p has one column)."""
    out = np.zeros(len(p))
    for places, letters in pieces.groups(words):
        rows_n, size = letters.shape
        if size > LONGEST + 1:
            logs = np.log(p)
            alpha = _long_forward(pieces, letters, logs)[:, :, 0]
            beta = np.full_like(alpha, -np.inf)
            beta[size] = 0
            for at in reversed(range(size)):
                for begin, end, rows, ids in pieces.spans(letters, at):
                    inner = logs[ids, 0] + beta[end, rows]
                    beta[begin, rows] = np.logaddexp(beta[begin, rows], inner)
                    np.add.at(out, ids, np.exp(alpha[begin, rows] + inner - alpha[size, rows]) * n[places][rows])
            continue
        spans = pieces.every_span(letters)
        alpha = _forward(rows_n, size, spans, p)[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[size] = 1
        for begin, end, rows, ids in reversed(spans):
            beta[begin, rows] += beta[end, rows] * p[ids, 0]
        scale = n[places] / np.maximum(alpha[size], 1e-300)
        for begin, end, rows, ids in spans:
            np.add.at(out, ids, alpha[begin, rows] * p[ids, 0] * beta[end, rows] * scale[rows])
    return out


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(offsets of the texts in codes, distinct words, codes): runs of letters, lower-cased."""
    split = pc.split_pattern_regex(pc.utf8_lower(pc.cast(texts, pa.large_string())), r"\PL+")
    flat, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    full = pc.greater(pc.binary_length(flat), 0)
    offsets = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[offsets]
    coded = flat.filter(full).dictionary_encode()
    return offsets, coded.dictionary.to_pylist(), coded.indices.to_numpy()


class Model:
    """Languages, and their piece probabilities (pieces x languages, the last row for letters without a piece)."""

    def __init__(self, path: str, languages: list[str], p: np.ndarray):
        self.path, self.languages, self.p = path, languages, p
        self.known: dict[str, np.ndarray] = {}

    def scores(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        pieces = Pieces.of(self.path)
        offsets, words, codes = words_of(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        table = np.zeros((len(words) + 1, len(self.languages)))
        new = []
        for i, w in enumerate(words):
            if (x := self.known.get(w)) is None:
                new.append(i)
            else:
                table[i] = x
        made = word_scores(pieces, [words[i] for i in new], self.p)
        table[new] = made
        for i, x in zip(new, made):
            if len(self.known) >= REMEMBERED:
                break
            self.known[words[i]] = x
        some = np.diff(offsets) > 0
        total = np.zeros((len(texts), table.shape[1]))
        for k in range(table.shape[1] if some.any() else 0):  # one language at a time, for memory
            total[some, k] = np.add.reduceat(table[:, k][codes], offsets[:-1][some])
        best = total.argmax(1)
        posterior = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, some)], np.where(some, posterior, 0.0)


def sample(train: DataFrame, size: int = SAMPLE) -> DataFrame:
    """Up to `size` training documents of each language, those with the least hashes of their ids: (lang, text).

    Rows whose hash is above a bound are left out before ids are put in order; the bound leaves four times as many ids as are
    needed, by an estimate of how many a language has. Repeated rows of an id count once.
    """
    known = train.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang").withColumn("__h", F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53)))
    bounds = known.groupBy("lang").agg((F.lit(4.0 * size) / F.approx_count_distinct("doc_id", 0.02)).alias("__bound"))
    bounds = Scratch(bounds, "bounds").df  # a row for each language
    bounds = F.broadcast(bounds) if bounds.count() <= BROADCAST_ROWS else bounds
    near = known.join(bounds, "lang").where(F.col("__h") < F.col("__bound")).select("lang", "__h", "doc_id").distinct()
    order = Window.partitionBy("lang").orderBy("__h", "doc_id")
    ids = near.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= size)
    ids = Scratch(ids.select("doc_id", "lang"), "sample").df
    # a few hundred ids for each language are sent out, so that no text is shuffled; with very many languages they are joined
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return train.select("doc_id", "lang", "text").where("text is not null").join(ids, ["doc_id", "lang"], "left_semi").select("lang", "text")


def fit(train: DataFrame, path: str, size: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """A model from the rows of train (doc_id, lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                offsets, words, codes = words_of(batch.column("text"))
                langs = batch.column("lang").dictionary_encode()
                key = np.repeat(langs.indices.to_numpy(), np.diff(offsets)).astype(np.int64) * (len(words) + 1) + codes
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key // (len(words) + 1))), pa.array(words, pa.string()).take(pa.array(key % (len(words) + 1))), pa.array(n)], names=["lang", "word", "n"])

    counted = Scratch(sample(train, size).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langwords").df
    languages = [r[0] for r in counted.select("lang").distinct().orderBy("lang").collect()]
    n_pieces = len(Pieces.of(path).pieces)
    p = np.full((n_pieces + 1, len(languages)), 1 / n_pieces)
    p[-1] = FLOOR
    place = {x: i for i, x in enumerate(languages)}
    for _ in range(rounds):
        now = p

        def step(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lang in pc.unique(batch.column("lang")).to_pylist():
                    own = batch.filter(pc.equal(batch.column("lang"), lang))
                    out = expected(Pieces.of(path), own.column("word").to_pylist(), own.column("n").to_numpy(), now[:, [place[lang]]])[:-1]
                    on = np.nonzero(out)[0]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(on), pa.string()), pa.array(on.astype(np.int32)), pa.array(out[on])], names=["lang", "piece", "n"])

        found = counted.mapInArrow(step, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        p = np.full_like(p, ADDED)
        np.add.at(p, (found["piece"].to_numpy(), found["lang"].map(place).to_numpy(int)), found["n"].to_numpy())
        p[-1] = 0
        p /= p.sum(0)
        p[-1] = FLOOR
    return Model(path, languages, p)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: pa.Array) -> list[pa.Array]:
        langs, scores = sent.value.scores(texts)
        return [pa.array(langs, pa.string()), pa.array(scores)]

    return add_columns(docs, "text", make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(docs: DataFrame, path: str, train: DataFrame | None = None) -> DataFrame:
    """docs with held_out, lang_pred and score; learnt from the rows of train (docs) that aren't held out.

    Columns of docs with these names make way for them.
    """
    source = docs if train is None else train
    docs = without(docs, "held_out", "lang_pred", "score")
    with freeing():
        model = fit(source.where(bucket_of(F.col("doc_id"), 5) != 0), path)
    return predict(docs.withColumn("held_out", F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(True))), model)
