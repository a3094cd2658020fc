"""A quality classifier: ridge regression on random Fourier features of document statistics, then isotonic calibration.

STATISTICS of a text are taken from its characters, words and lines (see `statistics`). They are standardised by the
training rows' means and deviations, and clipped. FEATURES random Fourier features approximate a Gaussian kernel of width
WIDTH over them. Each partition sums its rows' normal equations; the sums are added by row of the matrix, and the driver
solves one system of FEATURES + 1 unknowns. A fifth of the training rows (remainder 1) is left out of the fit: its scores,
counted in BINS bins by label, give the isotonic regression (pool adjacent violators) that turns ridge scores into
probabilities, as a step function that is interpolated between the means of its blocks.

The labels of a document are those of its doc_id; if there are several, each counts. Null labels, null ids and null texts
aren't learnt from. Null and empty texts are scored by their statistics, which are 0. With no training rows, or labels of
one value only, the score is that value's share (0.5 with no rows). Repeated rows score alike. Other columns are kept; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import Scratch, add_columns, bucket_of, freeing, without

FEATURES, WIDTH, RIDGE, BINS, CLIP, SEED, CUT = 256, 4.0, 1e-3, 2000, 6.0, 7, 0.3
STATISTICS = [
    "log_bytes", "upper", "digits", "spaces", "marks", "odd_marks", "other_bytes", "bars", "exclamations", "log_words", "word_length", "longest_word",
    "distinct_words", "commonest_word", "repeats", "marked_words", "distinct_lines", "words_a_line", "stops_a_word",
]
_KIND = np.zeros(256, np.int64)  # 0 lower case, 1 upper case, 2 digit, 3 white space, 4 usual marks, 5 odd marks, 6 beyond ASCII
_KIND[np.arange(256) >= 128] = 6
for _c in range(128):
    _s = chr(_c)
    _KIND[_c] = 1 if _s.isupper() else 0 if _s.islower() else 2 if _s.isdigit() else 3 if _s.isspace() else 4 if _s in ".,;:'\"?()-" else 5


def statistics(text: bytes) -> list[float]:
    """The STATISTICS of a text in UTF-8; shares are of bytes or words, and 0 where there are none."""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=7) / n
    words = text.split()
    m = len(words)
    if m:
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        repeats = sum(a == b for a, b in zip(words, words[1:])) / m
        by_word = [np.log1p(m), (n - kinds[3] * n) / m, np.log1p(max(map(len, counts))), len(counts) / m, max(counts.values()) / m, repeats, sum(k for w, k in counts.items() if not w[-1:].isalnum() and w[-1] < 128) / m]
    else:
        by_word = [0.0] * 7
    lines = text.split(b"\n")
    return [np.log1p(n), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], text.count(b"|") / n, text.count(b"!") / n, *by_word, len(set(lines)) / len(lines), np.log1p(m / len(lines)), text.count(b".") / max(m, 1)]


def with_statistics(docs: DataFrame, name: str = "__statistics") -> DataFrame:
    def make(texts: pa.Array) -> list[pa.Array]:
        made = np.array([statistics(x.as_buffer().to_pybytes()) for x in texts], np.float64).reshape(-1, len(STATISTICS))
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(made.ravel()))]

    return add_columns(docs, "text", make, [T.StructField(name, T.ArrayType(T.DoubleType()))])


def _matrix(a: pa.Array) -> np.ndarray:
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


class Model:
    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-12, spread, 1.0)
        self.w = rng.normal(0, 1 / WIDTH, (len(STATISTICS), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.steps: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2 / FEATURES) * np.cos(np.clip((x - self.mean) / self.spread, -CLIP, CLIP) @ self.w + self.b)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def isotonic(at: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of the blocks that pool adjacent violators leaves of points at (ascending), n rows each of which ones are 1."""
    blocks: list[list[float]] = []
    for a, k, y in zip(at, n, ones):
        blocks.append([a * k, k, y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([a / k for a, k, _ in blocks]), np.array([y / k for _, k, y in blocks])


def fit(held: DataFrame, labels: DataFrame, name: str = "__statistics") -> Model:
    """A model from held, a table with doc_id and statistics, and labels (doc_id, quality), all rows of which are used."""
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("y"))
    rows = Scratch(held.where("doc_id is not null").select("doc_id", F.col(name).alias("x")).join(known, "doc_id").select("x", "y", (bucket_of(F.col("doc_id"), 5) == 1).alias("left_out")), "labelled").df
    columns = [F.col("x")[i] for i in range(len(STATISTICS))]
    found = rows.agg(F.count("*").alias("n"), F.sum("y").alias("ones"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
    model = Model(np.array([found[f"m{i}"] or 0.0 for i in range(len(STATISTICS))]), np.array([found[f"s{i}"] or 0.0 for i in range(len(STATISTICS))]))
    if not found["n"] or found["ones"] in (0, found["n"]):
        model.steps = (np.array([0.0]), np.array([found["ones"] / found["n"] if found["n"] else 0.5]))
        return model

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = model.features(_matrix(batch.column("x")))
            total += z.T @ np.concatenate([z, batch.column("y").to_numpy()[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1, dtype=np.int32)), pa.array(list(total))], names=["row", "sums"])

    def add(pdf):
        return pdf.iloc[:1].assign(sums=[np.sum(np.stack(pdf["sums"].to_list()), axis=0)])

    # one row of the matrix for each partition and unknown; added by unknown, FEATURES + 1 rows come to the driver
    sums = rows.where("not left_out").select("x", "y").mapInArrow(normal, "row int, sums array<double>").groupBy("row").applyInPandas(add, "row int, sums array<double>").toPandas()
    a = np.stack(sums.sort_values("row")["sums"].to_list()) if len(sums) else np.zeros((FEATURES + 1, FEATURES + 2))
    n = max(a[-1, -2], 1.0)
    model.beta = np.linalg.solve(a[:, :-1] + RIDGE * n / FEATURES * np.eye(FEATURES + 1), a[:, -1])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(np.round((model.raw(_matrix(batch.column("x"))) + 1) / 3 * BINS), 0, BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column("y")], names=["bin", "y"])

    calibrate = rows.where("left_out") if rows.where("left_out").limit(1).count() else rows
    counted = calibrate.select("x", "y").mapInArrow(bins, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).toPandas().sort_values("bin")
    model.steps = isotonic(counted["bin"].to_numpy() / BINS * 3 - 1, counted["n"].to_numpy(float), counted["ones"].to_numpy())
    return model


def score(docs: DataFrame, labels: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs, without the columns of drop, with held_out, score and predicted; learnt from docs that aren't held out.

    Columns of docs with these names make way for them.
    """
    docs = without(docs, "held_out", "score", "predicted")
    out = F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(True))
    # the statistics are written once, for the fit and for the scores
    with freeing():
        held = Scratch(with_statistics(docs).drop(*drop).withColumn("held_out", out), "statistics").keep().df
        model = fit(held.where("not held_out"), labels)

    rest = [f"`{c}`" for c in held.columns if c != "__statistics"]
    # the statistics are the only column that goes to Python and back
    @F.arrow_udf(T.DoubleType())
    def scores(x: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(x)) if len(x) else np.zeros(0), pa.float64())

    return held.select(*rest, scores("__statistics").alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
