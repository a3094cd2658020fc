import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def test_encoder_equals_the_tokenizer():
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\t", "\r", "'s", "'", "1", "é", "<|endoftext|>", "。", " ", " ", "!!", "|", " x", "\n\n", "\u0085", "ab", "x" * 50]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    encoder = packing.Encoder(PATH)
    for _ in range(2):  # the second time from memory
        assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [x.ids for x in PLAIN.encode_batch(texts, add_special_tokens=False)]


def test_encoder_beyond_its_memory(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    encoder = packing.Encoder(PATH)
    texts = ["one two three four five six", "", "six seven one", "two"]
    for _ in range(3):
        assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [x.ids for x in PLAIN.encode_batch(texts, add_special_tokens=False)]
    assert len(encoder.known) == 3


def one_by_one(lengths, capacity):
    """Rooms that best-fit decreasing uses for each length, and how many sequences it makes."""
    room, used = [], []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        least = min(fits, default=capacity)
        used.append((n, least))
        if fits:
            room.remove(least)
        room.append(least - n)
    return sorted(used), len(room)


def placed(steps, counts):
    """(length, sequence, offset) of every piece."""
    out = []
    for i, (length, number, first, each, offset) in enumerate(steps.tolist()):
        after = [s[1] for s in steps.tolist() if s[0] == length and s[1] > number]
        for k in range((after[0] if after else counts[length]) - number):
            out.append((length, first + k // each, offset + k % each * length))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_plan_equals_one_by_one(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(8, 70))
    lengths = np.minimum(rng.integers(1, capacity + 1, 400), rng.integers(1, capacity + 1, 400)).tolist()
    counts = Counter(lengths)
    places = placed(packing.plan(counts, capacity), counts)
    used, n = one_by_one(lengths, capacity)
    # in the order of lengths, each piece went where the room was least
    assert sorted((length, capacity - offset) for length, _, offset in places) == used
    ends = Counter()
    for length, sequence, offset in sorted(places, key=lambda x: x[1:]):
        assert ends[sequence] == offset
        ends[sequence] += length
    assert len(ends) == n and max(ends.values()) <= capacity and sorted(ends) == list(range(n))


def test_plan_of_many():
    rng = np.random.default_rng(0)
    counts = {n: int(rng.integers(0, 10**9)) for n in range(1, 1024)}
    steps = packing.plan(counts)
    assert len(steps) < 100_000 and packing.plan({}).shape == (0, 5)


def test_one_length_in_many_buckets(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1024 + 1).cast("long").alias("length"), F.col("id").alias("__row"))
    found = packing.pack(rows, bucket=100).collect()
    ends = Counter()
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends[r["sequence_id"]] == r["offset"]
        ends[r["sequence_id"]] += r["length"]
    lengths = [r["length"] for r in found]
    assert len(found) == 5000 and max(ends.values()) <= 1024 and len(ends) == one_by_one(lengths, 1024)[1]


def test_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gam.", "de\nlta"]) for _ in range(rng.choice([0, 3, 50, 400, 3000])))) for i in range(40)]
    rows += [(100, None), (100, ""), (104, "an <|endoftext|> inside"), (105, "<|endoftext|>" * 1500), (None, "no id"), (101, "x" * 3000), (102, "word " * 1023), (103, " word" * 1023)]
    docs = spark.createDataFrame([(i, t, 5, "s") for i, t in rows], "doc_id long, text string, piece int, length string")
    found = packing.packed(docs, PATH).collect()
    expected = []
    for i, t in rows:
        ids = [*PLAIN.encode(t or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids), 1024)] if len(ids) > 1024 else [0]
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            expected.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(r[:5]) for r in found), key=key) == sorted(expected, key=key)
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 1024
    total = sum(x[3] for x in expected)
    assert len(sequences) <= total / 1024 * 1.05 + 2


def test_ids_are_whole(spark):
    docs = spark.createDataFrame([(1, "some words " * 700)], "doc_id long, text string")
    rows = sorted(packing.pieces(docs, PATH).collect(), key=lambda r: r["piece"])
    ids = [x for r in rows for x in r["ids"]]
    assert ids[:-1] == PLAIN.encode("some words " * 700, add_special_tokens=False).ids and ids[-1] == 2


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
