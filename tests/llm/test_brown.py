import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import brown


def split(text):
    return [w for w in (text or "").encode().lower().split()]


def rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in docs] + [(9001, None), (9002, ""), (9003, " x\x0by \t"), (9004, "É é A a"), (9004, "É é A a"), (None, "no id here")]


@pytest.mark.parametrize("head", [1 << 17, 40])
def test_base_and_counts(spark, monkeypatch, head):
    monkeypatch.setattr(brown, "HEAD", head)  # 40: nearly all counts are joined
    data = rows(spark)
    found = brown.score(spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, score int")).collect()
    train = [t for i, t in data if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in split(t))
    counts[None] = len(train)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (i is None, i or 0, i is None or zlib.crc32(str(i).encode()) % 7 == 2, len(split(t)) + 1, sum(counts[w] > 0 for w in [*split(t), None]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*split(t), None]), 6))
        for i, t in data
    )
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == expected
    held = [r for r in found if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in found)


def test_scores_do_not_depend_on_the_head(spark, monkeypatch):
    monkeypatch.setattr(brown, "UNITS", 30)
    docs = spark.createDataFrame(rows(spark), "doc_id long, text string")
    out = []
    for head in (1 << 17, 400):
        monkeypatch.setattr(brown, "HEAD", head)
        out.append(sorted((r["doc_id"] or -1, round(r["score"], 6)) for r in brown.score(docs).collect()))
    assert out[0] == out[1]


@pytest.mark.parametrize(("head", "units"), [(1 << 17, 1500), (300, 40)])
def test_scores_equal_brute_force(spark, monkeypatch, head, units):
    """Every score anew, token by token, from the words' classes and plain counts."""
    monkeypatch.setattr(brown, "HEAD", head)
    monkeypatch.setattr(brown, "UNITS", units)
    data = rows(spark) + [(9010, "tie tie tie"), (9011, "tie tie tie"), (9012, "w " * 30_000), (9013, "unseenword " * 3 + "w")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    learnt = [split(t) for i, t in data if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    train = docs.where("doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2")
    model, _ = brown.fit(train)
    placed = {r["word"]: r["class"] for r in brown.placed(train, model).collect()}
    u, of = model["units"], model["of"]
    words = sorted({w for _, t in data for w in split(t)})
    hashed, unit = dict(zip(words, brown.hashes(words).tolist())), dict(zip(words, u.look(words)[2].tolist()))
    count = Counter(w for t in learnt for w in t)
    klass = {w: int(placed.get(hashed[w], of[unit[w]])) if count[w] else int(of[unit[w]]) for w in words}
    own = {w for w in words if 0 < unit[w] < u.first_ending}
    k, bigram = brown.CLASSES, brown.BIGRAM
    moves = np.zeros((k, k))
    for t in learnt:
        seq = [0, *(klass[w] for w in t), 0]
        for a, b in zip(seq[:-1], seq[1:]):
            moves[a, b] += 1
    share = [(moves[:, j].sum() + 1) / (moves.sum() + k) for j in range(k)]
    step = lambda a, b: bigram * moves[a, b] / moves[a].sum() + (1 - bigram) * share[b] if moves[a].sum() else share[b]
    of_own, of_rest, inner = np.zeros(k), np.zeros(k), np.zeros(k)
    for w in words:
        if w in own:
            of_own[klass[w]] += count[w] + 1
        elif count[w]:
            of_rest[klass[w]] += count[w]
            inner[klass[w]] += count[w] + 1
    for c in of[u.first_ending :]:
        inner[c] += 1
    whole = of_own + of_rest + 1

    def emit(w):
        c = klass[w]
        return (count[w] + 1) / whole[c] if w in own else (count[w] + 1) / (whole[c] * max(inner[c], 1) / (of_rest[c] + 1))

    expected = Counter()
    for i, t in data:
        seq = [0, *(klass[w] for w in split(t)), 0]
        expected[i, round(sum(math.log10(step(a, b)) for a, b in zip(seq[:-1], seq[1:])) + sum(math.log10(emit(w)) for w in split(t)), 5)] += 1
    assert Counter((r["doc_id"], round(r["score"], 5)) for r in brown.score(docs).collect()) == expected


def test_probabilities_sum_to_one(spark):
    """Of all known words, the end, and one unseen word for each unit of endings, after any class."""
    docs = spark.createDataFrame(rows(spark), "doc_id long, text string")
    model, words = brown.fit(docs)
    units, of = model["units"], model["of"]
    assert np.allclose((10 ** model["step"]).sum(1), 1)
    emit = 10 ** model["emit"]
    assert np.allclose(np.bincount(of, emit, brown.CLASSES)[np.unique(of)], 1)
    counts = {r["word"]: (r["ending"], r["c"]) for r in words.collect()}
    total = np.zeros(units.n)
    own = set(units.head[units.own].tolist())
    for w, (ending, c) in counts.items():
        if w not in own:
            total[units.of_ending(np.array([ending]))[0]] += c + 1
    inner = np.arange(units.n) >= units.first_ending
    assert np.allclose((total + 1)[inner] / (10 ** model["within"])[inner], 1)


def test_exchange_finds_classes():
    """Two kinds of words that alternate end up apart, and the likelihood doesn't fall by any move."""
    rng = np.random.default_rng(0)
    a, b = np.arange(1, 11), np.arange(11, 21)
    seq = np.array([rng.choice(a if i % 2 else b) for i in range(20000)])
    pairs, n = np.unique(np.stack([seq[:-1], seq[1:]]), axis=1, return_counts=True)
    of = brown.exchange(pairs[0], pairs[1], n.astype(float), 21, classes=3, rounds=8)
    assert of[0] == 0 and len(set(of[a])) == 1 and len(set(of[b])) == 1 and of[1] != of[11]


def test_tokens_are_white_space_runs():
    offsets, words, codes = brown.tokens(pa.array([" A\tb\x0bc\x0cd\re\n", "", "\x1cx y A"]))
    assert [[words[c] for c in codes[i:j]] for i, j in zip(offsets[:-1], offsets[1:])] == [[b"a", b"b", b"c", b"d", b"e"], [], ["\x1cx y".encode(), b"a"]]


def test_nothing_to_learn_from(spark):
    assert brown.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = brown.score(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert only["train_tokens"] == 0 and only["n_known"] == 0 and only["base_score"] == 0 and math.isfinite(only["score"])


def test_words_beyond_the_units_are_placed_by_their_neighbours(spark, monkeypatch):
    """Rare words that end alike but have other neighbours get classes of their own, in the head and beyond it."""
    monkeypatch.setattr(brown, "UNITS", 8)
    a, b = [f"a{i}zz" for i in range(30)], [f"b{i}zz" for i in range(30)]
    out = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    learnt = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2][:300]
    text = lambda i: f"one two {a[i % 30]} three four {b[i * 7 % 30]} five six" if i % 5 < 3 else "one two apple three four berry five six"
    data = [(i, text(n)) for n, i in enumerate(learnt)] + [(out[0], "one two a3zz three four b5zz five six"), (out[1], "one two b5zz three four a3zz five six")]
    for head in (1 << 17, 10):
        monkeypatch.setattr(brown, "HEAD", head)
        docs = spark.createDataFrame(data, "doc_id long, text string")
        found = {r["doc_id"]: r["score"] for r in brown.score(docs).collect()}
        assert found[out[0]] > found[out[1]] + 1


def test_place_equals_trying_every_class():
    """Each word's class against the likelihood of the whole table, computed anew for every class."""
    rng = np.random.default_rng(3)
    k, f = brown.CLASSES, brown._xlogx
    moves = rng.integers(0, 30, (k, k)).astype(float) * (rng.random((k, k)) < 0.3)
    was = rng.integers(1, k, 20)
    word, slot, n = [], [], []
    for w in range(20):
        left, right = rng.integers(0, k, 4), rng.integers(0, k, 4)
        for side, classes in ((0, left), (1, right)):
            for j, c in Counter(classes.tolist()).items():
                word.append(w), slot.append(side * k + j), n.append(c)
        for j in left:
            moves[j, was[w]] += 1
        for j in right:
            moves[was[w], j] += 1
    word, slot, n = map(np.array, (word, slot, n))
    found = brown.place(moves, was, word, slot, n)
    for w in range(20):
        into, out = np.zeros(k), np.zeros(k)
        np.add.at(into, slot[(word == w) & (slot < k)], n[(word == w) & (slot < k)])
        np.add.at(out, slot[(word == w) & (slot >= k)] - k, n[(word == w) & (slot >= k)])
        values = []
        for to in range(1, k):
            now = moves.copy()
            now[:, was[w]] -= into
            now[was[w], :] -= out
            now = np.maximum(now, 0)
            now[:, to] += into
            now[to, :] += out
            values.append(f(now).sum() - f(now.sum(1)).sum() - f(now.sum(0)).sum())
        assert values[found[w] - 1] >= max(values) - 1e-6


def test_words_and_endings_share_their_class(spark):
    """Over all words, and one unseen word for each ending, the shares of every class sum to one."""
    docs = spark.createDataFrame(rows(spark), "doc_id long, text string")
    model, words = brown.fit(docs)
    others = brown.placed(docs, model)
    units, of = model["units"], model["of"]
    own = set(units.head[units.own].tolist())
    counts = {r["word"]: r["c"] for r in words.collect()}
    found = {r["word"]: (r["c"], r["class"]) for r in others.collect()}
    assert {w: c for w, (c, _) in found.items()} == {w: c for w, c in counts.items() if w not in own}
    divides = brown.shares(model, others)
    total = np.bincount(of[units.first_ending :], minlength=brown.CLASSES) / divides[1]
    for w, c in counts.items():
        k = found[w][1] if w in found else of[units.of_head[np.searchsorted(units.head, w)]]
        total[k] += (c + 1) / divides[int(w in found), k]
    filled = np.bincount(of[units.first_ending :], minlength=brown.CLASSES) > 0
    assert np.allclose(total[filled], 1) and (total < 1 + 1e-9).all()


def test_tokens_of_a_slice():
    """Texts that begin later in their array, as those of all but the first slice of a long batch."""
    texts = [f"Some{i} WORDS of {'long' * i} text" for i in range(50)]
    offsets, words, codes = brown.tokens(pa.array(texts).slice(20))
    assert [[words[c] for c in codes[i:j]] for i, j in zip(offsets[:-1], offsets[1:])] == [t.lower().encode().split() for t in texts[20:]]
