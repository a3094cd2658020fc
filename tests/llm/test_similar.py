import random

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import similar


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def classes(rows):
    """doc place -> places of its class, over every pair."""
    sets, of = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                of = [of[j] if x == of[i] else x for x in of]
    return [[j for j in range(len(rows)) if of[j] == of[i]] for i in range(len(rows))]


def prose(rng, n, words=4000):
    return " ".join(f"w{int(words * rng.random() ** 2)}" for _ in range(n))


def edited(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"new{rng.random():.9f}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rng, rows = random.Random(1), []
    for i in range(60):
        base = prose(rng, rng.choice([3, 8, 30, 120, 700]))
        rows.append((10 * i, base))
        for j in range(rng.randrange(4)):
            rows.append((10 * i + 1 + j, edited(rng, base, rng.randrange(1 + len(base.split()) // 60))))
    star = prose(rng, 400)  # copies that are like the first, though not like each other
    rows += [(1000 + i, edited(rng, star, 7)) for i in range(12)] + [(999, star)]
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "one"), (2004, "ONE "), (2005, "É"), (2006, "é"), (2007, "a b c d e"), (2008, "a b c d e f")]
    long = prose(rng, 200_000, 50_000)
    rows += [(3000, long), (3001, edited(rng, long, 900)), (3002, edited(rng, long, 9000))]
    rng.shuffle(rows)
    return rows


def test_equals_every_pair(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, kept string, __size int, lang int")
    made = similar.near_duplicates(docs)
    assert made.columns == ["doc_id", "text", "lang", "component_id", "kept"]
    found = {r["doc_id"]: (r["component_id"], r["kept"]) for r in made.collect()}
    assert len(found) == len(rows)
    for (i, _), own in zip(rows, classes(rows)):
        least = min(rows[j][0] for j in own)
        assert found[i] == (least, i == least)


def test_repeated_ids_nulls_and_no_rows(spark):
    text = prose(random.Random(2), 50)
    docs = spark.createDataFrame([(5, text), (5, text), (None, text), (None, "alone here"), (None, "alone here"), (7, text + " more")], "doc_id long, text string")
    made = [(r["doc_id"], r["component_id"], r["kept"]) for r in similar.near_duplicates(docs).collect()]
    assert sorted(made, key=str) == sorted([(5, 5, True), (5, 5, False), (None, 5, False), (7, 5, False), (None, None, True), (None, None, False)], key=str)
    assert similar.near_duplicates(docs.limit(0)).count() == 0


def test_what_meets():
    """Of pairs by similarity, how many share a triple of blocks and are within the radius; within 20 bits, all."""
    rng, met = random.Random(3), {0.8: [], 0.85: [], 0.9: [], 0.95: []}
    for _ in range(1500):
        a = prose(rng, rng.randrange(60, 500))
        b = edited(rng, a, rng.randrange(1, 2 + len(a.split()) // 40))
        (_, x), (_, y) = similar.shingled(pa.array([a, b]))
        both = len(np.intersect1d(x, y))
        s = both / (len(x) + len(y) - both)
        assert abs(s - jaccard(shingles(a), shingles(b))) < 1e-12
        (p, p_bits), (q, q_bits) = similar.fingerprint(x), similar.fingerprint(y)
        one, other = (set(np.concatenate([k for _, k in similar.triple_keys(v[None, :], np.array([len(n)]))]).tolist()) for v, n in ((p, x), (q, y)))
        shared = bool(one & other)
        if s >= 0.8:
            met[max(k for k in met if k <= s)].append(shared and ((p_bits ^ q_bits) & (2**64 - 1)).bit_count() <= similar.RADIUS)
            assert shared or np.bitwise_count(p ^ q).sum() > 20
    share = {k: np.mean(v) for k, v in met.items()}
    assert min(map(len, met.values())) > 40 and share[0.8] > 0.95 and share[0.85] > 0.98 and share[0.9] > 0.99, share


def test_triples_share_no_two_blocks():
    pairs = {frozenset(p) for t in similar.TRIPLES.tolist() for p in ((t[0], t[1]), (t[0], t[2]), (t[1], t[2]))}
    assert len(pairs) == 3 * len(similar.TRIPLES) and set(np.bincount(similar.TRIPLES.ravel())) == {9}


@pytest.mark.parametrize("run", [4, 1 << 16])
def test_streams_of_keys(monkeypatch, run):
    """Pairs and hot rows together hold all members of each key, however the rows are cut into batches."""
    monkeypatch.setattr(similar, "RUN", run)
    rng = np.random.default_rng(0)
    key = np.sort(np.concatenate([rng.integers(0, 200, 300), np.full(40, 77), np.full(9, 201)]))
    node, bits = np.arange(len(key)), rng.integers(0, 4, len(key))  # all near
    cuts = [0, 1, 5, 60, 130, 131, 200, len(key)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x[a:b]) for x in (key, node, bits)], names=["key", "node", "bits"]) for a, b in zip(cuts[:-1], cuts[1:])]
    out = [r for b in similar._met(iter(batches)) for r in b.to_pylist()]
    hot = {(r["key"], r["src"]) for r in out if r["key"] is not None}
    links = {frozenset((r["src"], r["dst"])) for r in out if r["key"] is None}
    for k in np.unique(key):
        own = set(node[key == k].tolist())
        if {x for x in own if (k, x) in hot}:
            assert len(own) > run and {x for q, x in hot if q == k} == own
        else:
            group, grown = {min(own)}, True
            while grown:
                grown = {x for l in links if l & group for x in l} & own - group
                group |= grown
            assert group == own
    assert bool(hot) == (run == 4)


def test_forests_of_links():
    rng = random.Random(4)
    sets = [np.unique(np.array([rng.randrange(60 + 5 * (i % 7)) for _ in range(50)], np.uint64)) for i in range(120)] + [np.zeros(0, np.uint64)] * 2
    for similarity in (0.3, 0.5, 0.8):
        a, b = similar.linked(sets, similarity)
        of = list(range(len(sets)))
        for x, y in zip(a.tolist(), b.tolist()):
            of = [of[x] if k == of[y] else k for k in of]
        want = list(range(len(sets)))
        for i in range(120):
            for j in range(i):
                if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= similarity:
                    want = [want[j] if k == want[i] else k for k in want]
        assert len({*zip(of, want)}) == len(set(of)) == len(set(want))
