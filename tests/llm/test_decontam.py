import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import decontam


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(docs, items):
    """(doc, item): best similarity over all windows as long as the item."""
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            if not v or not w:
                continue
            n = min(len(v), len(w))
            best = max(decontam.similarity(grams(w[k : k + n]), grams(v)) for k in range(len(w) - n + 1))
            if best >= 0.8:
                out[d, i] = best
    return out


def fixture(seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(12, 60)))) for i in range(40)] + [(50, "three short words"), (51, None), (52, ""), (53, items0 := "lone"), (54, items0)]
    docs = [(i, " ".join(text(rng.randint(0, 300)))) for i in range(40)]
    for k in range(120):
        i, item = items[k % 40]
        v = item.split()
        if k % 3 == 1:
            v = [x.upper() + rng.choice(["", ",", "."]) for x in v]
        if k % 3 == 2:
            v[len(v) // 2 :] = v[len(v) // 2 :] if len(v) < 50 else [*v[len(v) // 2 : -1], "changed"]
        docs.append((100 + k, " ".join([*text(rng.randint(0, 200)), *v, *text(rng.randint(0, 90))])))
    docs += [(500, "say three short words here"), (501, "lone"), (502, None), (503, ""), (504, "two short"), (505, items[0][1]), (505, items[0][1]), (506, " ".join(items[1][1].split()[:-1])), (None, items[2][1])]
    return docs, items


def test_recall_by_similarity(spark):
    """Edited passages of items, within other words and as whole documents, at each similarity from the threshold on."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(20, 120)))) for i in range(300)]
    docs, wanted = [], {}
    for k in range(2400):
        i, item = items[k % 300]
        v = item.split()
        for _ in range(rng.randrange(1 + len(v) // 25)):
            at, how = rng.randrange(len(v)), rng.randrange(3)
            v[at : at + (how < 2)] = text(how > 0)
        around = (text(rng.randrange(150)), text(rng.randrange(150))) if k % 4 else ([], [])
        n = len(item.split())
        w = [*around[0], *v, *around[1]]
        s = max((decontam.similarity(grams(w[a : a + n]), grams(item.split())) for a in range(max(0, len(around[0]) - 8), min(len(w) - n, len(around[0]) + 8) + 1)), default=decontam.similarity(grams(w), grams(item.split())))
        docs.append((k, " ".join(w)))
        if s >= 0.8:
            wanted[k, i] = s
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for low in (0.8, 0.85, 0.9, 0.95):
        band = [k for k, s in wanted.items() if low <= s < low + 0.05 + (low == 0.95)]
        assert len(band) > 50 and sum(k in got for k in band) >= 0.98 * len(band), (low, len(band), sum(k in got for k in band))
    assert all(s >= 0.8 for s in got.values())


def test_comparisons_of_bounded_size(monkeypatch):
    """However few windows are compared with the items at a time, the same are found."""
    docs, items = fixture(3)
    offsets, words = decontam.word_codes(pa.array([t or "" for _, t in items]))
    index = decontam.Index([(i, words[offsets[k] : offsets[k + 1]]) for k, (i, _) in enumerate(items)])
    at, own = decontam.word_codes(pa.array([t or "" for _, t in docs]))
    every = sorted(index.search(own, at), key=str)
    monkeypatch.setattr(decontam, "COMPARED", 50)
    assert sorted(index.search(own, at), key=str) == every and len(every) > 100


def test_equals_all_windows(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    got = decontam.contaminated(d, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")).collect()
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in got}
    expected = brute(docs, items)
    assert found == {k: found.get(k, v) for k, v in expected.items()}  # each pair, and no other
    assert all(abs(found[k] - v) < 1e-9 for k, v in expected.items())
    assert sum(r["doc_id"] == 505 for r in got) == 2 * sum(k[0] == 505 for k in expected)


def test_blocks_find_all_within_the_radius():
    """The index misses no fingerprint within its radius, whatever the positions of the bits."""
    rng = np.random.default_rng(0)
    near = np.array([0, *(sum(1 << b for b in c) for r in range(1, decontam.NEAR + 1) for c in decontam.combinations(range(16), r))], np.uint32)
    for _ in range(200):
        fp = int(rng.integers(0, 1 << 63))
        made = decontam._Class([(0, 20, fp)], near)
        other = fp
        for bit in rng.choice(64, decontam.RADIUS, replace=False):
            other ^= 1 << int(bit)
        assert any(made.blocks[b][(other >> (16 * b)) & 0xFFFF] for b in range(4))


def test_words_with_other_marks():
    texts = pa.array(["Ab—cd “Éf” x_y 12", "ab cd éf x y 12"], pa.large_string())
    offsets, codes = decontam.word_codes(texts)
    assert offsets.tolist() == [0, 6, 12] and (codes[:6] == codes[6:]).all()


@pytest.mark.parametrize("bound", [decontam.BOUND, 3000])
def test_marks_equal_the_search(spark, monkeypatch, bound):
    monkeypatch.setattr(decontam, "BOUND", bound)
    docs, items = fixture(3)
    d, i = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, Contaminated int"), spark.createDataFrame(items, "item_id long, text string")
    found = decontam.marked(d, i)
    assert found.columns == ["doc_id", "text", "contaminated"] and found.count() == len(docs)
    assert {r["doc_id"] for r in found.where("contaminated").collect()} == {r["doc_id"] for r in decontam.contaminated(d, i).collect()}


def test_long_documents_in_parts(spark, monkeypatch):
    docs, items = fixture(2)
    whole = [(1, " ".join(t for _, t in docs if t)), (2, "x " * 500)]
    d, i = spark.createDataFrame(whole, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {r["item_id"]: (r["similarity"], r["n_words"]) for r in decontam.contaminated(d, i).collect()}
    monkeypatch.setattr(decontam, "CHUNK", 150)
    assert {r["item_id"]: (r["similarity"], r["n_words"]) for r in decontam.contaminated(d, i).collect()} == found and len(found) > 40


def test_rounds_of_items(spark, monkeypatch):
    docs, items = fixture(1)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in decontam.contaminated(d, i).collect()}
    monkeypatch.setattr(decontam, "BOUND", 3000)
    assert {tuple(r) for r in decontam.contaminated(d, i).collect()} == whole


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert decontam.contaminated(none, some).count() == 0
    assert decontam.contaminated(spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string"), some.limit(0)).count() == 0
