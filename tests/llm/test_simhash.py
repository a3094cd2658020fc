import random

import pytest
import xxhash

from larkspur.llm import cells, simhash
from larkspur.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    """Least id reachable of every row, over all pairs."""
    fps = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((rows[i][0], f"{fps[i]:016x}", min(ids) if ids else None))
    return out


def messy(n=60, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [" ".join(word() for _ in range(200)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "two words"), (6, "two words"), (None, "no id"), (None, None), (7, "É é"), (8, "é É")]
    for i in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = word()
        rows.append((100 - i, rng.choice([" ", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("hot", [64, 1])
def test_equals_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)  # 1: every shared key goes through bounded cells
    rows = messy()
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, source string, fp long, component_id2 int")
    found = simhash.near_duplicates(docs.select("doc_id", "text", "source", "fp"), drop=("text",)).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found), key=key) == sorted(brute_classes(rows), key=key)
    # one row of each class is kept, the one with the least id
    classes = {}
    for r in found:
        classes.setdefault(r["component_id"] if r["doc_id"] is not None or r["component_id"] is not None else r["fingerprint"], []).append(r)
    assert all(sum(r["kept"] for r in group) == 1 for group in classes.values())
    assert all(r["doc_id"] == r["component_id"] for r in found if r["kept"])


@pytest.mark.parametrize("most", [1, 7, 40])
def test_fingerprint_in_blocks(most):
    for _, text in messy(20, 3):
        assert simhash.fingerprint((text or "").encode(), most=most) == brute_fingerprint(text)


def test_links_found_at_every_distance(spark):
    rng = random.Random(5)
    fps = []
    for _ in range(40):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        fps += [a, b]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {tuple(sorted((r[0], r[1]))) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got >= {tuple(sorted(signed[i : i + 2])) for i in range(0, 80, 2)}


def test_a_very_long_text(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(400_000))
    rows = [(1, long), (2, long.upper()), (3, long + " end"), (4, "other words are here")]
    found = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["fingerprint"] == f"{brute_fingerprint(long):016x}" == found[2]["fingerprint"]
    assert [found[i]["component_id"] for i in (1, 2, 3, 4)] == [1, 1, 1, 4]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, x) for x in range(1001, 1100)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)] + [(5, 5), (7, 6), (7, 6)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame([*edges, (None, 3), (4, None)], "src long, dst long")).collect()}
    assert found == {x: find(x) for x in parent}


def test_cells_meet_once(spark):
    members = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1)], "g string, x int")
    rows = cells.chunk_cells(members, ["g"], members["x"], chunk=8).collect()
    met, sizes = {}, {}
    for r in rows:
        sizes.setdefault((r["g"], r["i"], r["j"]), {"a": [], "b": []})[r["side"]].append(r["x"])
    for (g, i, j), s in sizes.items():
        assert g == "a" and len(s["a"]) + len(s["b"]) <= 40
        for x in s["a"]:
            for y in s["b"] if i != j else s["a"]:
                if x != y:
                    met[frozenset((x, y))] = met.get(frozenset((x, y)), 0) + (1 if i != j else 0.5)
    assert len(met) == 50 * 49 // 2 and set(met.values()) == {1}
