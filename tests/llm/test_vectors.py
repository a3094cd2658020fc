import numpy as np
import pytest

from larkspur.llm import vectors


def fixture(seed=0, n=260, dims=64):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dims))
    rows = []
    for i in range(n):
        x = centre[rng.integers(12)] + rng.normal(size=dims) * rng.choice([0.02, 0.2, 0.27, 0.3, 1.5])
        rows.append((i, int(rng.integers(0, 2)), (x * rng.uniform(0.1, 9)).astype(np.float32).tolist()))
    rows += [(900, 0, rows[0][2]), (901, 0, rows[0][2]), (901, 0, rows[0][2]), (902, 1, rows[0][2]), (903, None, rows[0][2]), (904, 0, None), (905, 0, [0.0] * dims), (906, 0, [float("nan")] * dims)]
    rows += [(907, 0, [None] * dims), (908, 0, [float("inf")] + [1.0] * (dims - 1)), (909, 0, []), (910, 0, [1.0, 2.0]), (911, 0, [2.0, 4.0]), (None, 0, rows[1][2]), (-5, rows[2][1], rows[2][2])]
    return rows


def brute(rows):
    def sound(r):
        return r[1] is not None and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[2]) and any(r[2])

    n = len(rows)
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if sound(a) and sound(b) and a[1] == b[1] and len(a[2]) == len(b[2]):
                x, y = np.array(a[2], float), np.array(b[2], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93 or a[2] == b[2]:
                    links[i].append(j)
                    links[j].append(i)
    label = list(range(n))
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        label[i] = min(ids) if ids else None
    key = lambda r: tuple((v is None, v) for v in r)
    return sorted(((rows[i][0], len(links[i]), label[i]) for i in range(n)), key=key)


@pytest.mark.parametrize("chunk", [4096, 16])
def test_equals_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(vectors, "CHUNK", chunk)  # 16: labels go through many cells
    rows = fixture()
    frame = spark.createDataFrame([(i, e, l, 1) for i, l, e in rows], "vec_id long, embedding array<float>, label int, node long")
    key = lambda r: tuple((v is None, v) for v in r)
    found = vectors.near_duplicates(frame).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=key) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_rotation_and_budgets():
    q = vectors.rotation(20)
    assert np.allclose(q @ q.T, np.eye(20))
    assert len(vectors.budgets(20)) == 3 and np.isclose(vectors.budgets(20).sum(), 0.14, atol=1e-5)


@pytest.mark.parametrize("dims", [64, 20, 3])
def test_few_pairs_are_tested_and_no_link_is_lost(dims):
    """Of random vectors, and of near ones among them: what the range joins bring together, against all pairs."""
    rng = np.random.default_rng(dims)
    raw = rng.normal(size=(4000 if dims == 64 else 600, dims))
    raw[1::7] = raw[::7][: len(raw[1::7])] + rng.normal(size=raw[1::7].shape) * 0.35
    x = vectors.turned(raw)
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    links = {(int(u), int(v)) for u, v in np.argwhere(np.triu(unit @ unit.T >= 0.93, 1))}
    every = np.arange(len(x))
    found, tested = [], 0
    for u, v, n in vectors.pairs(x, every, every):
        found += list(zip(u.tolist(), v.tolist()))
        tested += n
    assert len(found) == len(set(found)) and links <= set(found) and len(links) > 30
    if dims == 64:
        assert tested < 0.1 * len(x) * (len(x) - 1) / 2, tested / (len(x) * (len(x) - 1) / 2)
    two = [set(zip(u.tolist(), v.tolist())) for u, v, _ in vectors.pairs(x, every[::2], every[1::2])]
    assert {tuple(sorted(p)) for s in two for p in s} >= {p for p in links if (p[0] + p[1]) % 2}


def test_empty_table(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
