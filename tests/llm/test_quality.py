import zlib

import numpy as np
import pytest

from larkspur.llm import quality


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    made = quality.score(docs.select("doc_id", "text"), labels, drop=("text",)).join(labels, "doc_id").toPandas()
    held = made[made["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.97
    assert held[held["quality"] == 0]["predicted"].mean() < 0.1
    assert made["score"].between(0, 1).all() and ((made["score"] >= 0.3) == (made["predicted"] == 1)).all()


def test_normal_equations_equal_one_solve(spark):
    """Sums by partition give the ridge regression of all rows at once."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = quality.with_statistics(docs.select("doc_id", "text")).drop("text")
    train = held.join(labels.select("doc_id", "quality"), "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0")
    model = quality.fit(held.where("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0").repartition(7), labels)
    rows = train.selectExpr("__statistics as x", "quality as y", "crc32(cast(cast(doc_id as string) as binary)) % 5 = 1 as out").toPandas()
    x, y = np.stack(rows["x"]), rows["y"].to_numpy(float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.spread, np.where(x.std(0) > 1e-12, x.std(0), 1))
    keep = ~rows["out"].to_numpy()
    z = model.features(x[keep])
    beta = np.linalg.solve(z.T @ z + quality.RIDGE * keep.sum() / quality.FEATURES * np.eye(z.shape[1]), z.T @ y[keep])
    assert np.allclose(model.beta, beta, atol=1e-6)


def test_scores_equal_brute_force(spark):
    """The whole model from plain arrays: standardised statistics, one ridge system, blocks of means under order, interpolation."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows, known = docs.select("doc_id", "text").collect(), {r["doc_id"]: r["quality"] for r in labels.collect()}
    extra = [(10**6, "tie " * 9), (10**6 + 1, "tie " * 9), (10**6 + 2, "a long one. " * 60_000)]
    made = {r["doc_id"]: r["score"] for r in quality.score(docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string")), labels).collect()}
    crc = lambda i: zlib.crc32(str(i).encode()) % 5
    x = {r[0]: np.array(quality.statistics((r[1] or "").encode())) for r in [*rows, *extra]}
    train = [i for i in x if i in known and crc(i) != 0]
    mean, spread = np.mean([x[i] for i in train], 0), np.std([x[i] for i in train], 0)
    model = quality.Model(mean, spread)
    fit, left = [i for i in train if crc(i) != 1], [i for i in train if crc(i) == 1]
    z = model.features(np.stack([x[i] for i in fit]))
    beta = np.linalg.solve(z.T @ z + quality.RIDGE * len(fit) / quality.FEATURES * np.eye(z.shape[1]), z.T @ np.array([known[i] for i in fit], float))
    raw = lambda ids: model.features(np.stack([x[i] for i in ids])) @ beta
    bins = np.clip(np.round((raw(left) + 1) / 3 * quality.BINS), 0, quality.BINS).astype(int)
    at = sorted(set(bins.tolist()))
    n, ones = [int((bins == b).sum()) for b in at], [sum(known[i] for i, c in zip(left, bins) if c == b) for b in at]
    level = np.round(brute_isotonic(n, ones), 12)
    blocks = [[k for k in range(len(at)) if level[k] == v] for v in sorted(set(level))]
    middle = [sum(n[k] * (at[k] / quality.BINS * 3 - 1) for k in b) / sum(n[k] for k in b) for b in blocks]
    expected = np.interp(raw(list(x)), middle, [level[b[0]] for b in blocks])
    assert np.allclose([made[i] for i in x], expected, atol=1e-6)
    assert made[10**6] == made[10**6 + 1]


def test_features_approximate_the_kernel():
    model = quality.Model(np.zeros(len(quality.STATISTICS)), np.ones(len(quality.STATISTICS)))
    x = np.random.default_rng(0).normal(0, 1, (30, len(quality.STATISTICS)))
    z = model.features(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 2 / quality.WIDTH**2)
    assert np.abs(z @ z.T - kernel).mean() < 0.06


def brute_isotonic(n, ones):
    """Least squares under order: the max of mins of means."""
    k = len(n)
    mean = lambda i, j: sum(ones[i : j + 1]) / sum(n[i : j + 1])
    return [max(min(mean(i, j) for j in range(m, k)) for i in range(m + 1)) for m in range(k)]


def test_isotonic():
    rng = np.random.default_rng(2)
    n = rng.integers(1, 9, 25).astype(float)
    ones = np.floor(rng.uniform(0, 1, 25) * (n + 1))
    at, value = quality.isotonic(np.arange(25.0), n, ones)
    expected = brute_isotonic(n, ones)
    assert np.allclose(sorted(set(np.round(expected, 9))), np.round(value, 9)) and (np.diff(value) > 0).all() and (np.diff(at) > 0).all()


def test_statistics():
    assert quality.statistics(b"") == [0.0] * len(quality.STATISTICS)
    s = dict(zip(quality.STATISTICS, quality.statistics("Ab ab ab é!\nx | 1".encode())))
    assert s["repeats"] == pytest.approx(1 / 7) and s["distinct_words"] == pytest.approx(6 / 7) and s["distinct_lines"] == 1
    assert s["bars"] == pytest.approx(1 / 18) and s["digits"] == pytest.approx(1 / 18) and s["upper"] == pytest.approx(1 / 18)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a b c.", 1), (3, "a b c.", 1), (None, "x", 1), (4, "y " * 50000, 1)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (3, 1), (None, 1), (4, 1), (6, 0), (9, 1)], "doc_id long, quality int")
    made = quality.score(docs, labels).toPandas()
    assert len(made) == 6 and made["score"].between(0, 1).all() and made[made["doc_id"].isna()]["held_out"].all()
    assert made[made["doc_id"] == 3]["score"].nunique() == 1
    one = quality.score(docs, spark.createDataFrame([(3, 1), (4, 1)], "doc_id long, quality int")).toPandas()
    assert set(one["score"]) == {1.0}
    assert set(quality.score(docs, labels.limit(0)).toPandas()["score"]) == {0.5}
    assert quality.score(docs.limit(0), labels).count() == 0
