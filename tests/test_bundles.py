import json

import pytest
from pyspark.sql import functions as F

from larkspur.plans.adapter import hash_bucket
from larkspur.sources import bundles, readers

SCHEMA = "row_uid string, aspect string, p int, score double"
CONTRACT = {"study": "s", "fold": "L2-01"}


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame([(f"u{i}", a, i % 2, i / 50) for i in range(40) for a in ("A", "B")], SCHEMA)


def test_bundles(spark, scores, tmp_path):
    path = f"{tmp_path}/one"
    made = bundles.write_bundle(scores, path, CONTRACT, ["row_uid", "aspect"], ["score"], "p")
    assert made["rows"] == 80 and made["predicted_pair_count"] == 40
    assert bundles.read_bundle(spark, path, CONTRACT, SCHEMA, scores).count() == 80
    with pytest.raises(FileExistsError):
        bundles.write_bundle(scores, path, CONTRACT, ["row_uid", "aspect"], ["score"])
    with pytest.raises(ValueError, match="another contract"):
        bundles.read_bundle(spark, path, {"study": "t"}, SCHEMA)
    with pytest.raises(ValueError, match="missing"):
        bundles.read_bundle(spark, path, CONTRACT, SCHEMA, scores.unionByName(spark.createDataFrame([("x", "A", 0, 0.1)], SCHEMA)))
    with pytest.raises(ValueError, match="alike"):
        bundles.write_bundle(scores.withColumn("p", F.lit(1)), f"{tmp_path}/alike", CONTRACT, ["row_uid", "aspect"], ["score"], "p")
    with pytest.raises(ValueError, match="contract broken"):
        bundles.write_bundle(scores.withColumn("score", F.lit(float("nan"))), f"{tmp_path}/nan", CONTRACT, ["row_uid", "aspect"], ["score"])
    bundles.write_bundle(scores, f"{tmp_path}/two", {**CONTRACT, "fold": "L2-02"}, ["row_uid", "aspect"], ["score"])
    both = [path, f"{tmp_path}/two"]
    with pytest.raises(ValueError, match="instead of 3"):
        bundles.seal(spark, f"{tmp_path}/seal.json", [*both, f"{tmp_path}/three"], CONTRACT, 3)
    bundles.seal(spark, f"{tmp_path}/seal.json", both, CONTRACT, 2)
    assert bundles.check_seal(spark, f"{tmp_path}/seal.json", CONTRACT, 2)["bundles"] == 2
    with pytest.raises(FileExistsError):
        bundles.seal(spark, f"{tmp_path}/seal.json", both, CONTRACT, 2)
    with pytest.raises(PermissionError):
        bundles.check_seal(spark, f"{tmp_path}/seal.json", CONTRACT, 3)
    held = json.loads((tmp_path / "seal.json").read_text())
    (tmp_path / ".seal.json.crc").unlink()  # the file system's own checksum
    (tmp_path / "seal.json").write_text(json.dumps(held | {"bundles": 3}))
    with pytest.raises(ValueError, match="changed"):
        bundles.check_seal(spark, f"{tmp_path}/seal.json", CONTRACT, 3)
    # other rows under the same manifest
    scores.withColumn("score", F.col("score") / 2).write.mode("overwrite").parquet(f"{tmp_path}/two/data")
    with pytest.raises(ValueError, match="what its manifest says"):
        bundles.read_bundle(spark, f"{tmp_path}/two", {**CONTRACT, "fold": "L2-02"}, SCHEMA)


def test_receipts(spark, tmp_path):
    root = tmp_path / "unit"
    (root / "deep").mkdir(parents=True)
    (root / "a.txt").write_text("abc")
    (root / "deep" / "b.bin").write_bytes(b"\x00\x01")
    made = bundles.write_receipt(spark, str(root), CONTRACT)
    assert made["files"]["a.txt"] == {"bytes": 3, "sha256": "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"} and set(made["files"]) == {"a.txt", "deep/b.bin"}
    bundles.check_receipt(spark, str(root), CONTRACT)
    with pytest.raises(ValueError, match="another contract"):
        bundles.check_receipt(spark, str(root), {})
    (root / "a.txt").write_text("abd")  # as long as before
    with pytest.raises(ValueError, match="a.txt"):
        bundles.check_receipt(spark, str(root))


def test_shards(spark, scores, tmp_path):
    path = f"{tmp_path}/shards"
    key = ["row_uid", "aspect"]
    bundles.write_shards(scores, path, CONTRACT, 4, key, ["score"])
    assert {r["state"] for r in bundles.shard_states(spark, path, CONTRACT, scores).collect()} == {"complete"}
    assert bundles.merge_shards(spark, path, CONTRACT, scores).count() == 80
    assert {r["state"] for r in bundles.shard_states(spark, path, {}, scores).collect()} == {"corrupt"}
    more = scores.unionByName(spark.createDataFrame([("u99", "A", 0, 0.1)], SCHEMA))
    at = spark.range(1).select(hash_bucket(F.lit("u99"), 4)).first()[0]
    assert {r["shard"] for r in bundles.shard_states(spark, path, CONTRACT, more).where("state = 'corrupt'").collect()} == {at}
    with pytest.raises(ValueError, match="aren't complete"):
        bundles.merge_shards(spark, path, CONTRACT, more)


def test_scores_and_evidence(spark, tmp_path):
    (tmp_path / "x.csv").write_text("row_uid,fold,score\nu1,f,0.1\nu2,f,0.30000000000000004\n")
    (tmp_path / "y.csv").write_text("row_uid,fold,score\nu1,g,0.5\n")
    schema = "row_uid string, fold string, score double"
    expected = spark.createDataFrame([("f", 2), ("g", 1)], "fold string, rows long")
    made = readers.read_evidence(spark, f"{tmp_path}/*.csv", schema, ["fold"], expected)
    assert sorted(r["score"] for r in made.collect()) == [0.1, 0.30000000000000004, 0.5]
    for wrong in ([("f", 2)], [("f", 1), ("g", 1)], [("f", 2), ("g", 1), ("h", 1)]):
        with pytest.raises(Exception, match="what is expected"):
            readers.read_evidence(spark, f"{tmp_path}/*.csv", schema, ["fold"], spark.createDataFrame(wrong, "fold string, rows long")).count()
    (tmp_path / "z.csv").write_text("row_uid,fold,score\nu1,g,NaN\n")
    with pytest.raises(Exception, match="finite"):
        readers.read_scores(spark, f"{tmp_path}/z.csv", schema).collect()
    (tmp_path / "z.csv").write_text("row_uid,fold,score\nu1,g,half\n")
    with pytest.raises(Exception):
        readers.read_scores(spark, f"{tmp_path}/z.csv", schema).collect()


def test_checkpoints(spark, scores, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel

    from larkspur.operators.lexical import logistic
    from larkspur.sources import checkpoints

    model, _ = logistic(scores, ["score"], "p")
    path = f"{tmp_path}/model"
    checkpoints.save(spark, model, path, CONTRACT)
    assert checkpoints.load(spark, LogisticRegressionModel, path, CONTRACT).coefficients == model.coefficients
    with pytest.raises(FileExistsError):
        checkpoints.save(spark, model, path, CONTRACT)
    with pytest.raises(ValueError, match="another contract"):
        checkpoints.load(spark, LogisticRegressionModel, path, {})
    (tmp_path / "model" / "model" / "extra").write_text("x")
    checkpoints.load(spark, LogisticRegressionModel, path, CONTRACT)  # what the receipt lists is as it was
    next((tmp_path / "model" / "model" / "metadata").glob("part-*")).write_text("{}")
    with pytest.raises(Exception):
        checkpoints.load(spark, LogisticRegressionModel, path, CONTRACT)
