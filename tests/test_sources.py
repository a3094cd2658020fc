import gzip
import json

import pytest
from pyspark.sql import functions as F

from larkspur.plans.adapter import table
from larkspur.sources import readers, store
from larkspur.streaming import events

SF = "/root/testdata/sf0.001"


def write_splits(path):
    head = "id,org_index,data_source,industry,text,labels_json,label_codes\n"
    row = '{i},1,web,retail,"two\nlines, ""quoted""","[[""Online experience: App website"", ""negative""]]","[\'online-experience.app-website.-1\']"\n'
    for name in ("train", "validation"):
        (path / f"{name}.csv").write_text(head + row.format(i=1) + "2,,,,,,\n")


def test_splits(spark, tmp_path):
    write_splits(tmp_path)
    got = readers.load_splits(spark, ["train", "validation"], str(tmp_path)).orderBy("row_uid").collect()
    assert [r["row_uid"] for r in got] == ["train:1", "train:2", "validation:1", "validation:2"]
    assert got[0]["text"] == 'two\nlines, "quoted"' and got[0]["pair_labels"] == ["Online experience: App website | negative"] and got[0]["label_codes_list"] == ["online-experience.app-website.-1"]
    assert got[1]["text"] == "" and got[1]["labels"] == [] and got[1]["aspect_labels"] == []
    with pytest.raises(ValueError, match="unknown splits"):
        readers.load_splits(spark, ["dev"], str(tmp_path))
    with pytest.raises(Exception, match="(?i)path"):
        readers.load_splits(spark, ["test"], str(tmp_path)).collect()


def test_other_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert readers.read_jsonl(spark, f"{tmp_path}/a.jsonl", "x int").count() == 2
    (tmp_path / "c.json").write_text("[1]")
    with pytest.raises(ValueError, match="no JSON object"):
        readers.read_config(f"{tmp_path}/c.json")
    (tmp_path / "d.json").write_text(json.dumps({"a": 1}))
    assert readers.read_config(f"{tmp_path}/d.json") == {"a": 1}
    (tmp_path / "g.csv").write_text("m,v\na,0.5\n")
    assert readers.read_aggregates(spark, f"{tmp_path}/g.csv", "m string, v double").first()["v"] == 0.5
    (tmp_path / "h.csv").write_text("m,v\na,NaN\n")
    with pytest.raises(Exception, match="finite"):
        readers.read_aggregates(spark, f"{tmp_path}/h.csv", "m string, v double").collect()
    for n in (1, 2):
        with gzip.open(tmp_path / f"s{n}.csv.gz", "wt") as f:
            f.write(f"k,s\nx,{0.1 + n}\n")
    assert sorted(r["s"] for r in readers.read_scores(spark, f"{tmp_path}/s*.csv.gz", "k string, s double").collect()) == [1.1, 2.1]


def test_shards_and_resume(spark, tmp_path):
    unit = "method string, level string, fold_id string, condition string"
    rows = [("m", "L2", "f", "N", f"u{i}", 0.5) for i in range(30)]
    scores, path = spark.createDataFrame(rows, f"{unit}, row_uid string, score double"), f"{tmp_path}/scores"
    expected = scores.drop("score").unionByName(spark.createDataFrame([("m", "L2", "g", "N", "u1")], f"{unit}, row_uid string"))
    assert {r["state"] for r in store.resume_state(expected, path, "row_uid string", "row_uid").collect()} == {"missing"}
    store.write_scores(scores, path, 4)
    schema = f"row_uid string, score double, {unit}, shard int"
    assert {(r["fold_id"], r["state"]) for r in store.resume_state(expected, path, schema, "row_uid").collect()} == {("f", "complete"), ("g", "missing")}
    more = expected.unionByName(spark.createDataFrame([("m", "L2", "f", "N", "u99")], f"{unit}, row_uid string"))
    assert ("f", "corrupt") in {(r["fold_id"], r["state"]) for r in store.resume_state(more, path, schema, "row_uid").collect()}
    with pytest.raises(Exception, match="(?i)exist"):
        store.write_scores(scores, path, 4)
    assert store.read_scores(spark, path, schema).groupBy("row_uid").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0


def test_score_cache(spark, tmp_path):
    cache = store.ScoreCache(spark, f"{tmp_path}/cache", ["claim"])
    first = spark.createDataFrame([("a",), ("b",), ("a",)], "claim string")
    assert tuple(cache.statistics(first).first()) == (3, 2, 0, 2)
    assert cache.score(first, F.length("claim").cast("double")).count() == 3
    second = spark.createDataFrame([("a",), ("c",)], "claim string")
    assert tuple(cache.statistics(second).first()) == (2, 2, 1, 1)
    assert [r["claim"] for r in cache.misses(second).collect()] == ["c"]
    cache.score(second, F.lit(9.0))
    assert {r["claim"]: r["score"] for r in cache.table(second).collect()} == {"a": 1.0, "b": 1.0, "c": 9.0}
    with pytest.raises(ValueError, match="another contract"):
        store.ScoreCache(spark, f"{tmp_path}/cache", ["claim"], {"model": "other"})
    fixed = store.ScoreCache(spark, f"{tmp_path}/cache", ["claim"], read_only=True)
    assert {r["claim"]: r["score"] for r in fixed.score(second).collect()} == {"a": 1.0, "c": 9.0}
    with pytest.raises(Exception, match="read-only cache"):
        fixed.score(spark.createDataFrame([("z",)], "claim string")).collect()
    with pytest.raises(FileNotFoundError):
        store.ScoreCache(spark, f"{tmp_path}/none", ["claim"], read_only=True)
    spark.createDataFrame([("a", 2.0)], "claim string, score double").write.mode("append").parquet(f"{tmp_path}/cache/data")
    with pytest.raises(Exception, match="two scores"):
        cache.table(second).collect()


def test_reports(spark, tmp_path):
    frame = spark.createDataFrame([("a", 0.5, None)], "m string, v double, n int")
    assert store.markdown(frame) == "| m | v | n |\n|---|---|---|\n| a | 0.5000 |  |\n"
    with pytest.raises(ValueError, match="over"):
        store.markdown(spark.range(20), 10)
    store.write_once(frame, f"{tmp_path}/x", "json")
    with pytest.raises(Exception, match="(?i)exist"):
        store.write_once(frame, f"{tmp_path}/x", "json")


def test_streams(spark, tmp_path):
    source = f"{tmp_path}/in"
    table(spark, SF, "events").write.parquet(source)
    q = events.windowed(events.stream(spark, source)).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = {tuple(r)[:3] for r in events.windowed(table(spark, SF, "events")).collect()}
    assert {tuple(r)[:3] for r in spark.table("w").collect()} == batch
    rows = events.stream(spark, source).select((F.col("user_id").cast("string")).alias("row_uid"), "ts", "value")
    out = events.ingest(rows, f"{tmp_path}/out", f"{tmp_path}/check")
    out.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.select("row_uid").distinct().count() == table(spark, SF, "events").select("user_id").distinct().count()
