import corpus_pipeline

from larkspur.llm import common, decontam, quality, similar


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    item = "the quick brown fox of a benchmark says that one thing is never like any other thing in the whole wide world"
    text = " ".join(r["text"] for r in rows[:3] if r["lang"] == "en")[:1500]
    other = ". ".join(reversed(next(r["text"] for r in rows if r["lang"] == "en" and 80 < len(r["text"].split()) < 300 and "|" not in r["text"]).split(". ")))  # near to no other document
    extra = [(9000, "12 34 !!", "en", "s", 8), (9001, None, "en", "s", 0), (9002, text, "en", "s", 1), (9003, text, "en", "s", 1), (9004, f"{other} {item}.", "en", "s", 1), (None, "thing of the other", None, None, None)]
    whole = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    for name in ("labels",):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == now.dtypes
        out.write.parquet(f"{tmp_path}/stage{k}")
        before, now = now, spark.read.parquet(f"{tmp_path}/stage{k}")
        seen[name] = (before, now)
    ids = lambda frame: [r[0] for r in frame.select("doc_id").collect()]
    first = ids(seen["language_id"][1])
    assert 9000 not in first and 9001 not in first and len(first) == len(rows) + 4
    # the quality stage drops what the operator predicts to be of low quality, and no other row
    before, after = seen["quality_classifier"]
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    kept = quality.score(before.select("doc_id", "text"), labels.select("doc_id", "quality")).where("predicted = 1")
    assert sorted(map(str, ids(kept))) == sorted(map(str, ids(after)))
    # near-duplicates: one row of each class, and every class has one
    before, after = seen["near_dedup"]
    classes = {r["component_id"] for r in similar.near_duplicates(before.select("doc_id", "text")).collect()}
    assert set(ids(after)) == classes and len(ids(after)) == len(classes) and not {9002, 9003} <= set(ids(after))
    # decontamination: all documents with a passage go, all others stay
    before, after = seen["decontamination"]
    hit = {r["doc_id"] for r in decontam.contaminated(before, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()}
    assert 9004 in ids(before) and 9004 in hit and sorted(map(str, ids(after))) == sorted(str(i) for i in ids(before) if i not in hit)
    # packing: every document that is left, whole
    before, after = seen["best_fit_packing"]
    assert sorted({str(i) for i in ids(after)}) == sorted({str(i) for i in ids(before)})


def test_clashing_columns_are_kept(spark):
    from pyspark.sql import functions as F

    names = ["score", "Held_Out", "lang_pred", "predicted", "kept", "fingerprint", "component_id", "__row", "__fp", "__statistics", "in_lang", "a.b"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("*", *(F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in names))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        assert all(r[n] == f"{n}-{r['doc_id']}" for r in out.collect() for n in names)


def test_run_and_contract(spark):
    made = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert made.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and made.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "near_dedup", "decontamination", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_very_long_documents_and_what_is_left_behind(spark, tmp_path, monkeypatch):
    """Long documents and an edited copy of one go through whole; only the last stage's rows stay on disk."""
    import os
    import random

    rng, at = random.Random(1), "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    words = [w for r in docs.where("lang = 'en'").collect() for w in r["text"].split()]
    long = " ".join(rng.choice(words) for _ in range(150_000))
    edited = long.split()
    for _ in range(900):
        edited[rng.randrange(len(edited))] = "changed"
    docs.unionByName(spark.createDataFrame([(9100, long, "en", "s", 1), (9101, " ".join(edited), "en", "s", 1)], docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{at}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    shared = tmp_path / "shared"
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{shared}")
    made = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").count().collect()
    pieces = {r["doc_id"]: r["count"] for r in made}
    assert 9101 not in pieces
    left = [d.rsplit("-", 1)[0] for d in os.listdir(shared / "larkspur")]
    assert left == ["best_fit_packing"]


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
