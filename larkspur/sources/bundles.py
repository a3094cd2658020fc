"""Score bundles: tables with a manifest of what they hold, seals over many of them, and receipts of files.

A manifest is JSON beside a table: its contract, counts, and fingerprints that don't depend on the order of rows, so they are
sums over all tasks. Reading checks them all. Manifests, seals and receipts are written under another name and renamed, and
nothing that exists is written over. Paths are of any file system that Spark reads.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.contracts import audit, coverage, fingerprint
from larkspur.plans.adapter import hash_bucket

#: Counts of a manifest that must be 0.
FAULTS = ("failure_count", "non_finite_value_count", "prediction_collapse_count")


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The text as a file, whole or not at all; an existing file is an error."""
    if exists(spark, path):
        raise FileExistsError(path)
    p, fs = _at(spark, path)
    temporary = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.tmp")
    out = fs.create(temporary, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(temporary, p):
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    p, fs = _at(spark, path)
    held = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(held)).decode()
    finally:
        held.close()


def canonical_digest(value) -> str:
    """SHA-256 of the value's JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _write_json(spark: SparkSession, path: str, value: dict) -> dict:
    signed = value | {"payload_sha256": canonical_digest(value)}
    write_text(spark, path, json.dumps(signed, sort_keys=True, indent=2) + "\n")
    return signed


def _read_json(spark: SparkSession, path: str) -> dict:
    signed = json.loads(read_text(spark, path))
    value = {k: v for k, v in signed.items() if k != "payload_sha256"}
    if signed.get("payload_sha256") != canonical_digest(value):
        raise ValueError(f"{path} was changed after it was written")
    return signed


def _digests(frame: DataFrame, key: list[str], scores: list[str]) -> dict[str, str]:
    return {"pair_identity": fingerprint(frame, *key).first()["digest"], "scores": fingerprint(frame, *key, *scores).first()["digest"]}


def write_bundle(scores: DataFrame, path: str, contract: dict, key: list[str], columns: list[str], predicted: str | None = None) -> dict:
    """Write a table of scores with its manifest, which is returned.

    Keys must be distinct and not null, scores probabilities; if a column of predictions is named, it must have both 0 and 1.
    """
    spark = scores.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    scores.write.mode("errorifexists").parquet(f"{path}/data")
    held = spark.read.schema(scores.schema).parquet(f"{path}/data")  # what was written, not what was planned
    found = audit(held, key, columns)
    manifest = {"contract": contract, "key": key, "columns": columns, "schema": held.schema.simpleString(), "rows": found["rows"], "digests": _digests(held, key, columns)}
    if predicted:
        n = held.agg(F.sum(predicted)).first()[0]
        if n in (0, found["rows"]):
            raise ValueError("all predictions are alike")
        manifest["predicted_pair_count"] = int(n)
    return _write_json(spark, f"{path}/manifest.json", manifest | dict.fromkeys(FAULTS, 0))


def read_bundle(spark: SparkSession, path: str, contract: dict, schema: str, expected: DataFrame | None = None) -> DataFrame:
    """The table of a bundle; a manifest, contract, count, fingerprint or key that isn't as it should be is an error."""
    manifest = _read_json(spark, f"{path}/manifest.json")
    if manifest["contract"] != contract:
        raise ValueError(f"{path} is of another contract")
    if any(manifest.get(f, -1) for f in FAULTS):
        raise ValueError(f"{path} reports faults")
    held = spark.read.schema(schema).parquet(f"{path}/data")
    if audit(held, manifest["key"], manifest["columns"])["rows"] != manifest["rows"] or _digests(held, manifest["key"], manifest["columns"]) != manifest["digests"]:
        raise ValueError(f"{path} doesn't hold what its manifest says")
    if expected is not None and (wrong := coverage(expected, held, *manifest["key"]).limit(1).collect()):
        raise ValueError(f"{path}: {wrong[0]}")
    return held


def seal(spark: SparkSession, path: str, bundles: list[str], contract: dict, expected: int) -> dict:
    """A file over all bundles of a study; it isn't made while any of them lacks, or a second time."""
    manifests = [_read_json(spark, f"{b}/manifest.json") for b in bundles if exists(spark, f"{b}/manifest.json")]
    if len(manifests) != expected:
        raise ValueError(f"{len(manifests)} bundles instead of {expected}")
    if any(m["contract"].get("study") != contract.get("study") for m in manifests):
        raise ValueError("a bundle is of another study")
    return _write_json(spark, path, {"contract": contract, "bundles": expected, "manifests_sha256": canonical_digest(sorted(m["payload_sha256"] for m in manifests)), "outcomes_revealed": False, "failure_count": 0})


def check_seal(spark: SparkSession, path: str, contract: dict, expected: int) -> dict:
    found = _read_json(spark, path)
    if found["contract"] != contract or found["bundles"] != expected or found["outcomes_revealed"] or found["failure_count"]:
        raise PermissionError("the seal isn't of this study, or isn't complete")
    return found


def files(spark: SparkSession, root: str) -> DataFrame:
    """(file, bytes, sha256) of all files under a folder but receipts; hashed in tasks, a file in each row."""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # the path that Spark gives is absolute: what follows the folder's own name is the file's
    base, _ = _at(spark, root)
    start = F.instr("path", base.getName() + "/") + len(base.getName()) + 1
    return held.select(F.expr("path").alias("path"), "length", F.sha2("content", 256).alias("sha256")).withColumn("file", F.substr("path", start)).where("not endswith(file, 'receipt.json')").select("file", F.col("length").alias("bytes"), "sha256")


def write_receipt(spark: SparkSession, root: str, contract: dict) -> dict:
    """A receipt of every file of a folder, with its size and SHA-256."""
    listed = {r["file"]: {"bytes": r["bytes"], "sha256": r["sha256"]} for r in files(spark, root).collect()}  # names and hashes of one unit's files
    return _write_json(spark, f"{root}/receipt.json", {"status": "complete", "contract": contract, "files": listed, "failure_count": 0})


def check_receipt(spark: SparkSession, root: str, contract: dict | None = None) -> dict:
    found = _read_json(spark, f"{root}/receipt.json")
    if found["status"] != "complete" or found["failure_count"]:
        raise ValueError("the receipt isn't of a complete unit")
    if contract is not None and found["contract"] != contract:
        raise ValueError("the receipt is of another contract")
    now = {r["file"]: {"bytes": r["bytes"], "sha256": r["sha256"]} for r in files(spark, root).collect()}
    if wrong := sorted(k for k, v in found["files"].items() if now.get(k) != v):
        raise ValueError(f"files differ from their receipt: {wrong[:3]}")
    return found


def write_shards(scores: DataFrame, path: str, contract: dict, shards: int, key: list[str], columns: list[str]) -> None:
    """Scores by hash shard of their review, with a manifest row for each shard, in one table beside them."""
    spark, digest = scores.sparkSession, canonical_digest(contract)
    audit(scores, key, columns)
    made = scores.withColumns({"shard": hash_bucket(F.col("row_uid"), shards), "contract_sha256": F.lit(digest)})
    made.repartition("shard").write.mode("errorifexists").partitionBy("shard").parquet(f"{path}/data")
    held = spark.read.parquet(f"{path}/data")
    shard_manifest(held, key, columns).withColumns({"shards": F.lit(shards), "contract_sha256": F.lit(digest)}).write.mode("errorifexists").parquet(f"{path}/manifest")
    _write_json(spark, f"{path}/manifest.json", {"contract": contract, "shards": shards, "key": key, "columns": columns})


def shard_manifest(held: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(shard, rows, pair_identity, scores): counts and fingerprints of each shard, in one aggregation."""
    digest = lambda names: F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in names)), 256)
    total = lambda names: F.sum(F.conv(F.substring(digest(names), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return held.groupBy("shard").agg(F.count("*").alias("rows"), total(key).alias("pair_identity"), total([*key, *columns]).alias("scores"))


def shard_states(spark: SparkSession, path: str, contract: dict, expected: DataFrame) -> DataFrame:
    """(shard, state): missing, complete or corrupt, against the shards that the expected keys (with row_uid) fall into."""
    head = _read_json(spark, f"{path}/manifest.json")
    key, columns, shards = head["key"], head["columns"], head["shards"]
    want = expected.select(*key).withColumn("shard", hash_bucket(F.col("row_uid"), shards))
    needed = shard_manifest(want, key, []).select("shard", F.col("rows").alias("want_rows"), F.col("pair_identity").alias("want_identity"))
    said = spark.read.parquet(f"{path}/manifest").select("shard", F.col("rows").alias("said_rows"), F.col("scores").alias("said_scores"), F.col("contract_sha256").alias("said_contract"))
    now = shard_manifest(spark.read.parquet(f"{path}/data"), key, columns)
    made = needed.join(said, "shard", "full").join(now, "shard", "full")
    good = (F.col("rows") == F.col("want_rows")) & (F.col("rows") == F.col("said_rows")) & (F.col("pair_identity") == F.col("want_identity")) & (F.col("scores") == F.col("said_scores")) & (F.col("said_contract") == canonical_digest(contract))
    none = F.col("rows").isNull() & F.col("said_rows").isNull()
    return made.select("shard", F.when(none, "missing").when(F.coalesce(good, F.lit(False)), "complete").otherwise("corrupt").alias("state"))


def merge_shards(spark: SparkSession, path: str, contract: dict, expected: DataFrame) -> DataFrame:
    """All shards as one frame; a shard that isn't complete is an error."""
    wrong = shard_states(spark, path, contract, expected).where("state <> 'complete'").limit(3).collect()
    if wrong:
        raise ValueError(f"shards aren't complete: {[tuple(r) for r in wrong]}")
    return spark.read.parquet(f"{path}/data").drop("contract_sha256")
