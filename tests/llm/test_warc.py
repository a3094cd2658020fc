import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from larkspur.llm import warc
from larkspur.llm.common import scratch_path

LONG = "<p>é" + "x" * 1200


def pages(spark):
    rows = [(1, "http://a/", LONG), (2, "http://b/\r\nEvil: 1", LONG), (3, None, LONG), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 60), (9, "u", "y" * 1000), (9, "u", "y" * 1000), (None, "u", "z" * 1500), (None, "u", "z" * 1500), (10, "u", "y" * 999), (11, "u", "y" * 999)]
    return rows, spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int")


def brute(rows):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == body and j is not None]
        first = max(same) if same else None
        again = len(body) >= 1000 and first is not None and i != first
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


key = lambda r: tuple((v is None, v) for v in r)


def test_round_trip(spark):
    rows, frame = pages(spark)
    found = warc.round_trip(frame).collect()
    assert sorted((tuple(r) for r in found), key=key) == sorted(brute(rows), key=key)


def test_payloads_beyond_a_batch(spark):
    big = "é<p>" + "long " * 2_000_000
    rows = [(1, "u", big), (2, "u", big), (3, "u", big + "x"), (4, "u", "tail" * 300)]
    found = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((tuple(r) for r in found), key=key) == sorted(brute(rows), key=key)


def test_predicates_and_payloads(spark, monkeypatch):
    rows, frame = pages(spark)
    path = scratch_path(spark, "warc-test")
    warc.archive(frame, path)
    every = warc.read(spark, path)
    assert every.count() == len(rows)
    revisits = every.where("record_type = 'revisit'")
    assert sorted(r["record_id"] for r in revisits.collect()) == ["<urn:page:1>", "<urn:page:2>"] and all(r["payload"] is None and r["refers_to"] == "<urn:page:3>" for r in revisits.collect())
    assert every.count() == len(rows) and every.where("record_type = 'response'").count() == len(rows) - 2  # no filter outlives its use
    assert warc.read(spark, path, record_types="revisit").count() == 2
    assert spark.read.format("warc").load(path).where("record_type = 'revisit'").count() == 2
    assert warc.read(spark, path, **{"header.WARC-Record-ID": "<urn:page:8>"}).first()["payload"].decode() == rows[7][2]
    assert warc.read(spark, path, payload=False).columns == [c for c in every.columns if c != "payload"]
    assert warc.read(spark, path, payload=False).where(F.col("record_id").startswith("<urn:page:1") & F.col("refers_to").isNull()).count() == 2
    assert warc.read(spark, path).where(F.col("record_id").isin("<urn:page:4>", "<urn:page:5>")).count() == 2
    assert {r["target_uri"] for r in every.collect()} >= {"http://b/%0D%0AEvil: 1", None}


def test_unwanted_payloads_are_stepped_over():
    """Payloads of records that a predicate refuses are never read."""

    class Handle:
        def __init__(self, data):
            self.data, self.at, self.got = data, 0, 0

        def read(self, n):
            out = self.data[self.at : self.at + n]
            self.at += len(out)
            self.got += len(out)
            return out

        def seek(self, n, whence):
            self.at += n

    record = lambda kind, body: f"WARC/1.1\r\nWARC-Type: {kind}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    handle = Handle(record("response", b"x" * 5_000_000) + record("metadata", b"abc") + record("response", b"y" * 5_000_000))
    assert [body for _, body in warc.records(handle, False, lambda h: h["WARC-Type"] == "metadata", True)] == [b"abc"]
    assert handle.got < 400_000


def test_zipped(spark):
    rows, frame = pages(spark)
    made = frame.select(F.lit("response").alias("record_type"), F.col("page_id").cast("string").alias("record_id"), F.col("html").cast("binary").alias("payload"))
    path = scratch_path(spark, "warc-gz")
    spark.dataSource.register(warc.WarcDataSource)
    made.write.format("warc").option("compression", "gzip").option("file_bytes", "300").mode("append").save(path)
    found = warc.read(spark, path, partition_bytes="500").collect()
    assert sorted((r["record_id"] or "", r["payload"]) for r in found) == sorted((str(i) if i is not None else "", (h or "").encode()) for i, _, h in rows)


def test_foreign_files_and_broken_ones(spark, tmp_path):
    head = "WARC/1.0\r\nwarc-type: response\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\nX-Any: a: b\r\n\r\nhi\r\n\r\n".encode()
    (tmp_path / "a.warc").write_bytes(head * 3)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(head) + gzip.compress(head))
    (tmp_path / ".hidden.warc").write_bytes(b"junk")
    found = warc.read(spark, str(tmp_path)).collect()
    assert len(found) == 5 and found[0]["headers"]["X-Any"] == "a: b" and found[0]["payload"] == b"hi"
    (tmp_path / "c.warc").write_bytes(head[:-6])
    with pytest.raises(Exception, match="cut short"):
        warc.read(spark, str(tmp_path)).collect()


def test_empty_table(spark):
    assert warc.round_trip(pages(spark)[1].limit(0)).count() == 0
