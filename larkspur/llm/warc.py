"""WARC 1.1 archives as a Spark data source in Python, for reading and writing.

Reading (`spark.read.format("warc").load(path)`): the files of a folder are dealt into partitions of PARTITION bytes, about.
Of each record the headers are parsed first; a payload is decoded only if the record passes the predicates that were pushed
down and the schema has the column payload, and is stepped over by its length otherwise. Predicates reach the source as
the options record_types ("response,revisit") and "header.<Name>" (a header's exact value), or as filters (equality, IN,
null tests and prefixes on record_type, record_id, target_uri, date, refers_to and payload_digest). Filters are pushed by
`read`, or with the option pushdown; Spark keeps a relation's last filters if a later use of it has none to push, so `read`
sees to it that there always is one. Files that end in .gz are read member by member.

Writing: one file for each task, and a new one after FILE bytes; files appear under their names when the job commits, so
a task that is lost or repeated leaves no records. Null payloads are empty ones. Control characters in header values are
percent-encoded. The folder must be one that all executors share, of any scheme that pyarrow.fs opens.

`archive` stores pages: of records with equal payloads of LEAST bytes or more, the one with the largest page_id is a
response and the others are revisits that refer to it; all smaller ones are responses, as are rows that repeat the largest
page_id, and rows of payloads whose page_ids are all null. Equal means equal SHA-1 and length. An empty table gives an
empty archive. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from larkspur.llm.common import Scratch, freeing, scratch_path

PARTITION, FILE, BATCH, LEAST = 32 << 20, 64 << 20, 8 << 20, 1000
#: Rows of repeated payloads that may be broadcast (an SHA-1, two numbers: below 100 bytes each).
BROADCAST_ROWS = 400_000
SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
#: Columns and the headers that hold them.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
LENGTH, FULL_LENGTH, PROFILE = "Content-Length", "X-Payload-Bytes", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:", "file://", 1))


def _clean(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


class WarcFiles(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWritten(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Source:
    """Bytes of a file in order: read(n), and skip(n), which seeks where it can."""

    def __init__(self, handle, zipped: bool):
        self.handle, self.zipped, self.rest = handle, zipped, b""
        self.inflate = zlib.decompressobj(31) if zipped else None

    def _more(self) -> bytes:
        raw = self.handle.read(1 << 16)
        if not self.zipped or not raw:
            return raw
        out = io.BytesIO()
        while raw:
            out.write(self.inflate.decompress(raw))
            raw = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
        return out.getvalue() or self._more()

    def read(self, n: int) -> bytes:
        if len(self.rest) >= n:
            out, self.rest = self.rest[:n], self.rest[n:]
            return out
        parts, held = [self.rest], len(self.rest)
        self.rest = b""
        if not self.zipped and n - held > 1 << 16:
            more = self.handle.read(n - held)
            parts.append(more)
            held += len(more)
        while held < n:
            if not (more := self._more()):
                raise ValueError("a WARC record is cut short")
            parts.append(more)
            held += len(more)
        whole = b"".join(parts)
        self.rest = whole[n:]
        return whole[:n]

    def skip(self, n: int) -> None:
        if n <= len(self.rest):
            self.rest = self.rest[n:]
        elif self.zipped:
            while n:
                n -= len(self.read(min(n, 1 << 16)))
        else:
            self.handle.seek(n - len(self.rest), 1)
            self.rest = b""

    def head(self) -> bytes | None:
        """Up to the next empty line; None at the end."""
        while (at := self.rest.find(b"\r\n\r\n")) < 0:
            if not (more := self._more()):
                if self.rest.strip():
                    raise ValueError("a WARC header is cut short")
                return None
            self.rest += more
        out, self.rest = self.rest[:at], self.rest[at + 4 :]
        return out


def records(handle, zipped: bool, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload or None) of the records that wanted(headers) accepts."""
    source = _Source(handle, zipped)
    while (head := source.head()) is not None:
        lines = head.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers[LENGTH])
        if not wanted(headers):
            source.skip(size)
        elif payload:
            yield headers, source.read(size)
        else:
            source.skip(size)
            yield headers, None
        if source.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record doesn't end where its length says")


class WarcReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.schema = options["path"], schema
        types = options.get("record_types")
        self.types = {t.strip() for t in types.split(",")} if types else None
        self.exact = {k[len("header.") :].lower(): v for k, v in dict(options).items() if k.lower().startswith("header.")}
        self.partition_bytes = int(options.get("partition_bytes", PARTITION))
        self.filters: list[tuple[str, str, object]] = []

    def wanted(self, headers: dict[str, str]) -> bool:
        if self.types is not None and headers.get("WARC-Type") not in self.types:
            return False
        if self.exact:
            by_lower = {k.lower(): v for k, v in headers.items()}
            if any(by_lower.get(k) != v for k, v in self.exact.items()):
                return False
        for kind, name, value in self.filters:
            has = headers.get(name)
            if not {"EqualTo": has is not None and has == value, "EqualNullSafe": has == value, "In": has is not None and kind == "In" and has in value, "IsNull": has is None, "IsNotNull": has is not None, "StringStartsWith": has is not None and kind == "StringStartsWith" and has.startswith(value)}[kind]:
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        fs, root = _open(self.path)
        found = [f for f in fs.get_file_info(pa.fs.FileSelector(root, allow_not_found=True)) if f.is_file and f.base_name.endswith((".warc", ".warc.gz")) and not f.base_name.startswith((".", "_"))]
        parts: list[list[str]] = [[]]
        room = self.partition_bytes
        for f in sorted(found, key=lambda f: (-f.size, f.path)):
            if parts[-1] and room < f.size:
                parts.append([])
                room = self.partition_bytes
            parts[-1].append(f.path)
            room -= f.size
        return [WarcFiles(p) for p in parts]

    def read(self, partition: WarcFiles) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        schema = to_arrow_schema(self.schema)
        payload = "payload" in self.schema.names
        rows: list[dict] = []
        held = 0
        for path in partition.files:
            with fs.open_input_file(path) as handle:
                for headers, body in records(handle, path.endswith(".gz"), self.wanted, payload):
                    row = {k: headers.get(v) for k, v in HEADERS.items()}
                    row["payload_bytes"], row["headers"] = int(headers.get(FULL_LENGTH, headers[LENGTH])), list(headers.items())
                    row["payload"] = None if headers.get("WARC-Type") == "revisit" else body
                    rows.append(row)
                    held += 500 + len(body or b"")
                    if held > BATCH:
                        yield pa.RecordBatch.from_pylist([{n: r[n] for n in schema.names} for r in rows], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in schema.names} for r in rows], schema=schema)


class WarcFilteringReader(WarcReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append((type(f).__name__, HEADERS[f.attribute[0]], getattr(f, "value", None)))
            else:
                yield f


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.zipped = options.get("compression", "none") == "gzip"
        self.file_bytes = int(options.get("file_bytes", FILE))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WarcWritten:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                if out is None or size > self.file_bytes:
                    if out is not None:
                        out.close()
                    name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.zipped
                    files.append((f"{root}/.{name}.tmp", f"{root}/{name}"))
                    out, size = fs.open_output_stream(files[-1][0], compression=None), 0
                lines = ["WARC/1.1"]
                for column, header in HEADERS.items():
                    if column in columns and (value := columns[column][i].as_py()) is not None:
                        lines.append(f"{header}: {_clean(value)}")
                if "headers" in columns:
                    lines += [f"{_clean(k)}: {_clean(v)}" for k, v in columns["headers"][i].as_py() or [] if v is not None]
                body = columns["payload"][i].as_buffer() if "payload" in columns and columns["payload"][i].is_valid else b""
                if "payload_bytes" in columns:
                    lines.append(f"{FULL_LENGTH}: {columns['payload_bytes'][i].as_py()}")
                if columns["record_type"][i].as_py() == "revisit":
                    lines.append(f"WARC-Profile: {PROFILE}")
                lines.append(f"{LENGTH}: {len(body)}")
                head = ("\r\n".join(lines) + "\r\n\r\n").encode()
                if self.zipped:
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    made = [pack.compress(head), pack.compress(body), pack.compress(b"\r\n\r\n"), pack.flush()]
                else:
                    made = [head, body, b"\r\n\r\n"]
                for x in made:
                    out.write(x)
                    size += len(x)
        if out is not None:
            out.close()
        return WarcWritten(files)

    def commit(self, messages: list[WarcWritten | None]) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(pa.fs.FileSelector(root)):
                if f.is_file and f.base_name.endswith((".warc", ".warc.gz")) and not f.base_name.startswith("."):
                    fs.delete_file(f.path)
        for message in messages:
            for was, now in message.files if message else []:
                fs.move(was, now)

    def abort(self, messages: list[WarcWritten | None]) -> None:
        fs, _ = _open(self.path)
        for message in messages:
            for was, _ in message.files if message else []:
                if fs.get_file_info(was).is_file:
                    fs.delete_file(was)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return (WarcFilteringReader if self.options.get("pushdown", "false") == "true" else WarcReader)(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def archive(pages: DataFrame, path: str) -> None:
    """Write a record for each page to the folder `path`; see the module."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcDataSource)
    body = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select("page_id", "url", "html").withColumns({"digest": F.sha1(body), "size": F.octet_length(body).cast("long")})
    same = rows.where(F.col("size") >= LEAST).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    with freeing():
        same = Scratch(same, "payloads").df
        # few payloads repeat: a small table is sent out, a larger one is joined by shuffles
        same = F.broadcast(same) if same.count() <= BROADCAST_ROWS else same
        joined = rows.join(same, ["digest", "size"], "left")
        again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
        name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
        joined.select(
            F.when(again, "revisit").otherwise("response").alias("record_type"), name(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"),
            F.lit("1970-01-01T00:00:00Z").alias("date"), F.when(again, name(F.col("first"))).alias("refers_to"), F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
            F.col("size").alias("payload_bytes"), F.when(~again, F.col("html").cast("binary")).alias("payload"),
        ).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True, pushdown: bool = True, **options: str) -> DataFrame:
    """The records under `path`; without payload, payloads are stepped over. With pushdown, the session's filter pushdown is turned on.

    A record without its type, which the format demands, isn't returned.
    """
    spark.dataSource.register(WarcDataSource)
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a reader that takes filters fails without it
    reader = spark.read.format("warc").option("pushdown", str(pushdown).lower()).options(**options)
    return (reader if payload else reader.schema(SCHEMA.rsplit(",", 1)[0])).load(path).where(F.col("record_type").isNotNull())


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, from the archive that holds the pages.

    A response's length and digest are taken from the payload that was read. Revisits are read by their type and without
    payloads, which are stepped over; theirs are from the headers.
    """
    path = path or scratch_path(pages.sparkSession, "warc")
    archive(pages, path)
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    number = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).cast(kind)
    own = F.when(F.col("record_id") != "<urn:page:>", number("record_id")).alias("page_id")
    responses = read(spark, path, pushdown=False, record_types="response").select(
        own, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"),
    )
    revisits = read(spark, path, payload=False, pushdown=False, record_types="revisit").select(
        own, F.col("payload_bytes").cast("long").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
    )
    return responses.unionByName(revisits)
