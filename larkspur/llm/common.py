"""Shared folders, scratch tables and Arrow helpers of the operators in this subpackage."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one slice of a batch holds at most, unless a single text is longer.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"/tmp/checkpoints/larkspur-{os.getpid()}"
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/larkspur/{name}-{uuid.uuid4().hex}"


class _Scopes(threading.local):
    """Scratch tables of a thread's open scopes, from the outermost to the innermost."""

    def __init__(self):
        self.open: list[list[Scratch]] = []


_SCOPES = _Scopes()


@contextmanager
def freeing() -> Iterator[None]:
    """Scratch tables that are made inside are deleted at its end; those that were kept go over to the scope around it."""
    _SCOPES.open.append([])
    try:
        yield
    finally:
        for made in _SCOPES.open.pop():
            if not made.kept:
                made.drop()
            elif _SCOPES.open:
                made.kept = False
                _SCOPES.open[-1].append(made)


class Scratch:
    """A table written to the shared folder and read again: it cuts lineage and outlives executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.kept = df.sparkSession, False
        if _SCOPES.open:
            _SCOPES.open[-1].append(self)
        self.path = scratch_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def keep(self) -> Scratch:
        """It outlives the scope that it was made in."""
        self.kept = True
        return self

    def drop(self) -> None:
        """Delete the files; only after everything that reads them has been written."""
        for scope in _SCOPES.open:
            if self in scope:
                scope.remove(self)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def text_slices(batch: pa.RecordBatch, column: str | int = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(size)
    if batch.num_rows > begin:
        yield batch.slice(begin)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns of these names, in any case."""
    lower = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in lower))


def add_columns(df: DataFrame, text: str, fn: Callable[[pa.Array], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """df with further columns that fn makes from its column of text, row by row, whatever else df holds.

    fn gets a null-free array of texts (null: empty) and returns one array for each field. Columns of df with the fields'
    names, in any case, make way for them.
    """
    df = without(df, *(f.name for f in fields))
    at = df.columns.index(text)
    types = [arrow_type(f.dataType) for f in fields]
    names = [f"c{i}" for i in range(len(df.columns) + len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, at):
                made = fn(pc.fill_null(batch.column(at), ""))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(m.cast(t) for m, t in zip(made, types))], names=names)

    # plain names on the way, as mapInArrow takes a dot in a name for a field of a struct
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, [*df.schema.fields, *fields])])
    return df.toDF(*names[: len(df.columns)]).mapInArrow(run, schema).toDF(*df.columns, *(f.name for f in fields))


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
