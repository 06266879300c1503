"""What the operators share: byte-level words, Arrow plumbing, tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_DIRS: dict[str, str] = {}
_WRITES = threading.Lock()
_WRITING: dict[str, tuple[int, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a temporary folder in local mode (one machine); a cluster must name one.
    """
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    app = spark.sparkContext.applicationId
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="metricspine-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return _LOCAL_DIRS[app]


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the queries inside end; the setting is restored when the last of several threads leaves."""
    app = spark.sparkContext.applicationId
    with _WRITES:
        users, before = _WRITING.get(app) or (0, spark.conf.get(_CLEANUP, "false"))
        _WRITING[app] = users + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _WRITES:
            users, before = _WRITING.pop(app)
            if users > 1:
                _WRITING[app] = users - 1, before
            else:
                spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again.

    This cuts the lineage in a way that outlives any executor, and each later
    reader scans columns instead of computing df again. The shuffle files of the
    write go when it ends; left to the driver's garbage collection, those of
    several steps would fill the disks together.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def scale_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sources(docs: DataFrame, **wanted: Column) -> DataFrame:
    """Only the named columns, computed from docs; extra columns with any name do no harm."""
    return docs.select(*[c.alias(k) for k, c in wanted.items()])


def carried(docs: DataFrame, names: tuple[str, ...]) -> tuple[dict[str, Column], list[pa.Field]]:
    """Columns that pass through Python unchanged: as inputs _c0, _c1, ... and as Arrow fields with their own names."""
    types = [docs.select(F.col(f"`{n}`")).schema[0].dataType for n in names]
    return {f"_c{k}": F.col(f"`{n}`") for k, n in enumerate(names)}, [pa.field(n, to_arrow_type(t)) for n, t in zip(names, types, strict=True)]


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text column, null as null."""
    return F.col(name).cast("string").cast("binary")


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns, converted a slice at a time so that few long texts are live at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def emitter(schema: pa.Schema, rows: Iterator[tuple], size: int = 4096, max_bytes: int = 8 << 20, weigh: Callable[[tuple], int] | None = None) -> Iterator[pa.RecordBatch]:
    """Record batches from tuples, cut by count and, with weigh, by bytes."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += weigh(row) if weigh else 0
        if len(held) >= size or weight >= max_bytes:
            yield to_batch(schema, held)
            held, weight = [], 0
    if held:
        yield to_batch(schema, held)


def to_batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def spark_schema(schema: pa.Schema) -> T.StructType:
    return from_arrow_schema(schema)


_LOWER_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(c, _LOWER_FROM, _LOWER_FROM.lower())


def id_bucket(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def crc_bucket(doc_id: int | None, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n
