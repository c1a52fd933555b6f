"""Shared storage for intermediate tables and files, and small helpers for Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes in an Arrow batch that goes to Python: bounds what a worker holds of long documents.
BATCH_ROWS, BATCH_BYTES = "1000", str(16 << 20)
#: Tables that the scratch scopes now open have written, innermost last.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where the session names none and all runs in one process (tests) a local folder is made and set; on a cluster that is an
    error, as executors would write where nobody reads.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="hourloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/hourloom/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df once and read it back: cuts the lineage at a place that survives lost executors."""
    path = new_path(df.sparkSession, label)
    if _scopes:
        _scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside are deleted at the end, but for those that keep() makes."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            fs, root = filesystem(path)
            if fs.get_file_info(root).type != pafs.FileType.NotFound:
                fs.delete_dir(root)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Materialise a result of the innermost scratch scope in the scope around it."""
    own = _scopes.pop()
    try:
        return materialise(df, label)
    finally:
        _scopes.append(own)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a worker's memory doesn't follow the documents' lengths; the session keeps this setting."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI or absolute path, and the path in it; any store Arrow knows."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, name: str, chunks: Iterator[bytes]) -> str:
    """Write a file of its own name for this attempt; a failed attempt leaves nothing that is referenced."""
    fs, root = filesystem(uri)
    fs.create_dir(root, recursive=True)
    full = f"{root}/{name}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
    with fs.open_output_stream(full) as out:
        for chunk in chunks:
            out.write(chunk)
    return f"{uri}/{full.rsplit('/', 1)[1]}"


@contextmanager
def new_file(uri: str, name: str) -> Iterator[tuple[str, pa.NativeFile]]:
    """(uri, stream) of a file of its own name for this attempt, for writers that need a stream."""
    fs, root = filesystem(uri)
    fs.create_dir(root, recursive=True)
    own = f"{name}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
    with fs.open_output_stream(f"{root}/{own}") as out:
        yield f"{uri}/{own}", out


def give_back() -> None:
    """Return memory that this process has freed to the system: C libraries keep what texts and arrays of mixed sizes leave behind."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
