"""Intermediate tables that are written once and read often, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths that the scopes now open have written, innermost last.
_scopes: list[list[str]] = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir; a local one only where the session names none and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='hourloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/hourloom/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df, written and read back: what reads it later plans and computes from a table, and survives lost executors."""
    path = shared_path(df.sparkSession, label)
    if _scopes:
        _scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged inside go at the end: for jobs whose results are written before that."""
    _scopes.append([])
    try:
        yield
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for path in _scopes.pop():
            hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop(path), True)
