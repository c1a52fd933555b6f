"""Uploads as a stream: each arriving file updates its users' months, the latest version winning."""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.operators.review import upsert

#: A month's rows lie together, so a batch rewrites only the months that it touches.
PARTS = ["year", "month"]


def run_upserts(stream: DataFrame, target_path: str, checkpoint: str, keys: list[str], version: list[str]) -> int:
    """Merge everything that the stream has into a table by year and month under target_path; the number of batches.

    A batch writes new files of the months it touches, named by the batch, from their last ones and its rows, and then a manifest:
    which batch each month is current of. A batch that is replayed after a failure reads the manifest before it and so writes the same
    files again. Files that neither this manifest nor the one before names are removed: no replay reads them. The stream itself keeps
    no state.
    """
    done = []

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = max((n for n in manifests(spark, target_path) if n < number), default=None)
        touched = batch.select(*[F.col(c).cast("int").alias(c) for c in PARTS]).distinct()
        if last is None:
            new, current = upsert(batch.limit(0), batch, keys, version), touched.withColumn("batch", F.lit(number))
        else:
            before = read_manifest(spark, target_path, last)
            remove_old(spark, target_path, last)
            kinds = dict(batch.dtypes)
            old = read_months(spark, target_path, before.join(touched, PARTS, "left_semi"))
            new = batch if old is None else old.select(*[F.col(c).cast(kinds[c]).alias(c) for c in batch.columns])
            new = upsert(new.limit(0) if old is None else new, batch, keys, version)
            current = before.join(touched, PARTS, "left_anti").unionByName(touched.withColumn("batch", F.lit(number)))
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *PARTS).parquet(f"{target_path}/data")
        # The manifest counts from when it stands, so it comes last.
        current.select(*PARTS, "batch").coalesce(1).write.mode("overwrite").parquet(f"{target_path}/manifest/{number:012d}")
        done.append(number)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return max(done, default=-1) + 1


def _path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def manifests(spark: SparkSession, target_path: str) -> list[int]:
    """Batches whose manifest is whole, in order."""
    fs, folder = _path(spark, f"{target_path}/manifest")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n) for n in names if fs.exists(_path(spark, f"{target_path}/manifest/{n}/_SUCCESS")[1]))


def read_manifest(spark: SparkSession, target_path: str, number: int) -> DataFrame:
    """year, month, batch: which batch each month is current of after batch `number`; one row a month."""
    return spark.read.schema("year int, month int, batch int").parquet(f"{target_path}/manifest/{number:012d}")


def read_months(spark: SparkSession, target_path: str, months: DataFrame) -> DataFrame | None:
    """The rows of months(year, month, batch); only their folders are listed and read. None without months."""
    folders = [f"{target_path}/data/batch={r.batch}/year={r.year}/month={r.month}" for r in months.collect()]
    if not folders:
        return None
    return spark.read.option("basePath", f"{target_path}/data").parquet(*folders).drop("batch")


def remove_old(spark: SparkSession, target_path: str, last: int) -> None:
    """Remove months' files that manifests below `last` name and that of `last` doesn't, and those manifests: `last` is what a replay of
    the batch behind it reads. A second call changes nothing."""
    named = {tuple(r) for r in read_manifest(spark, target_path, last).collect()}
    for number in (n for n in manifests(spark, target_path) if n < last):
        for year, month, batch in read_manifest(spark, target_path, number).collect():
            if (year, month, batch) not in named:
                fs, folder = _path(spark, f"{target_path}/data/batch={batch}/year={year}/month={month}")
                fs.delete(folder, True)
        fs, folder = _path(spark, f"{target_path}/manifest/{number:012d}")
        fs.delete(folder, True)


def read_latest(spark: SparkSession, target_path: str) -> DataFrame:
    """The table as it is now."""
    known = manifests(spark, target_path)
    got = read_months(spark, target_path, read_manifest(spark, target_path, known[-1])) if known else None
    if got is None:
        raise ValueError(f"{target_path}: nothing stored")
    return got
