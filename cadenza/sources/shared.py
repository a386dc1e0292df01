"""Folders that driver and executors share, for queries that write files and read them again."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def out_folder(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors both write: below the cluster's shared folder, or a temporary one on a single machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    shared = shared or tempfile.mkdtemp(prefix="spark-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def emptied(spark: SparkSession, path: str) -> None:
    """Remove the files of a local folder by tasks, a folder each, where else the driver would hold the names in a folder and remove one file after the other.

    Its folders are left to delete, and so are stores, which remove a whole folder themselves.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    top = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    if not top.startswith("file:"):
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column("path").to_pylist():
                below = []
                with contextlib.suppress(FileNotFoundError), os.scandir(folder) as found:
                    for f in found:
                        if f.is_dir(follow_symlinks=False):
                            below.append(f.path)
                        else:
                            with contextlib.suppress(FileNotFoundError):  # a task that is repeated
                                os.unlink(f.path)
                yield pa.RecordBatch.from_arrays([pa.array(below, pa.string())], ["path"])

    level, n = spark.createDataFrame([(top.removeprefix("file:"),)], "path string"), 8 * spark.sparkContext.defaultParallelism
    while True:  # what is lost of a level is made again: the same folders, without their files
        below = level.repartition(n, "path").mapInArrow(run, "path string").persist()
        count = below.count()
        level.unpersist()
        level = below
        if not count:
            level.unpersist()
            return


def settled(df: DataFrame, name: str, *temporary: str, many: str | None = None) -> DataFrame:
    """The rows of df, written to the shared folder, after which the temporary folders that they were made from are removed; many: one of so many files that tasks do it."""
    spark, path = df.sparkSession, out_folder(df.sparkSession, name)
    try:
        df.write.parquet(path)
    finally:
        if many is not None:
            emptied(spark, many)
            delete(spark, many)
        for folder in temporary:
            delete(spark, folder)
    return spark.read.schema(df.schema).parquet(path)
