"""What the operators of this subpackage share: shared folders, lineage cuts, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch where a column holds whole texts, so that a batch of long ones fits a worker.
TEXT_BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Only where the session names none and all runs on one machine (tests), a temporary folder is made and set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    made = spark.sparkContext.getCheckpointDir()
    if made is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        made = spark.sparkContext.getCheckpointDir()
    return made


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_collecting: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, computed once and kept as a Parquet table in the shared folder; the lineage ends there."""
    path = new_folder(df.sparkSession, name)
    for paths in _collecting[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def transient(spark: SparkSession) -> Iterator[None]:
    """All tables that operators store meanwhile are removed at the end: for results that have been written by then."""
    _collecting.append([])
    try:
        yield
    finally:
        for path in _collecting.pop():
            delete(spark, path)


class Scratch:
    """Tables of one operator in the shared folder. They go when the operator has its result, also if it fails."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, new_folder(spark, name)
        self._paths: dict[int, tuple[str, DataFrame]] = {}

    def keep(self, df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
        """The rows of df, computed once; the lineage ends there. by: a folder for each value of that column, which has few."""
        path = f"{self.folder}/{len(self._paths)}-{name}"
        writer = df.write.options(**options)
        (writer.partitionBy(by) if by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path, out
        return out

    def path_of(self, table: DataFrame) -> str:
        return self._paths[id(table)][0]

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for t in tables:
            delete(self.spark, self.path_of(t))


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Scratch]:
    own = Scratch(spark, name)
    try:
        yield own
    finally:
        delete(spark, own.folder)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, made from name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small for this session; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of whole texts are small for the jobs inside; the session's own setting is restored."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    if before is None or int(before) <= 0 or int(before) > rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
