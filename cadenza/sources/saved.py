"""A saved catalogue that is brought up to date: tags, failures and suggestions of a library, one batch after the other.

Every batch is a whole version of each table in a folder of its own number, written first and committed last by a marker that is created at once or not
at all. Readers take the version of the highest marker, so that a save that fails halfway, or is repeated, changes nothing for them. What is copied from version to version are rows
of a few hundred bytes; files are opened only where they are new or have another time or length than when they were read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import containers
from .shared import delete

TAGS, FAILURES, SUGGESTIONS = "tags", "failures", "suggestions"
#: What tells whether a file is the one that was read.
SAME = ["path", "modificationTime", "length"]
#: Versions that remain after a commit: the new one, and the one that readers may still use.
VERSIONS = 2


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the committed batches, in order."""
    path, fs = _path(spark, f"{folder}/commits")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(path)) if fs.exists(path) else []


def saved(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """The last committed version of a table; None where nothing, or no such table, has been saved."""
    done = batches(spark, folder)
    if not done:
        return None
    where = f"{folder}/{table}/{done[-1]}"
    path, fs = _path(spark, where)
    return spark.read.parquet(where) if fs.exists(path) else None


def commit(spark: SparkSession, folder: str, batch: int, tables: dict[str, DataFrame]) -> bool:
    """Save a version of all tables as that batch; False if it, or a later one, is committed already. Tags are partitioned by container."""
    done = batches(spark, folder)
    if done and done[-1] >= batch:
        return False
    for name, rows in tables.items():
        writer = rows.write.mode("overwrite")  # what a failed attempt at this batch has left
        (writer.partitionBy("container") if name == TAGS else writer).parquet(f"{folder}/{name}/{batch}")
    marker, fs = _path(spark, f"{folder}/commits/{batch}")
    if not fs.createNewFile(marker):
        raise FileExistsError(f"batch {batch} was committed by another writer")
    for old in batches(spark, folder)[:-VERSIONS]:
        delete(spark, f"{folder}/commits/{old}")
        for name in (TAGS, FAILURES, SUGGESTIONS):
            delete(spark, f"{folder}/{name}/{old}")
    return True


def refresh(folder: str, batch: int, listed: DataFrame, suggest: Callable[[DataFrame], DataFrame] | None = None, read: Callable[[DataFrame], DataFrame] = containers.read_by_range) -> bool:
    """Bring the catalogue in folder up to date with the files that are listed (SAME), as that batch.

    Files that are new or changed are read; rows of others are kept, those of files that are not listed any more go. suggest gives the suggestions (with path) of
    what was read. A repeated batch does nothing.
    """
    spark = listed.sparkSession
    if any(b >= batch for b in batches(spark, folder)):
        return False
    old = {name: saved(spark, folder, name) for name in (TAGS, FAILURES, SUGGESTIONS)}
    listed = listed.select(*SAME)
    known = None if old[TAGS] is None else old[TAGS].select(*SAME).unionByName(old[FAILURES].select(*SAME))
    fresh = listed if known is None else listed.join(known, SAME, "left_anti")
    work = f"{folder}/reading/{batch}"
    read(fresh).write.mode("overwrite").parquet(work)  # opened once, whatever is made of it
    try:
        got = spark.read.parquet(work)
        rows = containers.tags(got).join(listed, "path")
        new = {TAGS: rows.where("error_code is null").drop("error_code", "error_detail"), FAILURES: rows.where("error_code is not null").select(*SAME, "error_code", "error_detail")}
        if suggest is not None:
            new[SUGGESTIONS] = suggest(got.where("error_code is null"))
        if known is not None:
            # suggestions of a file stay as long as its row does
            kept = {TAGS: old[TAGS].join(listed, SAME, "left_semi"), FAILURES: old[FAILURES].join(listed, SAME, "left_semi")}
            if old[SUGGESTIONS] is not None:
                kept[SUGGESTIONS] = old[SUGGESTIONS].join(kept[TAGS].select("path"), "path", "left_semi")
            new = {name: kept[name].unionByName(new[name]) if name in new and name in kept else new.get(name, kept.get(name)) for name in {**new, **kept}}
        return commit(spark, folder, batch, new)
    finally:
        delete(spark, work)
