"""Files of a loop library as rows: scanning folders, telling containers apart."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.tags import file_name, is_loop_path
from .ranges import folder_of, read_path
from .shared import out_folder

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def scan(spark: SparkSession, *roots: str) -> DataFrame:
    """All loop files below the roots, each once.

    Hidden files and folders below a root are left out; the root itself may lie in a hidden folder. Spark itself leaves out files and folders whose names start with _ or a dot. Only overlapping roots cost a shuffle.
    """
    def read(root: str) -> DataFrame:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        return found.where(is_loop_path(F.col("path"), _depth(spark, root)))

    out = read(roots[0])
    for root in roots[1:]:
        out = out.unionByName(read(root))
    return once(out) if len(roots) > 1 else out


#: Tasks for each core that folders, and then the files found, are dealt to.
LISTED = 8
#: Entries of a folder that a task hands on together.
ENTRIES_PER_BATCH = 10_000
ENTRIES = "path string, modificationTime timestamp, length bigint, folder boolean"


def listing(spark: SparkSession, *roots: str, work: str | None = None) -> DataFrame:
    """Path, time and length of the files that scan finds, each once; contents are not read.

    Tasks list the folders, one level after the other, and keep what they find in tables below work (a folder of the caller's that is not there yet, or else a new
    shared one, which stays), so that the driver holds neither files nor folders. Of a local folder a task holds a batch of entries, of one in a store all of them.
    Files are dealt to the tables by path, however few folders they come from. The listing stays as it was found. Roots in stores that tasks cannot open by path
    are listed by Spark, on the driver.
    """
    tops = _tops(spark, roots)
    if not _in_reach(spark, [path for path, *_ in tops]):
        return once(scan(spark, *roots).select("path", "modificationTime", "length")).coalesce(LISTED * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                found = _entries(path)
                while rows := list(islice(found, ENTRIES_PER_BATCH)):
                    paths, times, lengths, folder = zip(*rows, strict=True)
                    times = pa.array([t * 1000 for t in times], pa.timestamp("us", "UTC"))
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), times, pa.array(lengths, pa.int64()), pa.array(folder, pa.bool_())], ["path", "modificationTime", "length", "folder"])

    work, n = work or out_folder(spark, "listing"), LISTED * spark.sparkContext.defaultParallelism
    is_wanted = is_loop_path(file_name(F.col("path"))) & (F.col("length") > 0)
    top = spark.createDataFrame(tops, "path string, ms bigint, length bigint, folder boolean").select("path", F.timestamp_millis("ms").alias("modificationTime"), "length", "folder")
    folders, tables = top.where("folder").select("path"), []
    while not folders.isEmpty():
        tables.append(f"{work}/{len(tables)}")
        found = folders.repartition(n, "path").mapInArrow(run, ENTRIES).where(F.col("folder") | is_wanted)
        found.repartition(n, "path").write.parquet(tables[-1])
        folders = spark.read.schema(ENTRIES).parquet(tables[-1]).where("folder").select("path")
    out = top if not tables else spark.read.schema(ENTRIES).parquet(*tables)
    if tables and not all(folder for *_, folder in tops):
        out = out.unionByName(top)
    return out.where(~F.col("folder") & is_wanted).drop("folder")


def _entries(folder: str) -> Iterator[tuple[str, int, int, bool]]:
    """Path, time in milliseconds, length, and whether it is a folder, of what Spark would list of a folder. What is gone by then is left out."""
    system, base = folder_of(folder)
    within = lambda name: f"{folder.rstrip('/')}/{name}"
    if system.type_name == "local":
        try:
            with os.scandir(base) as found:
                for f in found:
                    try:
                        s = f.stat()
                    except OSError:  # a link to nothing, or gone
                        continue
                    name, is_folder = os.fsencode(f.name).decode("utf-8", "replace"), stat.S_ISDIR(s.st_mode)
                    if _looked_at(name, is_folder):
                        yield within(name), s.st_mtime_ns // 1_000_000, s.st_size, is_folder
        except FileNotFoundError:
            return
    else:
        for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            is_folder = f.type == fs.FileType.Directory
            if f.type != fs.FileType.NotFound and _looked_at(f.base_name, is_folder):
                yield within(f.base_name), (f.mtime_ns or 0) // 1_000_000, f.size or 0, is_folder


def _looked_at(name: str, folder: bool) -> bool:
    """Whether Spark lists a file or folder of that name."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return True
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def _tops(spark: SparkSession, roots: tuple[str, ...]) -> list[tuple[str, int, int, bool]]:
    """Entries of the roots, or of what their wildcards stand for, but for those that are found below another."""
    out = {}
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if set(root) & set("{}[]*?\\"):
            found = system.globStatus(path) or ()
        else:
            found = [system.getFileStatus(path)] if system.exists(path) else []
        if not found:
            scan(spark, root)  # raises Spark's own error
        for s in found:
            name = system.makeQualified(s.getPath())
            if s.isDirectory() or _looked_at(name.getName(), False):
                out[name.toString()] = s.getModificationTime(), s.getLen(), s.isDirectory()
    below = lambda path, top: path.startswith(f"{top.rstrip('/')}/") and all(_looked_at(part, True) for part in path[len(top) :].strip("/").split("/"))
    return [(path, *rest) for path, rest in out.items() if not any(below(path, top) for top in out if top != path)]


def _in_reach(spark: SparkSession, paths: list[str]) -> bool:
    """Whether tasks can open folders by these paths."""
    elsewhere = [(p,) for p in paths if not p.startswith("file:")]
    if not elsewhere:
        return True

    @F.udf("boolean")
    def opens(path):
        try:
            return bool(folder_of(path))
        except (OSError, ValueError, NotImplementedError):
            return False

    return spark.createDataFrame(elsewhere, "path string").where(~opens("path")).isEmpty()


#: Bytes of contents that a task holds at a time, unless one file alone has more.
CONTENT_BYTES = 64 << 20


def fetched(paths: DataFrame, content_bytes: int = CONTENT_BYTES) -> DataFrame:
    """paths (path and any other columns) with content: each file is opened by the task that has its row, a bounded number of bytes at a time.

    Filter and join before: only the files of these rows are opened. content is null, and read_error says why, where a file cannot be read.
    """

    def read(path: str | None) -> tuple[bytes | None, str | None]:
        try:
            return (read_path(path), None) if path is not None else (None, "no path")
        except OSError as e:
            return None, str(e)[:200]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, begin, size, got = [*b.schema.names, "content", "read_error"], 0, 0, []
            for at, path in enumerate(b.column("path").to_pylist()):
                got.append(read(path))
                size += len(got[-1][0] or b"")
                if size >= content_bytes or at + 1 == b.num_rows:
                    rows = b.slice(begin, at + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([c for c, _ in got], pa.binary()), pa.array([e for _, e in got], pa.string())], names)
                    begin, size, got = at + 1, 0, []

    return paths.mapInArrow(run, T.StructType([*paths.schema, T.StructField("content", T.BinaryType()), T.StructField("read_error", T.StringType())]))


def _depth(spark: SparkSession, root: str) -> int:
    """Number of parts, between slashes, of the whole path of a root, which may hold wildcards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return len(whole.rstrip("/").split("/"))


def once(files: DataFrame) -> DataFrame:
    """Each path once."""
    return files.dropDuplicates(["path"])


def container(content: Column) -> Column:
    """caf, aiff, or null for anything else."""
    at = lambda start, text: F.substring(content, start, 4) == F.lit(text).cast("binary")
    kind = F.when(at(1, "caff"), "caf").when(at(1, "FORM") & (at(9, "AIFF") | at(9, "AIFC")), "aiff")
    return F.when(F.octet_length(content) >= 12, kind)


def form_type(content: Column) -> Column:
    return F.when(container(content) == "aiff", F.decode(F.substring(content, 9, 4), "US-ASCII"))
