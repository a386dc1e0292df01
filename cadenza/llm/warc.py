"""Pages as WARC archives, read back, with an index of captures merged from sorted runs.

Every page is a record of its own gzip member, a response, or a revisit without payload where an equal payload of some size
is stored under a smaller identifier. A task writes its pages by URL key and date into archives, and their places in
the same order into an index: so each file of the index is a sorted run. Runs are merged outside memory with loser trees that read each run in small
batches: passes of FAN_IN runs to a task until no more than FAN_IN longer runs are left; then the keys are cut into ranges, and a task merges what its range
has of each. The result is the order of all captures by URL key and date, the histories of URLs one after the other.

Payloads go to the join that finds earlier equal ones and from there into archives; everything else moves keys. The join is one that Spark can split where
a payload is a third of all rows, and so is that which gives revisits the size of what they refer to. Ranges are cut at whole index rows, not at URLs, so that a URL with
a third of all captures fills several ranges. An archive's name belongs to one attempt of a task and is found through the index alone: files of lost
or repeated attempts are never read. The folder must be one that Spark and pyarrow open by the same name (a shared file system, hdfs, s3, gs, abfs).

Null payloads are empty, null URLs have the empty key, null dates are empty; records without identifier are responses, come first among equals
and are never referred to. Rows that repeat an identifier are records each; those of one payload under the smallest identifier
are all responses. Rows that agree in everything take any order among themselves. An empty table gives no archive and no rows. Only the columns named are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, scratch, small_batches, stored

#: Payloads of fewer bytes are stored each: fixed by contract.
LEAST_BYTES = 100
#: Size at which a task begins another archive.
ARCHIVE_BYTES = 512 << 20
#: Runs merged at a time, rows read of each at a time, captures of a range.
FAN_IN, READ_ROWS, RANGE_ROWS = 64, 1024, 1_000_000
#: Rows of the index of which a range is cut, for each range.
CUTS = 40

#: Row groups of runs are small, so that a range reads little more of a run than its own part.
SMALL_GROUPS = {"parquet.block.size": str(2 << 20)}
#: Never part of a header's value; written in percent form.
_CONTROL = re.compile("[\x00-\x1f\x7f]")
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The order of captures. The last two tell all records apart.
ORDER = ["url_key", "date", "order_id", "payload_digest", "archive", "offset"]
INDEX = "url_key string, date string, order_id long, payload_digest string, archive string, offset long, length long"


def url_key(url: Column) -> Column:
    """The key that puts pages of a host, and hosts of a domain, side by side: com,example,www)/path?query.

    The scheme and the fragment are left out; the host is lower-cased in A-Z and its labels reversed. A text without :// is its own key, null is empty.
    """
    rest = F.regexp_extract(url, "(?s)^.*?://([^#]*)", 1)
    host = F.translate(F.regexp_extract(rest, "^([^/?]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "(?s)^[^/?]*(.*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))
    return F.coalesce(F.when(F.contains(url, F.lit("://")), key).otherwise(url), F.lit(""))


def with_types(pages: DataFrame, id_col: str, url_col: str, payload_col: str, date: Column, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, url_key, date, order_id, payload_digest, refers_to (null for responses) and payload (null for revisits)."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(date.cast("string"), F.lit("")).alias("date"), payload.alias("payload"))
    own = own.withColumn("payload_digest", F.sha2("payload", 256))
    first = own.where(F.octet_length("payload") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    own = own.join(first, "payload_digest", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first")))
    return own.select(
        "page_id", "url", url_key(F.col("url")).alias("url_key"), "date", F.coalesce("page_id", F.lit(-(2**63))).alias("order_id"), "payload_digest", "refers_to",
        F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
    )


def _one_line(value: str) -> str:
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", value)


def _record(kind: str, headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {_one_line(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _named(identifier: int | None) -> str:
    return f"<urn:page:{'' if identifier is None else identifier}>"


def page_record(page_id: int | None, url: str, date: str, digest: str, refers_to: int | None, payload: bytes | None) -> bytes:
    """The record of one page: its payload behind an HTTP header, or what it refers to."""
    headers = [("WARC-Record-ID", _named(page_id)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is None:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        return _record(RESPONSE, headers, http + payload)
    return _record(REVISIT, [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _named(refers_to))], b"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\n\r\n")


def write_archives(typed: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The rows of typed (see with_types), in order within each partition, as archives below folder; returns the INDEX rows, one sorted run for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        name, out, at = None, None, 0
        try:
            for b in batches:
                rows = []
                for page, url, date, digest, first, payload in zip(b["page_id"].astype(object), b["url"], b["date"], b["payload_digest"], b["refers_to"].astype(object), b["payload"], strict=True):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                        at = out.write(_member(_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                    known = [None if pd.isna(x) else int(x) for x in (page, first)]
                    size = out.write(_member(page_record(known[0], url, date, digest, known[1], payload)))
                    rows.append((name, at, size))
                    at += size
                yield b[["url_key", "date", "order_id", "payload_digest"]].assign(**{c: [r[i] for r in rows] for i, c in enumerate(("archive", "offset", "length"))})
        finally:
            if out is not None:
                out.close()

    # identifiers that may be null go as text: numbers with nulls would turn into floats
    texts = {c: F.col(c).cast("string") for c in ("page_id", "refers_to")}
    return typed.sortWithinPartitions("url_key", "date", "order_id", "payload_digest").withColumns(texts).mapInPandas(run, INDEX)


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def records(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a stream, one at a time."""
    start, at, data = 0, 0, b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not data:
                data = stream.read(1 << 20)
                at += len(data)
                if not data:
                    if parts:
                        raise ValueError(f"the archive ends in a record at {start}")
                    return
            parts.append(unpack.decompress(data))
            data = unpack.unused_data
        yield start, b"".join(parts)
        start = at - len(data)


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers in lower case, and block, of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = [x.partition(":") for x in head.decode().split("\r\n")[1:]]
    headers = {k.strip().lower(): v.strip() for k, _, v in lines}
    return headers, rest[: int(headers["content-length"])]


RECORDS = "archive string, offset long, page_id long, url string, date string, record_type string, refers_to long, payload_digest string, payload_bytes long"


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A row per record (RECORDS) of the archives below folder that are named by archives (archive).

    Digest and size of responses are those of the payload as read; a revisit has the digest that it names and no size.
    """

    def number(named: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", named or "")
        return int(found[1]) if found else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        columns = [c.split()[0] for c in RECORDS.split(", ")]
        for name in (n for b in batches for n in b["archive"]):
            rows = []
            with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                for offset, record in records(stream):
                    h, block = parsed(record)
                    if h["warc-type"] not in (RESPONSE, REVISIT):
                        continue
                    own = [name, offset, number(h["warc-record-id"]), h["warc-target-uri"], h["warc-date"], h["warc-type"]]
                    if h["warc-type"] == RESPONSE:
                        payload = block.partition(b"\r\n\r\n")[2]
                        own += [None, hashlib.sha256(payload).hexdigest(), len(payload)]
                    else:
                        own += [number(h["warc-refers-to"]), h["warc-payload-digest"].removeprefix("sha256:"), None]
                    rows.append(own)
                    if len(rows) >= 10_000:
                        yield _nullable(pd.DataFrame(rows, columns=columns))
                        rows = []
            yield _nullable(pd.DataFrame(rows, columns=columns))

    # names are small and archives large: a number of partitions that is given is not made smaller by their size
    names = archives.select("archive").distinct()
    return names.repartition(max(1, names.count()), "archive").mapInPandas(run, RECORDS)


def _nullable(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.astype({c: "Int64" for c in ("page_id", "refers_to", "payload_bytes")})


def with_payloads(read: DataFrame) -> DataFrame:
    """read, where revisits have the size of the payload that they refer to."""
    sizes = read.where(F.col("record_type") == RESPONSE).groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("size"))
    found = read.where(F.col("record_type") == REVISIT).join(sizes, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.col("size"))
    return read.where(F.col("record_type") == RESPONSE).unionByName(found.drop("size"))


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so that the next item costs one match a level."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self._sources = sources
        self._heads = [next(s, None) for s in sources]
        self._losers = [-1] * max(1, len(sources))
        for leaf in range(len(sources)):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._heads[a], self._heads[b]
        return y is None or (x is not None and x <= y)

    def _play(self, leaf: int) -> None:
        """Carry a leaf's head up: the smaller one goes on, the other stays at the node. While the tree is filled, the first to come to a node waits there."""
        node, winner = (leaf + len(self._sources)) // 2, leaf
        while node:
            if self._losers[node] < 0:
                self._losers[node] = winner
                return
            if self._beats(self._losers[node], winner):
                self._losers[node], winner = winner, self._losers[node]
            node //= 2
        self._losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self._sources and self._heads[top := self._losers[0]] is not None:
            yield self._heads[top]
            self._heads[top] = next(self._sources[top], None)
            self._play(top)


def slice_of_run(path: str, low: tuple | None, high: tuple | None, read_rows: int = READ_ROWS) -> Iterator[tuple]:
    """The rows of a sorted run from low on and before high, in batches; row groups that lie outside by their URL keys are not read."""
    fs, name = pafs.FileSystem.from_uri(path)
    columns = [c.split()[0] for c in INDEX.split(", ")]
    with fs.open_input_file(name) as source:
        file = pq.ParquetFile(source)
        place = file.schema_arrow.get_field_index(columns[0])
        for group in range(file.num_row_groups):
            known = file.metadata.row_group(group).column(place).statistics
            if known is not None and known.has_min_max and ((low and known.max < low[0]) or (high and known.min > high[0])):
                continue
            for batch in file.iter_batches(read_rows, row_groups=[group], columns=columns):
                for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                    if high and row >= high:
                        return
                    if not low or row >= low:
                        yield row


def merge_runs(runs: DataFrame, own: Scratch, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """INDEX rows with place: their number in the order of all captures, from 1. runs: a table kept by own, each file of which is sorted.

    The driver holds the names of the runs and the cuts of the ranges.
    """
    spark, columns = runs.sparkSession, [c.split()[0] for c in INDEX.split(", ")]
    total, files = runs.count(), sorted(runs.inputFiles())
    n = max(-(-total // range_rows), min(spark.sparkContext.defaultParallelism, -(-total // 1000)), 1)
    share = min(1.0, n * CUTS / max(1, total))
    drawn = sorted(tuple(r) for r in runs.select(*columns).sample(share, seed=1).collect())
    cuts = sorted({drawn[len(drawn) * i // n] for i in range(1, n)}) if drawn else []
    ends: list[tuple | None] = [None, *cuts, None]
    ranges = len(ends) - 1
    schema = f"{INDEX}, range int, at long"

    def merged(tasks: list[tuple[int, list[str]]], ends: list[tuple | None], name: str) -> DataFrame:
        """One task, and one sorted file, for each range and list of runs."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for r, paths in (tasks[int(i)] for b in batches for i in b["id"]):
                rows, at = [], 0
                for row in LoserTree([slice_of_run(p, ends[r], ends[r + 1]) for p in paths]):
                    rows.append((*row, r, at := at + 1))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=[*columns, "range", "at"])
                        rows = []
                yield pd.DataFrame(rows, columns=[*columns, "range", "at"])

        return own.keep(spark.range(0, len(tasks), 1, len(tasks)).mapInPandas(run, schema), name, **SMALL_GROUPS)

    while len(files) > fan_in:
        files = sorted(merged([(0, files[i : i + fan_in]) for i in range(0, len(files), fan_in)], [None, None], "longer-runs").inputFiles())
    last = merged([(r, files) for r in range(ranges)], ends, "merged")
    sizes, before = {r["range"]: r["n"] for r in last.groupBy("range").agg(F.count("*").alias("n")).collect()}, [0]
    for r in range(ranges):
        before.append(before[-1] + sizes.get(r, 0))
    starts = spark.createDataFrame([(r, before[r]) for r in range(ranges)], "range int, start long")
    return last.join(starts, "range").select(*columns, (F.col("start") + F.col("at")).alias("place"))


def archive_pages(pages: DataFrame, folder: str, date: Column, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", own: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Writes pages as archives below folder and returns their INDEX, which own keeps as runs (else it is a table in the shared folder)."""
    spark = pages.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(fs_path)
    with small_batches(spark):
        index = write_archives(with_types(pages, id_col, url_col, payload_col, date), folder)
        return own(index) if own else stored(index, "warc-runs")


def captures(pages: DataFrame, date: Column, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """A row per page, from its record as read back: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, date,
    and place, the number of the capture in the order by URL key, date and identifier.

    The result is a table in the shared folder; archives and runs are removed. To keep them, use archive_pages, read_archives and merge_runs.
    """
    with scratch(pages.sparkSession, "warc") as own:
        folder = f"{own.folder}/archives"
        runs = archive_pages(pages, folder, date, id_col, url_col, payload_col, lambda df: own.keep(df, "runs", **SMALL_GROUPS))
        read = with_payloads(own.keep(read_archives(runs, folder), "read"))
        places = merge_runs(runs, own).select("archive", "offset", "url_key", "place")
        out = read.join(places, ["archive", "offset"])
        return stored(out.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "date", "place"), "warc-result")
