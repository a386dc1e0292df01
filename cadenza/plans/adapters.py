"""Loop-shaped tables from the driver's tables, and the registry of queries with their SQL.

The blocks of SQL run unchanged in Spark and DuckDB; {name} stands for a table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.ranges import write_path
from ..sources.shared import out_folder

LOOPS = """
SELECT CAST(p.p_partkey AS BIGINT) AS loop_id, p.p_brand AS pack,
       concat(p.p_name, ' ', CAST(p.p_partkey AS STRING), CASE WHEN p.p_partkey % 2 = 0 THEN '.caf' ELSE '.AIF' END) AS file_name,
       CASE WHEN p.p_partkey % 2 = 0 THEN 'caf' ELSE 'aiff' END AS container,
       c.name AS category,
       CASE p.p_partkey % 4 WHEN 0 THEN 'Hi-hat' WHEN 1 THEN 'Electric Piano' WHEN 2 THEN 'Kick' ELSE 'Hi-Hat' END AS subcategory,
       p.p_type AS genre,
       CAST(CASE WHEN p.p_size % 14 = 0 THEN 0 WHEN p.p_size % 14 = 13 THEN 65535 ELSE 47 + p.p_size % 14 END AS INT) AS key_midi,
       CAST(p.p_partkey % 6 AS INT) AS scale_code,
       CAST((p.p_partkey % 5) * 4 AS BIGINT) AS beat_count,
       CAST(floor(p.p_retailprice * 400) AS BIGINT) AS n_frames,
       CAST(44100 AS DOUBLE) AS sample_rate
FROM {part} p JOIN (VALUES (0,'Drums'),(1,'Bass'),(2,'Sound Effect'),(3,'Horn/Wind'),(4,'Mixed'),
                         (5,'Other Instrument'),(6,'Texture/Atmosphere'),(7,'Strings')) AS c(ix, name)
  ON p.p_partkey % 8 = c.ix
"""

LOOP_DESCRIPTORS = """
SELECT CAST(p.p_partkey AS BIGINT) AS loop_id, d.name AS descriptor
FROM {part} p CROSS JOIN (VALUES (0,'Grooving'),(1,'Part'),(2,'Single'),(3,'Melodic'),(4,'Clean'),(5,'Electric'),
  (6,'Dry'),(7,'Dark'),(8,'Vintage')) AS d(ix, name)
WHERE (p.p_partkey * 7 + d.ix * 3) % 4 = 0
"""

EDITS = """
SELECT CAST(c_custkey AS BIGINT) AS loop_id,
       CASE WHEN c_custkey % 3 = 0 THEN 'All Drums' WHEN c_custkey % 3 = 1 THEN 'FX' END AS category,
       CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS genre,
       CASE c_custkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN '' WHEN 2 THEN 'F#' END AS key_,
       CASE c_custkey % 5 WHEN 0 THEN 'Minor' WHEN 1 THEN '' WHEN 3 THEN 'Any' END AS mode_,
       CASE WHEN c_custkey % 7 = 0 THEN true END AS convert_to_one_shot
FROM {customer}
"""

MIDI_EVENTS = """
SELECT user_id AS loop_id, 0 AS track,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq,
       CAST(floor(value) AS BIGINT) AS delta,
       CAST(CASE WHEN event_id % 4 = 3 THEN 9 ELSE 0 END AS BIGINT) AS channel,
       36 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 8 AS pitch,
       CASE WHEN event_type IN ('click', 'view') THEN 'on' WHEN event_type = 'error' THEN 'other' ELSE 'off' END AS kind
FROM {events}
"""

NOTES = """
SELECT loop_id, CAST(row_number() OVER (PARTITION BY loop_id ORDER BY start_tick + dur, ok, ln, sk, price) AS BIGINT) AS note_ord,
       start_tick, start_tick + dur AS end_tick, pitch, channel
FROM (SELECT l_partkey AS loop_id, l_orderkey AS ok, l_linenumber AS ln, l_suppkey AS sk, l_extendedprice AS price,
             CAST(((l_orderkey * 7 + l_linenumber * 13) % 64) * 120 AS BIGINT) AS start_tick,
             CASE WHEN l_linenumber = 4 THEN CAST(0 AS BIGINT) ELSE CAST(l_quantity AS BIGINT) * 10 END AS dur,
             CAST(36 + (l_suppkey * 5 + l_linenumber * 7) % 48 AS BIGINT) AS pitch,
             CAST(CASE WHEN l_linenumber = 7 THEN 9 ELSE l_linenumber % 4 END AS BIGINT) AS channel
      FROM {lineitem}) t
"""

#: DuckDB only; Spark keeps the bands of a frame in an array.
FRAMES_LONG = """
SELECT loop_id, frame_ix, n_frames, band, abs(CAST(embedding[CAST((band * 5) % 64 + 1 AS INT)] AS DOUBLE)) AS mag
FROM (SELECT CAST(floor(vec_id / 10) AS BIGINT) AS loop_id, embedding,
             row_number() OVER (PARTITION BY CAST(floor(vec_id / 10) AS BIGINT) ORDER BY vec_id) - 1 AS frame_ix,
             count(*) OVER (PARTITION BY CAST(floor(vec_id / 10) AS BIGINT)) AS n_frames
      FROM {embeddings}) f CROSS JOIN (SELECT range AS band FROM range(252)) b
"""

FRAMES = """
SELECT CAST(floor(vec_id / 10) AS BIGINT) AS loop_id, CAST(row_number() OVER (PARTITION BY CAST(floor(vec_id / 10) AS BIGINT) ORDER BY vec_id) - 1 AS BIGINT) AS frame_ix,
       CAST(count(*) OVER (PARTITION BY CAST(floor(vec_id / 10) AS BIGINT)) AS BIGINT) AS n_frames,
       transform(sequence(0, 251), b -> abs(CAST(element_at(embedding, (b * 5) % 64 + 1) AS DOUBLE))) AS bands
FROM {embeddings}
"""

#: Tags as they would be on disk: shown names, key and mode texts.
DISK = """
SELECT loop_id, pack, file_name, container,
       CASE category WHEN 'Drums' THEN 'All Drums' WHEN 'Sound Effect' THEN 'FX' WHEN 'Horn/Wind' THEN 'Horn' WHEN 'Mixed' THEN 'Jingles'
         WHEN 'Other Instrument' THEN 'Other Inst' WHEN 'Texture/Atmosphere' THEN 'Textures' ELSE category END AS category,
       CASE subcategory WHEN 'Hi-hat' THEN 'Hi-Hat' WHEN 'Electric Piano' THEN 'Elec Piano' ELSE subcategory END AS subcategory,
       subcategory AS stored_subcategory, genre,
       CASE key_midi WHEN 48 THEN 'C' WHEN 49 THEN 'C#' WHEN 50 THEN 'D' WHEN 51 THEN 'D#' WHEN 52 THEN 'E' WHEN 53 THEN 'F' WHEN 54 THEN 'F#'
         WHEN 55 THEN 'G' WHEN 56 THEN 'G#' WHEN 57 THEN 'A' WHEN 58 THEN 'A#' WHEN 59 THEN 'B' ELSE '' END AS key_,
       CASE scale_code WHEN 1 THEN 'Minor' WHEN 2 THEN 'Major' WHEN 3 THEN 'Neither' WHEN 4 THEN 'Both'
         ELSE CASE WHEN key_midi BETWEEN 48 AND 59 THEN 'Any' ELSE '' END END AS mode_,
       beat_count, beat_count = 0 AS one_shot, n_frames, sample_rate
FROM {loops} l
"""

#: What stands against reading the file of a loop, in the files that files_of builds.
FAULTS = """
SELECT loop_id, CASE WHEN loop_id % 97 = 0 THEN 'unrecognized_container' WHEN loop_id % 89 = 0 THEN 'corrupt_chunk_table'
  WHEN loop_id % 83 = 0 THEN 'not_a_loop' END AS error_code FROM {loops} l
"""

BLOCKS = {"loops": LOOPS, "loop_descriptors": LOOP_DESCRIPTORS, "edits": EDITS, "midi_events": MIDI_EVENTS, "notes": NOTES, "frames_long": FRAMES_LONG, "disk": DISK, "faults": FAULTS}
DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The driver's tables and the adapters, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BLOCKS:
            return self.sql(BLOCKS[name])
        if name in DRIVER_TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", text))})

    @cached_property
    def frames(self) -> DataFrame:
        return self.sql(FRAMES)

    @cached_property
    def words(self) -> DataFrame:
        """(loop_id, descriptors): the words of each loop in order."""
        return self.loop_descriptors.groupBy("loop_id").agg(F.array_sort(F.collect_list("descriptor")).alias("descriptors"))

    @cached_property
    def paths(self) -> DataFrame:
        """(loop_id, path) of files, without their contents."""
        return self.loops.select("loop_id", path_of_loop().alias("path"))

    @cached_property
    def files(self) -> DataFrame:
        return files_of(self.dealt(self.loops), self.words)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """rows of loops, of which files are made: the table is small and the files are not, so that the number of tasks does not follow its size."""
        return rows.repartition(2 * self.spark.sparkContext.defaultParallelism, "loop_id")


def written(files: DataFrame, name: str = "library", folder: str | None = None) -> str:
    """A shared folder, new unless it is given, with a file for each row (path from the root, content); tasks write them, and a repeated task writes the same."""
    folder = folder or out_folder(files.sparkSession, name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                write_path(folder + path, bytes(content))
            yield b[["path"]]

    files.select("path", "content").mapInPandas(run, "path string").count()
    return folder


def path_in(folder: str) -> Column:
    """The part of path, as Spark lists it, below a folder."""
    return F.regexp_extract("path", re.escape(folder.rsplit("/", 1)[1]) + "(/.*)$", 1)


def duckdb_sql(text: str) -> str:
    """text with the adapters that it names (in braces) as common table expressions before it."""
    order: list[str] = []

    def need(s: str) -> None:
        for n in re.findall(r"\{(\w+)\}", s):
            if n in BLOCKS and n not in order:
                need(BLOCKS[n])
                order.append(n)

    need(text)
    fill = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    blocks = ", ".join(f"{n} AS ({fill(BLOCKS[n])})" for n in order)
    body = fill(text).strip()
    if not order:
        return body
    return f"WITH {blocks}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {blocks} {body}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Tables as a query, with the SQL for its rows."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = duckdb_sql(sql)
        return f

    return add


# Bytes of files, as column expressions.


def be(n: Column, size: int) -> Column:
    """A whole number as big-endian bytes."""
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), size * 2, "0"))


def ascii_(s: str) -> Column:
    return F.lit(s).cast("binary")


def chunk(kind: str, name: str, data: Column) -> Column:
    size = F.octet_length(data)
    body = F.concat(ascii_(name), be(size, 8 if kind == "caf" else 4), data)
    return body if kind == "caf" else F.when(size % 2 == 1, F.concat(body, F.unhex(F.lit("00")))).otherwise(body)


def when_binary(condition: Column, data: Column) -> Column:
    return F.when(condition, data).otherwise(F.lit(b""))


def slot(s: Column) -> Column:
    return F.rpad(s.cast("binary"), F.lit(50), F.lit(b"\0"))


def cstring(s: Column) -> Column:
    return F.concat(s.cast("binary"), F.lit(b"\0"))


def files_of(loops: DataFrame, words: DataFrame) -> DataFrame:
    """(loop_id, path, content): a CAF or AIFF file for each loop, some of them faulty (see FAULTS)."""
    from ..functions.vocabulary import FLATS, SCALES, mapped, note_name, reverse

    i = F.col("loop_id")
    empty = F.array().cast("array<string>")
    own = loops.join(words, "loop_id", "left").withColumn("descriptors", F.coalesce("descriptors", empty))
    name = F.when(F.col("key_midi").between(48, 59), note_name(F.col("key_midi"))).otherwise("")
    # some keys are spelt with flats
    own = own.withColumn("key_text", F.when(i % 4 == 2, mapped(name, reverse(FLATS))).otherwise(name))
    kind = F.when(F.col("scale_code") == 0, "any")
    for code, scale in SCALES.items():
        kind = kind.when(F.col("scale_code") == code, scale.lower())
    own = own.withColumn("key_type", F.coalesce(kind, F.lit("")))

    midi = F.concat(ascii_("MThd"), be(F.lit(6), 4), be(F.lit(0), 2), be(F.lit(0), 2), be(F.lit(480), 2))
    smf = F.when(i % 3 == 1, F.substring(midi, 1, 13)).otherwise(midi)
    uuid = F.unhex(F.lit("29819273b5bf4aefb78d62d1ef90bb2c"))
    pair = lambda key, value: when_binary(value != "", F.concat(cstring(F.lit(key)), cstring(value)))
    beats = F.when(F.col("beat_count") > 0, F.col("beat_count").cast("string")).otherwise("")
    texts = {"category": F.col("category"), "subcategory": F.col("subcategory"), "genre": F.col("genre"), "descriptors": F.array_join("descriptors", " ,"), "key signature": F.col("key_text"), "key type": F.col("key_type"), "beat count": beats}
    count = sum(((t != "").cast("int") for t in texts.values()), F.lit(0))
    pairs = F.concat(be(count, 4), *(pair(k, t) for k, t in texts.items()))
    desc = F.concat(F.unhex(F.lit("40E5888000000000")), ascii_("lpcm"), be(F.lit(0), 4), be(F.lit(4), 4), be(F.lit(1), 4), be(F.lit(2), 4), be(F.lit(16), 4))
    pakt = F.concat(be(F.lit(1), 8), be(F.col("n_frames"), 8), be(F.lit(0), 8))
    audio = F.rpad(F.lit(b""), (4 + 4 * (i % 50)).cast("int"), F.lit(b"\0"))
    rest_of_file = F.concat(ascii_("data"), F.unhex(F.lit("FF" * 8)), audio)
    caf = F.concat(
        ascii_("caff"), be(F.lit(1), 2), be(F.lit(0), 2), chunk("caf", "desc", desc), when_binary(i % 4 == 0, chunk("caf", "pakt", pakt)),
        when_binary((i % 12 == 0) | (i % 83 == 0), chunk("caf", "uuid", F.lpad(F.lit(b""), F.lit(20), F.lit(b"\x07")))),
        when_binary(i % 83 != 0, chunk("caf", "uuid", F.concat(uuid, pairs))),
        when_binary(i % 3 != 2, chunk("caf", "midi", smf)),
        when_binary(i % 89 == 0, F.concat(ascii_("free"), be(F.lit(1000), 8))),
        F.when(i % 8 == 2, rest_of_file).otherwise(chunk("caf", "data", audio)),
    )
    comm = F.concat(be(F.lit(2), 2), be(F.col("n_frames"), 4), be(F.lit(16), 2), F.unhex(F.lit("400EAC44000000000000")))
    cate = F.concat(be(F.lit(0), 4), slot(F.col("category")), slot(F.col("subcategory")), slot(F.col("genre")), slot(F.lit("")), be(F.lit(0), 16), be(F.size("descriptors"), 2))
    cate = F.concat(cate, F.unhex(F.array_join(F.transform("descriptors", lambda w: F.hex(slot(w))), "")))
    basc = F.concat(be(F.lit(1), 4), be(F.col("beat_count"), 4), be(F.col("key_midi"), 2), be(F.col("scale_code"), 2), be(F.lit(4), 2), be(F.lit(4), 2), F.rpad(F.lit(b""), F.lit(68), F.lit(b"\0")))
    body = F.concat(
        chunk("aiff", "NAME", ascii_("abc")), chunk("aiff", "COMM", comm), when_binary(i % 83 != 0, chunk("aiff", "cate", cate)), when_binary(i % 7 != 0, chunk("aiff", "basc", basc)),
        when_binary(i % 3 != 2, chunk("aiff", ".mid", smf)), when_binary(i % 89 == 0, F.concat(ascii_("free"), be(F.lit(1000), 4))),
    )
    own = own.withColumn("body", body)
    aiff = F.concat(ascii_("FORM"), be(F.octet_length("body") + 4, 4), F.when(i % 5 == 0, ascii_("AIFC")).otherwise(ascii_("AIFF")), F.col("body"))
    content = F.when(F.col("container") == "caf", caf).otherwise(aiff)
    own = own.withColumn("content", F.when(i % 97 == 0, F.substring(content, 1, 11)).otherwise(content))
    return own.select("loop_id", path_of_loop().alias("path"), "content")


def path_of_loop() -> Column:
    return F.concat(F.lit("/library/"), F.col("pack"), F.lit("/"), F.col("file_name"))
