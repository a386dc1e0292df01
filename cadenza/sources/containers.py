"""Reading CAF and AIFF containers: chunk tables, tag chunks, duration fields, embedded MIDI.

One small decoder per file, in batches; a file that cannot be read is a row with an error code, never a failed job.
File contents end here: nothing behind this step carries them through a shuffle.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import tags as t, vocabulary as v
from .ranges import Ranges, open_path

# Fixed values of the formats.
METADATA_UUID = bytes.fromhex("29819273b5bf4aefb78d62d1ef90bb2c")
SLOT = 50
CATE_LEAST = 4 + 4 * SLOT + 16 + 2
BASC_LEAST = 16
UNRECOGNISED, NOT_A_LOOP, CORRUPT = "unrecognized_container", "not_a_loop", "corrupt_chunk_table"
#: A file that is listed but cannot be opened or read.
UNREADABLE = "unreadable"

SCHEMA = """path string, container string, form_type string, error_code string, error_detail string,
chunks array<struct<id:string,header_offset:bigint,data_offset:bigint,data_length:bigint,has_pad:boolean>>,
pairs array<struct<key:string,value:string>>,
cate struct<category:string,subcategory:string,genre:string,descriptors:array<string>>,
basc struct<beat_count:bigint,key_midi:int,scale:int,numerator:int,denominator:int>,
sample_rate double, valid_frames bigint, frame_bytes bigint, audio_bytes bigint, smf binary"""


class Corrupt(ValueError):
    pass


def kind_of(b: bytes) -> tuple[str, str | None] | None:
    if len(b) < 12:
        return None
    if b[:4] == b"caff":
        return "caf", None
    if b[:4] == b"FORM" and b[8:12] in (b"AIFF", b"AIFC"):
        return "aiff", b[8:12].decode()
    return None


def chunk_table(b: bytes, kind: str) -> list[dict]:
    """Top-level chunks in order. CAF sizes have eight bytes, all ones reaching to the end; odd AIFF chunks are padded unless they end the file."""
    at, head, out = (8, 12, []) if kind == "caf" else (12, 8, [])
    while at + 8 <= len(b):
        if at + head > len(b):
            raise Corrupt(f"truncated chunk size at {at}")
        size = int.from_bytes(b[at + 4 : at + head], "big")
        start = at + head
        if kind == "caf" and size == 2**64 - 1:
            size = len(b) - start
        if start + size > len(b):
            raise Corrupt(f"chunk size {size} at {at} runs past the end")
        pad = kind == "aiff" and size % 2 == 1 and start + size < len(b)
        name = b[at : at + 4]
        out.append({"id": name.decode("ascii") if name.isascii() else "????", "header_offset": at, "data_offset": start, "data_length": size, "has_pad": pad})
        at = start + size + pad
    return out


def first(chunks: list[dict], name: str) -> dict | None:
    return next((c for c in chunks if c["id"] == name), None)


def metadata_chunk(chunks: list[dict], b: bytes) -> dict | None:
    """The first uuid chunk with the metadata marker."""
    fits = lambda c: c["id"] == "uuid" and c["data_length"] >= 16 and b[c["data_offset"] : c["data_offset"] + 16] == METADATA_UUID
    return next(filter(fits, chunks), None)


def text(raw: bytes) -> str:
    """UTF-8, or '' if it is not."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return ""


def pair_list(b: bytes, at: int) -> list[tuple[str, str]]:
    """Count, then key and value ended by zero bytes; bounded by the count and the end of the file."""
    if at + 4 > len(b):
        return []
    count, at, out = int.from_bytes(b[at : at + 4], "big"), at + 4, []
    while len(out) < count:
        middle = b.find(0, at)
        end = b.find(0, middle + 1) if middle >= 0 else -1
        if end < 0:
            break
        out.append((text(b[at:middle]), text(b[middle + 1 : end])))
        at = end + 1
    return out


def slot(raw: bytes) -> str:
    return text(raw.split(b"\0", 1)[0])


def cate_fields(b: bytes, at: int, size: int) -> dict:
    if size < CATE_LEAST:
        raise Corrupt(f"cate chunk of {size} bytes")
    names = [slot(b[at + 4 + i * SLOT : at + 4 + (i + 1) * SLOT]) for i in range(3)]
    count = int.from_bytes(b[at + CATE_LEAST - 2 : at + CATE_LEAST], "big")
    places = [at + CATE_LEAST + i * SLOT for i in range(min(count, (size - CATE_LEAST) // SLOT))]
    words = [slot(b[p : p + SLOT]) for p in places]
    return {"category": names[0], "subcategory": names[1], "genre": names[2], "descriptors": [w for w in words if w]}


def basc_fields(b: bytes, at: int, size: int) -> dict:
    if size < BASC_LEAST:
        raise Corrupt(f"basc chunk of {size} bytes")
    _, beats, key, scale, n, d = struct.unpack(">IIHHHH", b[at : at + BASC_LEAST])
    return {"beat_count": beats, "key_midi": key, "scale": scale, "numerator": n, "denominator": d}


def extended(raw: bytes) -> float:
    """80-bit extended float."""
    head, mantissa = int.from_bytes(raw[:2], "big"), int.from_bytes(raw[2:10], "big")
    exponent = head & 0x7FFF
    if not exponent and not mantissa:
        return 0.0
    try:
        return (-1.0 if head & 0x8000 else 1.0) * mantissa * 2.0 ** (exponent - 16446)
    except OverflowError:
        return float("inf")


def duration_fields(b: bytes, kind: str, chunks: list[dict]) -> dict:
    """Sample rate with either valid frames, or bytes of a frame and of audio.

    frame_bytes is the public layout's bytes per packet; channels_field (see catalogue) is read by those who want the other reading.
    """
    if kind == "aiff":
        c = first(chunks, "COMM")
        if not c or c["data_length"] < 18:
            return {}
        at = c["data_offset"]
        return {"sample_rate": extended(b[at + 8 : at + 18]), "valid_frames": int.from_bytes(b[at + 2 : at + 6], "big")}
    d = first(chunks, "desc")
    if not d or d["data_length"] < 8:
        return {}
    out, at = {"sample_rate": struct.unpack(">d", b[d["data_offset"] : d["data_offset"] + 8])[0]}, d["data_offset"]
    packets = first(chunks, "pakt")
    if packets and packets["data_length"] >= 16:
        valid = int.from_bytes(b[packets["data_offset"] + 8 : packets["data_offset"] + 16], "big")
        return out | {"valid_frames": valid if valid < 2**63 else None}
    data = first(chunks, "data")
    if d["data_length"] >= 28 and data:
        out |= {"frame_bytes": int.from_bytes(b[at + 16 : at + 20], "big"), "channels_field": int.from_bytes(b[at + 24 : at + 28], "big"), "audio_bytes": data["data_length"] - 4}
    return out


def embedded_midi(b: bytes, kind: str, chunks: list[dict]) -> bytes | None:
    c = first(chunks, "midi" if kind == "caf" else ".mid")
    if not c or c["data_length"] < 14 or b[c["data_offset"] : c["data_offset"] + 4] != b"MThd":
        return None
    return b[c["data_offset"] : c["data_offset"] + c["data_length"]]


def decode(b: bytes | Ranges, compat: bool = False) -> dict:
    """All that one file says; with compat the frame size is read where the channel count is. Of Ranges only headers and tag chunks are fetched."""
    found = kind_of(b)
    if not found:
        return {"error_code": UNRECOGNISED}
    kind, form = found
    out: dict = {"container": kind, "form_type": form}
    try:
        out["chunks"] = chunks = chunk_table(b, kind)
        if kind == "caf":
            meta = metadata_chunk(chunks, b)
            if meta:
                out["pairs"] = [{"key": k, "value": x} for k, x in pair_list(b, meta["data_offset"] + 16)]
            else:
                out["error_code"] = NOT_A_LOOP
        else:
            cate, basc = first(chunks, "cate"), first(chunks, "basc")
            if cate:
                out["cate"] = cate_fields(b, cate["data_offset"], cate["data_length"])
                if basc:
                    out["basc"] = basc_fields(b, basc["data_offset"], basc["data_length"])
            else:
                out["error_code"] = NOT_A_LOOP
        fields = duration_fields(b, kind, chunks)
        channels = fields.pop("channels_field", None)
        if compat and channels is not None:
            fields["frame_bytes"] = channels
        out |= fields
        out["smf"] = embedded_midi(b, kind, chunks)
    except Corrupt as e:
        out |= {"error_code": CORRUPT, "error_detail": str(e)}
    return out


COLUMNS = ("path", "container", "form_type", "error_code", "error_detail", "chunks", "pairs", "cate", "basc", "sample_rate", "valid_frames", "frame_bytes", "audio_bytes", "smf")


#: Bytes of an Arrow batch of file contents, and the setting's default.
BATCH_BYTES, UNBOUNDED = "67108864", "-1"


def bounded_batches(spark: SparkSession) -> None:
    """Where the session sets no bound on the bytes of Arrow batches, set one, so that contents or samples of many loops fit a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == UNBOUNDED:
        spark.conf.set(key, BATCH_BYTES)


def read_containers(files: DataFrame, compat: bool = False) -> DataFrame:
    """One row per file (path, content) with the fields of SCHEMA. Null content is unrecognised; batches are bounded."""
    bounded_batches(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _rows([{"path": p} | decode(bytes(c) if c is not None else b"", compat) for p, c in zip(b["path"], b["content"], strict=True)])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def _rows(rows: list[dict], columns: tuple[str, ...] = COLUMNS) -> pd.DataFrame:
    out = pd.DataFrame([[r.get(k) for k in columns] for r in rows], columns=columns, dtype=object)
    for c in ("valid_frames", "frame_bytes", "audio_bytes"):
        out[c] = out[c].astype("Int64")
    out["sample_rate"] = out["sample_rate"].astype(float)
    return out


#: Files whose rows are handed on together.
FILES_PER_BATCH = 256


def read_by_range(listed: DataFrame, compat: bool = False) -> DataFrame:
    """read_containers for files that are listed (path) and not read: tasks open them and fetch headers and tag chunks, so that audio stays where it is.

    The rows have bytes_read besides. A file that cannot be opened is a row too.
    """

    def read(path: str) -> dict:
        try:
            with open_path(path) as f:
                b = Ranges(f)
                return {"path": path} | decode(b, compat) | {"bytes_read": b.fetched}
        except OSError as e:
            return {"path": path, "error_code": UNREADABLE, "error_detail": str(e)[:200], "bytes_read": 0}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), FILES_PER_BATCH):
                yield _rows([read(p) for p in b["path"].iloc[at : at + FILES_PER_BATCH]], (*COLUMNS, "bytes_read"))

    return listed.select("path").mapInPandas(run, f"{SCHEMA}, bytes_read bigint")


def chunk_rows(read: DataFrame) -> DataFrame:
    """One row per top-level chunk."""
    rows = read.select("path", F.posexplode("chunks").alias("chunk_ix", "c"))
    return rows.select("path", "chunk_ix", "c.id", "c.header_offset", "c.data_offset", "c.data_length", "c.has_pad")


def pair_value(pairs, key: str):
    """The first pair's value."""
    return F.get(F.filter(pairs, lambda p: p["key"] == key), F.lit(0))["value"]


def duration(rate, valid, frame_bytes, audio_bytes):
    """Seconds from the container's own fields; null if they do not say."""
    counted = F.when((frame_bytes > 0) & (audio_bytes > 0), F.floor(audio_bytes / frame_bytes))
    return F.when(rate > 0, F.coalesce(valid, counted) / rate)


def tags(read: DataFrame) -> DataFrame:
    """The catalogue's tag table: both containers in one schema, error rows included."""
    pair = lambda key: F.coalesce(pair_value(F.col("pairs"), key), F.lit(""))
    caf = F.col("container") == "caf"
    cate = lambda f: F.coalesce(F.col("cate")[f], F.lit(""))
    stored = F.when(caf, pair("subcategory")).otherwise(cate("subcategory"))
    aiff_key = F.coalesce(v.note_name(F.col("basc.key_midi")), F.lit(""))
    key = F.when(caf, v.sharp_name(pair("key signature"))).otherwise(aiff_key)
    aiff_mode = F.when(F.col("basc").isNotNull(), v.scale_name(F.col("basc.scale"), aiff_key != "")).otherwise("")
    seconds = duration(F.col("sample_rate"), F.col("valid_frames"), F.col("frame_bytes"), F.col("audio_bytes"))
    own = read.withColumns({
        "category": v.shown_category(F.when(caf, pair("category")).otherwise(cate("category"))),
        "subcategory": v.shown_subcategory(stored),
        "stored_subcategory": stored,
        "genre": F.when(caf, pair("genre")).otherwise(cate("genre")),
        "descriptors": F.when(caf, t.split_descriptors(pair("descriptors"))).otherwise(F.coalesce(F.col("cate.descriptors"), F.array().cast("array<string>"))),
        "key": key,
        "mode": F.when(caf, v.scale_of_key_type(pair("key type"))).otherwise(aiff_mode),
        "beat_count": F.when(caf, t.beat_count(pair("beat count"))).otherwise(F.coalesce(F.col("basc.beat_count"), F.lit(0))),
        "has_midi": F.col("smf").isNotNull(),
        "duration_s": seconds,
    })
    own = own.withColumns({"is_one_shot": t.is_one_shot(F.col("beat_count")), "tempo_bpm": t.effective_tempo(F.col("beat_count"), F.col("duration_s"))})
    names = ["category", "subcategory", "stored_subcategory", "genre", "descriptors", "key", "mode", "beat_count", "is_one_shot", "has_midi", "duration_s", "tempo_bpm"]
    ok = F.col("error_code").isNull()
    return own.select("path", "container", *(F.when(ok, F.col(n)).alias(n) for n in names), "error_code", "error_detail")
