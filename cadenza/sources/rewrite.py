"""New file bytes for edits, as a table. Spark cannot write binary files back; the table is the result.

rewrite_paths takes edits by path and opens those files only; rewrite takes contents that are there already.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import vocabulary as v
from . import containers as c
from .ranges import read_path

NEEDS_BASC = "key_edit_requires_basc"
SCHEMA = "path string, new_content binary, error_code string"
FIELDS = ("category", "subcategory", "genre", "descriptors", "key", "mode", "one_shot")


def set_pair(pairs: list[tuple[str, str]], key: str, value: str | None) -> list[tuple[str, str]]:
    """Replace the first pair of that key or add one; an empty value removes them all."""
    if not value:
        return [p for p in pairs if p[0] != key]
    at = next((i for i, p in enumerate(pairs) if p[0] == key), None)
    return [*pairs, (key, value)] if at is None else [*pairs[:at], (key, value), *pairs[at + 1 :]]


def spliced(b: bytes, kind: str, chunk: dict, payload: bytes) -> bytes:
    """The file with one chunk's data replaced; AIFF's total size follows."""
    size = struct.pack(">Q" if kind == "caf" else ">I", len(payload))
    pad = b"\0" if kind == "aiff" and len(payload) % 2 else b""
    new = b[chunk["header_offset"] : chunk["header_offset"] + 4] + size + payload + pad
    end = chunk["data_offset"] + chunk["data_length"] + chunk["has_pad"]
    out = b[: chunk["header_offset"]] + new + b[end:]
    if kind == "aiff":
        grown = len(new) - (end - chunk["header_offset"])
        out = out[:4] + struct.pack(">I", (int.from_bytes(b[4:8], "big") + grown) % 2**32) + out[8:]
    return out


def _caf(b: bytes, edit: dict) -> bytes:
    chunk = c.metadata_chunk(c.chunk_table(b, "caf"), b)
    if not chunk:
        raise LookupError(c.NOT_A_LOOP)
    pairs = c.pair_list(b, chunk["data_offset"] + 16)
    stored = {"category": v.STORED_CATEGORIES, "subcategory": v.STORED_SUBCATEGORIES}
    for field in ("category", "subcategory", "genre"):
        if edit[field] is not None:
            pairs = set_pair(pairs, field, stored.get(field, {}).get(edit[field], edit[field]))
    if edit["descriptors"] is not None:
        pairs = set_pair(pairs, "descriptors", ",".join(edit["descriptors"]))
    if edit["key"] is not None:
        pairs = set_pair(pairs, "key signature", edit["key"])
    if edit["mode"] is not None:
        pairs = set_pair(pairs, "key type", edit["mode"].lower())
    if edit["one_shot"]:
        for key in ("beat count", "key signature", "key type"):
            pairs = set_pair(pairs, key, None)
    strings = b"".join(s.encode() + b"\0" for pair in pairs for s in pair)
    return spliced(b, "caf", chunk, c.METADATA_UUID + struct.pack(">I", len(pairs)) + strings)


def _slot(s: str) -> bytes:
    return s.encode()[: c.SLOT - 1].ljust(c.SLOT, b"\0")


def _aiff(b: bytes, edit: dict) -> bytes:
    chunks = c.chunk_table(b, "aiff")
    cate, basc = c.first(chunks, "cate"), c.first(chunks, "basc")
    if not cate:
        raise LookupError(c.NOT_A_LOOP)
    if edit["key"] is not None or edit["mode"] is not None or edit["one_shot"]:
        if not basc:
            raise LookupError(NEEDS_BASC)
        at = basc["data_offset"]
        c.basc_fields(b, at, basc["data_length"])
        head = [*struct.unpack(">IIHHHH", b[at : at + c.BASC_LEAST])]
        if edit["key"] is not None:
            head[2] = 48 + v.NOTE_NAMES.index(edit["key"]) if edit["key"] in v.NOTE_NAMES else 0
        if edit["mode"] is not None:
            head[3] = {s.lower(): n for n, s in v.SCALES.items()}.get(edit["mode"].lower(), 0)
        if edit["one_shot"]:
            head[1:] = 0, v.NO_KEY, 0, 0, 0
        b = b[:at] + struct.pack(">IIHHHH", *head) + b[at + c.BASC_LEAST :]
    if any(edit[f] is not None for f in ("category", "subcategory", "genre", "descriptors")):
        at = cate["data_offset"]
        old = c.cate_fields(b, at, cate["data_length"])
        slots = [_slot(slot_text) for slot_text in (old["category"], old["subcategory"], old["genre"])]
        stored = [v.STORED_CATEGORIES, v.STORED_SUBCATEGORIES, {}]
        for i, field in enumerate(("category", "subcategory", "genre")):
            if edit[field] is not None:
                slots[i] = _slot(stored[i].get(edit[field], edit[field]))
        words = old["descriptors"] if edit["descriptors"] is None else edit["descriptors"]
        kept = b[at + 4 + 3 * c.SLOT : at + c.CATE_LEAST - 2]
        payload = b[at : at + 4] + b"".join(slots) + kept + struct.pack(">H", len(words)) + b"".join(map(_slot, words))
        b = spliced(b, "aiff", cate, payload)
    return b


def rewritten(b: bytes, edit: dict) -> bytes:
    """The bytes of one edited file; LookupError or Corrupt name what stands against it."""
    found = c.kind_of(b)
    if not found:
        raise LookupError(c.UNRECOGNISED)
    return (_caf if found[0] == "caf" else _aiff)(b, edit)


def _row(path: str, content: bytes, r: dict) -> tuple[str, bytes | None, str | None]:
    edit = {f: None if r[f] is None or isinstance(r[f], float) else r[f] for f in FIELDS}
    edit["descriptors"] = None if edit["descriptors"] is None else list(edit["descriptors"])
    try:
        return path, rewritten(content, edit), None
    except LookupError as e:
        return path, None, str(e.args[0])
    except c.Corrupt:
        return path, None, c.CORRUPT


def rewrite(files: DataFrame) -> DataFrame:
    """(path, new_content, error_code) from rows of path, content and the edit's FIELDS (null: untouched)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_row(r["path"], bytes(r["content"] or b""), r) for r in batch.to_dict("records")]
            yield pd.DataFrame(rows, columns=["path", "new_content", "error_code"], dtype=object)

    return files.select("path", "content", *FIELDS).mapInPandas(run, SCHEMA)


#: Bytes of new contents that a task hands on at a time, unless one file alone has more.
CONTENT_BYTES = 64 << 20


def rewrite_paths(edits: DataFrame, content_bytes: int = CONTENT_BYTES) -> DataFrame:
    """(path, new_content, error_code) from rows of path and the edit's FIELDS: the task that has an edit opens its file, and no other file is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=["path", "new_content", "error_code"], dtype=object)
        for batch in batches:
            rows, size = [], 0
            for r in batch.to_dict("records"):
                try:
                    rows.append(_row(r["path"], read_path(r["path"]), r))
                except OSError:
                    rows.append((r["path"], None, c.UNREADABLE))
                size += len(rows[-1][1] or b"")
                if size >= content_bytes:
                    yield frame(rows)
                    rows, size = [], 0
            yield frame(rows)

    return edits.select("path", *FIELDS).mapInPandas(run, SCHEMA)
