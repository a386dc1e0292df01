"""Standard MIDI files as event rows: delta times, running status, meta and system messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "loop_id bigint, track int, seq bigint, delta bigint, kind string, channel int, pitch int"


class _Bytes:
    """A place in the bytes; reading beyond either end raises IndexError."""

    def __init__(self, b: bytes, at: int):
        self.b, self.at = b, at

    def one(self) -> int:
        x = self.b[self.at]
        self.at += 1
        return x

    def number(self) -> int:
        """Seven bits a byte, highest first; the last byte has the top bit clear. Of numbers beyond 63 bits nothing is read."""
        value = 0
        while True:
            x = self.one()
            value = value << 7 | x & 0x7F
            if value >> 63:
                raise IndexError
            if x < 0x80:
                return value


def events(b: bytes) -> list[tuple] | None:
    """(track, seq, delta, kind, channel, pitch) of all events; None if any read goes past the end, a number has over 63 bits or data comes before a status.

    Any status byte replaces the running status. An unknown system status ends its track, a foreign chunk header ends the file.
    """
    if len(b) < 14 or b[:4] != b"MThd":
        return None
    at, out = 8 + int.from_bytes(b[4:8], "big"), []
    try:
        for track in range(int.from_bytes(b[10:12], "big")):
            if at + 8 > len(b) or b[at : at + 4] != b"MTrk":
                break
            end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "big")
            r, status, seq = _Bytes(b, at + 8), None, 0
            while r.at < end:
                delta = r.number()
                if b[r.at] & 0x80:
                    status = r.one()
                elif status is None:
                    return None
                kind, channel, pitch = "other", status & 0x0F, None
                match status & 0xF0:
                    case 0x80 | 0x90 as high:
                        pitch, velocity = r.one(), r.one()
                        kind = "on" if high == 0x90 and velocity else "off"
                    case 0xA0 | 0xB0 | 0xE0:
                        r.at += 2
                    case 0xC0 | 0xD0:
                        r.at += 1
                    case _ if status in (0xFF, 0xF0, 0xF7):
                        r.at += status == 0xFF
                        length = r.number()
                        r.at += length
                    case _:
                        break
                out.append((track, seq, delta, kind, channel, pitch))
                seq += 1
            at = end
    except IndexError:
        return None
    return out


def midi_events(loops: DataFrame) -> DataFrame:
    """Event rows from (loop_id, smf); loops whose bytes are malformed or null have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["loop_id", "track", "seq", "delta", "kind", "channel", "pitch"]
        for b in batches:
            rows = [(i, *e) for i, s in zip(b["loop_id"], b["smf"], strict=True) for e in (events(bytes(s)) if s is not None else None) or ()]
            out = pd.DataFrame(rows, columns=names)
            out["pitch"] = out["pitch"].astype("Int64")
            yield out

    return loops.select("loop_id", "smf").mapInPandas(run, SCHEMA)
