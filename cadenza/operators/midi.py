"""Notes from MIDI events, and pitch-class statistics of loops from their notes."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

DRUMS = 9
BASS_BELOW = 52


def with_ticks(events: DataFrame) -> DataFrame:
    """events with the absolute tick: the running sum of delta times of a track, over events of all kinds; null beyond 63 bits."""
    track = Window.partitionBy("loop_id", "track").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("tick", F.try_sum("delta").over(track))


def paired_notes(events: DataFrame) -> DataFrame:
    """Notes of loops: each Off whose previous on/off event of the same track, channel and pitch is an On.

    note_ord is the order of ending, tracks in sequence.
    """
    ticks = with_ticks(events).where(F.col("kind").isin("on", "off") & F.col("tick").isNotNull())
    one = Window.partitionBy("loop_id", "track", "channel", "pitch").orderBy("seq")
    ticks = ticks.withColumns({"before": F.lag("kind").over(one), "start_tick": F.lag("tick").over(one)})
    notes = ticks.where("kind = 'off' and before = 'on'")
    order = Window.partitionBy("loop_id").orderBy("track", "seq")
    return notes.select("loop_id", F.row_number().over(order).cast("bigint").alias("note_ord"), "start_tick", F.col("tick").alias("end_tick"), "pitch", "channel")


def pitched(notes: DataFrame) -> DataFrame:
    return notes.where(F.col("channel") != DRUMS)


def _length() -> Column:
    return F.greatest(F.col("end_tick") - F.col("start_tick"), F.lit(1))


def statistics(notes: DataFrame) -> DataFrame:
    """Long rows (loop_id, feature, pc, value) of six statistics, 12 classes each; loops without pitched notes have none.

    duration, count, bass (duration below BASS_BELOW), first and last (notes that start at the first and last onset), lowest.
    """
    own = pitched(notes)
    loop = own.groupBy("loop_id").agg(F.min("start_tick").alias("first"), F.max("start_tick").alias("last"), F.min("pitch").alias("lowest"))
    joined = own.join(loop, "loop_id").withColumn("pc", (F.col("pitch") % 12).cast("int")).withColumn("length", _length())
    when = lambda c, x=1: F.sum(F.when(c, x).otherwise(0)).cast("double")
    sums = joined.groupBy("loop_id", "pc").agg(
        F.sum("length").cast("double").alias("duration"),
        F.count("*").cast("double").alias("count"),
        when(F.col("pitch") < BASS_BELOW, F.col("length")).alias("bass"),
        when(F.col("start_tick") == F.col("first")).alias("first"),
        when(F.col("start_tick") == F.col("last")).alias("last"),
        F.max((F.col("pitch") == F.col("lowest")).cast("double")).alias("lowest"),
    )
    return dense(loop.select("loop_id"), sums, ["duration", "count", "bass", "first", "last", "lowest"])


def dense(loops: DataFrame, sums: DataFrame, names: list[str]) -> DataFrame:
    """Long rows with a value, 0 where there is none, for each loop, feature and pitch class."""
    grid = loops.select("loop_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pc"))
    wide = grid.join(sums, ["loop_id", "pc"], "left").fillna(0.0, subset=names)
    return wide.unpivot(["loop_id", "pc"], names, "feature", "value")


def sounding(notes: DataFrame) -> DataFrame:
    """(loop_id, onset, note_ord, pitch, length): notes with start <= onset < end for each distinct onset of pitched notes.

    Onsets with nothing sounding (notes of no length) get the notes that start there. Onsets are numbered in each loop, and so
    is the last onset before each note's end; a note then meets the numbers between its own and that one. So the work is the size of the result,
    however long a note is.
    """
    own = pitched(notes).withColumn("length", _length())
    onsets = own.select("loop_id", F.col("start_tick").alias("tick")).distinct()
    ends = own.where("end_tick > start_tick").select("loop_id", F.col("end_tick").alias("tick"), F.struct("start_tick", "note_ord", "pitch", "length").alias("note"))
    marks = onsets.withColumns({"note": F.lit(None).cast(ends.schema["note"].dataType), "starts": F.lit(1)}).unionByName(ends.withColumn("starts", F.lit(0)))
    # an end comes before the onsets of its tick
    before = Window.partitionBy("loop_id").orderBy("tick", "starts").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("number", F.sum("starts").over(before))
    numbered = marks.where("starts = 1").select("loop_id", F.col("tick").alias("onset"), "number")
    until = marks.where("starts = 0").select("loop_id", F.col("note.start_tick").alias("onset"), "note.note_ord", "note.pitch", "note.length", F.col("number").alias("last"))
    over = until.join(numbered, ["loop_id", "onset"]).drop("onset").withColumn("number", F.explode(F.sequence("number", "last")))
    over = over.join(numbered, ["loop_id", "number"]).select("loop_id", "onset", "note_ord", "pitch", "length")
    # a note of some length sounds at its own onset, so only onsets of none remain
    silent = numbered.join(over.select("loop_id", "onset").distinct(), ["loop_id", "onset"], "left_anti").select("loop_id", "onset")
    there = own.select("loop_id", F.col("start_tick").alias("onset"), "note_ord", "pitch", "length").join(silent, ["loop_id", "onset"], "left_semi")
    return over.unionByName(there)


def _sweep(notes: Iterator[tuple[int, int, int, int, int]]) -> Iterator[tuple[int, int]]:
    """Pitch class and length of the lowest sounding note at each onset, from one loop's notes (start, pitch, note_ord, end, length), sorted.

    Sounding notes wait in a heap, lowest first; those that have ended leave it when they come to the top.
    """
    heap: list[tuple[int, int, int, int]] = []
    for onset, group in groupby(notes, key=lambda n: n[0]):
        starting = [(pitch, order, end, length) for _, pitch, order, end, length in group]
        for note in starting:
            if note[2] > onset:
                heappush(heap, note)
        while heap and heap[0][2] <= onset:
            heappop(heap)
        pitch, _, _, length = heap[0] if heap else starting[0]
        yield pitch % 12, length


def bass_line(notes: DataFrame) -> DataFrame:
    """Long rows of the statistic bass_line: at each onset the lowest sounding note (first of equals) counts with its length.

    The same notes as the lowest of sounding, in one pass over the notes of a loop by onset: a task holds those that sound, not all pairs of note and onset, nor the loop.
    """
    columns = ["start_tick", "pitch", "note_ord", "end_tick", "length"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((loop, note) for b in batches for loop, note in zip(b["loop_id"].tolist(), zip(*(b[c].tolist() for c in columns), strict=True), strict=True))
        out: list[tuple[int, int, float]] = []
        for loop, group in groupby(rows, key=lambda r: r[0]):
            sums = [0] * 12
            for pc, length in _sweep(note for _, note in group):
                sums[pc] += length
            out += [(loop, pc, float(v)) for pc, v in enumerate(sums)]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["loop_id", "pc", "value"])
                out = []
        yield pd.DataFrame(out, columns=["loop_id", "pc", "value"])

    own = pitched(notes).select("loop_id", *(F.col(c).cast("long").alias(c) for c in columns[:-1]), _length().cast("long").alias("length"))
    swept = own.repartition("loop_id").sortWithinPartitions("loop_id", "start_tick", "pitch", "note_ord").mapInPandas(run, "loop_id long, pc int, value double")
    return swept.select("loop_id", "pc", F.lit("bass_line").alias("feature"), "value")


def all_statistics(notes: DataFrame) -> DataFrame:
    """statistics and bass_line: the seven that keys are scored from."""
    return statistics(notes).unionByName(bass_line(notes))
