"""Ranking of keys, suggestions, comparison with tags, and the order of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.tags import COLLATION, natural_key
from ..sources.shared import out_folder, settled
from .scoring import key_of

UNCERTAIN_BELOW = 0.3


def ranked(candidates: DataFrame) -> DataFrame:
    """candidates (loop_id, key_ix, probability, ...) with rank 1 for the likeliest; equals by key index."""
    order = Window.partitionBy("loop_id").orderBy(F.desc("probability"), "key_ix")
    key, mode = key_of(F.col("key_ix"))
    return candidates.withColumns({"rank": F.row_number().over(order), "key": key, "mode": mode})


def suggestions(candidates: DataFrame, n: int = 3) -> DataFrame:
    """The best n of each loop, with the uncertainty flag and a label such as `C Major 61%`."""
    best = ranked(candidates).where(F.col("rank") <= n)
    percent = F.round(F.col("probability") * 100).cast("int").cast("string")
    label = F.concat(F.col("key"), F.lit(" "), F.col("mode"), F.lit(" "), percent, F.lit("%"))
    return best.withColumns({"is_uncertain": F.col("probability") < UNCERTAIN_BELOW, "label": label})


def compared(best: DataFrame, tags: DataFrame) -> DataFrame:
    """Suggestions next to tags that have a key and a mode of Major or Minor."""
    tagged = tags.where((F.col("tag_key") != "") & F.col("tag_mode").isin("Major", "Minor"))
    return best.join(tagged, "loop_id")


def agreement(compared_rows: DataFrame, by: str) -> DataFrame:
    """Shares of loops with the right tonic, tonic and mode, tonic among the three best, and the mean confidence of the best."""
    right = F.col("key") == F.col("tag_key")
    first = F.col("rank") == 1
    loop = compared_rows.groupBy(by, "loop_id").agg(
        F.max((first & right).cast("int")).alias("tonic"),
        F.max((first & right & (F.col("mode") == F.col("tag_mode"))).cast("int")).alias("both"),
        F.max(((F.col("rank") <= 3) & right).cast("int")).alias("top3"),
        F.max(F.when(first, F.col("probability"))).alias("confidence"),
    )
    return loop.groupBy(by).agg(F.count("*").alias("loops"), *(F.avg(c).alias(c) for c in ("tonic", "both", "top3", "confidence")))


def before_name(by: str) -> tuple[Column, Column]:
    """What an order of the catalogue goes by before the name: a text and a number."""
    number = {"midi": lambda: (~F.col("has_midi")).cast("long"), "bpm": lambda: F.coalesce(F.col("bpm").cast("long"), F.lit(0)), "changes": lambda: F.col("has_changes").cast("long")}
    return F.col("file_type") if by == "type" else F.lit(""), number[by]() if by in number else F.lit(0).cast("long")


def in_order(rows: DataFrame, by: str = "name", descending: bool = False, collation: str = COLLATION) -> DataFrame:
    """The catalogue by name, type, midi, bpm or changes; the name breaks every tie. Descending turns the whole list round.

    For pages: with a limit, each task keeps the first rows of its own.
    """
    keys = [*before_name(by), natural_key(F.col("file_name"), collation), F.col("file_name")]
    return rows.orderBy(*(c.desc() if descending else c.asc() for c in keys))


def _numbered(rows: DataFrame, keys: list[Column | str], folder: str) -> tuple[DataFrame, int]:
    """rows sorted over all partitions and kept below folder, with place (from 0), and how many there are.

    No task holds all rows; the driver sees one count per range. The rows are kept, so that counts and places are of the same ranges.
    """
    rows.orderBy(*keys).withColumn("at_", F.monotonically_increasing_id()).write.parquet(folder)  # the partition above 33 bits of the row's place within it
    part, kept = F.shiftright("at_", 33), rows.sparkSession.read.parquet(folder)
    before, total = {}, 0
    for r in kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        before[r.part] = total
        total += r.n
    offsets = F.create_map(*(F.lit(x) for p, n in before.items() for x in (p, n))) if before else F.create_map().cast("map<bigint,int>")
    return kept.withColumn("place", (F.element_at(offsets, part) + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint")).drop("at_"), total


def places(rows: DataFrame, orders: dict[str, bool], on: str = "loop_id", collation: str = COLLATION) -> DataFrame:
    """(by_, place, on) for each order named in orders (true: descending): the place of every row, from 0, in the whole catalogue.

    Names are compared in one sort; the other orders, all in a second one, go by the place that a name got there, a number. A list that is
    turned round has the same places from its other end. The tables between are removed.
    """
    folder = out_folder(rows.sparkSession, "order")
    facts = [F.col(c) for c in rows.columns if c in ("file_type", "has_midi", "bpm", "has_changes")]
    named, total = _numbered(rows.select(on, *facts, "file_name", natural_key(F.col("file_name"), collation).alias("key_")), ["key_", "file_name", on], f"{folder}/names")
    others = [by for by in orders if by != "name"]
    every = named.select(F.lit("name").alias("by_"), "place", on) if "name" in orders else None
    if others:
        sort_key = lambda i, by: F.struct(F.lit(i).alias("order"), F.lit(by).alias("by_"), before_name(by)[0].alias("text"), before_name(by)[1].alias("number"))
        rows_ = named.select(on, F.col("place").alias("name_place"), F.explode(F.array(*(sort_key(i, by) for i, by in enumerate(others)))).alias("k")).select(on, "name_place", "k.*")
        sorted_, _ = _numbered(rows_, ["order", "text", "number", "name_place"], f"{folder}/others")
        rest = sorted_.select("by_", (F.col("place") - F.col("order") * total).alias("place"), on)
        every = every.unionByName(rest) if every is not None else rest
    down = F.col("by_").isin([by for by, descending in orders.items() if descending])
    return settled(every.select("by_", F.when(down, total - 1 - F.col("place")).otherwise(F.col("place")).alias("place"), on), "catalogue-order", folder)
