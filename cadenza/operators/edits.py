"""Edits of tags: staging for a selection, sparse edits, what remains after saving, and outcomes.

In tables of edits a null field is untouched and '' clears.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocabulary as v

FIELDS = ("category", "subcategory", "genre", "key", "mode")
NONE, MULTIPLE = "(None)", "(Multiple)"


def apply_sparse(tags: DataFrame, edits: DataFrame, on: str, fields: tuple[str, ...]) -> DataFrame:
    """tags with the fields that an edit names replaced."""
    own = edits.select(on, *(F.col(f).alias(f"edit_{f}") for f in fields))
    joined = tags.join(own, on, "left")
    return joined.withColumns({f: F.coalesce(f"edit_{f}", f) for f in fields}).drop(*(f"edit_{f}" for f in fields))


def chosen(rows: DataFrame, selection: DataFrame, on: str) -> DataFrame:
    return rows.join(selection.select(on), on, "left_semi")


def without_chosen(rows: DataFrame, selection: DataFrame, on: str) -> DataFrame:
    return rows.join(selection.select(on), on, "left_anti")


def common_value(value: str, several: str | None = MULTIPLE) -> Column:
    """The value that all rows of a group have, else `several`; '' counts as no value: (None), or null where `several` is null."""
    none = F.lit(NONE) if several is not None else F.lit(None).cast("string")
    filled = F.coalesce(F.col(value).cast("string"), F.lit(""))
    same = F.min(filled) == F.max(filled)
    only = F.min(filled)
    return F.when(same, F.when(only == "", none).otherwise(only)).otherwise(F.lit(several).cast("string"))


def common_flag(value: str) -> Column:
    return F.when(F.min(F.col(value)) == F.max(F.col(value)), F.min(F.col(value)))


def word_mask(words: Column) -> Column:
    """The vocabulary's words in an array, as bits: one for each of the 18."""
    return sum((F.when(F.array_contains(words, w), 1 << i).otherwise(0) for i, w in enumerate(v.DESCRIPTORS)), F.lit(0)).cast("bigint")


def words_of(mask: Column) -> Column:
    """The vocabulary's words of a mask, in their own order."""
    return F.filter(F.array(*(F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, w) for i, w in enumerate(v.DESCRIPTORS))), lambda w: w.isNotNull())


def extra_words(words: Column) -> Column:
    """Words outside the vocabulary, each once, sorted."""
    return F.array_sort(F.array_except(words, F.array(*map(F.lit, v.DESCRIPTORS))))


def _no_words() -> Column:
    return F.array().cast("array<string>")


def shared_descriptors(loops: DataFrame, group: str, words: str = "descriptors") -> DataFrame:
    """(group, shared): the words that every loop of a group has, sorted; loops has one row a loop, null words being none.

    Words of the vocabulary are bits that bit_and keeps, so that a group is one number in each task. Of other words those of the loop that has fewest can be shared;
    where there are any, a second pass finds those that some loop lacks, as bits too.
    """
    own = loops.select(group, F.coalesce(F.col(words), _no_words()).alias("w")).select(group, word_mask(F.col("w")).alias("mask"), extra_words(F.col("w")).alias("extras"))
    fewest = F.min_by("extras", F.struct(F.size("extras"), "extras"))
    groups = own.groupBy(group).agg(F.bit_and("mask").alias("mask"), fewest.alias("candidates"))
    # a bit for each candidate, as many numbers as they need
    lacks = lambda at: F.aggregate(F.slice("candidates", at * 62 + 1, 62), F.struct(F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("bits")), lambda acc, w: F.struct((acc["i"] + 1).alias("i"), F.when(F.array_contains("extras", w), acc["bits"]).otherwise(acc["bits"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), acc["i"]))).alias("bits")), lambda acc: acc["bits"])
    open_ = groups.where(F.size("candidates") > 0).select(F.col(group).alias("g_"), "candidates")
    checked = own.join(open_, F.col(group) == F.col("g_")).select(group, "extras", "candidates", F.explode(F.sequence(F.lit(0), F.floor((F.size("candidates") - 1) / 62).cast("int"))).alias("at"))
    lacking = checked.select(group, "at", F.slice("candidates", F.col("at") * 62 + 1, F.lit(62)).alias("part"), lacks(F.col("at")).alias("bits")).groupBy(group, "at", "part").agg(F.bit_or("bits").alias("bits"))
    left = F.transform(F.filter(F.transform("part", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), x["i"])) == 0), lambda x: x["w"])
    extras = lacking.select(F.col(group).alias("g_"), left.alias("left")).groupBy("g_").agg(F.flatten(F.collect_list("left")).alias("left"))
    both = groups.join(extras, F.col(group) == F.col("g_"), "left")
    return both.select(group, F.array_sort(F.concat(words_of(F.col("mask")), F.coalesce("left", _no_words()))).alias("shared"))


def same_words(a: Column, b: Column) -> Column:
    """Whether two arrays have the same words, whatever their order: equal masks and equal extras."""
    return word_mask(a).eqNullSafe(word_mask(b)) & extra_words(a).eqNullSafe(extra_words(b))


def is_canonical(stored: Column) -> Column:
    """Whether a stored subcategory is the name that its label would be stored under."""
    return v.stored_subcategory(v.shown_subcategory(stored)).eqNullSafe(stored)


def field_changes(disk: str = "disk", pending: str = "pending") -> dict[str, Column]:
    """For each field, whether the pending value differs from that on disk. Both are structs."""
    d, p = F.col(disk), F.col(pending)
    out = {f: ~p[f].eqNullSafe(d[f]) for f in ("category", "genre", "key", "mode", "one_shot")}
    repicked = p["subcategory_picked"] & ~is_canonical(d["stored_subcategory"])
    out["subcategory"] = ~p["subcategory"].eqNullSafe(d["subcategory"]) | F.coalesce(repicked, F.lit(False))
    out["descriptors"] = ~same_words(p["descriptors"], d["descriptors"])
    return out


def sparse_edit(changes: dict[str, Column], pending: str = "pending") -> Column:
    """The edit that takes the file to its pending values: a struct of seven fields, null where nothing differs. Descriptors are in their stored order."""
    p = F.col(pending)
    value = {f: p[f] for f in changes} | {"descriptors": descriptor_order(p["descriptors"])}
    return F.struct(*(F.when(changes[f], value[f]).alias(f) for f in changes))


def any_change(changes: dict[str, Column]) -> Column:
    out = F.lit(False)
    for c in changes.values():
        out = out | c
    return out


def descriptor_order(words: Column) -> Column:
    """Vocabulary words in their own order, then others sorted."""
    return F.concat(words_of(word_mask(words)), extra_words(words))


def set_unless_one_shot(selected: Column, one_shot: Column, value: Column, old: Column) -> Column:
    """Bulk choice of key or scale: one-shots stay, (None) clears, (Multiple) changes nothing."""
    new = F.when(value == NONE, "").otherwise(value)
    return F.when(selected & ~one_shot & (value != MULTIPLE), new).otherwise(old)


def set_value(selected: Column, value: Column, old: Column) -> Column:
    return F.when(selected & (value != MULTIPLE), F.when(value == NONE, "").otherwise(value)).otherwise(old)


def toggle_descriptor(selected: Column, words: Column, word: Column, add: Column) -> Column:
    return F.when(selected & add, F.array_union(words, F.array(word))).when(selected, F.array_remove(words, word)).otherwise(words)


def to_one_shot(selected: Column, on_disk: Column, choice: Column, disk_value: Column, value: Column) -> Column:
    """Key or scale after a bulk choice of one-shot (true) or its undoing (false); files that are one-shots on disk stay."""
    return F.when(selected & ~on_disk & choice, "").when(selected & ~on_disk, disk_value).otherwise(value)


def _cut49(text: Column) -> Column:
    """What a 50-byte slot gives back: at most 49 bytes; '' if a character is split."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, 49)
    whole = F.when(F.is_valid_utf8(cut.cast("string")), cut.cast("string")).otherwise("")
    return F.when(text.isNotNull(), whole)


def after_saving(container: Column, old: dict[str, Column], edit: dict[str, Column]) -> dict[str, Column]:
    """Tags that a file gives when it is read again after an edit; both dicts have FIELDS, old also beat_count, edit also one_shot."""
    caf, one_shot = container == "caf", F.coalesce(edit["one_shot"], F.lit(False))
    out = {}
    for f in ("category", "subcategory", "genre"):
        new = F.when(caf, edit[f]).otherwise(_cut49(edit[f]))
        out[f] = F.coalesce(new, old[f])
    key_caf = F.coalesce(v.sharp_name(edit["key"]), old["key"])
    key_aiff = F.coalesce(F.when(edit["key"].isin(v.NOTE_NAMES), edit["key"]).when(edit["key"].isNotNull(), ""), old["key"])
    out["key"] = F.when(one_shot, "").otherwise(F.when(caf, key_caf).otherwise(key_aiff))
    mode_caf = F.coalesce(v.scale_of_key_type(edit["mode"]), F.when(edit["mode"].isNotNull(), F.lit("")), old["mode"])
    code = F.when(edit["mode"].isNotNull(), v.scale_code(edit["mode"])).otherwise(v.scale_code(old["mode"]))
    mode_aiff = v.scale_name(code, out["key"] != "")
    mode_caf = F.when(edit["mode"].isNull(), old["mode"]).otherwise(mode_caf)
    out["mode"] = F.when(one_shot, "").otherwise(F.when(caf, mode_caf).otherwise(mode_aiff))
    out["beat_count"] = F.when(one_shot, F.lit(0)).otherwise(old["beat_count"]).cast("bigint")
    return out


def outcome(container: Column, has_basc: Column, error: Column, edit: dict[str, Column]) -> Column:
    """saved, no-op, or failed with the reason."""
    empty = F.lit(True)
    for c in edit.values():
        empty = empty & c.isNull()
    needs = edit["key"].isNotNull() | edit["mode"].isNotNull() | F.coalesce(edit["one_shot"], F.lit(False))
    return (
        F.when(empty, "no-op")
        .when(error.isNotNull(), F.concat(F.lit("failed: "), error))
        .when((container == "aiff") & ~has_basc & needs, "failed: key_edit_requires_basc")
        .otherwise("saved")
    )


def cancel(pending: DataFrame, selection: DataFrame, on: str) -> DataFrame:
    """Pending edits that remain when those of the selection are dropped."""
    return without_chosen(pending, selection, on)
