"""Column functions on file names, tempo, descriptor lists and list order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLANKS = r"[\t\p{Zs}]+"
EXTENSIONS = ("caf", "aif", "aiff")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def file_type(path: Column) -> Column:
    """Extension in capitals."""
    return F.upper(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def is_loop_path(path: Column, depth: int = 0) -> Column:
    """A file with one of the extensions, in any case, that is not hidden and lies in no hidden folder.

    The first depth parts of the path lead to the library and may be hidden.
    """
    below = F.slice(F.split(path, "/"), F.lit(depth + 1), F.size(F.split(path, "/")))
    return F.lower(file_type(path)).isin(*EXTENSIONS) & ~F.exists(below, lambda part: part.startswith("."))


def is_one_shot(beats: Column) -> Column:
    return beats == 0


def beat_count(text: Column) -> Column:
    """Integer of a text of sign and digits only; else 0."""
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint")), F.lit(0).cast("bigint"))


def tempo(beats: Column, seconds: Column) -> Column:
    """Beats a minute, rounded half away from zero, 0 to 999; null without beats or duration."""
    return F.when((beats > 0) & (seconds > 0), F.least(F.greatest(F.round(beats * 60 / seconds), F.lit(0)), F.lit(999)).cast("int"))


def effective_tempo(beats: Column, seconds: Column) -> Column:
    return F.when(~is_one_shot(beats), tempo(beats, seconds))


def tempo_label(bpm: Column) -> Column:
    return F.lpad(F.coalesce(bpm, F.lit(0)).cast("string"), 3, "0")


def split_descriptors(text: Column) -> Column:
    """Parts between commas, trimmed, without empty ones."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.regexp_replace(x, f"^{BLANKS}|{BLANKS}$", ""))
    return F.filter(trimmed, lambda x: x != "")


def join_descriptors(words: Column, separator: str = ", ") -> Column:
    return F.array_join(words, separator)


#: The order of names where no language is named: the Unicode collation algorithm's own.
COLLATION = "UNICODE"


def natural_key(name: Column, collation: str = COLLATION) -> Column:
    """Sorts names as a file browser does: digit runs by value, the rest by a collation, which looks at letters first, then at accents, then at case.

    The collation is one of Spark's (UNICODE, or that of a language such as de or sv). A digit run is written with its number of digits before it, so that the
    collation compares runs by value.
    """
    parts = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    number = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    ranked = lambda n: F.concat(F.lpad(F.length(n).cast("string"), 10, "0"), n)  # a run with more digits comes later
    return F.collate(F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), ranked(number(x))).otherwise(x)), ""), collation)
