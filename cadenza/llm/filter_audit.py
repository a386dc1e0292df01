"""What filters of documents do to each other, in every order in which they can be applied.

Each filter has a relation of the documents that fail it: one id table a filter, stored once. What a filter removes
after a prefix of others are the rows of its relation that are in none of theirs (left-anti joins), what it fails in vain are
those that are in one (left-semi joins). What a prefix leaves does not depend on its order, so that a row of a relation
carries the sets of earlier filters that leave it to its own one (removed) and those that do not (redundant). One step per filter splits the
rows by a semi and an anti join with that filter's ids, and doubles the sets. All orders are read off these. Labels are lost by
the removed rows that a semi join with the labelled ids keeps.

Texts are read once, and only identifiers, hashes and parts are shuffled, by identifier; all counts are combined before
their shuffle, so that a part that holds a third of all rows costs one row a task. The join that finds texts that occurred before
is one that Spark can split where a text is a third of all rows.

Null texts count as empty, null parts as the empty string. Rows count each, repeated ones too: rows that share an identifier are told apart by a hash of their text. A text is
identical to an earlier one if a row with a smaller identifier has it; a null identifier is neither smaller nor larger than another.
A label counts once, however often its row is repeated. An empty table gives no rows. Only the columns named are read.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, scratch, stored

BLANK = "[\\x20\\x09-\\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Failure conditions on a text with its words: fixed by contract. REPEATED is found by a join.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 50,
    "B": lambda text, words: F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
    "C": lambda text, words: (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) * 100 > F.length(text) * 5,
    "D": lambda text, words: F.length(F.translate(text, "#$%&*|", "")) < F.length(text),
}
REPEATED = "E"

#: What tells rows apart in relations.
KEY = ["doc", "text_key"]


def judged(docs: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per document: its KEY, part, digest of the text, failed (array of filter names)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    own = own.withColumn("words", F.filter(F.split("text", BLANK), lambda w: w != ""))
    fails = F.array_compact(F.array(*(F.when(f(F.col("text"), F.col("words")), F.lit(n)) for n, f in filters.items())))
    return own.select("doc", F.xxhash64("text").alias("text_key"), "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), fails.alias("failed"))


def with_repeats(rows: DataFrame, name: str = REPEATED) -> DataFrame:
    """rows, where those whose text a smaller identifier has fail the filter of that name too."""
    first = rows.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    failed = F.when(F.col("doc") > F.col("first"), F.array_append("failed", F.lit(name))).otherwise(F.col("failed"))
    return rows.join(first, "digest", "left").withColumn("failed", failed).drop("first")


def failing_ids(rows: DataFrame, names: str, own: Scratch) -> dict[str, DataFrame]:
    """The relation of each filter: KEY, part of the documents that fail it, kept as a table each."""
    every = own.keep(rows.select(*KEY, "part", F.explode("failed").alias("filter")), "failing", by="filter")
    return {n: every.where(F.col("filter") == n) for n in names}


def _step(rows: DataFrame, name: str, bit: int, ids: DataFrame) -> DataFrame:
    """rows after the sets have been doubled by those with one more filter; its own rows stay as they are."""
    ids, mine = ids.select(*(F.col(k).alias(f"its_{k}") for k in KEY)), F.col("filter") == name
    same = F.col("doc").eqNullSafe(F.col("its_doc")) & (F.col("text_key") == F.col("its_text_key"))
    more = lambda *sets: F.transform(F.concat(*sets), lambda s: s.bitwiseOR(F.lit(bit)))
    grown = lambda old, new: F.when(mine, F.col(old)).otherwise(F.concat(old, new)).alias(old)
    rest = [*KEY, "part", "filter"]
    there = rows.join(ids, same, "left_semi").select(*rest, "removed", grown("redundant", more("removed", "redundant")))
    not_there = rows.join(ids, same, "left_anti").select(*rest, grown("removed", more("removed")), grown("redundant", more("redundant")))
    return there.unionByName(not_there)


def prefixes(relations: dict[str, DataFrame], own: Scratch) -> DataFrame:
    """Every row of the relations with removed and redundant: sets of other filters as numbers, with the bit of the filter at a place."""
    sets = {"removed": F.array(F.lit(0)), "redundant": F.array().cast("array<int>")}
    rows = None
    for name, ids in relations.items():
        mine = ids.select(*KEY, "part", F.lit(name).alias("filter")).withColumns(sets)
        rows = mine if rows is None else rows.unionByName(mine)
    for place, (name, ids) in enumerate(relations.items()):
        rows = own.keep(_step(rows, name, 1 << place, ids), f"after-{name}")
    return rows


def _counts(rows: DataFrame, **columns: Column) -> DataFrame:
    """Counts by part, filter and set of earlier filters; equal arrays of sets are counted before they are exploded."""
    sums = rows.groupBy("part", "filter", "removed", "redundant").agg(F.count("*").alias("n"))
    one = lambda sets, kind: F.transform(sets, lambda s: F.struct(s.alias("earlier"), F.lit(kind).alias("kind")))
    each = sums.select("part", "filter", "n", F.explode(F.concat(one("removed", True), one("redundant", False))).alias("s"))
    return each.select("part", "filter", "s.earlier", *(F.when(F.col("s.kind") == kind, F.col("n")).otherwise(0).alias(c) for c, kind in columns.items()))


def interactions(rows: DataFrame, labels: DataFrame, names: str, own: Scratch) -> DataFrame:
    """Counts by part, filter, earlier: removed, redundant, good_lost, toxic_lost. Combinations that nothing falls under are left out."""
    sets = prefixes(failing_ids(rows, names, own), own)
    labelled = lambda c: sets.join(labels.where(F.col(c) == 1).select(F.col("doc_id").cast("long").alias("doc")), "doc", "left_semi")
    parts = [_counts(sets, removed=True, redundant=False), _counts(labelled("quality"), good_lost=True), _counts(labelled("toxic"), toxic_lost=True)]
    every = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return every.groupBy("part", "filter", "earlier").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("removed", "redundant", "good_lost", "toxic_lost")))


def _places(names: str) -> Column:
    """All orders step by step, as an array of a fixed size: 5 * 120 for five filters."""
    bit = {n: 1 << i for i, n in enumerate(names)}
    steps = [{"filter_order": "".join(o), "step": k + 1, "filter": o[k], "earlier": sum(bit[n] for n in o[:k])} for o in permutations(names) for k in range(len(o))]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,filter:string,earlier:int>>")


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step, with the counts of the step's filter.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: documents kept after the step, removed by it, failing its filter but removed earlier, failing
    its filter only, removed with quality 1 and with toxic 1, and removed by the filter summed over all orders. labels has doc_id, quality, toxic.
    The filters are those given and REPEATED. The result is a table in the shared folder; relations are removed.
    """
    names = "".join(filters) + REPEATED
    with scratch(docs.sparkSession, "filter-audit") as own:
        rows = own.keep(with_repeats(own.keep(judged(docs, filters, id_col, text_col, part_col), "judged")), "rows")
        counts = own.keep(interactions(rows, labels, names, own), "counts")
        last = len(names) - 1
        orders = sum((F.when(F.bit_count("earlier") == k, factorial(k) * factorial(last - k)).otherwise(0) for k in range(len(names))), F.lit(0))
        alone = counts.groupBy("part", "filter").agg(F.sum(F.when(F.bit_count("earlier") == last, F.col("removed")).otherwise(0)).alias("unique_fails"), F.sum(F.col("removed") * orders).alias("shapley"))
        grid = rows.groupBy("part").agg(F.count("*").alias("documents")).select("part", "documents", F.explode(_places(names)).alias("s")).select("part", "documents", "s.*")
        every = grid.join(counts, ["part", "filter", "earlier"], "left").join(alone, ["part", "filter"], "left")
        every = every.fillna(0, ["removed", "redundant", "good_lost", "toxic_lost", "unique_fails", "shapley"])
        # the steps of one order, five rows, are summed up in one array
        wanted = ["step", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        orders_ = every.groupBy("part", "documents", "filter_order").agg(F.array_sort(F.collect_list(F.struct(*wanted))).alias("steps"))
        upto = lambda s: F.aggregate(F.filter("steps", lambda x: x["step"] <= s["step"]), F.lit(0).cast("long"), lambda acc, x: acc + x["removed"])
        with_kept = F.transform("steps", lambda s: F.struct(s["step"].alias("step"), (F.col("documents") - upto(s)).alias("kept"), *(s[c].alias(c) for c in wanted[1:])))
        return stored(orders_.select("part", "filter_order", F.explode(with_kept).alias("s")).select("part", "filter_order", "s.*"), "filter-audit-result")
