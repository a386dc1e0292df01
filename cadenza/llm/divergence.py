"""How far the sources of a language diverge in their use of words, in exact integers.

Counts of a language's kept terms make a matrix with a row for each term and a one-hot column for each (source, count level): 1 where the source
has the term that often. The matrix multiplied by its transpose holds, for each pair of sources, their joint table: how many terms have one level
here and another level there. Since a term's share in a source depends on its level alone, a pair's divergence is the sum over its joint table of
cell count times the price of the two levels. The product is made in blocks of terms and of sources; prices are linear in cell counts,
so that each block is priced by itself and only a number for each pair leaves it.

Words are counted by source before anything is shuffled, in tables of bounded size. The counts of a term are kept by language and source, a third of all rows in one source being no more than a row
for each of its terms. A block holds about TERMS terms of at most 2 * SOURCES sources, all from the terms' hash, so that no language or source is
collected into one task. The output has a row for each pair of sources of a language.

Null texts, languages and sources count as empty strings. Repeated rows are documents each. Ties of value are broken by item, in order of UTF-8. Groups
without terms have the same share of every kept term; a language without kept terms has divergences of 0. An empty table gives no
rows. Only the columns named are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, scratch, small_batches, stored

#: Fixed by contract: documents of a language that a kept term is in, scale of shares, ranks of terms.
LEAST_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Terms of a block, so that its counts fit single precision exactly, and sources on each of its sides.
TERMS, SOURCES = 2048, 64
#: Distinct (source, term) entries that a task counts before it hands them on.
ENTRIES = 400_000

#: Bytes that are no part of a term become blanks, A-Z become small.
_BYTES = bytes(32 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in UTF-8, in order: runs of letters A-Z, a-z and of all characters beyond U+007F."""
    return text.encode().translate(_BYTES).split()


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = 0

    def rows() -> Iterator[pd.DataFrame]:
        for (lang, source), (n, docs) in tables.items():
            words = [*n]
            yield pd.DataFrame({"lang": lang, "source": source, "term": [None, *(w.decode() for w in words)], "n": [0, *(n[w] for w in words)], "docs": [0, *(docs[w] for w in words)]})
        tables.clear()

    for b in batches:
        for lang, source, text in zip(b["lang"], b["source"], b["text"], strict=True):
            n, docs = tables.setdefault((lang, source), (Counter(), Counter()))
            before, words = len(n), terms_of(text)
            n.update(words)
            docs.update(set(words))
            entries += len(n) - before
            if entries > ENTRIES:
                yield from rows()
                entries = 0
    yield from rows()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; the null term stands for the group itself."""
    filled = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))))
    counted = filled.mapInPandas(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), in decimals, as products may have more than 63 bits."""
    wide = lambda c: c.cast("decimal(28,0)")
    over = wide(F.lit(SCALE)) * wide(count + 2)
    return (F.lit(1) + F.call_function("div", over, wide(total + 2 * terms))).cast("long")


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def block_products(part: pd.DataFrame) -> pd.DataFrame:
    """Divergence of the pairs of sources of one block, summed over its terms.

    part: rows of one block of a language with side (0, 1 or 2 for both), source, total, terms; term is null in the row that names the source, else n is its count there.
    """
    lists = part["term"].isna()
    roster, counts = part[lists], part[~lists]
    sources, sides = roster["source"].tolist(), roster["side"].to_numpy()
    place = {s: i for i, s in enumerate(sources)}
    row, words = pd.factorize(counts["term"])
    levels = np.zeros((len(words), len(sources)), dtype=np.int64)
    levels[row, counts["source"].map(place).to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=np.int64)
    hot, shares, starts = [], [], [0]
    for i, (total, kept) in enumerate(zip(roster["total"], roster["terms"], strict=True)):
        own, at = np.unique(levels[:, i], return_inverse=True)
        one = np.zeros((len(words), len(own)), dtype=np.float32)
        one[np.arange(len(words)), at] = 1
        hot.append(one)
        shares.append(np.array([1 + SCALE * (int(c) + 2) // (int(total) + 2 * int(kept)) for c in own], dtype=np.int64))
        starts.append(starts[-1] + len(own))
    left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
    out: list[tuple[str, str, int]] = []
    wide = np.concatenate([hot[i] for i in right], axis=1) if len(right) else None
    at = np.cumsum([0, *(hot[i].shape[1] for i in right)])
    for i in left:
        joint = hot[i].T @ wide if len(words) else None  # cells of single precision are whole numbers up to the terms of a block
        for k, j in enumerate(right):
            if sides[i] != 2 or i < j:
                value = 0
                if joint is not None and shares[i].size:
                    p, q = shares[i][:, None], shares[j][None, :]
                    value = int((joint[:, at[k] : at[k + 1]].astype(np.int64) * ((p - q) * (p - q) // (p + q))).sum())
                out.append((sources[i], sources[j], value))
    return pd.DataFrame(out, columns=["source", "item", "value"])


def _blocks(source: Column, sources: Column) -> Column:
    """Pairs of blocks of sources (a <= b) that a source takes part in, with its side in each."""
    mine = F.pmod(F.xxhash64(source), sources).cast("int")
    pair = lambda b: F.struct(F.least(mine, b).alias("a"), F.greatest(mine, b).alias("b"), F.when(mine == b, 2).when(mine < b, 0).otherwise(1).alias("side"))
    return F.transform(F.sequence(F.lit(0), (sources - 1).cast("int")), pair)


def pair_rows(used: DataFrame, roster: DataFrame, languages: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of a language's sources.

    used: (lang, source, term, n) of kept terms; roster: (lang, source, total, terms); languages: (lang, term_blocks, source_blocks).
    """
    named = roster.join(languages.select("lang", "term_blocks", "source_blocks"), "lang")
    named = named.withColumn("term_block", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)))
    counted = used.join(languages.select("lang", "term_blocks", "source_blocks"), "lang").withColumn("term_block", F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int"))
    columns = ["lang", "term_block", "source_blocks", "source", "term", "n", "total", "terms"]
    long_ = lambda c: F.lit(None).cast("long").alias(c)
    rows = counted.select(*columns[:6], long_("total"), long_("terms")).unionByName(named.select(*columns[:4], F.lit(None).cast("string").alias("term"), long_("n"), *columns[6:]))
    rows = rows.withColumn("at", F.explode(_blocks(F.col("source"), F.col("source_blocks")))).select("lang", "term_block", "at.*", *columns[3:])

    def products(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return block_products(part).assign(lang=key[0])

    by_block = rows.groupBy("lang", "term_block", "a", "b").applyInPandas(products, "source string, item string, value long, lang string")
    one_way = by_block.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return one_way.select("lang", F.explode(both).alias("x"), "value").select("lang", "x.source", "x.item", "value")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _kept(docs: DataFrame, least: int, own: Scratch, **columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of kept terms (with lang_n, the language's), groups (with total, terms, lang_total), languages (with their numbers of blocks)."""
    with small_batches(docs.sparkSession):
        counts = own.keep(term_counts(docs, **columns), "counts")
    words = counts.where("term is not null")
    kept = words.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least)
    used = own.keep(words.join(kept.drop("docs"), ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "used")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    languages = used.groupBy("lang").agg(F.sum("n").alias("lang_total")).join(used.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms")), "lang")
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
    groups = own.keep(groups.fillna(0, ["total", "terms", "lang_total"]), "groups")
    blocks = lambda n, size: F.greatest(F.ceil(n / size), F.lit(1)).cast("int")
    per_language = groups.groupBy("lang").agg(F.max("terms").alias("terms"), F.count("*").alias("sources"))
    return used, groups, own.keep(per_language.select("lang", blocks(F.col("terms"), TERMS).alias("term_blocks"), blocks(F.col("sources"), SOURCES).alias("source_blocks")), "languages")


def divergences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence of each source from every other of its language (part pair), and the
    top terms that it uses more than its language does (part term).

    The result is a table in the shared folder; counts are removed.
    """
    with scratch(docs.sparkSession, "divergence") as own:
        used, groups, languages = _kept(docs, least, own, text_col=text_col, lang_col=lang_col, source_col=source_col)
        pairs = own.keep(pair_rows(used.drop("lang_n"), groups.drop("lang_total"), languages), "pairs")
        priced = used.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
        over = priced.where("p > q").select("lang", "source", "item", difference(F.col("p"), F.col("q")).alias("value"))
        return stored(_ranked(pairs, "pair").unionByName(_ranked(over, "term").where(F.col("rank") <= top)), "divergence-result")
