"""Benchmark decontamination by a BM25 index of the test items.

The test items are indexed by word, with BM25 contributions divided by the item's score for itself,
so that one threshold THETA holds for items of all lengths. Every training text is cut into
overlapping passages, long enough that each item fits into one, and each passage is a query. Items are indexed
by classes of length, so that a long item does not make the passages of short ones long.

Retrieval returns every item at or above THETA, by block-max WAND: lists sorted by item, upper bounds
per list and per block of items decide which items need a full score. A bound that is cheaper to
compute comes first, for all passages of a batch at once: an item's heaviest words, without which it cannot pass half of THETA, must
bring the rest themselves. It never drops an item that would reach THETA.

A retrieved item counts if its question and its answer are both there: the share of their word
trigrams found in the passage must reach OVERLAP. An item that is one text counts by the share of the whole of it.

Items are broadcast in shards of at most about SHARD_CHARS characters, one after the other: with several shards the documents
are scanned as often, and stored between the scans, so that driver and workers hold one shard at a time. Statistics (number of items, mean length,
document frequencies) are those of all items. Items of fewer than MIN_WORDS words say too little for a score; they count
where their exact sequence of words occurs, with score 1. Items without words are never found. Null and empty texts hold no item, an empty table of items is
found nowhere. Repeated rows are treated alike; a column of the result's name is replaced.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from .common import free_name, stored, text_batches

WORD = regex.compile(r"\w+")
K1, B = 1.2, 0.75
THETA = 0.6
OVERLAP = 0.7
MIN_WORDS = 5
BLOCK = 64
#: Items whose lengths in words have the same power of this share an index.
LENGTH_CLASS = 8
SHARD_CHARS = 16_000_000
FOUND = "array<struct<item_id:bigint,score:double,question:double,answer:double>>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def trigrams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(3, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def share(part: list[str], passage: list[str]) -> float:
    """Share of the part's trigrams that the passage holds."""
    own = trigrams(part)
    if not own:
        return 1.0
    n = len(next(iter(own)))
    there = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
    return len(own & there) / len(own)


@dataclass
class Statistics:
    items: int
    mean_length: float
    #: word -> number of items, for the words of the shard
    frequency: dict[str, int]


@dataclass
class Index:
    """The inverted index of items of one class of length."""

    ids: list[int] = field(default_factory=list)
    parts: list[tuple[list[str], list[str]]] = field(default_factory=list)
    stride: int = 1

    @classmethod
    def build(cls, items: list[tuple[int, str, str]], stats: Statistics) -> Index:
        self = cls()
        rows, self.terms = [], {}
        for item, question, answer in items:
            q, a = words_of(question), words_of(answer)
            words = q if question == answer else q + a
            length = K1 * (1 - B + B * len(words) / stats.mean_length)
            own = {t: math.log(1 + (stats.items - (n := stats.frequency[t]) + 0.5) / (n + 0.5)) * c * (K1 + 1) / (c + length) for t, c in Counter(words).items()}
            total = sum(own.values())
            rows += [(self.terms.setdefault(t, len(self.terms)), len(self.ids), x / total) for t, x in own.items()]
            self.ids.append(item)
            self.parts.append((q, a))
            self.stride = max(self.stride, len(words))
        if not rows:
            return self
        rows.sort()
        table = pd.DataFrame(rows, columns=["term", "item", "x"])
        at = np.searchsorted(table["term"], np.arange(len(self.terms) + 1))
        #: per term: items in order, contributions, list bound, block bounds
        self.lists = []
        for t in range(len(self.terms)):
            items_, x = table["item"].to_numpy()[at[t] : at[t + 1]], table["x"].to_numpy()[at[t] : at[t + 1]]
            blocks = [float(x[i : i + BLOCK].max()) for i in range(0, len(x), BLOCK)]
            self.lists.append((items_.tolist(), x.tolist(), float(x.max()), blocks))
        self._bound(table)
        return self

    def _bound(self, table: pd.DataFrame) -> None:
        """Heavy words of each item: all but the lightest, which together stay below half of THETA."""
        light = table.sort_values(["item", "x"])
        running = light.groupby("item")["x"].cumsum()
        heavy = light[running >= THETA / 2].sort_values(["term", "item"])
        self.light = np.zeros(len(self.ids))
        np.maximum.at(self.light, light["item"].to_numpy(), np.where(running < THETA / 2, running, 0))
        self.heavy_at = np.searchsorted(heavy["term"], np.arange(len(self.terms) + 1))
        self.heavy_items, self.heavy_x = heavy["item"].to_numpy(), heavy["x"].to_numpy()

    def passages(self, texts: list[list[str]]) -> list[tuple[int, int]]:
        """(text, passage) of those that the first bound lets through; passage k has the words from k to k + 2 strides."""
        if not self.ids:
            return []
        get = self.terms.get
        ids = np.array([get(w, -1) for ws in texts for w in ws], dtype=np.int64)
        sizes = np.array([len(ws) for ws in texts], dtype=np.int64)
        n_blocks = -(-sizes // self.stride) + 1  # one empty block between texts
        base = np.cumsum(n_blocks) - n_blocks
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(ids)) - np.repeat(starts, sizes)
        block = np.repeat(base, sizes) + place // self.stride
        lengths = np.diff(self.heavy_at)
        keep = ids >= 0
        ids, block = ids[keep], block[keep]
        keep = lengths[ids] > 0
        once = np.unique(block[keep] * len(self.terms) + ids[keep])
        if not len(once):
            return []
        block, ids = once // len(self.terms), once % len(self.terms)
        n = lengths[ids]
        at = np.repeat(self.heavy_at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key, where = np.unique(np.repeat(block, n) * len(self.ids) + self.heavy_items[at], return_inverse=True)
        x = np.bincount(where, weights=self.heavy_x[at])
        first = np.unique(np.r_[key, key - len(self.ids)])  # a passage has this block and the next
        bound = self.light[first % len(self.ids)] + 1e-9
        for k in (first, first + len(self.ids)):
            i = np.minimum(np.searchsorted(key, k), len(key) - 1)
            bound += np.where(key[i] == k, x[i], 0)
        first = first[(bound >= THETA) & (first >= 0)]
        passes = np.unique(first // len(self.ids))
        text = np.searchsorted(base, passes, side="right") - 1
        return [(int(t), int(b - base[t])) for t, b in zip(text, passes, strict=True)]

    def search(self, words: list[str]) -> list[tuple[int, float]]:
        """All items whose score for these words is at least THETA, by block-max WAND."""
        lists = [self.lists[t] for t in sorted({self.terms[w] for w in words if w in self.terms})]
        at, live, found = [0] * len(lists), [*range(len(lists))], []
        while live:
            live.sort(key=lambda k: lists[k][0][at[k]])
            bound, pivot = 0.0, -1
            for p, k in enumerate(live):
                bound += lists[k][2]
                if bound >= THETA - 1e-9:
                    pivot = p
                    break
            if pivot < 0:
                break
            item = lists[live[pivot]][0][at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][at[live[pivot + 1]]] == item:
                pivot += 1
            ahead, blocks, ends = live[: pivot + 1], 0.0, []
            for k in ahead:
                j = bisect_left(lists[k][0], item, at[k]) // BLOCK
                if j < len(lists[k][3]):
                    blocks += lists[k][3][j]
                    ends.append(lists[k][0][min((j + 1) * BLOCK, len(lists[k][0])) - 1] + 1)
            if blocks < THETA - 1e-9:  # no item up to the nearest end of these blocks can pass
                target = min(ends, default=item + 1)
                if pivot + 1 < len(live):
                    target = min(target, lists[live[pivot + 1]][0][at[live[pivot + 1]]])
                target = max(target, item + 1)
            elif lists[live[0]][0][at[live[0]]] == item:
                score = sum(lists[k][1][at[k]] for k in ahead)
                if score >= THETA - 1e-9:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            for k in ahead:
                at[k] = bisect_left(lists[k][0], target, at[k])
            live = [k for k in live if at[k] < len(lists[k][0])]
        return found

    def matches(self, split: list[list[str]]) -> list[dict[int, tuple[float, float, float]]]:
        """For the words of each text the items found in it: identifier -> best score, shares of question and answer."""
        out: list[dict] = [{} for _ in split]
        for t, k in self.passages(split):
            passage = split[t][k * self.stride : (k + 2) * self.stride]
            for item, score in self.search(passage):
                question, answer = (share(p, passage) for p in self.parts[item])
                if question >= OVERLAP and answer >= OVERLAP:
                    out[t][self.ids[item]] = max(out[t].get(self.ids[item], (0.0, 0.0, 0.0)), (score, question, answer))
        return out


class Phrases:
    """Items of few words, found as they stand."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.by_first: dict[str, list[tuple[int, list[str]]]] = {}
        for item, words in items:
            self.by_first.setdefault(words[0], []).append((item, words))

    def matches(self, split: list[list[str]]) -> list[dict[int, tuple[float, float, float]]]:
        out, get = [], self.by_first.get
        for words in split:
            out.append({item: (1.0, 1.0, 1.0) for i, w in enumerate(words) for item, own in get(w, ()) if words[i : i + len(own)] == own})
        return out


def item_words(question: str, answer: str) -> list[str]:
    return words_of(question) if question == answer else words_of(question) + words_of(answer)


class Shard:
    """The indexes of one shard of items: one for each class of length, and the phrases."""

    def __init__(self, items: list[tuple[int, str, str]], stats: Statistics):
        classes: dict[int, list] = {}
        short = []
        for item, question, answer in items:
            words = item_words(question, answer)
            if len(words) >= MIN_WORDS:
                classes.setdefault(int(math.log(len(words), LENGTH_CLASS)), []).append((item, question, answer))
            elif words:
                short.append((item, words))
        self.indexes = [Index.build(own, stats) for _, own in sorted(classes.items())] + [Phrases(short)] * bool(short)

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, float, float, float]]]:
        """For each text the items found in it: identifier, best score, shares of question and answer."""
        split = [words_of(t) for t in texts]
        out: list[dict] = [{} for _ in texts]
        for index in self.indexes:
            for whole, found in zip(out, index.matches(split), strict=True):
                for item, x in found.items():
                    whole[item] = max(whole.get(item, (0.0, 0.0, 0.0)), x)
        return [[(i, *x) for i, x in sorted(o.items())] for o in out]


_built: dict[str, Shard] = {}


def _index(key: str, shard) -> Shard:
    """This worker's indexes of a broadcast shard."""
    if key not in _built:
        _built.clear()
        _built[key] = Shard(*shard.value)
    return _built[key]


def _shards(items: DataFrame) -> Iterator[tuple[list, Statistics]]:
    """Items and statistics of each shard, one at a time; items has item_id, question, answer, no nulls."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [w for q, a in zip(b["question"], b["answer"], strict=True) if (w := item_words(q, a))]
            yield pd.DataFrame([(t, 1, 0) for w in words for t in set(w)] + [("", 1, len(w)) for w in words], columns=["term", "n", "length"])

    counts = stored(items.mapInPandas(count, "term string, n long, length long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")), "bm25-counts")
    whole = counts.where("term = ''").first()
    if whole is None:
        return
    chars = items.agg(F.sum(F.length("question") + F.length("answer")).alias("n")).first().n or 0
    shards = -(-chars // SHARD_CHARS) or 1
    for k in range(shards):
        own = items.where(F.pmod(F.xxhash64("item_id", "question"), F.lit(shards)) == k).orderBy("item_id", "question", "answer")
        rows = [(r.item_id, r.question, r.answer) for r in own.collect()]
        if rows:
            terms = sorted({w for _, q, a in rows for w in item_words(q, a)})
            wanted = counts.join(items.sparkSession.createDataFrame([(t,) for t in terms], "term string"), "term") if shards > 1 else counts.where("term != ''")
            yield rows, Statistics(whole.n, whole.length / whole.n, {r.term: r.n for r in wanted.collect()})


def _scanner(spark, shard: tuple[list, Statistics]):
    """A column function that searches texts for the items of one shard, and the broadcast."""
    shared, key = spark.sparkContext.broadcast(shard), uuid.uuid4().hex

    @F.pandas_udf(FOUND)
    def scan(texts: pd.Series) -> pd.Series:
        names = ("item_id", "score", "question", "answer")
        return pd.Series([[dict(zip(names, m, strict=True)) for m in row] for row in _index(key, shared).matches(texts.tolist())])

    return scan, shared


def find_items(docs: DataFrame, items: DataFrame, text_col: str = "text", found: str = "found", item_id: str = "item_id", item_text: str = "text", question: str | None = None, answer: str | None = None) -> DataFrame:
    """docs with an array of the items found in each whole text (item_id, score, question, answer), by item_id.

    question and answer name columns of items; without them item_text as a whole is both.
    """
    spark = docs.sparkSession
    text_batches(spark)
    if question is None or answer is None:
        whole = F.coalesce(F.col(item_text), F.lit(""))
        own = items.select(F.col(item_id).cast("long").alias("item_id"), whole.alias("question"), whole.alias("answer"))
    else:
        own = items.select(F.col(item_id).cast("long").alias("item_id"), *(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((question, "question"), (answer, "answer"))))
    own = stored(own.where("item_id is not null"), "bm25-items")
    out, before = docs, None
    for shard in _shards(own):
        scan, shared = _scanner(spark, shard)
        if before is not None:  # the scan before is done before the next shard is there
            out = stored(out, "bm25-scanned")
            before.unpersist()
        first = before is None
        out = out.withColumn(found, scan(F.col(text_col)) if first else F.array_sort(F.concat(F.col(found), scan(F.col(text_col)))))
        before = shared
    return out if before is not None else docs.withColumn(found, F.expr(f"cast(array() as {FOUND})"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs in which no item is found."""
    found = free_name(docs, "found")
    return find_items(docs, items, text_col, found).where(F.size(found) == 0).drop(found)
