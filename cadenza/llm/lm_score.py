"""Masked pseudo-likelihood by a bidirectional window network.

Every word of a document is predicted from the WINDOW words before it and the WINDOW after it; the sum
of the log conditional probabilities scores the document.

    h = tanh(T1[word two before] + T2[word before] + T3[word after] + T4[word two after])
    P(word | context) = product over the nodes on the word's way through a binary tree of sigmoid(+-(V[node] . h + c[node]))

The leaves of the tree are the WORDS most frequent words of all documents and one leaf for all other words; it is a
Huffman tree of their counts, so that frequent words have short ways. A word of the last leaf is spelled:
its letters and its end have the shares that they have in all such words of the corpus, and letters that
never occur share what one new letter would get. So the probabilities of all words in a context sum to one.

Training masks every position of every document once: each of ROUNDS rounds takes every ROUNDS-th one. Documents are dealt
to shards of about SHARD positions, by hash, and sorted in them; each shard trains from the same weights by mini-batches (AdaGrad, numpy);
the weights are then averaged in Spark, by number of positions. Shards depend on the documents alone, so that scores do not
depend on partitions or cores (but for the last digits). Work and what is gathered grow with the corpus, and the driver holds one
set of weights, the most frequent words and at most one count for each code point.

Null and empty texts have no words and score 0 with a null mean. Repeated rows are scored alike; rows without
identifier that are equal share a shard. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, repeat
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, scratch, stored, text_batches

WORD = re.compile(r"\w+|[^\w\s]")
#: The same for small letters of ASCII, where it is quicker.
ASCII_WORD = re.compile(r"[a-z0-9_]+|[\x00-\x08\x0e-\x1b!-/:-@\[-^`{-\x7f]")
WORDS = 8192
WINDOW = 2
WIDTH = 8
ROUNDS = 2
RATE = 0.1
BATCH = 8192
#: Nodes with most below them, which are the last of a tree: half of all steps are on these, and they are taken as matrix products.
HEAD = 16
#: Positions of a shard.
SHARD = 4_000_000
#: Groups in which shards' weights are added first.
SALTS = 64
PARTS = 8
CACHE_WORDS = 400_000
#: Positions whose steps are held at a time: few enough that the arrays stay in cache and the allocator gives no pages back.
CHUNK = 1 << 12
#: Positions of documents that are laid out at a time for training.
BLOCK = 1 << 20
CODE_POINTS = 0x110000


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    return (ASCII_WORD if low.isascii() else WORD).findall(low)


class Spelling:
    """Probabilities of words that have no leaf, letter by letter."""

    def __init__(self, letters: dict[str, int], words: int, top: list[str]):
        """Counts of letters in words without leaf, number of such words, the words with one."""
        new = max(1, len(letters))
        whole = sum(letters.values()) + words + 1 + new
        self.letters = {c: log(n / whole) for c, n in letters.items()}
        self.end = log((words + 1) / whole)
        self.other = log(new / whole / (CODE_POINTS - len(letters)))
        #: Nothing and the words that have a leaf are never spelled.
        self.rest = log(1 - np.exp(self.end) - sum(np.exp(self.plain(w)) for w in top))
        #: The same by code point, with one entry more for all beyond the last known one; made where it is used.
        self.table = None

    def plain(self, word: str) -> float:
        get, other = self.letters.get, self.other
        return sum(get(c, other) for c in word) + self.end

    def log_p(self, word: str) -> float:
        return self.plain(word) - self.rest

    def total(self, words: list[str]) -> float:
        """Sum of log_p over these words."""
        if self.table is None:
            last = max(map(ord, self.letters), default=0)
            self.table = np.array([self.letters.get(chr(c), self.other) for c in range(last + 1)] + [self.other])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        return float(self.table.take(codes, mode="clip").sum()) + len(words) * (self.end - self.rest)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}


@dataclass
class Tree:
    """Ways from the root to the leaves: those of leaf k are places at[k] to at[k + 1] of nodes and bits."""

    at: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    #: Share of the occurrences below a node that go to bit 1, as log odds.
    odds: np.ndarray

    @classmethod
    def of(cls, counts: list[int]) -> Tree:
        """Huffman's tree of at least two leaves; each count is at least one."""
        heap = [(n, k) for k, n in enumerate(counts)]
        heapq.heapify(heap)
        leaves, up = len(counts), {}
        odds = []
        while len(heap) > 1:
            (m, a), (n, b) = heapq.heappop(heap), heapq.heappop(heap)
            node = len(odds)
            odds.append(log(n / m))
            up[a], up[b] = (node, 0), (node, 1)
            heapq.heappush(heap, (m + n, leaves + node))
        ways = []
        for k in range(leaves):
            way, x = [], k
            while x in up:
                node, bit = up[x]
                way.append((node, bit))
                x = leaves + node
            ways.append(way[::-1])
        flat = [x for w in ways for x in w]
        return cls(np.concatenate([[0], np.cumsum([len(w) for w in ways])]), np.array([n for n, _ in flat]), np.array([b for _, b in flat], dtype=np.float32), np.array(odds, dtype=np.float32))

    def __post_init__(self):
        self.signs = self.low = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"signs": None, "low": None}

    def head(self) -> np.ndarray:
        """Row by leaf: 1 for each node of the head on its way that it leaves by bit 0, -1 by bit 1, 0 for the others. Made where it is used."""
        size = min(HEAD, len(self.odds))
        if self.signs is None or self.signs.shape[1] != size:
            first, leaf = len(self.odds) - size, np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
            high = self.nodes >= first
            self.signs = np.zeros((len(self.at) - 1, size), np.float32)
            self.signs[leaf[high], self.nodes[high] - first] = 1 - 2 * self.bits[high]
            # nodes have less below them the further they are on a way, so that the head is the first part of each
            self.low = self.at[:-1] + np.bincount(leaf[high], minlength=len(self.signs))
        return self.signs

    def places(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the ways of these leaves below the head, one after the other, and which of the leaves each is for."""
        self.head()
        low = self.low.take(leaves)
        n = self.at.take(leaves + 1) - low
        return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(np.arange(len(leaves)), n)


@dataclass
class Vocabulary:
    top: list[str]
    tree: Tree
    spelling: Spelling

    def __post_init__(self):
        self.leaf = {w: i for i, w in enumerate(self.top)}
        #: Leaf of words that are spelled, and the entry beyond the ends of a text.
        self.rare, self.edge = len(self.top), len(self.top) + 1

    def encode(self, text: str | None) -> tuple[np.ndarray, float]:
        """Leaves of a whole text's words, and the log probability of spelling those that have none."""
        words = words_of(text)
        leaves = np.fromiter(map(self.leaf.get, words, repeat(self.rare)), dtype="<u2", count=len(words))
        return leaves, self.spelling.total(list(compress(words, (leaves == self.rare).tobytes())))


@dataclass
class Steps:
    """Steps of the ways of some leaves. wrong: log odds of the bit that a way does not take."""

    #: Row by leaf, column by node of the head: signs, 0 for nodes that are on no way of the leaf.
    head_signs: np.ndarray
    head_wrong: np.ndarray
    #: All steps below the head: sign, log odds, node, number of the leaf, the node's vector and the leaf's hidden layer.
    signs: np.ndarray
    wrong: np.ndarray
    nodes: np.ndarray
    row: np.ndarray
    own: np.ndarray
    long: np.ndarray


@dataclass
class Network:
    T: np.ndarray
    V: np.ndarray
    c: np.ndarray

    @classmethod
    def new(cls, tree: Tree, entries: int, seed: int = 1) -> Network:
        """Without training it gives each word its share of the corpus."""
        r = np.random.default_rng(seed)
        return cls((r.standard_normal((2 * WINDOW, entries, WIDTH)) * 0.3).astype(np.float32), np.zeros((len(tree.odds), WIDTH), np.float32), tree.odds.copy())

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in vars(self).values()])

    def filled(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for x in vars(self).values():
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Network(*out)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        return np.tanh(sum(self.T[k].take(context[:, k], axis=0) for k in range(2 * WINDOW)))

    def steps(self, tree: Tree, h: np.ndarray, target: np.ndarray) -> Steps:
        head_signs = tree.head().take(target, axis=0)
        first = len(self.V) - head_signs.shape[1]
        at, row = tree.places(target)
        nodes, signs = tree.nodes.take(at), 1 - 2 * tree.bits.take(at)
        own, long = self.V.take(nodes, axis=0), h.take(row, axis=0)
        z = (own * long) @ np.ones(WIDTH, np.float32) + self.c.take(nodes)
        clipped = [np.clip(x, -30, 30, out=x) for x in (head_signs * (h @ self.V[first:].T + self.c[first:]), signs * z)]
        return Steps(head_signs, clipped[0], signs, clipped[1], nodes, row, own, long)

    def log_p(self, tree: Tree, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probabilities of target leaves, row by row."""
        s = self.steps(tree, self.hidden(context), target)
        head = np.log1p(np.exp(s.head_wrong)) * np.abs(s.head_signs)
        return -(head @ np.ones(head.shape[1], np.float32) + np.bincount(s.row, weights=np.log1p(np.exp(s.wrong)), minlength=len(target)))

    def learn(self, tree: Tree, context: np.ndarray, target: np.ndarray, squares: Network) -> None:
        """One mini-batch of AdaGrad on the sum of negative log probabilities."""
        h = self.hidden(context)
        first = len(self.V) - tree.head().shape[1]
        dV, dc, dh = np.zeros((WIDTH, len(self.V))), np.zeros(len(self.c)), np.empty((WIDTH, len(target)))
        for i in range(0, len(target), CHUNK):
            here = slice(i, i + CHUNK)
            s = self.steps(tree, h[here], target[here])
            g = s.head_signs / (1 + np.exp(-s.head_wrong))
            dc[first:] += np.ones(len(g), np.float32) @ g
            dh[:, here] = (g @ self.V[first:]).T
            dV[:, first:] += (g.T @ h[here]).T
            weight = (s.signs / (1 + np.exp(-s.wrong))).astype(np.float64)
            dc += np.bincount(s.nodes, weights=weight, minlength=len(dc))
            for j in range(WIDTH):
                dh[j, here] += np.bincount(s.row, weights=s.own[:, j] * weight, minlength=len(g))
                dV[j] += np.bincount(s.nodes, weights=s.long[:, j] * weight, minlength=len(self.V))
        dh *= (1 - h * h).T
        self._step(self.V, squares.V, dV.T.astype(np.float32, order="C"))
        self._step(self.c, squares.c, dc.astype(np.float32))
        for k in range(2 * WINDOW):
            entries, d = np.ascontiguousarray(context[:, k]), np.empty_like(self.T[k])
            for j in range(WIDTH):
                d[:, j] = np.bincount(entries, weights=dh[j], minlength=len(d))
            self._step(self.T[k], squares.T[k], d)

    @staticmethod
    def _step(x: np.ndarray, squares: np.ndarray, d: np.ndarray) -> None:
        """Entries whose gradient is nought stay."""
        squares += d * d
        d *= RATE
        d /= np.sqrt(squares)
        x -= d


def laid_out(docs: list[np.ndarray], edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents in one row with gaps of edges between them; where each position is in it, and the sizes of the documents."""
    gap = np.full(WINDOW, edge, dtype=np.int64)
    row = np.concatenate([gap, *(x for d in docs for x in (d, gap))])
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    gaps = WINDOW * np.arange(1, len(docs) + 1)
    return row, np.repeat(gaps, sizes) + np.arange(sizes.sum()), sizes


def contexts(row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The entries around the given positions of a row."""
    return np.stack([row.take(at + k) for k in range(-WINDOW, WINDOW + 1) if k]).T


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of all words of all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for t in b["t"]:
                seen.update(words_of(t))
            if len(seen) > CACHE_WORDS:
                yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                seen = Counter()
        if seen:
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    return docs.select(F.col(text_col).alias("t")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _size_class(n: Column) -> Column:
    return F.floor(F.log2(n) * 16).cast("int")


def vocabulary(counts: DataFrame, own: Scratch) -> Vocabulary:
    """From the counts of all words. The most frequent ones are sought among those of sufficient size only; ties in order of the words."""
    sizes = {r.c: r.k for r in counts.groupBy(_size_class(F.col("n")).alias("c")).agg(F.count("*").alias("k")).collect()}
    least, there = max(sizes, default=0), 0
    for c in sorted(sizes, reverse=True):
        least, there = c, there + sizes[c]
        if there >= WORDS:
            break
    top = own.keep(counts.where(_size_class(F.col("n")) >= least).orderBy(F.desc("n"), "word").limit(WORDS), "words")
    rows = sorted(top.collect(), key=lambda r: (-r.n, r.word))
    others = counts.join(F.broadcast(top.select("word")), "word", "left_anti")  # at most WORDS words
    rare = others.agg(F.sum("n").alias("n")).first().n or 0
    letters = others.select(F.explode(F.split("word", "")).alias("c"), "n").where("c != ''").groupBy("c").agg(F.sum("n").alias("n")).collect()
    names = [r.word for r in rows]
    return Vocabulary(names, Tree.of([*(r.n for r in rows), rare + 1, *[1] * (not rows)]), Spelling({r.c: r.n for r in letters}, rare, names))


def encoded(docs: DataFrame, words: Vocabulary, id_col: str, text_col: str, own: Scratch) -> DataFrame:
    """id, leaves of the text's words as little-endian unsigned 16-bit integers, and the log probability of its spelled words."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("ids binary, spelled double")
    def encode(texts: pd.Series) -> pd.DataFrame:
        rows = [shared.value.encode(t) for t in texts]
        return pd.DataFrame({"ids": pd.Series([x.tobytes() for x, _ in rows], dtype=object), "spelled": pd.Series([float(s) for _, s in rows], dtype=float)})

    return own.keep(docs.select(F.col(id_col).alias("id"), encode(F.col(text_col)).alias("x")).select("id", "x.ids", "x.spelled"), "ids")


def train_on(docs: list[np.ndarray], net: Network, words: Vocabulary, turn: int, rounds: int) -> int:
    """Train net on every rounds-th position of the documents; the number of positions."""
    squares = net.filled(np.ones(net.flat().size, dtype=np.float32))
    c, t, seen = np.zeros((0, 2 * WINDOW), dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    for block in blocks(docs):
        row, at, sizes = laid_out(block, words.edge)
        within = np.arange(len(at)) - np.repeat(np.cumsum(sizes), sizes)  # from the end of its document
        at = at[(within - turn) % rounds == 0]
        seen += len(at)
        for some in (at[i : i + BLOCK] for i in range(0, len(at), BLOCK)):
            c, t = np.concatenate([c.T, contexts(row, some).T], axis=1).T, np.concatenate([t, row.take(some)])
            whole = len(t) // BATCH * BATCH
            for i in range(0, whole, BATCH):
                net.learn(words.tree, c[i : i + BATCH], t[i : i + BATCH], squares)
            c, t = c[whole:], t[whole:]
    if len(t):
        net.learn(words.tree, c, t, squares)
    return seen


def blocks(docs: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The documents in their order, about BLOCK positions at a time."""
    block, n = [], 0
    for d in docs:
        block.append(d)
        n += len(d)
        if n >= BLOCK:
            yield block
            block, n = [], 0
    if block:
        yield block


def _trainer(shared, turn: int, rounds: int):
    """A grouped function that trains the broadcast network on one shard."""

    def local(g: pd.DataFrame) -> pd.DataFrame:
        start, words = shared.value
        own = start.filled(start.flat())
        docs = [np.frombuffer(x, dtype="<u2").astype(np.int64) for x in g.sort_values(["id", "ids"])["ids"]]
        seen = train_on(docs, own, words, turn, rounds)
        return pd.DataFrame({"part": range(PARTS), "order": int(g["shard"].iloc[0]), "weights": np.array_split(own.flat().astype(np.float64) * seen, PARTS), "n": seen})

    return local


def train(ids: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> Network:
    """Rounds of local training and averaging over all documents."""
    spark, net = ids.sparkSession, Network.new(words.tree, words.edge + 1)
    whole = ids.agg(F.sum(F.octet_length("ids") / 2).alias("n")).first().n or 0
    shards = int(-(-whole // SHARD)) or 1
    dealt = ids.where(F.octet_length("ids") > 0).select(F.pmod(F.xxhash64("id", "ids"), F.lit(shards)).cast("int").alias("shard"), "id", "ids")

    def add(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("order")
        return pd.DataFrame({"part": g["part"].iloc[:1], "order": g["order"].iloc[:1], "weights": [np.sum(np.stack(g["weights"]), axis=0)], "n": [g["n"].sum()]})

    schema = "part int, order int, weights array<double>, n long"
    for turn in range(rounds):
        local = _trainer(spark.sparkContext.broadcast((net, words)), turn, rounds)
        # sums of sums, so that no group takes the weights of more than a SALTS-th of the shards
        some = dealt.groupBy("shard").applyInPandas(local, schema).withColumn("salt", F.col("order") % SALTS)
        rows = some.groupBy("part", "salt").applyInPandas(add, schema).groupBy("part").applyInPandas(add, schema).orderBy("part").collect()
        if rows and rows[0].n:
            net = net.filled(np.concatenate([r.weights for r in rows]) / rows[0].n)
    return net


def batch_scores(docs: list[np.ndarray], net: Network, words: Vocabulary) -> np.ndarray:
    """Sums of log P(leaf | context) of documents, whose positions go through the network together."""
    row, at, sizes = laid_out(docs, words.edge)
    each = np.zeros(len(at))
    for i in range(0, len(at), CHUNK):
        here = at[i : i + CHUNK]
        each[i : i + CHUNK] = net.log_p(words.tree, contexts(row, here), row.take(here))
    sums = np.concatenate([[0.0], np.cumsum(each)])
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its identifier, n_words, log_likelihood, and mean_log_likelihood (null without words).

    The result is a table in the shared folder; all others are removed.
    """
    spark = docs.sparkSession
    text_batches(spark)
    with scratch(spark, "lm-score") as own:
        words = vocabulary(own.keep(word_counts(docs, text_col), "word-counts"), own)
        ids = encoded(docs, words, id_col, text_col, own)
        shared = spark.sparkContext.broadcast((train(ids, words), words))

        @F.pandas_udf("double")
        def score(raws: pd.Series) -> pd.Series:
            return pd.Series(batch_scores([np.frombuffer(r, dtype="<u2").astype(np.int64) for r in raws], *shared.value))

        n = (F.octet_length("ids") / 2).cast("long")
        out = ids.select(F.col("id").alias(id_col), n.alias("n_words"), (score("ids") + F.col("spelled")).alias("log_likelihood"))
        mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
        return stored(out.withColumn("mean_log_likelihood", mean), "lm-score-result")
