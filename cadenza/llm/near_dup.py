"""Near-duplicate groups by bottom-k sketches of word shingles.

One hash function maps each distinct shingle of a document to a number; the SKETCH smallest are its
sketch. Documents with equal shingle sets form a class, which is one node from then on, so that
thousands of exact copies cost one. Equal are sets of equal 63-bit digests, sizes and second digests; sets that only the first
digest takes for equal get nodes of their own. The first INDEX values of each class's sketch go into inverted lists.

Candidates: in each list the members meet one of them, the pivot. That makes as many pairs as
members. Pairs that pass the union-sketch estimate are compared on their full shingle sets, and the links
that hold are joined to components. In short lists that still have several components, members of different ones are
paired, estimated and compared likewise.

Which values stand for a class: the rarest ones of which a document as similar as THRESHOLD must share one (one more
than it may lack); if so many have short lists, all of these. This loses a link only if sampling goes wrong by over five
standard deviations; sets up to INDEX shingles are exact. So classes stay in long lists only if much of them is popular.
Those of lists that still have several components go on with their full sets, without sampling:

- a shingle is popular if over SHORT of these classes have it. Order all shingles by rarity: if the rarest one that two linked
  classes share is not popular, both have it among their first few, and short lists bring them together;
- else all that they share is popular, and whether they are linked depends on their popular shingles and sizes alone. Classes
  with equal popular shingles are one group. Its smallest class stands for it: whoever is linked with a larger one is linked with this one. A
  class that is too large to be linked with it is a satellite, linked with another group's smallest class if one is close enough;
- groups are fewer than classes, so that popular shingles become rare among them, and the same is done to groups, until
  they are few or get no fewer. What then is left is compared in blocks of close sizes, in tasks; a block gives a spanning set of links.

So thousands of unlike documents around one passage are one group, and no link is lost to a long list.

Texts without words (null, empty, blank) have no shingles and are linked with nothing. Null identifiers are rows like
others; repeated rows are exact copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, free_name, scratch, small_batches, stored
from .components import components

SHINGLE = 5
#: Of 100: intersection against union.
THRESHOLD = 75
SKETCH = 64
INDEX = 32
#: Lists up to this length are short, and paired fully once pivots have done their part.
SHORT = 24
#: Items that one side of a block takes, values of their sets in all (but for a larger set, which is alone), and columns of its matrices at a time.
BLOCK = 1024
BLOCK_VALUES = 2_000_000
COLUMNS = 4096
#: Groups go on by popular shingles while they are more than FEW blocks and at most this share of what there was before.
FEW = 4
FEWER = 0.9
#: Estimates may fall short of the threshold by five standard deviations of a sample of SKETCH.
MARGIN = 5 * (0.75 * 0.25 / SKETCH) ** 0.5
#: Words whose hashes a worker keeps.
CACHE_WORDS = 1_000_000

_M = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class _Hashes(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h
        return h


def shingle_set(text: str | None, hashes: _Hashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the word shingles of a whole text; of fewer words, the hash of all."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.int64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    k = min(n, size)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, k, dtype=np.uint64)
        for j in range(k):
            h = h * _M + w[j : n - k + 1 + j]
        h ^= h >> np.uint64(33)
        h *= _A
        h ^= h >> np.uint64(33)
        h *= _B
        h ^= h >> np.uint64(33)
    return np.unique((h >> np.uint64(1)).astype(np.int64))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bits: int = 63) -> DataFrame:
    """id, content (hash of the text), n_shingles, node (digest of the shingle set of so many bits; null if empty), check (a second digest of 63 bits), sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for b in batches:
            n, nodes, checks, tops = [], [], [], []
            for t in b["text"]:
                s = shingle_set(t, hashes, size)
                n.append(len(s))
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                nodes.append(digest >> (128 - bits) if len(s) else None)
                checks.append(digest & (1 << 63) - 1)
                tops.append(s[:SKETCH])
            yield pd.DataFrame({"id": b["id"], "content": b["content"], "n_shingles": n, "node": pd.array(nodes, dtype="Int64"), "check": checks, "sketch": tops})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("content"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id long, content long, n_shingles long, node long, check long, sketch array<long>")


def _classes(rows: DataFrame, own: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows, and their classes (node, row, n_shingles, sketch, lo, hi): a node that stands for unlike sets is replaced by one for each of them."""
    while True:
        same = F.struct("n_shingles", "check")
        grouped = rows.where("node is not null").groupBy("node")
        classes = grouped.agg(
            F.min(F.struct("id", "content")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.min(same).alias("lo"), F.max(same).alias("hi")
        )
        classes = own.keep(classes, "classes")
        clashing = own.keep(classes.where("lo != hi").select("node", F.lit(True).alias("clashes")), "clashing")
        if clashing.isEmpty():
            return rows, classes
        renamed = F.shiftrightunsigned(F.xxhash64("node", "n_shingles", "check"), 1)
        node = F.when(F.col("clashes"), renamed).otherwise(F.col("node"))
        apart = own.keep(rows.join(clashing, "node", "left").withColumn("node", node).drop("clashes"), "sketches")
        own.drop(rows, classes)
        rows = apart


def estimate_ok(n_a: Column, a: Column, n_b: Column, b: Column) -> Column:
    """Whether the union sketch leaves a chance that the similarity reaches THRESHOLD; exact if both sketches are whole sets."""
    top = F.least(F.when(n_a > SKETCH, a[SKETCH - 1]), F.when(n_b > SKETCH, b[SKETCH - 1]))
    whole = top.isNull()
    below = lambda s: F.when(whole, s).otherwise(F.filter(s, lambda x: x <= top))
    a, b = below(a), below(b)
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    least = F.when(whole, THRESHOLD * union).otherwise((THRESHOLD - 100 * MARGIN) * union)
    sizes = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * THRESHOLD
    return sizes & (both * 100 >= least)


def _postings(classes: DataFrame, own: Scratch) -> DataFrame:
    """(value, node, weight) of the inverted lists with at least two members, after the choice of values."""
    all_ = classes.select("node", F.explode(F.slice("sketch", 1, INDEX)).alias("value"))
    lengths = own.keep(all_.groupBy("value").agg(F.count("*").alias("length")).where("length > 1"), "lengths")
    by_rarity = F.array_sort(F.collect_list(F.struct("length", "value")))
    lists = all_.join(lengths, "value").groupBy("node").agg(by_rarity.alias("lists"))
    sizes = classes.select("node", F.col("n_shingles").alias("n"), F.least(F.size("sketch"), F.lit(INDEX)).alias("k"))
    short = F.filter("lists", lambda x: x["length"] <= SHORT)
    alone = F.col("k") - F.size("lists")
    # a whole set as similar as THRESHOLD shares all but a quarter of it, less what a larger set has beyond INDEX; a sample of INDEX at least 12 (24 less five deviations)
    whole = F.greatest(F.floor(F.col("k") * (100 - THRESHOLD) / 100), F.floor(F.col("k") * 100 / THRESHOLD) - INDEX)
    need = F.when(F.col("n") <= INDEX, whole).otherwise(INDEX - 12).cast("int") + 1
    rarest = F.slice("lists", F.lit(1), F.greatest(F.lit(0), need - alone))
    chosen = F.when(alone + F.size(short) >= need, short).otherwise(rarest)
    weight = F.aggregate("lists", F.lit(0).cast("bigint"), lambda a, x: a + x["length"])
    chosen = sizes.join(lists, "node").select("node", weight.alias("weight"), F.explode(chosen).alias("x"))
    return chosen.select(F.col("x.value").alias("value"), "node", "weight")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that pass the estimate."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.where(estimate_ok(F.col("n_a"), F.col("s_a"), F.col("n_b"), F.col("s_b"))).select("a", "b")


def _full_sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, size, set): the full shingle sets."""

    @F.pandas_udf("array<bigint>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = _Hashes()
        for b in batches:
            yield pd.Series([shingle_set(t, hashes, size) for t in b])

    return texts.select("node", sets("text").alias("set")).select("node", F.size("set").alias("size"), "set")


def _compared(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of both items and the number of values that their sets share."""
    side = lambda c: items.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("set").alias(f"set_{c}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    return joined.select("a", "b", "size_a", "size_b", F.size(F.array_intersect("set_a", "set_b")).alias("both"))


#: Whether the intersection is THRESHOLD of 100 of the union.
SIMILAR = f"{100 + THRESHOLD} * both >= {THRESHOLD} * (size_a + size_b)"


def _labelled(postings: DataFrame, labels: DataFrame, own: Scratch) -> DataFrame:
    """Members of the lists that still hold several components, with component and length of the list."""
    postings = postings.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ends = postings.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("length"))
    return postings.join(own.keep(ends.where("lo != hi"), "ends"), "value").select("value", "node", "component", "length")


def _to_pivots(postings: DataFrame, own: Scratch) -> DataFrame:
    """Each member with the pivot of its list: the one whose lists are longest in sum, which in a group of copies has the fewest edits."""
    pivots = postings.groupBy("value").agg(F.max(F.struct("weight", "node")).alias("p")).select("value", F.col("p.node").alias("pivot"))
    return postings.join(own.keep(pivots, "pivots"), "value").where("node != pivot").select(*_ordered("node", "pivot")).distinct()


def _short_pairs(lists: DataFrame) -> DataFrame:
    """All pairs of members of different components of short lists (value, node, component)."""
    members = lists.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("node", "component"))).alias("m")).select("m").distinct()
    ahead = lambda x: F.transform(F.filter("m", lambda y: (y["node"] > x["node"]) & (y["component"] != x["component"])), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))
    return members.select(F.explode(F.flatten(F.transform("m", ahead))).alias("p")).select("p.a", "p.b").distinct()


def _merged(labels: DataFrame, links: DataFrame, own: Scratch) -> DataFrame:
    """Labels (node, component) after new links; only the components that these join need rounds again."""
    if links.isEmpty():
        return labels
    name = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    joined = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(joined, within=own).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    every = labels.unionByName(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("component")))
    return own.keep(every.join(merged, "component", "left").select("node", F.coalesce("whole", "component").alias("component")), "labels")


def _split(items: DataFrame, own: Scratch) -> DataFrame:
    """(node, size, rare, hot) of items (node, size, set): which values bring together items that share a value of a short list, and the popular values of items that could be linked by these alone."""
    values = items.select("node", F.explode("set").alias("value"))
    lengths = own.keep(values.groupBy("value").agg(F.count("*").alias("length")).where("length > 1"), "set-lengths")
    lists = values.join(lengths, "value").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("length", "value"))).alias("lists"))
    known = items.select("node", "size", F.size("set").alias("k")).join(lists, "node")
    lacks = F.col("k") - F.ceil(F.col("size") * THRESHOLD / 100).cast("int")
    ahead = F.slice("lists", F.lit(1), F.greatest(F.lit(0), lacks + 1 - (F.col("k") - F.size("lists"))))
    rare = F.transform(F.filter(ahead, lambda x: x["length"] <= SHORT), lambda x: x["value"])
    hot = F.array_sort(F.transform(F.filter("lists", lambda x: x["length"] > SHORT), lambda x: x["value"]))
    none = F.expr("cast(array() as array<bigint>)")
    return known.select("node", "size", rare.alias("rare"), F.when(100 * F.size(hot) >= THRESHOLD * F.col("size"), hot).otherwise(none).alias("hot"))


def _of_groups(split: DataFrame, own: Scratch) -> tuple[DataFrame, DataFrame]:
    """Groups of items with equal popular values as items (node, size, set), named by their smallest item; and all items with their group: a, b, size_a, size_b, both."""
    key = F.md5(F.array_join(F.col("hot").cast("array<string>"), ",").cast("binary"))
    popular = split.where(F.size("hot") > 0).withColumn("key", key)
    first = popular.groupBy("key").agg(F.min(F.struct("size", "node")).alias("least"))
    first = own.keep(first.select("key", F.col("least.node").alias("b"), F.col("least.size").alias("size_b")), "groups")
    members = popular.select("key", F.col("node").alias("a"), F.col("size").alias("size_a"), F.size("hot").alias("both")).join(first, "key")
    groups = popular.join(first, "key").where("node = b").select("node", "size", F.col("hot").alias("set"))
    return own.keep(groups, "items"), own.keep(members.select("a", "b", "size_a", "size_b", "both"), "members")


def _of_satellites(satellites: DataFrame, pairs: DataFrame, own: Scratch) -> DataFrame:
    """Links of satellites (node, size, key): a partner of the group, the one that allows the largest sizes, is similar enough."""
    way = lambda a, b: pairs.select(F.col(a).alias("key"), F.col(b).alias("other"), ((100 + THRESHOLD) * F.col("both") - THRESHOLD * F.col(f"size_{b}")).alias("room"))
    best = way("a", "b").unionByName(way("b", "a")).groupBy("key").agg(F.max_by("other", "room").alias("other"), F.max("room").alias("room"))
    return satellites.join(own.keep(best, "best"), "key").where(f"{THRESHOLD} * size <= room").select(F.col("node").alias("a"), F.col("other").alias("b"))


def _block(g: pd.DataFrame) -> pd.DataFrame:
    """Pairs of items of two parts that share values: a spanning set of the similar ones, and the partner of each item that allows the largest sizes.

    Intersections are products of incidence matrices over the values that occur on both sides.
    """
    columns = ["a", "b", "size_a", "size_b", "both"]
    low, high = g["place"].min(), g["place"].max()
    sides = [g[g["place"] == low], g[g["place"] == high]]
    if low == high and not g["alone"].iloc[0]:
        return pd.DataFrame({c: [] for c in columns}, dtype="int64")  # the other part has no items
    sets = [[np.asarray(x, dtype=np.int64) for x in side["set"]] for side in sides]
    flat = [np.concatenate(x) for x in sets]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    rows = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in sets]
    both = np.zeros((len(sets[0]), len(sets[1])), dtype=np.float32)
    for i in range(0, len(shared), COLUMNS):
        part, matrices = shared[i : i + COLUMNS], []
        for row, values, x in zip(rows, flat, sets, strict=True):
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            there = part[at] == values
            m = np.zeros((len(x), len(part)), dtype=np.float32)
            m[row[there], at[there]] = 1
            matrices.append(m)
        both += matrices[0] @ matrices[1].T
    if low == high:
        np.fill_diagonal(both, 0)
    sizes, nodes = [side["size"].to_numpy(dtype=np.float64) for side in sides], [side["node"].to_numpy() for side in sides]
    room = (100 + THRESHOLD) * both.astype(np.float64) - THRESHOLD * (sizes[0][:, None] + sizes[1][None, :])
    wanted = set(zip(range(len(nodes[0])), (room + THRESHOLD * sizes[0][:, None]).argmax(axis=1).tolist(), strict=True))
    wanted |= set(zip((room + THRESHOLD * sizes[1][None, :]).argmax(axis=0).tolist(), range(len(nodes[1])), strict=True))
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            root[c] = root.get(root[c], root[c])
            c = root[c]
        return c

    for i, j in zip(*np.nonzero(room >= 0), strict=True):
        c, d = find(int(nodes[0][i])), find(int(nodes[1][j]))
        if c != d:
            root[c] = d
            wanted.add((int(i), int(j)))
    out = [(nodes[0][i], nodes[1][j], sizes[0][i], sizes[1][j], both[i, j]) for i, j in sorted(wanted) if both[i, j]]
    return pd.DataFrame(out, columns=columns).astype("int64")


def _in_blocks(items: DataFrame, own: Scratch) -> DataFrame:
    """Pairs a, b, size_a, size_b, both of items (node, size, set), as _block gives them, over all parts of close sizes."""
    # sizes of linked items are in one bin or in neighbouring ones: a bin spans more than 100 / THRESHOLD
    binned = items.withColumn("bin", F.floor(F.log("size") / F.log(F.lit(1.4))).cast("int"))
    parts = own.keep(binned.groupBy("bin").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.size("set")) / BLOCK_VALUES)).cast("int").alias("parts")), "bins")
    near = parts.select((F.col("bin") - 1).alias("bin"), F.col("parts").alias("above")), parts.select((F.col("bin") + 1).alias("bin"), F.col("parts").alias("below"))
    placed = binned.join(parts, "bin").join(near[0], "bin", "left").join(near[1], "bin", "left")
    mine = F.pmod(F.hash("node"), F.col("parts"))
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    block = lambda b1, p1, b2, p2: F.struct(b1.alias("b1"), p1.alias("p1"), b2.alias("b2"), p2.alias("p2"))
    bin_, part = F.col("bin"), F.col("part")
    placed = placed.withColumn("part", mine)
    blocks = F.concat(
        F.transform(up_to(F.col("parts")), lambda q: block(bin_, F.least(part, q), bin_, F.greatest(part, q))),
        F.transform(up_to(F.coalesce("above", F.lit(0))), lambda q: block(bin_, part, bin_ + 1, q)),
        F.transform(up_to(F.coalesce("below", F.lit(0))), lambda q: block(bin_ - 1, q, bin_, part)),
    )
    dealt = placed.withColumn("x", F.explode(blocks)).select("x", F.struct("bin", "part").alias("at"), "node", "size", "set")
    own_block = (F.col("x.b1") == F.col("x.b2")) & (F.col("x.p1") == F.col("x.p2"))
    place = F.when((F.col("at.bin") == F.col("x.b1")) & (F.col("at.part") == F.col("x.p1")), 0).otherwise(1)
    dealt = dealt.select("x.*", place.alias("place"), own_block.alias("alone"), "node", "size", "set")
    return dealt.groupBy("b1", "p1", "b2", "p2").applyInPandas(_block, "a long, b long, size_a long, size_b long, both long")


def _hot_links(items: DataFrame, labels: DataFrame, sketched: DataFrame, own: Scratch) -> DataFrame:
    """Links among items (node, size, set) that span all components that their similarity gives; see the module.

    Of the classes themselves only pairs of different components that pass the estimate are compared.
    """
    links, satellites = [], None
    while True:
        split = own.keep(_split(items, own), "split")
        lists = split.select("node", F.explode("rare").alias("value"))
        if satellites is None:
            pairs = _estimated(_short_pairs(_labelled(lists, labels, own)), sketched)
        else:
            pairs = _short_pairs(lists.withColumn("component", F.col("node")))
        close = own.keep(_compared(own.keep(pairs, "pairs"), items), "compared")
        groups, members = _of_groups(split, own)
        every = close.unionByName(members.where("a != b"))
        links.append(every.where(SIMILAR).select("a", "b"))
        far = members.where(f"a != b and not ({SIMILAR})").select(F.col("a").alias("node"), F.col("size_a").alias("size"), F.col("b").alias("key"))
        if satellites is not None:
            links.append(_of_satellites(satellites, every, own))
            far = far.unionByName(satellites.join(members.select(F.col("a").alias("key"), "b"), "key").select("node", "size", F.col("b").alias("key")))
        satellites, before = own.keep(far, "satellites"), items.count()
        items, n = groups, groups.count()
        if n <= 1:
            break
        if n <= FEW * BLOCK or n > FEWER * before:
            every = own.keep(_in_blocks(items, own), "blocks")
            links += [every.where(SIMILAR).select("a", "b"), _of_satellites(satellites, every, own)]
            break
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return own.keep(out.distinct(), "hot-links")


def near_dup_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bits: int = 63) -> DataFrame:
    """One row per row of docs: the identifier, n_shingles, component_id (smallest identifier of its group) and kept.

    Linked are documents with 100 * intersection >= THRESHOLD * union of their shingle sets; groups are the connected
    components of all such links. bits: length of the first digest, on which the result does not depend. The result is a
    table in the shared folder; all others are removed, and the session's settings are as before.
    """
    with scratch(docs.sparkSession, "near-dup") as own, small_batches(docs.sparkSession):
        return stored(_groups(docs, id_col, text_col, size, bits, own), "near-dup-result")


def _groups(docs: DataFrame, id_col: str, text_col: str, size: int, bits: int, own: Scratch) -> DataFrame:
    rows, classes = _classes(own.keep(sketches(docs, id_col, text_col, size, bits), "sketches"), own)
    postings = own.keep(_postings(classes, own), "lists")
    active = own.keep(classes.drop("lo", "hi").join(postings.select("node").distinct(), "node", "left_semi"), "active")
    members = own.keep(rows.select("id", "n_shingles", "node"), "members")
    repeated = not rows.groupBy("id", "content").count().where("count > 1").isEmpty()
    own.drop(rows, classes)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("content"), F.col(text_col).alias("text"))
    places = active.select("node", F.col("row.id").alias("rid"), F.col("row.content").alias("rcontent"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        """Full sets of some classes. Texts meet no more than the places of these, and no table of all sets is moved again."""
        at = places.join(nodes.distinct(), "node", "left_semi")
        # both sides grow with the documents, so neither is broadcast at any size
        found = texts.join(at.hint("merge"), F.col("id").eqNullSafe(F.col("rid")) & (F.col("content") == F.col("rcontent"))).select("node", "text")
        return own.keep(_full_sets(found.dropDuplicates(["node"]) if repeated else found, size), "sets")

    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node"))
    links_of = lambda pairs, sets: own.keep(_compared(pairs, sets).where(SIMILAR).select("a", "b"), "links")

    pairs = own.keep(_estimated(_to_pivots(postings, own), active), "pairs")
    sets = sets_of(ends(pairs))
    labels = own.keep(components(links_of(pairs, sets), within=own), "labels")
    own.drop(sets)
    lists = own.keep(_labelled(postings, labels, own), "several")
    pairs = own.keep(_estimated(_short_pairs(lists.where(F.col("length") <= SHORT)), active), "pairs")
    long_ = own.keep(lists.where(F.col("length") > SHORT).select("node").distinct(), "popular")
    sets = sets_of(ends(pairs).unionByName(long_))
    more = links_of(pairs, sets)
    if not long_.isEmpty():
        more = more.unionByName(_hot_links(own.keep(sets.join(long_, "node", "left_semi"), "popular-sets"), labels, active, own))
    labels = _merged(labels, more, own)

    out = members.join(labels, "node", "left").select("id", "n_shingles", F.coalesce("component", "node").alias("group"))
    first = own.keep(out.where("group is not null").groupBy("group").agg(F.min("id").alias("first")), "first")
    out = out.join(first, "group", "left")
    component = F.when(F.col("group").isNull(), F.col("id")).otherwise(F.col("first"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: one document of each group (the smallest identifier), and texts without words."""
    kept = free_name(docs, "kept_id")
    ids = near_dup_groups(docs, id_col, text_col).where("kept").select(F.col(id_col).alias(kept)).distinct()
    return docs.join(ids, F.col(id_col).cast("long").eqNullSafe(F.col(kept)), "left_semi")
