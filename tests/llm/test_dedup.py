"""op3, op4 and op2 on small tables with the cases that the contracts name, against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cadenza.llm import components, decontaminate, exact_dedup, near_dup

random.seed(5)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(random.choice(VOCAB) for _ in range(n))


def edited(text, k):
    words = text.split()
    for i in random.sample(range(len(words)), k):
        words[i] = random.choice(VOCAB)
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    base, shared = prose(120), prose(60)
    texts = [prose(random.randint(1, 150)) for _ in range(30)]
    texts += [edited(base, random.randint(0, 9)) for _ in range(60)]  # a group of near copies, longer than a short list
    texts += [f"{prose(4)} {shared} {prose(5)}" for _ in range(60)]  # unlike texts around one passage
    texts += [base, base.upper(), base.replace(" ", "\n"), None, "", " \t\n", "One", "one", "a b c", "A b C", "x " * 30_000, "x " * 30_000]
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[40]]  # repeated rows


def shingles(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return sorted((i, len(s), root(i), i == root(i)) for i, s in sets)


def test_near_dup_equals_brute_force(spark, corpus):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in corpus], "doc_id long, text string, node string, value string")
    got = sorted(tuple(r) for r in near_dup.near_dup_groups(df).collect())
    assert got == brute_groups(corpus)
    kept = near_dup.drop_near_copies(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in got if r[3]}


def test_near_dup_digests_that_clash_are_told_apart(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in near_dup.near_dup_groups(df, bits=3).collect()) == brute_groups(corpus)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_near_dup_long_sets_are_dealt_to_more_blocks(spark, monkeypatch):
    """Parts are cut by the values of their sets; the links of blocks are those of all pairs, in one piece or many."""
    own = random.Random(3)
    sets = {i: sorted(own.sample(range(1000), 700)) for i in range(40)} | {i: [*range(i % 5, 960 + i % 5)] for i in range(40, 60)}
    rows = [(i, len(s), s) for i, s in sets.items()]
    items = spark.createDataFrame(rows, "node long, size long, set array<long>")
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len({*sets[a]} & {*sets[b]}) >= 75 * len({*sets[a]} | {*sets[b]})}
    seen = []
    for values in (near_dup.BLOCK_VALUES, 4000, 100):  # 100: every set is longer than a part should be
        monkeypatch.setattr(near_dup, "BLOCK_VALUES", values)
        with near_dup.scratch(spark, "test") as own_tables:
            found = near_dup._in_blocks(items, own_tables).where(near_dup.SIMILAR).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            assert {tuple(r) for r in found.collect()} <= linked
            seen.append(sorted((r.node, r.component) for r in components.components(found).collect()))
    assert seen[0] == seen[1] == seen[2] and {n for n, _ in seen[0]} == {n for pair in linked for n in pair}


@pytest.mark.parametrize("fewer", [near_dup.FEWER, 0.0])
def test_near_dup_long_lists_lose_no_link(spark, corpus, monkeypatch, fewer):
    """Almost every list is long here; without FEWER the blocks compare all that is left after the first grouping."""
    monkeypatch.setattr(near_dup, "SHORT", 1)
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "FEW", 1)
    monkeypatch.setattr(near_dup, "FEWER", fewer)
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dup.near_dup_groups(df).collect()) == brute_groups(corpus)


def popular_parts(seed):
    """Documents made of popular passages with own words in all proportions, some passages damaged: groups, satellites, links across groups."""
    own = random.Random(seed)
    words = lambda n: [own.choice(VOCAB) for _ in range(n)]
    parts, out = [words(own.randint(20, 60)) for _ in range(5)], []
    for _ in range(150):
        text = [w for p in own.sample(parts, own.randint(1, 3)) for w in p]
        if own.random() < 0.4:
            at = own.randrange(len(text))
            text[at : at + own.randint(1, 4)] = words(2)
        out.append(" ".join(text + words(own.randint(0, len(text) // 2))))
    return [*enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dup_groups_of_popular_parts(spark, monkeypatch, seed):
    pivots = near_dup._to_pivots
    monkeypatch.setattr(near_dup, "SHORT", 2)
    monkeypatch.setattr(near_dup, "BLOCK", 6)
    monkeypatch.setattr(near_dup, "FEW", 1)
    monkeypatch.setattr(near_dup, "_to_pivots", lambda postings, own: pivots(postings, own).where(F.lit(False)))  # the lists alone
    rows = popular_parts(seed)
    got = near_dup.near_dup_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == brute_groups(rows)


def test_near_dup_many_long_lists_at_production_parameters(spark):
    """25 passages in 30 documents each give over 2,000 lists of more than SHORT members."""
    own = random.Random(17)
    words = lambda n: [f"v{own.randrange(5000)}" for _ in range(n)]
    rows = []
    for _ in range(25):
        passage = words(130)
        for k in range(30):
            cut = own.choice([0, 0, 0, own.randrange(40)])
            rows.append(passage[cut:] + words(own.choice([0, 5, 12, 20, 28, 33, 40, 60, 120])))
            if k % 10 == 0:
                rows.append(rows[-1][: own.randrange(90, 130)])
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    got = near_dup.near_dup_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == brute_groups(rows)


def test_near_dup_satellites(spark):
    """Equal popular words: the smallest document is linked with those close in size, another group's document with a larger one."""
    items = spark.createDataFrame([(1, 10, [*range(10)]), (2, 12, [*range(12)]), (3, 14, [*range(10), 90, 91, 92, 93])], "node long, size long, set array<long>")
    pairs = spark.createDataFrame([(1, 2, 10, 12, 10)], "a long, b long, size_a long, size_b long, both long")
    with near_dup.scratch(spark, "test") as own:
        far = spark.createDataFrame([(7, 11, 1), (8, 13, 2), (9, 14, 2)], "node long, size long, key long")
        linked = near_dup._of_satellites(far, pairs, own).collect()
        assert sorted(tuple(r) for r in linked) == [(7, 2), (8, 1)]  # 10 shared of 13, of 13, of 14
        blocks = {frozenset((r.a, r.b)): r.both for r in near_dup._in_blocks(items, own).collect()}
        assert blocks[frozenset((1, 2))] == 10 and blocks[frozenset((1, 3))] == 10


def passages_of_unequal_popularity():
    """A = P + Q is as similar as THRESHOLD to B = P, but A's longest lists are those of Q, and other members of P's lists weigh more than B."""
    own = random.Random(11)
    words = lambda n: [own.choice(VOCAB) for _ in range(n)]
    p, q, loads, rest = words(300), words(95), [words(80), words(80)], [words(60) for _ in range(10)]
    texts = [p, p + q, p[:237] + loads[0], p[63:] + loads[1]]
    texts += [p + words(130) for _ in range(27)] + [p + words(700) for _ in range(10)]
    texts += [q + rest[a] + rest[b] for a in range(10) for b in range(a)]
    texts += [x + words(130) for x in rest for _ in range(28)] + [x + words(175) for x in loads for _ in range(45)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_near_dup_visits_all_long_lists(spark, monkeypatch):
    pivots = near_dup._to_pivots
    monkeypatch.setattr(near_dup, "_to_pivots", lambda postings, own: pivots(postings, own).where(F.lit(False)))  # the lists alone
    rows = passages_of_unequal_popularity()
    want = brute_groups(rows)
    assert (1, 391, 0, False) in want
    got = near_dup.near_dup_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert near_dup.near_dup_groups(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.drop_copies(none).count() == 0
    assert decontaminate.find_items(none, items).count() == 0


def test_components_of_a_chain(spark):
    n = 40
    order = random.sample(range(n), n)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(n)}, 100: 100, 101: 100}


def brute_exact(rows):
    norm = lambda t: "".join(c for c in (t or "") if c not in " \t\n\x0b\f\r")
    best, size = {}, {}
    for i, t in rows:
        k = norm(t)
        size[k] = size.get(k, 0) + 1
        rank = (-len(t or ""), i is None, i)
        if k not in best or rank < best[k]:
            best[k] = rank
    return sorted(((i, best[norm(t)][2], size[norm(t)]) for i, t in rows), key=repr)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: (F.length(c) % 3).cast("string")])
def test_exact_dedup_equals_brute_force(spark, corpus, digest):
    rows = [*corpus, (None, "same"), (None, "s a m e"), (5000, "same"), (5001, "sa me "), (4000, "sam e"), (6000, "abc"), (6000, "abd")]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, kept string, n int, rank int")
    got = exact_dedup.exact_dedup(df.repartition(6), digest=digest, batches=3).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == brute_exact(rows)
    assert [r.doc_id for r in got if r.text_sha256 == hashlib.sha256(b"same").hexdigest() and r.kept] == [None]


def test_exact_dedup_meets_state_of_earlier_batches(spark, tmp_path):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    entries = []
    with exact_dedup.scratch(spark, "test") as own:
        keys = own.keep(exact_dedup.keys_of(docs, "doc_id", "text", exact_dedup.sha256), "keys")
        last = exact_dedup.run_state(spark, own.path_of(keys), keys.schema, f"{own.folder}/stream", 2).collect()
        entries = spark.read.parquet(f"{own.folder}/stream/entries").groupBy("digest").count().collect()
    assert max(r["count"] for r in entries) > 1
    assert sorted((r.keep_id, r.group_size) for r in last) == sorted((i, sum(j % 7 == i for j, _ in rows)) for i in range(7))
    assert all(r.keep_locator for r in last)


@pytest.mark.parametrize("repeated", [True, False])
def test_drop_copies_leaves_one(spark, corpus, repeated):
    rows = corpus if repeated else [(n, t) for n, (_, t) in enumerate(corpus)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, digest int, gone_id int, own_key int")
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    norm = lambda t: "".join((t or "").split())
    assert sorted(norm(r.text) for r in kept.collect()) == sorted({norm(t) for _, t in rows})


def test_decontamination(spark):
    items = [(1, "Alpha beta gamma delta epsilon zeta eta theta? Iota kappa lambda mu nu xi."), (2, "one two three four five six seven eight nine ten eleven twelve"), (3, None), (4, "too short"), (None, "no id at all but words enough here")]
    item = {i: t for i, t in items}
    docs = [
        (1, f"{prose(200)} {item[1]} {prose(90)}"), (2, f"{prose(5)}\n{item[2].upper()}! {item[1]}"), (3, prose(300)), (4, "Alpha beta gamma delta epsilon zeta eta theta? " + prose(50)),
        (5, None), (6, ""), (7, item[2] + " " + "z" * 50_000), (7, item[2] + " " + "z" * 50_000), (8, "too short"), (9, " ".join(reversed(item[2].split()))),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    found = decontaminate.find_items(df, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((r.doc_id, tuple(x.item_id for x in r.found)) for r in found.collect())
    assert got == [(1, (1,)), (2, (1, 2)), (3, ()), (4, ()), (5, ()), (6, ()), (7, (2,)), (7, (2,)), (8, (4,)), (9, ())]
    left = decontaminate.drop_contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 9]


def test_edited_copy_with_a_short_last_sentence(spark):
    item = prose(60) + ". The old mill by the river."
    docs = spark.createDataFrame([(1, f"{prose(40)} {item.replace('mill', 'barn')} {prose(40)}"), (2, prose(140))], "doc_id long, text string")
    found = decontaminate.find_items(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, [x.item_id for x in r.found]) for r in found) == [(1, [1]), (2, [])]
    split = decontaminate.find_items(docs, spark.createDataFrame([(1, *item.split(". "))], "item_id long, q string, a string"), question="q", answer="a")
    assert all(not r.found for r in split.collect())  # a real answer is asked for by itself


def test_shards_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, prose(20)) for i in range(40)], "item_id long, text string").cache()
    texts = [r.text for r in items.collect()]
    docs = spark.createDataFrame([(i, f"{prose(30)} {texts[i]} {prose(30)} {texts[39 - i]}") for i in range(20)], "doc_id long, text string").cache()
    rows = lambda: sorted((r.doc_id, tuple(x.item_id for x in r.found)) for r in decontaminate.find_items(docs, items).collect())
    whole = rows()
    assert whole == [(i, (i, 39 - i)) for i in range(20)]
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", 1000)
    assert rows() == whole
    own = items.withColumnRenamed("text", "question").withColumn("answer", F.col("question"))
    assert len([*decontaminate._shards(own)]) >= 3


def test_a_worker_builds_each_shard_once(monkeypatch):
    built = []
    build = decontaminate.Index.build.__func__
    monkeypatch.setattr(decontaminate.Index, "build", classmethod(lambda cls, *a: built.append(1) or build(cls, *a)))
    stats = decontaminate.Statistics(3, 20.0, {f"w{i}": 1 for i in range(400)})
    shared = type("Shared", (), {"value": ([(1, t := prose(20), t), (2, u := prose(300), u)], stats)})
    for _ in range(10):
        decontaminate._index("some key", shared).matches([prose(40), t])
    assert len(built) == 2  # one for each class of length


def brute_items(text, items, stats_of):
    """Scores of all items for all passages of a text, without index."""
    words, out = decontaminate.words_of(text), {}
    longest = {}
    for _, t in items:
        n = len(decontaminate.words_of(t))
        if n >= decontaminate.MIN_WORDS:
            c = int(decontaminate.math.log(n, decontaminate.LENGTH_CLASS))
            longest[c] = max(longest.get(c, 1), n)
    for item, t in items:
        own = decontaminate.words_of(t)
        if not own:
            continue
        if len(own) < decontaminate.MIN_WORDS:
            if any(words[i : i + len(own)] == own for i in range(len(words))):
                out[item] = 1.0
            continue
        weights = stats_of(own)
        stride = longest[int(decontaminate.math.log(len(own), decontaminate.LENGTH_CLASS))]
        for k in range(0, max(1, len(words)), stride):
            passage = words[k : k + 2 * stride]
            score = sum(x for w, x in weights.items() if w in set(passage)) / sum(weights.values())
            if score >= decontaminate.THETA - 1e-9 and decontaminate.share(own, passage) >= decontaminate.OVERLAP:
                out[item] = max(out.get(item, 0.0), score)
    return out


def test_items_equal_brute_force(spark):
    own = random.Random(3)
    words = lambda n: [own.choice(VOCAB[:120]) for _ in range(n)]
    lengths = [1, 2, 4, 5, 7, 9, 20, 40, 63, 64, 65, 90, 0]
    items = [(i, " ".join(words(lengths[i % len(lengths)] if i % len(lengths) > 2 or i < 30 else 4))) for i in range(60)]
    docs = []
    for i in range(60):
        t = own.choice(items)[1].split()
        for j in own.sample(range(len(t)), own.randint(0, len(t) // 6)):
            t[j] = own.choice(VOCAB)
        docs.append((i, " ".join(words(own.randint(0, 200)) + t + words(own.randint(0, 200)))))
    lists = [w for _, t in items if (w := decontaminate.words_of(t))]
    mean, count = sum(map(len, lists)) / len(lists), {}
    for w in lists:
        for t in set(w):
            count[t] = count.get(t, 0) + 1

    def weights(ws):
        k = decontaminate.K1 * (1 - decontaminate.B + decontaminate.B * len(ws) / mean)
        idf = lambda t: decontaminate.math.log(1 + (len(lists) - count[t] + 0.5) / (count[t] + 0.5))
        return {t: idf(t) * ws.count(t) * (decontaminate.K1 + 1) / (ws.count(t) + k) for t in set(ws)}

    found = decontaminate.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: {x.item_id: x.score for x in r.found} for r in found.collect()}
    for i, t in docs:
        want = brute_items(t, items, weights)
        assert got[i].keys() == want.keys() and all(got[i][k] == pytest.approx(want[k]) for k in want)
    assert sum(map(len, got.values())) >= 40


def test_wand_equals_full_scores():
    items = [(i, t := prose(random.randint(8, 40)), t) for i in range(300)]
    frequency = {}
    for _, t, _ in items:
        for w in set(decontaminate.words_of(t)):
            frequency[w] = frequency.get(w, 0) + 1
    index = decontaminate.Index.build(items, decontaminate.Statistics(300, 24.0, frequency))
    for _ in range(60):
        query = set(decontaminate.words_of(prose(30) + " " + random.choice(items)[1]))
        full = {}
        for w in query:
            if w in index.terms:
                for i, x in zip(*index.lists[index.terms[w]][:2], strict=True):
                    full[i] = full.get(i, 0) + x
        want = {i: s for i, s in full.items() if s >= decontaminate.THETA - 1e-9}
        got = dict(index.search(list(query)))
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in got)


def test_exact_dedup_with_the_least_identifier(spark):
    docs = spark.createDataFrame([(5, "a b"), (-(2**63), "ab "), (None, "a b"), (2**63 - 1, "a b")], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(docs).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows} == {(i, -(2**63), 4, i == -(2**63)) for i in (5, -(2**63), None, 2**63 - 1)}
