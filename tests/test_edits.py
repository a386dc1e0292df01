"""Descriptors as masks: what loops share, what differs, in which order they are stored."""

import random

from pyspark.sql import functions as F

from cadenza.functions import vocabulary as v
from cadenza.operators import edits as e


def test_shared_words_equal_set_intersections(spark):
    random.seed(9)
    odd = [f"extra {i}" for i in range(150)]
    rows = []
    for g in range(12):
        common = random.sample(v.DESCRIPTORS, random.randint(0, 3)) + random.sample(odd, random.choice([0, 2, 100]))
        for _ in range(random.randint(1, 30)):
            words = common + random.sample(v.DESCRIPTORS, 3) + random.sample(odd, 5)
            rows.append((g, random.sample(words, len(words)) + words[:1]))
    rows += [(50, None), (50, ["Dry"]), (51, []), (52, ["Dry", "x"]), (52, ["x", "Dry", "Dry"]), (None, ["Dry"])]
    want = {}
    for g, words in rows:
        want[g] = want[g] & set(words or []) if g in want else set(words or [])
    got = {r.g: r.shared for r in e.shared_descriptors(spark.createDataFrame(rows, "g int, descriptors array<string>").repartition(6), "g").collect()}
    assert got == {g: sorted(w) for g, w in want.items()}
    assert any(len(w - {*v.DESCRIPTORS}) > 62 for w in want.values())


def test_vocabulary_words_are_shared_in_one_shuffle(spark):
    """Words outside the vocabulary take a second pass; what is shared of the vocabulary is there after the first."""
    loops = spark.createDataFrame([(1, ["Dry"])], "g int, descriptors array<string>")
    plan = loops.groupBy("g").agg(F.bit_and(e.word_mask(F.col("descriptors"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan


def test_order_and_equality_of_words(spark):
    rows = [(1, ["z", "Dark", "Part", "a", "Dark"], ["Part", "a", "Dark", "z"]), (2, ["Dry"], ["dry"]), (3, ["a"], ["a", "b"]), (4, [], []), (5, None, None), (6, None, [])]
    got = {r.id: (r.o, r.s) for r in spark.createDataFrame(rows, "id int, a array<string>, b array<string>").select("id", e.descriptor_order(F.col("a")).alias("o"), e.same_words(F.col("a"), F.col("b")).alias("s")).collect()}
    assert got[1] == (["Part", "Dark", "a", "z"], True)
    assert [got[i][1] for i in (2, 3, 4, 5, 6)] == [False, False, True, True, False]
