"""The order of the catalogue: names by a locale with digit runs by value, five orders from two sorts, nothing left behind."""

import os

import pytest
from pyspark.sql import functions as F

from cadenza.functions.tags import natural_key
from cadenza.operators import ranking


def in_name_order(spark, names, **collation):
    rows = spark.createDataFrame([(n,) for n in reversed(names)], "name string").orderBy(natural_key(F.col("name"), **collation), "name")
    return [r.name for r in rows.collect()]


@pytest.mark.parametrize("names", [
    ["a9", "a10", "A11", "b1"],  # digits by value, letters before case
    ["loop", "Loop", "lööp", "loop 2", "Loop 10", "lop"],  # accents before case, both after letters
    ["e1", "é1", "e2", "É2", "f"],  # a number decides before an accent does
    ["a-", "a1", "ab"],  # punctuation, digits, letters
    ["ｘ2", "x10", "zebra"],
    ["Straße", "Strasse 2", "strassen"],
    ["1 take", "02 take", "10 take", "take"],
])
def test_names_sort_like_in_a_file_browser(spark, names):
    assert in_name_order(spark, names) == names


def test_a_language_has_its_own_order(spark):
    assert in_name_order(spark, ["a", "å", "z"]) == ["a", "å", "z"]
    assert in_name_order(spark, ["a", "z", "å"], collation="sv") == ["a", "z", "å"]


@pytest.fixture(scope="module")
def rows(spark):
    names = ["b10", "b9", "B9", "é", "e", "z", "a 2", "a 10", "a 02"]
    return spark.createDataFrame(
        [(i, names[i % 9] + ("" if i < 9 else f" {i}"), ["CAF", "AIF"][i % 2], i % 3 == 0, None if i % 4 == 0 else 60 + i % 5, i % 7 == 0) for i in range(200)] + [(200, "e", "CAF", True, 1, False)],
        "loop_id long, file_name string, file_type string, has_midi boolean, bpm int, has_changes boolean",
    ).repartition(5)


def test_places_are_those_of_sorting_each_order(spark, rows):
    where = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(where))
    orders = {"name": False, "type": True, "midi": False, "bpm": True, "changes": False}
    got = {}
    for r in ranking.places(rows, orders).collect():
        got.setdefault(r.by_, {})[r.place] = r.loop_id
    shown = {r.loop_id: (r.file_name, r.file_type, r.has_midi, r.bpm or 0, r.has_changes) for r in rows.collect()}
    for by, down in orders.items():
        field = {"name": 0, "type": 1, "midi": 2, "bpm": 3, "changes": 4}[by]
        want = [r.loop_id for r in ranking.in_order(rows, by, down).collect()]
        assert sorted(got[by]) == [*range(201)] and {*got[by].values()} == {*shown}
        # rows that agree in name and in what the order goes by may change places
        assert [(shown[got[by][i]][0], shown[got[by][i]][field]) for i in range(201)] == [(shown[i][0], shown[i][field]) for i in want]
    assert sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(where)) - before) == ["catalogue-order"]


def test_one_order_and_no_rows(spark, rows):
    assert [r.by_ for r in ranking.places(rows.limit(1), {"bpm": True}).collect()] == ["bpm"]
    assert ranking.places(rows.where("false"), {"name": False, "midi": True}).count() == 0


def test_names_are_sorted_once(spark, rows, monkeypatch):
    sorts = []
    real = ranking._numbered
    monkeypatch.setattr(ranking, "_numbered", lambda df, keys, folder: sorts.append(keys) or real(df, keys, folder))
    ranking.places(rows, {"name": False, "type": False, "midi": False, "bpm": True, "changes": True})
    assert [("key_" in k) for k in sorts] == [True, False]
