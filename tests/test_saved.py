"""A catalogue saved again: changed files are read, vanished ones go, a repeated batch changes nothing, a failed one is not seen."""

import os
import time

import pytest
from pyspark.sql import functions as F

import test_containers as made
from cadenza.sources import containers as c, files, saved


def rows_of(spark, folder, table):
    return sorted(map(repr, saved.saved(spark, folder, table).collect()))


def tree(folder):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs)


@pytest.fixture
def library(tmp_path):
    root = tmp_path / "lib"
    root.mkdir()
    for i in range(6):
        (root / f"{i}.caf").write_bytes(made.caf([("category", "Drums"), ("genre", f"g{i}")]))
    (root / "bad.caf").write_bytes(b"nothing")
    return root, str(tmp_path / "saved")


def test_refresh(spark, library):
    root, folder = library
    opened = []

    def read(listed):
        opened.append(sorted(r.path.rsplit("/", 1)[1] for r in listed.collect()))
        return c.read_by_range(listed)

    def suggest(got):
        return got.select("path", F.lit(1).alias("rank"), F.concat(F.lit("of "), F.col("pairs")[1]["value"]).alias("key"))

    def state():
        return {r.path.rsplit("/", 1)[1]: (r.genre, r.key) for r in saved.saved(spark, folder, "tags").drop("key").join(saved.saved(spark, folder, "suggestions"), "path").collect()}

    assert saved.saved(spark, folder, "tags") is None
    refresh = lambda n: saved.refresh(folder, n, files.listing(spark, str(root)), suggest, read)
    assert refresh(1)
    assert state() == {f"{i}.caf": (f"g{i}", f"of g{i}") for i in range(6)}
    assert [r.error_code for r in saved.saved(spark, folder, "failures").collect()] == [c.UNRECOGNISED]
    before = tree(folder)
    assert not refresh(1) and not refresh(0) and tree(folder) == before  # repeated
    (root / "0.caf").unlink()
    (root / "1.caf").write_bytes(made.caf([("category", "Drums"), ("genre", "new")]))  # another length
    (root / "2.caf").write_bytes(made.caf([("category", "Drums"), ("genre", "G2")]))  # another time
    os.utime(root / "2.caf", (time.time() + 9, time.time() + 9))
    (root / "7.caf").write_bytes(made.caf([("category", "Drums"), ("genre", "g7")]))
    assert refresh(2)
    assert opened == [[*(f"{i}.caf" for i in range(6)), "bad.caf"], ["1.caf", "2.caf", "7.caf"]]
    want = {"1.caf": ("new", "of new"), "2.caf": ("G2", "of G2"), "7.caf": ("g7", "of g7")} | {f"{i}.caf": (f"g{i}", f"of g{i}") for i in (3, 4, 5)}
    assert state() == want
    assert refresh(3) and opened[-1] == [] and state() == want  # nothing has changed
    assert saved.batches(spark, folder) == [2, 3]
    assert {int(n) for n in os.listdir(f"{folder}/tags")} == {2, 3} and not os.listdir(f"{folder}/reading")


def test_a_failed_save_is_not_seen_and_can_be_repeated(spark, library):
    root, folder = library
    saved.refresh(folder, 1, files.listing(spark, str(root)))
    before = rows_of(spark, folder, "tags")
    (root / "0.caf").unlink()
    (root / "8.caf").write_bytes(made.caf())
    broken = F.udf(lambda p: 1 / 0, "double")

    def fails(got):
        return got.select("path", broken("path").alias("rank"))

    with pytest.raises(Exception, match="division by zero"):
        saved.refresh(folder, 2, files.listing(spark, str(root)), fails)
    assert saved.batches(spark, folder) == [1] and rows_of(spark, folder, "tags") == before
    assert saved.refresh(folder, 2, files.listing(spark, str(root)))
    assert len(rows_of(spark, folder, "tags")) == 6
