"""Folders listed, and libraries removed, by tasks: the same rows as Spark's own scan, and nothing that grows with the files on the driver."""

import os

import pytest

from cadenza.plans.queries import QUERIES
from cadenza.sources import files
from cadenza.sources.shared import emptied, out_folder, settled

TREE = [
    "a.caf", "b.AIF", "c.aiff", "d.wav", "empty.caf", ".hidden.caf", "_left.caf", "_kept=1.caf", "copied.caf._COPYING_", "odd #1 é %41?.caf", "pack 1/a:b.caf",
    "pack 1/x.caf", "pack 1/deep/er/still/y.aif", ".cache/z.caf", "pack 1/.cache/z.caf", "_left/z.caf", "_metadata/m.caf", "k=1/z.caf", "pack 1/folder.caf/in.caf",
]


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    root = tmp_path_factory.mktemp("listed") / ".lib"
    for i, name in enumerate(TREE):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if name.startswith("empty") else b"x" * (i + 1))
        os.utime(root / name, ns=(0, 1_700_000_000_123_999_999 + i * 10**9 if i else -1))
    (root / "linked.caf").symlink_to(root / "a.caf")
    (root / "linked").symlink_to(root / "pack 1" / "deep")
    (root / "nowhere.caf").symlink_to(root / "gone")
    return root


def rows(df):
    return sorted(map(repr, df.select("path", "modificationTime", "length").collect()))


ROOTS = [[""], ["", "/pack 1", "/.cache"], ["/pack*", "/k=1", "/pack 1/deep"], ["/a.caf", "/_left", "/pack 1"], ["/a.caf"], ["/d.wav", "/_left.caf"]]


@pytest.mark.parametrize("roots", ROOTS, ids=str)
def test_listing_has_the_rows_of_sparks_scan(spark, library, roots):
    roots = [f"{library}{r}" for r in roots]
    want = rows(files.once(files.scan(spark, *roots)))
    assert rows(files.listing(spark, *roots)) == want and (want or "d.wav" in roots[0])
    assert not any("empty" in r or "z.caf" in r and "/.cache" in r and not any(x.endswith(".cache") for x in roots) for r in want)


def test_a_root_that_is_not_there_raises(spark, library):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.listing(spark, str(library / "nothing"))


def test_the_driver_has_tables_instead_of_files(spark, tmp_path):
    for i in range(600):
        (tmp_path / f"{i}.caf").write_bytes(b"x")
    listed = files.listing(spark, str(tmp_path), work=out_folder(spark, "listing"))
    tables = listed.inputFiles()
    assert all(t.endswith(".parquet") for t in tables) and len(tables) <= files.LISTED * spark.sparkContext.defaultParallelism + 1
    assert len(tables) > 8  # one folder, and yet its files are dealt out
    before = rows(listed)
    for i in range(300):
        (tmp_path / f"{i}.caf").unlink()
    assert len(before) == 600 and rows(listed) == before  # as it was found


def test_a_store_that_only_spark_reaches_is_listed(spark, library):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.listed.link./in", f"file://{library}")
    root = "viewfs://listed/in"
    assert rows(files.listing(spark, root)) == rows(files.scan(spark, root)) != []


def test_names_that_are_no_text_are_rows(spark, tmp_path):
    with open(os.fsencode(tmp_path) + b"/\xff.caf", "wb") as f:
        f.write(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in files.listing(spark, str(tmp_path)).collect()] == ["�.caf"]


def test_tasks_remove_files_and_follow_no_links(spark, tmp_path):
    root, other = tmp_path / "many", tmp_path / "other"
    for name in ("a/b/c/1", "a/2", "3", ".h/4"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x")
    other.mkdir()
    (other / "kept").write_bytes(b"x")
    (root / "link").symlink_to(other)
    emptied(spark, f"file://{root}")
    assert not [f for _, _, fs in os.walk(root) for f in fs] and (other / "kept").exists() and (root / "a/b/c").is_dir()
    assert settled(spark.range(3), "few", str(other), many=str(root)).count() == 3 and not root.exists() and not other.exists()


@pytest.mark.parametrize("name", ["s12_saved_again", "s13_rewritten", "s12_saved", "s8_tags", "s1_scan", "s4_chunks"])
def test_queries_leave_listing_and_removal_to_tasks(spark, monkeypatch, name):
    def scan(*_):
        raise AssertionError("files listed on the driver")

    monkeypatch.setattr(files, "scan", scan)
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    left = set(os.listdir(shared)) - before
    assert got.count() and len(left) == 1 and got.inputFiles()[0].rsplit("/", 2)[1] in left
