"""Files read by range and by path: what is fetched, and that it says the same as whole files."""

import struct

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import test_containers as made
from cadenza.sources import containers as c, files, ranges, rewrite


class Source:
    def __init__(self, b):
        self.b, self.at, self.reads = b, 0, []

    def size(self):
        return len(self.b)

    def seek(self, at):
        self.at = at

    def read(self, n):
        self.reads.append((self.at, n))
        return self.b[self.at : self.at + n]


@given(st.binary(max_size=200), st.lists(st.tuples(st.integers(0, 220), st.integers(0, 220)), max_size=6), st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_ranges_are_like_bytes(b, parts, block):
    r = ranges.Ranges(Source(b), block)
    assert len(r) == len(b)
    for i, j in parts:
        assert r[i:j] == b[i:j] and r[:j] == b[:j]
        assert r.find(0, i) == b.find(0, i)
    assert r.fetched <= len(b)  # no block twice


def test_neighbouring_blocks_are_fetched_at_once():
    s = Source(bytes(100))
    r = ranges.Ranges(s, 10)
    assert r[35:38] == bytes(3) and r[5:72] == bytes(67)
    assert s.reads == [(30, 10), (0, 30), (40, 40)]


AUDIO = bytes(3_000_000)
FILES = made.FILES | {
    "long.caf": made.caf(tail=made.caf_chunk(b"data", AUDIO) + made.caf_chunk(b"midi", b"MThd" + bytes(20))),
    "long#1 é %41.aif": made.aiff(extra=made.aiff_chunk(b"SSND", AUDIO + b"x") + made.aiff_chunk(b".mid", b"MThd" + bytes(20))),
    "open long.caf": made.caf(tail=made.caf_chunk(b"data", AUDIO, b"\xff" * 8)),
    "uncounted.caf": made.caf(tail=b"").replace(struct.pack(">I", len(made.PAIRS)) + b"category", struct.pack(">I", 9) + b"category"),
}
FILES = {n: b for n, b in FILES.items() if b is not None and n != "other.wav"}


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    root = tmp_path_factory.mktemp("lib")
    for name, b in FILES.items():
        (root / name).write_bytes(b)
    return root


def test_tags_by_range_equal_those_of_whole_files(spark, library):
    listed = files.listing(spark, str(library))
    assert "content" not in listed.columns
    by_range = c.read_by_range(listed)
    whole = c.read_containers(files.scan(spark, str(library)))
    assert by_range.count() == len(FILES)
    assert sorted(map(repr, by_range.drop("bytes_read").collect())) == sorted(map(repr, whole.collect()))
    assert sorted(map(repr, c.tags(by_range).collect())) == sorted(map(repr, c.tags(whole).collect()))


def test_audio_stays_where_it_is(spark, library):
    read = {r.path.rsplit("/", 1)[1]: r for r in c.read_by_range(files.listing(spark, str(library))).collect()}
    for name in ("long.caf", "long#1 é %41.aif", "open long.caf"):
        assert len(FILES[name]) > 2_900_000 and read[name].bytes_read < 64 << 10
    assert read["long.caf"].smf and read["long#1 é %41.aif"].smf
    assert all(r.bytes_read <= len(FILES[n]) for n, r in read.items())


def test_listing_reads_no_contents(spark, library):
    plan = files.listing(spark, str(library))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_a_file_that_is_gone_is_a_row(spark, library):
    listed = files.listing(spark, str(library)).select(F.concat("path", F.lit(".gone")).alias("path"))
    rows = c.tags(c.read_by_range(listed)).collect()
    assert {r.error_code for r in rows} == {c.UNREADABLE} and len(rows) == len(FILES)
    assert {r.error_code for r in rewrite.rewrite_paths(listed.select("path", *(F.lit(None).cast("array<string>" if f == "descriptors" else "boolean" if f == "one_shot" else "string").alias(f) for f in rewrite.FIELDS))).collect()} == {c.UNREADABLE}


def test_only_edited_files_are_opened(spark, tmp_path):
    """100 files, 3 edits: the others could not be opened any more."""
    for i in range(100):
        (tmp_path / f"loop {i:02}.caf").write_bytes(made.caf([("category", "Drums"), ("genre", f"g{i}")]))
    found = files.listing(spark, str(tmp_path))
    listed = spark.createDataFrame(found.collect(), found.schema)  # Spark's own scan asks for the status of each file again
    edits = spark.createDataFrame([(f"loop {i:02}.caf", None, None, "new", None, None, None, None) for i in (3, 50, 99)], "name string, category string, subcategory string, genre string, descriptors array<string>, key string, mode string, one_shot boolean")
    rows = listed.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(edits, "name")
    for i in range(100):
        if i not in (3, 50, 99):
            (tmp_path / f"loop {i:02}.caf").unlink()
    done = rewrite.rewrite_paths(rows).collect()
    assert len(done) == 3 and all(r.error_code is None for r in done)
    assert {p["value"] for r in done for p in c.decode(bytes(r.new_content))["pairs"]} == {"Drums", "new"}


@pytest.mark.parametrize("content_bytes", [1, 2500, 1 << 30])
def test_contents_come_for_a_list_of_paths(spark, tmp_path, content_bytes):
    want = {}
    for i in range(20):
        (tmp_path / f"{i}.caf").write_bytes(bytes([i]) * 1000)
        want[f"{i}.caf"] = (i, bytes([i]) * 1000, None)
    paths = files.listing(spark, str(tmp_path)).select("path", F.regexp_extract("path", r"(\d+)\.caf$", 1).cast("int").alias("n"), F.array(F.lit("w")).alias("words"))
    paths = spark.createDataFrame(paths.collect(), paths.schema)
    gone = paths.limit(1).withColumns({"path": F.concat("path", F.lit("x")), "n": F.lit(-1)})
    nowhere = gone.withColumns({"path": F.lit(None).cast("string"), "n": F.lit(-2)})
    rows = files.fetched(paths.unionByName(gone).unionByName(nowhere).coalesce(1), content_bytes).collect()
    assert {r.path.rsplit("/", 1)[1]: (r.n, bytes(r.content), r.read_error) for r in rows if r.n >= 0} == want
    assert sorted((r.n, r.content, bool(r.read_error), r.words) for r in rows if r.n < 0) == [(-2, None, True, ["w"]), (-1, None, True, ["w"])]


@pytest.mark.parametrize(("path", "uri"), [("file:/a b/c#1.caf", "file:///a%20b/c%231.caf"), ("/x%y", "file:///x%25y"), ("hdfs://nn:8020/a", "hdfs://nn:8020/a"), ("s3a://bucket/a?b", "s3://bucket/a%3Fb"), ("file:///a", "file:///a")])
def test_uris(path, uri):
    assert ranges.uri_of(path) == uri
