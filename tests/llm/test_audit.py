"""op11, op12 and op13 against brute force and their SQL, with the cases that the contracts name."""

import gzip
import hashlib
import io
import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from math import floor

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cadenza.llm import divergence, filter_audit, queries, sql, warc
from cadenza.llm.common import delete, new_folder, scratch

SF = "/root/testdata/sf0.001"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_warc", "op13_filter_audit"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = getattr(queries, name)(spark, SF), con.execute(sql.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


# op11


def brute_divergence(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(CAPITALS, CAPITALS.lower())))) for text, lang, source in rows]
    groups, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        groups[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang in df | {lang: None for lang, _ in groups}:
        kept = {w for w, n in df[lang].items() if n >= least}
        counts = {s: {w: c[w] for w in kept} for (la, s), c in groups.items() if la == lang}
        whole = {w: sum(c[w] for c in counts.values()) for w in kept}

        def share(c, kept=kept):
            total = sum(c.values()) + 2 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 2) // total for w in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s, c in counts.items():
            pairs = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in counts if o != s]
            over = [(f(p[s][w], q[w]), w) for w in kept if c[w] > 0 and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", over)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


@pytest.fixture(scope="module")
def sourced():
    random.seed(3)
    words = ["Le", "le", "été", "ÉTÉ", "x1y", "naïve", "word", "wörd", "日本", "a-b", "z"] + [f"t{chr(97 + i)}" for i in range(12)]
    rows = [(" ".join(random.choices(words, k=random.randint(0, 30))), random.choice(["en", "fr", None]), random.choice(["s1", "s1", "s1", "é", "s2", None, ""])) for _ in range(150)]
    rows += [(None, "de", "lone"), ("", "it", "p"), (" 12 \x7f ", "it", "q"), ("le " * 40_000, "en", "long"), ("only here", "en", "s9"), (None, None, None)]
    return [*rows, rows[0], rows[0], rows[-4]]


@pytest.mark.parametrize("terms,sources,entries", [(2048, 64, 400_000), (5, 2, 20)])
def test_divergences_equal_brute_force(spark, sourced, monkeypatch, terms, sources, entries):
    """Also with many small blocks, so that pairs of sources meet across them, and with count tables handed on often."""
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    df = spark.createDataFrame([(*r, "t", 1) for r in sourced], "text string, lang string, source string, term string, n int")
    got = divergence.divergences(df, least=8, top=4)
    assert sorted(map(tuple, got.collect())) == brute_divergence(sourced, 8, 4)
    delete(spark, got.inputFiles()[0].rsplit("/", 1)[0])


def test_divergences_of_nothing_and_of_one_source(spark):
    schema = "text string, lang string, source string"
    assert divergence.divergences(spark.createDataFrame([], schema)).count() == 0
    alone = divergence.divergences(spark.createDataFrame([("a b", "en", "s")] * 12, schema))
    assert alone.count() == 0  # no other source, and no share above the language's


def test_shares_and_differences_are_exact_beyond_63_bits(spark):
    c, total, terms = 9_123_456_789_012, 18_000_000_000_123, 77_777_777
    row = spark.range(1).select(divergence.share(F.lit(c), F.lit(total), F.lit(terms)).alias("p")).collect()[0]
    assert row.p == 1 + 10**9 * (c + 2) // (total + 2 * terms)
    p, q = 999_999_999, 3
    assert spark.range(1).select(divergence.difference(F.lit(p).cast("long"), F.lit(q).cast("long")).alias("f")).collect()[0].f == floor((p - q) ** 2 // (p + q))


# op12


def url_key_of(url):
    if url is None:
        return ""
    if "://" not in url:
        return url
    rest = url.split("://", 1)[1].split("#", 1)[0]
    host = re.match(r"[^/?]*", rest)[0]
    return ",".join(reversed(host.translate(str.maketrans(CAPITALS, CAPITALS.lower())).split("."))) + ")" + (rest[len(host) :] or "/")


def brute_captures(rows):
    least = {}
    for page, _, html in rows:
        h = html or ""
        if len(h.encode()) >= 100 and page is not None:
            least[h] = min(page, least.get(h, page))
    out = []
    for page, url, html in rows:
        h = html or ""
        first = least.get(h) if page is not None and page > least.get(h, page) else None
        out.append((page, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "response" if first is None else "revisit", first, url_key_of(url)))
    return out


@pytest.fixture(scope="module")
def pages():
    random.seed(4)
    long_, copied = "<p>é" * 300_000, "<html>" + "copy " * 40
    urls = ["http://A.Example.com/x?b=1#t", "https://b.example.com", "http://a.example.com/", "no url", None, "", "http://x\r\nWARC-Type: y/z\n", "ftp://ü.org/ü?ä", "http://a.example.com/?q"]
    rows = [(i * 3 % 71, random.choice(urls), random.choice([copied, copied, f"<i>{i}</i>" * 40, "x" * 99, "y" * 100, None, "", "two\r\n\r\nparts" * 20])) for i in range(70)]
    rows += [(500, "http://l.org/a", long_), (400, "http://l.org/a", long_), (None, "http://n.org", copied), (None, None, None)]
    return [*rows, rows[3], rows[0], (400, "http://l.org/b", long_)]


def test_captures_equal_brute_force(spark, pages):
    df = spark.createDataFrame([(*r, "d", 0) for r in pages], "page_id long, url string, html string, payload_digest string, offset int").repartition(5)
    got = warc.captures(df, F.lit("2024-01-01T00:00:00Z"))
    rows = got.collect()
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key"]
    want = brute_captures(pages)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in rows) == sorted(map(repr, want))
    order = [(r["url_key"].encode(), -(2**63) if r["page_id"] is None else r["page_id"]) for r in sorted(rows, key=lambda r: r["place"])]
    assert order == sorted(order)
    assert sorted(r["place"] for r in rows) == [*range(1, len(pages) + 1)]


def test_archives_hold_what_was_written(spark, pages):
    """Several archives a task; gzip's own reader finds the records in the order of the index, and the index leads to each."""
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2)
    with scratch(spark, "warc-test") as own:
        folder = f"{own.folder}/archives"
        typed = own.keep(warc.with_types(df, "page_id", "url", "html", F.lit("2024")), "typed")
        spark._jvm.java.io.File(folder.removeprefix("file:")).mkdirs()
        runs = own.keep(warc.write_archives(typed, folder, archive_bytes=2_000), "runs")
        index = runs.collect()
        assert len({r["archive"] for r in index}) > 3
        for r in index:
            with open(f"{folder.removeprefix('file:')}/{r['archive']}", "rb") as f:
                f.seek(r["offset"])
                headers, block = warc.parsed(gzip.decompress(f.read(r["length"])))
            assert headers["warc-payload-digest"] == "sha256:" + r["payload_digest"]
            if headers["warc-type"] == "response":
                assert hashlib.sha256(block.split(b"\r\n\r\n", 1)[1]).hexdigest() == r["payload_digest"]
        read = warc.read_archives(runs, folder)
        assert read.count() == len(pages) == len(index)


def test_a_cut_archive_is_an_error():
    member = warc._member(warc.page_record(1, "u", "d", "x", None, b"payload" * 50))
    assert [o for o, _ in warc.records(io.BytesIO(member * 3))] == [0, len(member), 2 * len(member)]
    with pytest.raises(ValueError, match="ends in a record"):
        list(warc.records(io.BytesIO(member + member[:-20])))


@given(st.lists(st.lists(st.integers(0, 9)), max_size=9))
@settings(max_examples=200, deadline=None)
def test_loser_tree_merges(runs):
    sources = [[(x, i) for x in sorted(r)] for i, r in enumerate(runs)]
    assert list(warc.LoserTree([iter(s) for s in sources])) == sorted(x for s in sources for x in s)


@pytest.mark.parametrize("fan_in,range_rows", [(64, 1_000_000), (2, 7), (3, 50)])
def test_runs_merge_in_passes_and_ranges(spark, fan_in, range_rows):
    """A third of the rows have one URL key; ranges cut through it."""
    random.seed(6)
    rows = [(random.choice(["hot", "hot", f"k{random.randint(0, 40)}"]), str(random.randint(0, 5)), random.randint(0, 9), "d", f"a{i % 7}", i, 1) for i in range(300)]
    with scratch(spark, "merge-test") as own:
        runs = own.keep(spark.createDataFrame(rows, warc.INDEX).repartition(9, "archive").sortWithinPartitions(*warc.ORDER), "runs", **warc.SMALL_GROUPS)
        got = warc.merge_runs(runs, own, fan_in, range_rows).orderBy("place").collect()
    assert [tuple(r)[:-1] for r in got] == sorted(rows)
    assert [r["place"] for r in got] == [*range(1, 301)]


def test_no_pages(spark):
    assert warc.captures(spark.createDataFrame([], "page_id long, url string, html string"), F.lit("2024")).count() == 0


# op13


def brute_audit(rows, labels):
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    good, toxic = {d for d, g, _ in labels if g == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    parts = defaultdict(list)
    for doc, text, source in rows:
        t = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        failed = {n for n, x in (("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)), ("C", 100 * sum(c in CAPITALS for c in t) > 5 * len(t)), ("D", bool(set("#$%&*|") & set(t))), ("E", doc is not None and doc > least.get(t, doc))) if x}
        parts[source or ""].append((failed, doc in good, doc in toxic))
    out = []
    for part, docs in parts.items():
        total = Counter()
        mine = []
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                before = set(order[:k])
                removed = [d for d in docs if f in d[0] and not d[0] & before]
                total[f] += len(removed)
                mine.append([part, order, k + 1, sum(not d[0] & (before | {f}) for d in docs), len(removed), sum(f in d[0] and bool(d[0] & before) for d in docs), sum(d[0] == {f} for d in docs), sum(d[1] for d in removed), sum(d[2] for d in removed)])
        out += [(*m, total[m[1][m[2] - 1]]) for m in mine]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    random.seed(8)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(random.choices(words[: random.choice([30, 300])], k=random.choice([20, 49, 50, 51, 90]))) for _ in range(40)]
    texts = [random.choice([t, t.upper(), t + " #1", t.replace(" ", "\x0b"), t.title()]) for t in texts]
    rows = [(i, random.choice(texts), random.choice(["s", "s", "t", "", None])) for i in range(120)]
    rows += [(900, None, "s"), (901, "", "s"), (902, " \t", None), (903, "é" * 50_000 + " W" * 50_000, "t"), (None, texts[0], "s"), (None, None, "null"), (7, "other text of a known id", "s")]
    rows += [rows[3], rows[3], rows[60], rows[-3]]
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 0, 1])) for i in range(0, 130, 2)] + [(4, 1, 1), (4, 1, 1), (None, 1, 1), (0, 1, 0)]
    docs = spark.createDataFrame([(*r, "p", 1, "k") for r in rows], "doc_id long, text string, source string, part string, doc int, filter string")
    got = filter_audit.audit(docs, spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, text string"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)


def test_audit_of_nothing_and_without_labels(spark):
    docs, labels = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], labels)
    assert filter_audit.audit(spark.createDataFrame([], docs), none).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, "words " * 3, "s")], docs), none).toPandas()
    assert len(one) == 600 and one["good_lost"].sum() == 0
    assert one.groupby("filter_order")["removed"].sum().eq(1).all()


def test_operators_leave_their_result_only_and_the_settings_as_found(spark):
    where = new_folder(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    listed = lambda: set(pd.Series(__import__("os").listdir(where)))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, setting = listed(), spark.conf.get(key, None)
    divergence.divergences(spark.createDataFrame([("a", "en", "s"), ("b", "en", "t")], "text string, lang string, source string"))
    warc.captures(spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string"), F.lit("2024"))
    filter_audit.audit(spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string"), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert sorted(re.sub("-[0-9a-f]{32}$", "", x) for x in listed() - before) == ["divergence-result", "filter-audit-result", "warc-result"]
    assert spark.conf.get(key, None) == setting
