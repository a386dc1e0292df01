"""Byte formats: malformed files are rows, and edits survive a round trip."""

import struct

import pytest

from pyspark.sql import functions as F

from cadenza.functions.tags import natural_key
from cadenza.operators.midi import paired_notes
from cadenza.sources import containers as c, files, rewrite, smf

PAIRS = [("category", "Drums"), ("key signature", "Bb"), ("category", "Bass"), ("beat count", "8")]


def caf_chunk(name, data, size=None):
    return name + (struct.pack(">Q", len(data)) if size is None else size) + data


def caf(pairs=PAIRS, extra=b"", tail=None):
    text = b"".join(k.encode() + b"\0" + v.encode() + b"\0" for k, v in pairs)
    desc = struct.pack(">d4sIIIII", 44100.0, b"lpcm", 0, 4, 1, 2, 16)
    wrong = caf_chunk(b"uuid", b"\1" * 20)
    meta = caf_chunk(b"uuid", c.METADATA_UUID + struct.pack(">I", len(pairs)) + text)
    return b"caff\0\1\0\0" + caf_chunk(b"desc", desc) + wrong + meta + extra + (tail if tail is not None else caf_chunk(b"data", b"\0" * 44))


def aiff_chunk(name, data):
    return name + struct.pack(">I", len(data)) + data + b"\0" * (len(data) % 2)


def slot(s):
    return s[:49].ljust(50, b"\0")


def aiff(form=b"AIFF", basc=True, category=b"Drums", words=(b"Dry", b"", b"Part"), extra=b""):
    cate = b"\0" * 4 + slot(category) + slot(b"Hi-hat") + slot(b"Funk") + slot(b"") + b"\5" * 16 + struct.pack(">H", len(words)) + b"".join(map(slot, words))
    comm = struct.pack(">HIH", 2, 88200, 16) + bytes.fromhex("400eac44000000000000")
    body = aiff_chunk(b"NAME", b"odd") + aiff_chunk(b"COMM", comm) + aiff_chunk(b"cate", cate)
    if basc:
        body += aiff_chunk(b"basc", struct.pack(">IIHHHH", 1, 4, 57, 1, 4, 4) + b"\0" * 68)
    body += extra
    return b"FORM" + struct.pack(">I", len(body) + 4) + form + body


FILES = {
    "short.caf": b"caff\0\1\0\0\0\0\0",
    "other.wav": b"RIFF" + b"\0" * 20,
    "good.caf": caf(),
    "open.caf": caf(tail=caf_chunk(b"data", b"\0" * 44, b"\xff" * 8)),
    "stray.caf": caf(tail=b"\0" * 9),
    "past.caf": caf(extra=caf_chunk(b"free", b"", struct.pack(">Q", 10**6))),
    "huge.caf": caf(extra=caf_chunk(b"free", b"", struct.pack(">Q", 2**63 + 5))),
    "packets.caf": caf(extra=caf_chunk(b"pakt", struct.pack(">QQII", 1, 22050, 0, 0))),
    "plain.caf": b"caff\0\1\0\0" + caf_chunk(b"free", b"1234"),
    "good.aif": aiff(),
    "c.aif": aiff(form=b"AIFC", basc=False),
    "bytes.aif": aiff(category=b"\xff\xfe"),
    "nomidi.aif": aiff(extra=aiff_chunk(b".mid", b"MThd" + b"\0" * 9)),
    "fake.aif": aiff(extra=aiff_chunk(b".mid", b"Mxxx" + b"\0" * 20)),
    "midi.aif": aiff(extra=aiff_chunk(b".mid", b"MThd" + b"\0" * 10)),
    "null.caf": None,
}


@pytest.fixture(scope="module")
def tags(spark):
    rows = [(p, bytearray(b) if b is not None else None) for p, b in FILES.items()]
    read = c.read_containers(spark.createDataFrame(rows, "path string, content binary"))
    return {r.path: r for r in c.tags(read).collect()}


def test_faulty_files_are_rows(tags):
    assert len(tags) == len(FILES)
    errors = {p: r.error_code for p, r in tags.items() if r.error_code}
    assert errors == {
        "short.caf": c.UNRECOGNISED, "other.wav": c.UNRECOGNISED, "null.caf": c.UNRECOGNISED, "stray.caf": c.CORRUPT,
        "past.caf": c.CORRUPT, "huge.caf": c.CORRUPT, "plain.caf": c.NOT_A_LOOP,
    }


def test_caf_fields(tags):
    r = tags["good.caf"]
    assert (r.category, r.key, r.beat_count, r.duration_s) == ("All Drums", "A#", 8, 10 / 44100)  # first pair wins
    assert tags["open.caf"].duration_s == 10 / 44100
    assert tags["packets.caf"].duration_s == 0.5


def test_aiff_fields(tags):
    r = tags["good.aif"]
    assert (r.category, r.subcategory, r.descriptors, r.key, r.mode, r.beat_count, r.duration_s, r.tempo_bpm) == ("All Drums", "Hi-Hat", ["Dry", "Part"], "A", "Minor", 4, 2.0, 120)
    assert (tags["c.aif"].key, tags["c.aif"].beat_count) == ("", 0)
    assert tags["bytes.aif"].category == ""
    assert [tags[p].has_midi for p in ("nomidi.aif", "fake.aif", "midi.aif")] == [False, False, True]


def test_chunk_offsets():
    b = aiff()
    rows = c.chunk_table(b, "aiff")
    assert [r["id"] for r in rows] == ["NAME", "COMM", "cate", "basc"]
    assert [r["has_pad"] for r in rows] == [True, False, False, False]
    last = rows[-1]
    assert last["data_offset"] + last["data_length"] == len(b)


def edit(**fields):
    return {f: fields.get(f) for f in rewrite.FIELDS}


def test_rewritten_caf_keeps_the_rest():
    b = FILES["packets.caf"]
    new = rewrite.rewritten(b, edit(category="FX", key="", descriptors=["Dry", "Part"]))
    out = c.decode(new)
    assert [(p["key"], p["value"]) for p in out["pairs"]] == [("category", "Sound Effect"), ("category", "Bass"), ("beat count", "8"), ("descriptors", "Dry,Part")]
    assert [x["id"] for x in out["chunks"]] == [x["id"] for x in c.decode(b)["chunks"]]
    shot = c.decode(rewrite.rewritten(b, edit(one_shot=True)))
    assert [p["key"] for p in shot["pairs"]] == ["category", "category"]


def test_rewritten_aiff_grows_the_form():
    b = FILES["good.aif"]
    new = rewrite.rewritten(b, edit(descriptors=["é" * 40, "Part", "Dry"], key="Bb", mode="both"))
    assert int.from_bytes(new[4:8], "big") == len(new) - 8
    out = c.decode(new)
    assert out["cate"]["descriptors"] == ["Part", "Dry"]  # a slot of 49 bytes splits the last é
    assert (out["basc"]["key_midi"], out["basc"]["scale"]) == (0, 4)
    with pytest.raises(LookupError):
        rewrite.rewritten(FILES["c.aif"], edit(key="A"))


def test_scan_skips_hidden_and_other_files(spark, tmp_path):
    for name in ("a.CAF", "b.aiff", "c.txt", ".hidden.caf", "sub/d.aif", ".dir/e.caf"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x")
    got = files.scan(spark, str(tmp_path), str(tmp_path / "sub"))
    assert sorted(r.path.rsplit("/", 1)[1] for r in got.select("path").collect()) == ["a.CAF", "b.aiff", "d.aif"]


def test_a_library_may_lie_in_a_hidden_folder(spark, tmp_path):
    for name in (".data/lib/a.caf", ".data/lib/sub/b.aif", ".data/lib/.trash/c.caf", ".data/lib/.d.caf"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    for root in (f"{tmp_path}/.data/lib", f"file://{tmp_path}/.data/lib/", f"{tmp_path}/.data/*"):
        assert sorted(r.path.rsplit("/", 1)[1] for r in files.scan(spark, root).select("path").collect()) == ["a.caf", "b.aif"]


def test_reading_leaves_the_session_as_it_is(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    c.read_containers(spark.createDataFrame([("a.caf", b"x")], "path string, content binary")).count()
    assert spark.conf.get(key) == before


def test_digit_runs_of_any_length_sort_by_value(spark):
    names = ["a9", "a010", "a10b", "a" + "9" * 20, "a" + "9" * 21, "a1" + "0" * 21, "B1", "b02"]
    rows = spark.createDataFrame([(n,) for n in reversed(names)], "name string").orderBy(natural_key(F.col("name")), "name").collect()
    assert [r.name for r in rows] == names


def midi_file(track, tracks=1):
    return b"MThd" + struct.pack(">IHHH", 6, 0, tracks, 480) + b"MTrk" + struct.pack(">I", len(track)) + track


def test_running_status_and_velocity_zero():
    track = bytes([0, 0x90, 60, 64, 0x83, 0x60, 60, 0, 10, 0xFF, 1, 2, 65, 66, 0, 0x90, 62, 1, 5, 0x80, 62, 0, 0, 0xFF, 0x2F, 0])
    got = smf.events(midi_file(track))
    assert [(e[2], e[3], e[5]) for e in got] == [(0, "on", 60), (480, "off", 60), (10, "other", None), (0, "on", 62), (5, "off", 62), (0, "other", None)]


@pytest.mark.parametrize("b", [b"MThd", midi_file(bytes([0, 60, 64])), midi_file(bytes([0, 0x90, 60])), midi_file(bytes([0x81])), midi_file(bytes([0x83] * 10 + [0, 0x90, 60, 64]))])
def test_malformed_midi_has_no_events(b):
    assert smf.events(b) is None


def test_one_malformed_file_does_not_end_the_job(spark):
    good = midi_file(bytes([0, 0x90, 60, 64, 5, 0x80, 60, 0]))
    late = midi_file(bytes([0xFF] * 8 + [0x7F, 0x90, 60, 64] + [0xFF] * 8 + [0x7F, 0x80, 60, 0]))  # each delta fits, their sum does not
    rows = [(1, midi_file(bytes([0xFF] * 12 + [0, 0x90, 60, 64]))), (2, good), (3, None), (4, late)]
    events = smf.midi_events(spark.createDataFrame(rows, "loop_id long, smf binary"))
    assert sorted({r.loop_id for r in events.collect()}) == [2, 4]
    assert [r.loop_id for r in paired_notes(events).collect()] == [2]


def test_unknown_status_ends_the_track():
    assert smf.events(midi_file(bytes([0, 0x90, 60, 64, 0, 0xF1, 0, 0x80, 60, 0]))) == [(0, 0, 0, "on", 0, 60)]


@pytest.mark.parametrize(("raw", "value"), [("400eac44000000000000", 44100.0), ("0" * 20, 0.0), ("c00eac44000000000000", -44100.0), ("3fff8000000000000000", 1.0)])
def test_extended(raw, value):
    assert c.extended(bytes.fromhex(raw)) == value
