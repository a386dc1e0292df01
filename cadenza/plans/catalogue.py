"""Queries of sources, projections, vocabulary joins and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import tags as t, vocabulary as v
from ..operators import edits as e, ranking
from ..sources import containers, files, rewrite, saved, smf
from . import keys
from .adapters import Tables, ascii_, be, chunk, path_in, query, written
from ..sources.shared import out_folder, settled

L = F.col

PATHS = """SELECT loop_id, concat('/lib/', CASE WHEN loop_id % 17 = 0 THEN '.cache/' ELSE '' END, pack, '/', CASE WHEN loop_id % 13 = 0 THEN '._' ELSE '' END,
  file_name, CASE WHEN loop_id % 11 = 0 THEN '.bak' ELSE '' END) AS path FROM {loops} l"""


@query("s1_scan", f"SELECT loop_id, path FROM ({PATHS}) p WHERE regexp_matches(lower(path), '\\.(caf|aif|aiff)$') AND NOT regexp_matches(path, '(^|/)\\.')")
def s1(x: Tables) -> DataFrame:
    """Of a folder that holds files of all these paths, hidden ones and others too, those that are listed."""
    paths = x.sql(PATHS)
    root, work = written(x.dealt(paths).select("path", F.lit(b"x").alias("content"))), out_folder(x.spark, "listing")
    return settled(files.listing(x.spark, root, work=work).select(path_in(root).alias("path")).join(paths, "path").select("loop_id", "path"), "s1", work, many=root)


@query("s2_once", f"SELECT DISTINCT path FROM ({PATHS}) p")
def s2(x: Tables) -> DataFrame:
    paths = x.sql(PATHS).select("path", "loop_id")
    return files.once(paths.unionByName(paths.where("loop_id % 2 = 0"))).select("path")


@query("s3_container", """SELECT l.loop_id, CASE WHEN error_code = 'unrecognized_container' THEN NULL ELSE container END AS container,
  CASE WHEN error_code = 'unrecognized_container' OR container = 'caf' THEN NULL WHEN l.loop_id % 5 = 0 THEN 'AIFC' ELSE 'AIFF' END AS form_type
  FROM {loops} l JOIN {faults} f ON l.loop_id = f.loop_id""")
def s3(x: Tables) -> DataFrame:
    return x.files.select("loop_id", files.container(L("content")).alias("container"), files.form_type(L("content")).alias("form_type"))


def _read(x: Tables) -> DataFrame:
    """The files' fields with their loops."""
    return containers.read_containers(x.files).join(x.paths, "path")


def _library(x: Tables) -> tuple[str, str, DataFrame]:
    """A folder with the loops' files, one with their listing, and what is read of the files by range."""
    root, work = written(x.files), out_folder(x.spark, "listing")
    return root, work, containers.read_by_range(files.listing(x.spark, root, work=work)).withColumn("path", path_in(root))


@query("s4_chunks", """SELECT l.loop_id, CASE WHEN container = 'caf' THEN
    concat('desc', CASE WHEN l.loop_id % 4 = 0 THEN '|pakt' ELSE '' END, CASE WHEN l.loop_id % 12 = 0 OR l.loop_id % 83 = 0 THEN '|uuid' ELSE '' END, CASE WHEN l.loop_id % 83 <> 0 THEN '|uuid' ELSE '' END,
      CASE WHEN l.loop_id % 3 <> 2 THEN '|midi' ELSE '' END, '|data')
  ELSE concat('NAME|COMM', CASE WHEN l.loop_id % 83 <> 0 THEN '|cate' ELSE '' END, CASE WHEN l.loop_id % 7 <> 0 THEN '|basc' ELSE '' END, CASE WHEN l.loop_id % 3 <> 2 THEN '|.mid' ELSE '' END) END AS ids,
  CAST(CASE WHEN container = 'caf' THEN 0 ELSE 1 + CASE WHEN l.loop_id % 3 = 1 THEN 1 ELSE 0 END END AS BIGINT) AS padded,
  CAST(CASE WHEN container = 'caf' THEN 4 + 4 * (l.loop_id % 50) ELSE 18 END AS BIGINT) AS sound_length
  FROM {loops} l JOIN {faults} f ON l.loop_id = f.loop_id WHERE error_code IS NULL OR error_code = 'not_a_loop'""")
def s4(x: Tables) -> DataFrame:
    root, work, read = _library(x)
    rows = containers.chunk_rows(read).join(x.paths, "path")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_ix", "id"))), lambda c: c["id"]), "|")
    length = F.max(F.when(L("id").isin("data", "COMM"), L("data_length")))
    return settled(rows.groupBy("loop_id").agg(ids.alias("ids"), F.sum(L("has_pad").cast("bigint")).alias("padded"), length.alias("sound_length")), "s4", work, many=root)


FLAT_TEXT = """CASE WHEN loop_id % 4 = 2 THEN CASE key_ WHEN 'C#' THEN 'Db' WHEN 'D#' THEN 'Eb' WHEN 'F#' THEN 'Gb' WHEN 'G#' THEN 'Ab' WHEN 'A#' THEN 'Bb' ELSE key_ END ELSE key_ END"""
WORDS = "SELECT loop_id, string_agg(descriptor, ' ,' ORDER BY descriptor) AS words FROM {loop_descriptors} GROUP BY loop_id"


@query("s5_pairs", f"""WITH w AS ({WORDS}), s AS (SELECT d.*, l.category AS stored_category, l.scale_code, coalesce(w.words, '') AS words FROM {{disk}} d JOIN {{loops}} l ON l.loop_id = d.loop_id LEFT JOIN w ON w.loop_id = d.loop_id),
  p AS (SELECT loop_id, 1 AS o, 'category' AS key, stored_category AS value FROM s WHERE container = 'caf' UNION ALL SELECT loop_id, 2, 'subcategory', stored_subcategory FROM s WHERE container = 'caf'
  UNION ALL SELECT loop_id, 3, 'genre', genre FROM s WHERE container = 'caf' UNION ALL SELECT loop_id, 4, 'descriptors', words FROM s WHERE container = 'caf'
  UNION ALL SELECT loop_id, 5, 'key signature', {FLAT_TEXT} FROM s WHERE container = 'caf'
  UNION ALL SELECT loop_id, 6, 'key type', CASE scale_code WHEN 0 THEN 'any' WHEN 1 THEN 'minor' WHEN 2 THEN 'major' WHEN 3 THEN 'neither' WHEN 4 THEN 'both' ELSE '' END FROM s WHERE container = 'caf'
  UNION ALL SELECT loop_id, 7, 'beat count', CASE WHEN beat_count > 0 THEN CAST(beat_count AS STRING) ELSE '' END FROM s WHERE container = 'caf')
  SELECT p.loop_id, CAST(row_number() OVER (PARTITION BY p.loop_id ORDER BY o) - 1 AS BIGINT) AS ix, key, value FROM p JOIN {{faults}} f ON f.loop_id = p.loop_id WHERE error_code IS NULL AND value <> ''""")
def s5(x: Tables) -> DataFrame:
    return _read(x).select("loop_id", F.posexplode("pairs").alias("ix", "p")).select("loop_id", L("ix").cast("bigint").alias("ix"), "p.key", "p.value")


@query("s6_cate", """SELECT l.loop_id, l.category, l.subcategory, l.genre, coalesce(w.words, '') AS words FROM {loops} l JOIN {faults} f ON f.loop_id = l.loop_id
  LEFT JOIN (SELECT loop_id, string_agg(descriptor, ', ' ORDER BY descriptor) AS words FROM {loop_descriptors} GROUP BY loop_id) w ON w.loop_id = l.loop_id WHERE container = 'aiff' AND error_code IS NULL""")
def s6(x: Tables) -> DataFrame:
    return _read(x).where("cate is not null").select("loop_id", "cate.category", "cate.subcategory", "cate.genre", t.join_descriptors(L("cate.descriptors")).alias("words"))


@query("s7_basc", """SELECT l.loop_id, beat_count, CAST(key_midi AS BIGINT) AS key_midi, CAST(scale_code AS BIGINT) AS scale_code, CAST(4 AS BIGINT) AS numerator FROM {loops} l JOIN {faults} f ON f.loop_id = l.loop_id
  WHERE container = 'aiff' AND error_code IS NULL AND l.loop_id % 7 <> 0""")
def s7(x: Tables) -> DataFrame:
    rows = _read(x).where("basc is not null")
    return rows.select("loop_id", L("basc.beat_count").alias("beat_count"), *(L(f"basc.{f}").cast("bigint").alias(a) for f, a in (("key_midi", "key_midi"), ("scale", "scale_code"), ("numerator", "numerator"))))


SECONDS = "CASE WHEN container = 'aiff' OR loop_id % 4 = 0 THEN n_frames / 44100.0 WHEN loop_id % 50 > 0 THEN (loop_id % 50) / 44100.0 END"
BEATS = "CASE WHEN container = 'aiff' AND loop_id % 7 = 0 THEN 0 ELSE beat_count END"
TAGS = f"""SELECT d.loop_id, d.container, category, subcategory, stored_subcategory, genre,
  CASE WHEN container = 'aiff' AND d.loop_id % 7 = 0 THEN '' ELSE key_ END AS key,
  CASE WHEN container = 'caf' THEN CASE d.loop_id % 6 WHEN 0 THEN 'Any' WHEN 1 THEN 'Minor' WHEN 2 THEN 'Major' WHEN 3 THEN 'Neither' WHEN 4 THEN 'Both' ELSE '' END WHEN d.loop_id % 7 = 0 THEN '' ELSE mode_ END AS mode,
  CAST({BEATS.replace('loop_id', 'd.loop_id')} AS BIGINT) AS beat_count, d.loop_id % 3 = 0 AS has_midi,
  {SECONDS.replace('loop_id', 'd.loop_id')} AS seconds FROM {{disk}} d"""


@query("s8_tags", f"""SELECT t.loop_id, t.container, t.category, t.subcategory, t.stored_subcategory, t.genre, t.key, t.mode, t.beat_count, coalesce(w.words, '') AS words FROM ({TAGS}) t JOIN {{faults}} f ON f.loop_id = t.loop_id
  LEFT JOIN (SELECT loop_id, string_agg(descriptor, ',' ORDER BY descriptor) AS words FROM {{loop_descriptors}} GROUP BY loop_id) w ON w.loop_id = t.loop_id WHERE error_code IS NULL""")
def s8(x: Tables) -> DataFrame:
    root, work, read = _library(x)
    rows = containers.tags(read).where("error_code is null").join(x.paths, "path")
    return settled(rows.select("loop_id", "container", "category", "subcategory", "stored_subcategory", "genre", "key", "mode", "beat_count", t.join_descriptors(L("descriptors"), ",").alias("words")), "s8", work, many=root)


def _tags(x: Tables) -> DataFrame:
    return containers.tags(containers.read_containers(x.files)).join(x.paths, "path")


@query("s9_has_midi", f"SELECT t.loop_id, has_midi FROM ({TAGS}) t JOIN {{faults}} f ON f.loop_id = t.loop_id WHERE error_code IS NULL")
def s9(x: Tables) -> DataFrame:
    return _tags(x).where("error_code is null").select("loop_id", "has_midi")


@query("s10_duration", f"SELECT t.loop_id, round(CAST(seconds AS DOUBLE), 6) AS seconds FROM ({TAGS}) t JOIN {{faults}} f ON f.loop_id = t.loop_id WHERE error_code IS NULL")
def s10(x: Tables) -> DataFrame:
    return _tags(x).where("error_code is null").select("loop_id", F.round("duration_s", 6).alias("seconds"))


@query("s11_midi_events", "SELECT loop_id, CAST(track AS BIGINT) AS track, seq - 1 AS seq, delta, kind, CAST(CASE WHEN kind = 'other' THEN -1 ELSE channel END AS BIGINT) AS channel, CAST(CASE WHEN kind = 'other' THEN -1 ELSE pitch END AS BIGINT) AS pitch FROM {midi_events} m")
def s11(x: Tables) -> DataFrame:
    events = smf.midi_events(smf_files(x.midi_events))
    musical = L("kind") != "other"
    return events.select("loop_id", L("track").cast("bigint").alias("track"), "seq", "delta", "kind", F.when(musical, L("channel")).otherwise(-1).cast("bigint").alias("channel"), F.when(musical, L("pitch")).otherwise(-1).cast("bigint").alias("pitch"))


def smf_files(events: DataFrame) -> DataFrame:
    """(loop_id, smf): a Standard MIDI File of one track from the events of each loop."""
    byte = lambda n: F.lpad(F.hex(n.cast("bigint")), 2, "0")
    delta = L("delta")
    length = F.concat(*(F.when(delta >= 1 << k, byte(F.shiftright(delta, k).bitwiseAND(127).bitwiseOR(128))).otherwise("") for k in (14, 7)), byte(delta.bitwiseAND(127)))
    on = F.concat(byte(L("channel") + 0x90), byte(L("pitch")), F.lit("40"))
    off = F.when(L("seq") % 2 == 0, F.concat(byte(L("channel") + 0x80), byte(L("pitch")), F.lit("00"))).otherwise(F.concat(byte(L("channel") + 0x90), byte(L("pitch")), F.lit("00")))
    event = F.concat(length, F.when(L("kind") == "on", on).when(L("kind") == "off", off).otherwise("B00101"))
    track = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", event.alias("hex")))), lambda e: e["hex"]), ""))
    head = F.concat(ascii_("MThd"), be(F.lit(6), 4), be(F.lit(0), 2), be(F.lit(1), 2), be(F.lit(480), 2))
    return events.groupBy("loop_id").agg(track.alias("track")).select("loop_id", F.concat(head, ascii_("MTrk"), be(F.octet_length("track"), 4), L("track")).alias("smf"))


@query("s12_saved", "SELECT CASE WHEN error_code IS NULL THEN container END AS container, error_code, count(*) AS files FROM {loops} l JOIN {faults} f ON f.loop_id = l.loop_id GROUP BY ALL")
def s12(x: Tables) -> DataFrame:
    root, folder, work = written(x.files), out_folder(x.spark, "catalogue"), out_folder(x.spark, "listing")
    saved.refresh(folder, 1, files.listing(x.spark, root, work=work))
    ok = saved.saved(x.spark, folder, saved.TAGS).select(L("container").cast("string").alias("container"), F.lit(None).cast("string").alias("error_code"))
    bad = saved.saved(x.spark, folder, saved.FAILURES).select(F.lit(None).cast("string").alias("container"), "error_code")
    return settled(ok.unionByName(bad).groupBy("container", "error_code").agg(F.count("*").alias("files")), "s12", folder, work, many=root)


#: The files at a second save: a tenth are gone, a tenth have been retagged.
GONE, RETAGGED = "loop_id % 10 = 0", "loop_id % 10 = 1"


@query("s12_saved_again", keys.RANKED + f""" SELECT l.loop_id, coalesce(f.error_code, '') AS error_code, CASE WHEN f.error_code IS NOT NULL THEN '' WHEN l.{RETAGGED} THEN 'Strings' ELSE d.category END AS category,
  CASE WHEN f.error_code IS NULL THEN coalesce(r.key, '') ELSE '' END AS suggested FROM {{loops}} l JOIN {{faults}} f ON f.loop_id = l.loop_id JOIN {{disk}} d ON d.loop_id = l.loop_id LEFT JOIN r ON r.loop_id = l.loop_id AND rank = 1 WHERE NOT (l.{GONE})""")
def s12_again(x: Tables) -> DataFrame:
    """A library saved with its suggestions, then changed and saved once more, that batch twice."""
    root, folder, found, *works = written(x.files), *(out_folder(x.spark, n) for n in ("catalogue", "suggestions", "listing", "listing"))
    ranking.suggestions(keys.candidates(x), 1).join(x.paths, "loop_id").select("path", "rank", "key", "mode", "probability").write.parquet(found)  # for both saves
    best = x.spark.read.parquet(found)
    suggest = lambda read: read.select("path", path_in(root).alias("at")).join(best.withColumnRenamed("path", "at"), "at").drop("at")
    saved.refresh(folder, 1, files.listing(x.spark, root, work=works[0]), suggest)
    none = F.lit(None)
    edits = x.paths.where(RETAGGED).select("loop_id", "path", F.lit("Strings").alias("category"), *(none.cast("string").alias(c) for c in ("subcategory", "genre", "key", "mode")), none.cast("array<string>").alias("descriptors"), none.cast("boolean").alias("one_shot"))
    done = rewrite.rewrite(x.files.drop("path").join(edits, "loop_id")).where("new_content is not null")
    written(done.select("path", L("new_content").alias("content")), folder=root)
    still = files.listing(x.spark, root, work=works[1]).withColumn("at", path_in(root)).join(x.paths.where(f"not ({GONE})").select(L("path").alias("at")), "at", "left_semi").drop("at")
    for _ in range(2):
        saved.refresh(folder, 2, still, suggest)
    tags, failures, suggestions = (saved.saved(x.spark, folder, name) for name in (saved.TAGS, saved.FAILURES, saved.SUGGESTIONS))
    rows = tags.select("path", F.lit("").alias("error_code"), "category").unionByName(failures.select("path", "error_code", F.lit("").alias("category")))
    rows = rows.join(suggestions.select("path", L("key").alias("suggested")), "path", "left").withColumn("path", path_in(root)).join(x.paths, "path")
    return settled(rows.select("loop_id", "error_code", "category", F.coalesce("suggested", F.lit("")).alias("suggested")), "s12", folder, found, *works, many=root)


@query("p1_file_name", f"""WITH p AS ({PATHS}), n AS (SELECT loop_id, regexp_extract(path, '([^/]*)$', 1) AS name FROM p)
  SELECT loop_id, name, regexp_replace(name, '\\.[^.]*$', '') AS stem, upper(regexp_extract(name, '\\.([^.]+)$', 1)) AS type FROM n""")
def p1(x: Tables) -> DataFrame:
    return x.sql(PATHS).select("loop_id", t.file_name(L("path")).alias("name"), t.file_stem(L("path")).alias("stem"), t.file_type(L("path")).alias("type"))


@query("p2_one_shot", "SELECT loop_id, beat_count = 0 AS one_shot FROM {loops} l")
def p2(x: Tables) -> DataFrame:
    return x.loops.select("loop_id", t.is_one_shot(L("beat_count")).alias("one_shot"))


BEAT_TEXT = "SELECT loop_id, CASE loop_id % 7 WHEN 0 THEN CAST(beat_count AS STRING) WHEN 1 THEN '+16' WHEN 2 THEN ' 8' WHEN 3 THEN '-4' WHEN 4 THEN 'x' WHEN 5 THEN '' END AS v FROM {loops} l"


@query("p3_beat_count", f"SELECT loop_id, CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN CAST(replace(v, '+', '') AS BIGINT) ELSE 0 END AS beats FROM ({BEAT_TEXT}) b")
def p3(x: Tables) -> DataFrame:
    return x.sql(BEAT_TEXT).select("loop_id", t.beat_count(L("v")).alias("beats"))


TEMPO = "SELECT loop_id, beat_count, CASE WHEN beat_count > 0 AND n_frames > 0 THEN CAST(least(greatest(round(beat_count * 60 / (n_frames / sample_rate)), 0), 999) AS BIGINT) END AS bpm FROM {loops} l"


@query("p4_tempo_bpm", f"SELECT loop_id, coalesce(bpm, -1) AS bpm FROM ({TEMPO}) x")
def p4(x: Tables) -> DataFrame:
    return x.loops.select("loop_id", F.coalesce(t.tempo(L("beat_count"), L("n_frames") / L("sample_rate")), F.lit(-1)).cast("bigint").alias("bpm"))


@query("p5_tempo_label", f"SELECT loop_id, lpad(CAST(coalesce(bpm, 0) AS STRING), 3, '0') AS label FROM ({TEMPO}) x")
def p5(x: Tables) -> DataFrame:
    return x.loops.select("loop_id", t.tempo_label(t.effective_tempo(L("beat_count"), L("n_frames") / L("sample_rate"))).alias("label"))


NAMES_SQL = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"


@query("p6_note_name", f"SELECT l_orderkey, l_linenumber, CASE WHEN n BETWEEN 1 AND 127 AND (n - 48) % 12 >= 0 THEN {NAMES_SQL}[CAST((n - 48) % 12 + 1 AS INT)] ELSE '' END AS name FROM (SELECT l_orderkey, l_linenumber, (l_partkey + l_suppkey) % 140 - 5 AS n FROM lineitem) x")
def p6(x: Tables) -> DataFrame:
    return x.lineitem.select("l_orderkey", "l_linenumber", v.note_name((L("l_partkey") + L("l_suppkey")) % 140 - 5).alias("name"))


KEY_TEXT = f"SELECT loop_id, {FLAT_TEXT} AS k, mode_ FROM {{disk}} d"


@query("p7_note_number", f"SELECT loop_id, CASE WHEN list_position({NAMES_SQL}, k) > 0 THEN 47 + CAST(list_position({NAMES_SQL}, k) AS BIGINT) ELSE 0 END AS note FROM ({KEY_TEXT}) x")
def p7(x: Tables) -> DataFrame:
    return x.sql(KEY_TEXT).select("loop_id", v.note_number(L("k")).alias("note"))


@query("p8_sharps", f"SELECT loop_id, CASE k WHEN 'Db' THEN 'C#' WHEN 'Eb' THEN 'D#' WHEN 'Gb' THEN 'F#' WHEN 'Ab' THEN 'G#' WHEN 'Bb' THEN 'A#' ELSE k END AS key FROM ({KEY_TEXT}) x")
def p8(x: Tables) -> DataFrame:
    return x.sql(KEY_TEXT).select("loop_id", v.sharp_name(L("k")).alias("key"))


@query("p9_scale_name", "SELECT loop_id, mode_ AS scale FROM {disk} d")
def p9(x: Tables) -> DataFrame:
    return x.loops.select("loop_id", v.scale_name(L("scale_code"), v.note_name(L("key_midi")) != "").alias("scale"))


CASED = "SELECT loop_id, CASE WHEN loop_id % 2 = 0 THEN upper(mode_) ELSE concat(mode_, CASE WHEN loop_id % 5 = 0 THEN ' ' ELSE '' END) END AS m FROM {disk} d"


@query("p10_scale_code", f"SELECT loop_id, CAST(CASE lower(m) WHEN 'minor' THEN 1 WHEN 'major' THEN 2 WHEN 'neither' THEN 3 WHEN 'both' THEN 4 ELSE 0 END AS BIGINT) AS code FROM ({CASED}) x")
def p10(x: Tables) -> DataFrame:
    return x.sql(CASED).select("loop_id", v.scale_code(L("m")).alias("code"))


@query("p11_key_type", f"SELECT loop_id, lower(m) AS text, CASE lower(m) WHEN 'any' THEN 'Any' WHEN 'minor' THEN 'Minor' WHEN 'major' THEN 'Major' WHEN 'neither' THEN 'Neither' WHEN 'both' THEN 'Both' ELSE '' END AS scale FROM ({CASED}) x")
def p11(x: Tables) -> DataFrame:
    return x.sql(CASED).select("loop_id", v.key_type(L("m")).alias("text"), v.scale_of_key_type(L("m")).alias("scale"))


@query("p12_scale_label", "SELECT loop_id, CASE WHEN mode_ = 'Both' THEN 'Good for Both' ELSE mode_ END AS label FROM {disk} d")
def p12(x: Tables) -> DataFrame:
    return x.disk.select("loop_id", v.scale_label(L("mode_")).alias("label"))


LIST_TEXT = "SELECT CAST(p_partkey AS BIGINT) AS loop_id, concat(' ', replace(p_name, ' ', ' , '), ',,', p_brand, CASE WHEN p_partkey % 3 = 0 THEN ' ,' ELSE '' END) AS v FROM {part} p"


@query("p13_split", f"SELECT loop_id, array_to_string(list_filter(list_transform(string_split(v, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS words FROM ({LIST_TEXT}) x")
def p13(x: Tables) -> DataFrame:
    return x.sql(LIST_TEXT).select("loop_id", F.array_join(t.split_descriptors(L("v")), "|").alias("words"))


@query("p14_join", "SELECT loop_id, string_agg(descriptor, ', ' ORDER BY descriptor) AS shown, string_agg(descriptor, ',' ORDER BY descriptor) AS stored FROM {loop_descriptors} d GROUP BY loop_id")
def p14(x: Tables) -> DataFrame:
    return x.words.select("loop_id", t.join_descriptors(L("descriptors")).alias("shown"), t.join_descriptors(L("descriptors"), ",").alias("stored"))


@query("p15_shown", "SELECT loop_id, category, subcategory FROM {disk} d")
def p15(x: Tables) -> DataFrame:
    return x.loops.select("loop_id", v.shown_category(L("category")).alias("category"), v.shown_subcategory(L("subcategory")).alias("subcategory"))


@query("p16_stored", "SELECT l.loop_id, l.category, CASE d.subcategory WHEN 'Hi-Hat' THEN 'Hi-hat' WHEN 'Elec Piano' THEN 'Electric Piano' ELSE d.subcategory END AS subcategory FROM {loops} l JOIN {disk} d ON d.loop_id = l.loop_id")
def p16(x: Tables) -> DataFrame:
    return x.disk.select("loop_id", v.stored_category(L("category")).alias("category"), v.stored_subcategory(L("subcategory")).alias("subcategory"))


@query("p17_subcategories", """SELECT loop_id, CAST(CASE category WHEN 'All Drums' THEN 7 WHEN 'Bass' THEN 3 WHEN 'FX' THEN 14 WHEN 'Horn' THEN 14 WHEN 'Strings' THEN 7 ELSE 0 END AS BIGINT) AS n, category NOT IN ('Jingles', 'Other Inst', 'Textures') AS apply_,
  CASE category WHEN 'Bass' THEN 'Acoustic Bass' WHEN 'All Drums' THEN 'Beats' WHEN 'FX' THEN 'Ambience' WHEN 'Horn' THEN 'Bagpipe' WHEN 'Strings' THEN 'Cello' END AS first_ FROM {disk} d""")
def p17(x: Tables) -> DataFrame:
    subs = v.subcategories(L("category"))
    return x.disk.select("loop_id", F.size(subs).cast("bigint").alias("n"), v.subcategories_apply(L("category")).alias("apply_"), F.get(subs, F.lit(0)).alias("first_"))


@query("p18_extended_float", "SELECT loop_id, CAST(8000 + loop_id % 40000 AS DOUBLE) AS rate FROM {loops} l")
def p18(x: Tables) -> DataFrame:
    rate = 8000 + L("loop_id") % 40000
    log = F.floor(F.log2(rate)).cast("int")
    bits = F.concat(be(log + 16383, 2), F.unhex(F.lpad(F.hex(F.expr("shiftleft(8000 + loop_id % 40000, 63 - cast(floor(log2(8000 + loop_id % 40000)) as int))")), 16, "0")))
    body = F.concat(chunk("aiff", "COMM", F.concat(be(F.lit(2), 2), be(F.lit(1), 4), be(F.lit(16), 2), bits)), chunk("aiff", "cate", F.lpad(F.lit(b""), F.lit(222), F.lit(b"\0"))))
    made = x.loops.select(L("loop_id").cast("string").alias("path"), F.concat(ascii_("FORM"), be(F.octet_length(body) + 4, 4), ascii_("AIFF"), body).alias("content"))
    return containers.read_containers(made).select(L("path").cast("bigint").alias("loop_id"), L("sample_rate").alias("rate"))


@query("j1_vocabulary", "SELECT loop_id, category, subcategory FROM {disk} d")
def j1(x: Tables) -> DataFrame:
    cats, subs = v.category_names(x.spark), v.subcategory_names(x.spark)
    own = x.loops.select("loop_id", L("category").alias("c"), L("subcategory").alias("s"))
    own = own.join(F.broadcast(cats.toDF("c", "category")), "c", "left").join(F.broadcast(subs.toDF("s", "subcategory")), "s", "left")
    return own.select("loop_id", F.coalesce("category", "c").alias("category"), F.coalesce("subcategory", "s").alias("subcategory"))


@query("a4_pairs", "SELECT category, subcategory, count(*) AS loops FROM {loops} l GROUP BY ALL")
def a4(x: Tables) -> DataFrame:
    return x.loops.groupBy("category", "subcategory").agg(F.count("*").alias("loops"))


@query("e12_audit", """SELECT d.loop_id, stored_subcategory = 'Hi-Hat' AS not_canonical, coalesce(w.n, 0) AS unknown_words,
  NOT (category = 'All Drums' AND subcategory IN ('Hi-Hat', 'Kick')) AS misplaced FROM {disk} d LEFT JOIN (SELECT loop_id, count(*) AS n FROM {loop_descriptors} x WHERE descriptor = 'Vintage' GROUP BY loop_id) w ON w.loop_id = d.loop_id""")
def e12(x: Tables) -> DataFrame:
    known = F.array(*map(F.lit, v.DESCRIPTORS))
    own = x.disk.join(x.words, "loop_id", "left").join(F.broadcast(v.taxonomy(x.spark).withColumn("listed", F.lit(True))), ["category", "subcategory"], "left")
    return own.select("loop_id", (~e.is_canonical(L("stored_subcategory"))).alias("not_canonical"), F.coalesce(F.size(F.array_except("descriptors", known)), F.lit(0)).cast("bigint").alias("unknown_words"), L("listed").isNull().alias("misplaced"))
