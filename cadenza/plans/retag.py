"""Queries of edits: what a selection has in common, staged edits, what saving leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import edits as e
from ..sources import containers, files, rewrite
from .adapters import Tables, path_in, query, written
from ..sources.shared import out_folder, settled

L = F.col

#: Three quarters of the loops, grouped by pack, are the selections.
CHOSEN = "SELECT loop_id, pack FROM {loops} l WHERE loop_id % 4 <> 1"

#: Pending values of the loops that have edits.
PENDING = """SELECT d.loop_id, pack, container, d.category AS disk_category, d.subcategory AS disk_subcategory, stored_subcategory, d.genre AS disk_genre, d.key_ AS disk_key, d.mode_ AS disk_mode, one_shot AS disk_one_shot, beat_count,
  coalesce(x.category, d.category) AS category, coalesce(x.genre, d.genre) AS genre, coalesce(x.key_, d.key_) AS key_, coalesce(x.mode_, d.mode_) AS mode_, one_shot OR coalesce(convert_to_one_shot, false) AS one_shot,
  d.loop_id % 6 = 3 AS subcategory_picked, x.loop_id IS NOT NULL AS has_edit FROM {disk} d LEFT JOIN {edits} x ON x.loop_id = d.loop_id"""


def _chosen(x: Tables) -> DataFrame:
    return x.sql(CHOSEN)


def _pending(x: Tables) -> DataFrame:
    return x.sql(PENDING)


def _words(x: Tables) -> DataFrame:
    empty = F.array().cast("array<string>")
    own = _pending(x).join(x.words, "loop_id", "left").withColumn("words", F.coalesce("descriptors", empty)).drop("descriptors")
    # pending words: one removed, one added, in another order
    changed = F.when(L("loop_id") % 3 == 0, F.reverse(e.toggle_descriptor(F.lit(True), L("words"), F.lit("Fill"), F.lit(True))))
    return own.withColumn("pending_words", changed.when(L("loop_id") % 3 == 1, F.reverse("words")).otherwise(F.array_remove("words", "Clean")))


@query("j2_sparse_edit", "SELECT l.loop_id, coalesce(x.category, l.category) AS category, coalesce(x.genre, l.genre) AS genre FROM {loops} l LEFT JOIN {edits} x ON x.loop_id = l.loop_id")
def j2(x: Tables) -> DataFrame:
    return e.apply_sparse(x.loops.select("loop_id", "category", "genre"), x.edits, "loop_id", ("category", "genre"))


@query("j3_selection", "SELECT loop_id, loop_id IN (SELECT loop_id FROM {edits} y) AS chosen FROM {loops} l")
def j3(x: Tables) -> DataFrame:
    own, sel = x.loops.select("loop_id"), x.edits
    return e.chosen(own, sel, "loop_id").withColumn("chosen", F.lit(True)).unionByName(e.without_chosen(own, sel, "loop_id").withColumn("chosen", F.lit(False)))


@query("a1_common_values", f"""WITH s AS (SELECT d.* FROM {{disk}} d JOIN ({CHOSEN}) c ON c.loop_id = d.loop_id)
  SELECT pack, CASE WHEN min(key_) = max(key_) THEN CASE WHEN min(key_) = '' THEN '(None)' ELSE min(key_) END ELSE '(Multiple)' END AS key,
  CASE WHEN min(genre) = max(genre) THEN CASE WHEN min(genre) = '' THEN '(None)' ELSE min(genre) END ELSE '(Multiple)' END AS genre,
  CASE WHEN min(mode_) = max(mode_) THEN CASE WHEN min(mode_) = '' THEN '(None)' ELSE min(mode_) END ELSE '(Multiple)' END AS scale,
  CASE WHEN min(category) = max(category) THEN nullif(min(category), '') END AS category, CASE WHEN min(subcategory) = max(subcategory) THEN nullif(min(subcategory), '') END AS subcategory, CASE WHEN min(one_shot) = max(one_shot) THEN CAST(min(one_shot) AS STRING) END AS one_shot FROM s GROUP BY pack""")
def a1(x: Tables) -> DataFrame:
    own = e.chosen(x.disk, _chosen(x), "loop_id")
    return own.groupBy("pack").agg(e.common_value("key_").alias("key"), e.common_value("genre").alias("genre"), e.common_value("mode_").alias("scale"), e.common_value("category", None).alias("category"), e.common_value("subcategory", None).alias("subcategory"), e.common_flag("one_shot").cast("string").alias("one_shot"))


@query("a2_shared_descriptors", """WITH m AS (SELECT loop_id, loop_id % 40 AS grp FROM {loops} l), n AS (SELECT grp, count(*) AS n FROM m GROUP BY grp),
  w AS (SELECT grp, descriptor, count(*) AS k FROM m JOIN {loop_descriptors} d ON d.loop_id = m.loop_id GROUP BY ALL)
  SELECT w.grp, string_agg(descriptor, ',' ORDER BY descriptor) AS shared FROM w JOIN n ON n.grp = w.grp WHERE k = n GROUP BY w.grp""")
def a2(x: Tables) -> DataFrame:
    loops = x.loops.select("loop_id", (L("loop_id") % 40).alias("grp")).join(x.words, "loop_id", "left")
    return e.shared_descriptors(loops, "grp").where(F.size("shared") > 0).select("grp", F.array_join("shared", ",").alias("shared"))


CHANGES = f"""SELECT loop_id, pack, category IS DISTINCT FROM disk_category AS c_category, genre IS DISTINCT FROM disk_genre AS c_genre, key_ IS DISTINCT FROM disk_key AS c_key, mode_ IS DISTINCT FROM disk_mode AS c_mode,
  one_shot <> disk_one_shot AS c_one_shot, subcategory_picked AND stored_subcategory = 'Hi-Hat' AS c_subcategory, CASE loop_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE loop_id IN (SELECT loop_id FROM {{loop_descriptors}} w WHERE descriptor = 'Clean') END AS c_words FROM ({PENDING}) p"""
ANY = "(c_category OR c_genre OR c_key OR c_mode OR c_one_shot OR c_subcategory OR c_words)"


def _changes(x: Tables) -> tuple[DataFrame, dict]:
    own = _words(x)
    disk = F.struct(L("disk_category").alias("category"), L("disk_subcategory").alias("subcategory"), "stored_subcategory", L("disk_genre").alias("genre"), L("disk_key").alias("key"), L("disk_mode").alias("mode"), L("disk_one_shot").alias("one_shot"), L("words").alias("descriptors"))
    pending = F.struct("category", L("disk_subcategory").alias("subcategory"), "subcategory_picked", "genre", L("key_").alias("key"), L("mode_").alias("mode"), "one_shot", L("pending_words").alias("descriptors"))
    return own.withColumn("disk", disk).withColumn("pending", pending), e.field_changes()


@query("e1_has_changes", f"SELECT loop_id, {ANY} AS has_changes FROM ({CHANGES}) c")
def e1(x: Tables) -> DataFrame:
    own, changes = _changes(x)
    return own.select("loop_id", e.any_change(changes).alias("has_changes"))


#: Pending words in the order in which they are stored.
PENDING_WORDS = """SELECT l.loop_id, string_agg(descriptor, ',' ORDER BY ix) AS words FROM {loops} l LEFT JOIN (SELECT loop_id, descriptor FROM {loop_descriptors} d WHERE NOT (loop_id % 3 = 2 AND descriptor = 'Clean') UNION ALL SELECT loop_id, 'Fill' FROM {loops} k WHERE loop_id % 3 = 0) w ON w.loop_id = l.loop_id
  LEFT JOIN (VALUES (0,'Grooving'),(1,'Part'),(2,'Single'),(3,'Melodic'),(4,'Clean'),(5,'Electric'),(8,'Dry'),(13,'Dark'),(15,'Fill'),(99,'Vintage')) AS o(ix, name) ON o.name = w.descriptor GROUP BY l.loop_id"""


@query("e2_sparse", f"""SELECT c.loop_id, CASE WHEN c_category THEN category END AS category, CASE WHEN c_genre THEN genre END AS genre, CASE WHEN c_key THEN key_ END AS key, CASE WHEN c_mode THEN mode_ END AS mode,
  CASE WHEN c_one_shot THEN 'true' END AS one_shot, CASE WHEN c_subcategory THEN disk_subcategory END AS subcategory, CASE WHEN c_words THEN coalesce(pw.words, '') END AS descriptors
  FROM ({CHANGES}) c JOIN ({PENDING}) p ON p.loop_id = c.loop_id LEFT JOIN ({PENDING_WORDS}) pw ON pw.loop_id = c.loop_id""")
def e2(x: Tables) -> DataFrame:
    """All seven fields: those that differ, null otherwise; descriptors in the order in which they are stored."""
    own, changes = _changes(x)
    kept = [L(f"edit.{f}").cast("string").alias(f) for f in ("category", "genre", "key", "mode", "one_shot", "subcategory")]
    return own.withColumn("edit", e.sparse_edit(changes)).select("loop_id", *kept, F.array_join("edit.descriptors", ",").alias("descriptors"))


@query("a3_unsaved", f"SELECT pack, bool_or{ANY} AS unsaved FROM ({CHANGES}) c GROUP BY pack")
def a3(x: Tables) -> DataFrame:
    own, changes = _changes(x)
    return own.groupBy("pack").agg(F.bool_or(e.any_change(changes)).alias("unsaved"))


@query("e3_descriptor_order", """WITH o AS (SELECT * FROM (VALUES (0,'Grooving'),(1,'Part'),(2,'Single'),(3,'Melodic'),(4,'Clean'),(5,'Electric'),(8,'Dry'),(13,'Dark'),(15,'Fill'),(99,'Vintage')) AS o(ix, name)),
  p AS (SELECT loop_id, descriptor FROM {loop_descriptors} d WHERE NOT (loop_id % 3 = 2 AND descriptor = 'Clean') UNION ALL SELECT loop_id, 'Fill' FROM {loops} l WHERE loop_id % 3 = 0)
  SELECT l.loop_id, coalesce(string_agg(descriptor, ',' ORDER BY ix), '') AS words FROM {loops} l LEFT JOIN p ON p.loop_id = l.loop_id LEFT JOIN o ON o.name = p.descriptor GROUP BY l.loop_id""")
def e3(x: Tables) -> DataFrame:
    return _words(x).select("loop_id", F.array_join(e.descriptor_order(L("pending_words")), ",").alias("words"))


SEL = "loop_id % 4 <> 1"
CHOICE = "CASE loop_id % 3 WHEN 0 THEN '(None)' WHEN 1 THEN '(Multiple)' ELSE 'G' END"


@query("e4_bulk_key", f"SELECT loop_id, CASE WHEN {SEL} AND NOT one_shot AND loop_id % 3 <> 1 THEN CASE loop_id % 3 WHEN 0 THEN '' ELSE 'G' END ELSE key_ END AS key FROM ({PENDING}) p")
def e4(x: Tables) -> DataFrame:
    return _pending(x).select("loop_id", e.set_unless_one_shot(F.expr(SEL), L("one_shot"), F.expr(CHOICE), L("key_")).alias("key"))


@query("e5_bulk_category", f"SELECT loop_id, CASE WHEN {SEL} THEN 'Bass' ELSE category END AS category, CASE WHEN {SEL} THEN '' ELSE disk_subcategory END AS subcategory, CASE WHEN {SEL} AND loop_id % 3 = 0 THEN '' WHEN {SEL} AND loop_id % 3 = 2 THEN 'G' ELSE genre END AS genre FROM ({PENDING}) p")
def e5(x: Tables) -> DataFrame:
    sel = F.expr(SEL)
    return _pending(x).select("loop_id", e.set_value(sel, F.lit("Bass"), L("category")).alias("category"), e.set_value(sel, F.lit(e.NONE), L("disk_subcategory")).alias("subcategory"), e.set_value(sel, F.expr(CHOICE), L("genre")).alias("genre"))


@query("e6_bulk_descriptor", """WITH p AS (SELECT loop_id, descriptor FROM {loop_descriptors} d WHERE NOT (loop_id % 4 = 2 AND descriptor = 'Dark') UNION SELECT loop_id, 'Dark' FROM {loops} l WHERE loop_id % 4 IN (0, 3))
  SELECT l.loop_id, coalesce(string_agg(descriptor, ',' ORDER BY descriptor), '') AS words FROM {loops} l LEFT JOIN p ON p.loop_id = l.loop_id GROUP BY l.loop_id""")
def e6(x: Tables) -> DataFrame:
    sel, add = F.expr(SEL), F.expr("loop_id % 4 <> 2")
    return _words(x).select("loop_id", F.array_join(F.array_sort(e.toggle_descriptor(sel, L("words"), F.lit("Dark"), add)), ",").alias("words"))


@query("e7_bulk_one_shot", f"SELECT loop_id, CASE WHEN {SEL} AND NOT disk_one_shot THEN CASE WHEN loop_id % 2 = 0 THEN '' ELSE disk_key END ELSE key_ END AS key, CASE WHEN {SEL} AND NOT disk_one_shot THEN loop_id % 2 = 0 ELSE one_shot END AS one_shot FROM ({PENDING}) p")
def e7(x: Tables) -> DataFrame:
    sel, choice = F.expr(SEL), F.expr("loop_id % 2 = 0")
    shot = F.when(sel & ~L("disk_one_shot"), choice).otherwise(L("one_shot"))
    return _pending(x).select("loop_id", e.to_one_shot(sel, L("disk_one_shot"), choice, L("disk_key"), L("key_")).alias("key"), shot.alias("one_shot"))


#: Key, mode and the rest as a file gives them after the edit was saved; AIFF files all have basc here.
AFTER = f"""SELECT loop_id, category, genre, CASE WHEN coalesce(conv, false) THEN '' WHEN container = 'caf' THEN coalesce(ekey, disk_key) ELSE coalesce(ekey, disk_key) END AS key,
  CASE WHEN coalesce(conv, false) THEN '' WHEN container = 'caf' THEN coalesce(emode, disk_mode)
    ELSE CASE coalesce(lower(emode), lower(disk_mode)) WHEN 'minor' THEN 'Minor' WHEN 'major' THEN 'Major' WHEN 'neither' THEN 'Neither' WHEN 'both' THEN 'Both' ELSE CASE WHEN coalesce(ekey, disk_key) <> '' THEN 'Any' ELSE '' END END END AS mode,
  CASE WHEN coalesce(conv, false) THEN 0 ELSE beat_count END AS beat_count
  FROM (SELECT p.*, x.key_ AS ekey, x.mode_ AS emode, x.convert_to_one_shot AS conv FROM ({PENDING}) p LEFT JOIN {{edits}} x ON x.loop_id = p.loop_id) q"""


@query("e9_after_saving", AFTER)
def e9(x: Tables) -> DataFrame:
    own = _pending(x).join(x.edits.select("loop_id", L("category").alias("e_category"), L("genre").alias("e_genre"), L("key_").alias("e_key"), L("mode_").alias("e_mode"), "convert_to_one_shot"), "loop_id", "left")
    old = {"category": L("disk_category"), "subcategory": L("disk_subcategory"), "genre": L("disk_genre"), "key": L("disk_key"), "mode": L("disk_mode"), "beat_count": L("beat_count")}
    edit = {"category": L("e_category"), "subcategory": F.lit(None).cast("string"), "genre": L("e_genre"), "key": L("e_key"), "mode": L("e_mode"), "one_shot": L("convert_to_one_shot")}
    after = e.after_saving(L("container"), old, edit)
    return own.select("loop_id", *(after[f].alias(f) for f in ("category", "genre", "key", "mode", "beat_count")))


REWRITTEN = """WITH t AS (SELECT d.*, x.category AS ecat, x.genre AS egenre, x.key_ AS ekey, x.mode_ AS emode, coalesce(x.convert_to_one_shot, false) AS conv, f.error_code AS fault, x.loop_id IS NOT NULL AS edited
    FROM {disk} d JOIN {faults} f ON f.loop_id = d.loop_id JOIN {edits} x ON x.loop_id = d.loop_id),
  s AS (SELECT *, container = 'aiff' AND loop_id % 7 = 0 AS bare, CASE WHEN fault IS NOT NULL THEN fault WHEN container = 'aiff' AND loop_id % 7 = 0 AND (ekey IS NOT NULL OR emode IS NOT NULL OR conv) THEN 'key_edit_requires_basc' END AS error,
    CASE WHEN container = 'caf' THEN CASE loop_id % 6 WHEN 0 THEN 'Any' WHEN 1 THEN 'Minor' WHEN 2 THEN 'Major' WHEN 3 THEN 'Neither' WHEN 4 THEN 'Both' ELSE '' END ELSE mode_ END AS old_mode FROM t)
"""


@query("s13_rewritten", REWRITTEN + """SELECT loop_id, error AS error_code, CASE WHEN error IS NULL THEN coalesce(ecat, category) END AS category, CASE WHEN error IS NULL THEN coalesce(egenre, genre) END AS genre,
  CASE WHEN error IS NULL THEN CASE WHEN conv OR bare THEN '' ELSE coalesce(ekey, key_) END END AS key,
  CASE WHEN error IS NULL THEN CASE WHEN conv OR bare THEN '' WHEN container = 'caf' THEN coalesce(emode, old_mode)
    ELSE CASE coalesce(CASE lower(emode) WHEN 'minor' THEN 1 WHEN '' THEN 0 WHEN 'any' THEN 0 END, loop_id % 6) WHEN 1 THEN 'Minor' WHEN 2 THEN 'Major' WHEN 3 THEN 'Neither' WHEN 4 THEN 'Both' ELSE CASE WHEN coalesce(ekey, key_) <> '' THEN 'Any' ELSE '' END END END END AS mode,
  CAST(CASE WHEN error IS NULL AND NOT conv AND NOT bare THEN beat_count ELSE 0 END AS BIGINT) AS beat_count FROM s""")
def s13(x: Tables) -> DataFrame:
    """Of a folder with all files, those that an edit names are opened, by the tasks that rewrite them."""
    root, work = written(x.files), out_folder(x.spark, "listing")
    edits = _file_edits(x).join(x.paths, "loop_id").drop("loop_id").withColumnRenamed("path", "at")
    wanted = files.listing(x.spark, root, work=work).select("path", path_in(root).alias("at")).join(edits, "at")
    done = rewrite.rewrite_paths(wanted.drop("at")).withColumn("path", path_in(root))
    again = containers.tags(containers.read_containers(done.where("error_code is null").select("path", L("new_content").alias("content"))))
    out = done.select("path", L("error_code").alias("failed")).join(again.drop("error_code"), "path", "left").join(x.paths, "path")
    out = out.select("loop_id", L("failed").alias("error_code"), "category", "genre", "key", "mode", F.coalesce("beat_count", F.lit(0)).cast("bigint").alias("beat_count"))
    return settled(out, "s13", work, many=root)


def _file_edits(x: Tables) -> DataFrame:
    none = F.lit(None)
    return x.edits.select("loop_id", "category", none.cast("string").alias("subcategory"), "genre", none.cast("array<string>").alias("descriptors"), L("key_").alias("key"), L("mode_").alias("mode"), L("convert_to_one_shot").alias("one_shot"))


def _edited_files(x: Tables) -> DataFrame:
    """Files of edited loops, contents at hand, with their edits."""
    return x.files.join(_file_edits(x), "loop_id")


@query("e10_outcome", REWRITTEN + """SELECT loop_id, CASE WHEN ecat IS NULL AND egenre IS NULL AND ekey IS NULL AND emode IS NULL AND NOT conv THEN 'no-op' WHEN error IS NOT NULL THEN concat('failed: ', error) ELSE 'saved' END AS outcome FROM s""")
def e10(x: Tables) -> DataFrame:
    """Errors are those of rewriting the files; an edit that needs basc has failed there if there was none."""
    done = rewrite.rewrite(_edited_files(x)).select("path", "error_code").join(x.paths, "path")
    own = x.edits.join(done, "loop_id").join(x.loops.select("loop_id", "container"), "loop_id")
    edit = {"category": L("category"), "genre": L("genre"), "key": L("key_"), "mode": L("mode_"), "one_shot": L("convert_to_one_shot")}
    return own.select("loop_id", e.outcome(L("container"), F.lit(True), L("error_code"), edit).alias("outcome"))


@query("e11_cancel", f"SELECT x.loop_id, x.category FROM {{edits}} x WHERE loop_id NOT IN (SELECT loop_id FROM ({CHOSEN}) c)")
def e11(x: Tables) -> DataFrame:
    return e.cancel(x.edits, _chosen(x), "loop_id").select("loop_id", "category")


@query("w6_catalogue_page", """WITH k AS (SELECT loop_id, file_name, container, lower(regexp_extract(file_name, '^([^0-9]*)', 1)) AS a, CAST(regexp_extract(file_name, '([0-9]+)\\.', 1) AS BIGINT) AS n, CASE WHEN beat_count > 0 THEN least(greatest(round(beat_count * 60 / (n_frames / sample_rate)), 0), 999) ELSE 0 END AS bpm FROM {loops} l)
  SELECT 'name' AS by_, loop_id FROM (SELECT * FROM k ORDER BY a, n, file_name LIMIT 100) UNION ALL SELECT 'type', loop_id FROM (SELECT * FROM k ORDER BY container, a, n, file_name LIMIT 100)
  UNION ALL SELECT 'bpm', loop_id FROM (SELECT * FROM k ORDER BY bpm DESC, a DESC, n DESC, file_name DESC LIMIT 100)""")
def w6_page(x: Tables) -> DataFrame:
    """The first page of 100 in three orders; a page is a top-k, so that no task sorts the whole catalogue."""
    from ..functions import tags as t
    from ..operators import ranking

    own = x.loops.withColumns({"bpm": t.tempo(L("beat_count"), L("n_frames") / L("sample_rate")), "file_type": L("container")})
    pages = [ranking.in_order(own, by, down).limit(100).select(F.lit(by).alias("by_"), "loop_id") for by, down in (("name", False), ("type", False), ("bpm", True))]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


PLACE = "row_number() OVER (ORDER BY {}) - 1 AS place, loop_id FROM k"


@query("w6_catalogue_order", """WITH k AS (SELECT l.loop_id, file_name, container, lower(regexp_extract(file_name, '^([^0-9]*)', 1)) AS a, CAST(regexp_extract(file_name, '([0-9]+)\\.', 1) AS BIGINT) AS n, CASE WHEN beat_count > 0 THEN least(greatest(round(beat_count * 60 / (n_frames / sample_rate)), 0), 999) ELSE 0 END AS bpm,
    CASE WHEN l.loop_id % 3 <> 2 THEN 0 ELSE 1 END AS no_midi, CASE WHEN x.loop_id IS NULL THEN 0 ELSE 1 END AS changed FROM {loops} l LEFT JOIN {edits} x ON x.loop_id = l.loop_id)
  SELECT 'name' AS by_, """ + PLACE.format("a, n, file_name") + " UNION ALL SELECT 'type', " + PLACE.format("container, a, n, file_name") + " UNION ALL SELECT 'midi', " + PLACE.format("no_midi, a, n, file_name")
  + " UNION ALL SELECT 'bpm', " + PLACE.format("bpm DESC, a DESC, n DESC, file_name DESC") + " UNION ALL SELECT 'changes', " + PLACE.format("changed DESC, a DESC, n DESC, file_name DESC"))
def w6(x: Tables) -> DataFrame:
    """Every loop with its place in each of the five orders."""
    from ..functions import tags as t
    from ..operators import ranking

    own = x.loops.join(x.edits.select("loop_id", F.lit(True).alias("edited")), "loop_id", "left")
    own = own.withColumns({"bpm": t.tempo(L("beat_count"), L("n_frames") / L("sample_rate")), "file_type": L("container"), "has_midi": L("loop_id") % 3 != 2, "has_changes": L("edited").isNotNull()})
    return ranking.places(own, {"name": False, "type": False, "midi": False, "bpm": True, "changes": True})
