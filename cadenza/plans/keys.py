"""Queries of keys: notes and their statistics, audio descriptors, scores, ranking, comparison.

Weights are the synthetic formulas of the fixtures; the flagship query ranks three keys per loop from its notes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..operators import analysis, audio, edits as e, midi, ranking, scoring
from .adapters import Tables, query

L = F.col
FEATURES = ["duration", "count", "bass", "first", "last", "lowest", "bass_line"]
BIAS = (0.03, -0.03)
FEATURE_SQL = "(VALUES (0,'duration'),(1,'count'),(2,'bass'),(3,'first'),(4,'last'),(5,'lowest'))"


def model(x: Tables, names: list[str] = FEATURES) -> DataFrame:
    """Weights by formula: (feature, offset, mode, weight)."""
    named = F.get(F.array(*map(F.lit, names)), (L("id") / 12).cast("int"))
    ids = x.spark.range(len(names) * 12).select(named.alias("feature"), (L("id") % 12).cast("int").alias("offset"), "id")
    rows = F.explode(F.array(
        F.struct(F.lit("Major").alias("mode"), ((L("id") * 37 % 101 - 50) / 100.0).alias("weight")),
        F.struct(F.lit("Minor").alias("mode"), ((L("id") * 53 % 103 - 51) / 100.0).alias("weight")),
    ))
    return ids.select("feature", "offset", rows.alias("r")).select("feature", "offset", "r.mode", "r.weight")


def deviations(x: Tables, names: list[str] = FEATURES) -> DataFrame:
    return x.spark.range(len(names)).select(F.get(F.array(*map(F.lit, names)), L("id").cast("int")).alias("feature"), (0.1 + 0.01 * L("id")).alias("std"))


EVENTS = """WITH t AS (SELECT *, sum(delta) OVER (PARTITION BY loop_id, track ORDER BY seq ROWS UNBOUNDED PRECEDING) AS tick FROM {midi_events} m),
  p AS (SELECT *, lag(kind) OVER w AS before_, lag(tick) OVER w AS start_tick FROM t WHERE kind <> 'other' WINDOW w AS (PARTITION BY loop_id, track, channel, pitch ORDER BY seq))"""


@query("w1_ticks", "SELECT loop_id, seq, CAST(sum(delta) OVER (PARTITION BY loop_id, track ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tick FROM {midi_events} m")
def w1(x: Tables) -> DataFrame:
    return midi.with_ticks(x.midi_events).select("loop_id", "seq", "tick")


@query("w2_paired_notes", EVENTS + " SELECT loop_id, CAST(start_tick AS BIGINT) AS start_tick, CAST(tick AS BIGINT) AS end_tick, CAST(pitch AS BIGINT) AS pitch, channel FROM p WHERE kind = 'off' AND before_ = 'on'")
def w2(x: Tables) -> DataFrame:
    return midi.paired_notes(x.midi_events).select("loop_id", "start_tick", "end_tick", L("pitch").cast("bigint").alias("pitch"), "channel")


@query("w3_note_order", EVENTS + " SELECT loop_id, CAST(row_number() OVER (PARTITION BY loop_id ORDER BY track, seq) AS BIGINT) AS note_ord, CAST(tick AS BIGINT) AS end_tick FROM p WHERE kind = 'off' AND before_ = 'on'")
def w3(x: Tables) -> DataFrame:
    return midi.paired_notes(x.midi_events).select("loop_id", "note_ord", "end_tick")


PITCHED = "n AS (SELECT *, CAST(pitch % 12 AS BIGINT) AS pc, greatest(end_tick - start_tick, 1) AS len FROM {notes} x WHERE channel <> 9)"
STATS = f"""WITH {PITCHED}, l AS (SELECT loop_id, min(start_tick) AS f, max(start_tick) AS z, min(pitch) AS lo FROM n GROUP BY loop_id),
  g AS (SELECT n.loop_id, pc, sum(len) AS duration, count(*) AS count, sum(CASE WHEN pitch < 52 THEN len ELSE 0 END) AS bass, sum(CASE WHEN start_tick = f THEN 1 ELSE 0 END) AS first, sum(CASE WHEN start_tick = z THEN 1 ELSE 0 END) AS last,
    max(CASE WHEN pitch = lo THEN 1 ELSE 0 END) AS lowest FROM n JOIN l ON l.loop_id = n.loop_id GROUP BY ALL),
  d AS (SELECT l.loop_id, f.ix AS fx, f.name AS feature, c.pc, coalesce(CASE f.ix WHEN 0 THEN duration WHEN 1 THEN count WHEN 2 THEN bass WHEN 3 THEN first WHEN 4 THEN last ELSE lowest END, 0) AS value
    FROM l CROSS JOIN {FEATURE_SQL} f(ix, name) CROSS JOIN (SELECT range AS pc FROM range(12)) c LEFT JOIN g ON g.loop_id = l.loop_id AND g.pc = c.pc)"""


@query("a5_statistics", STATS + " SELECT loop_id, feature, CAST(pc AS BIGINT) AS pc, CAST(value AS DOUBLE) AS value FROM d")
def a5(x: Tables) -> DataFrame:
    return midi.statistics(x.notes).select("loop_id", "feature", L("pc").cast("bigint").alias("pc"), "value")


OVER = f"""WITH {PITCHED}, o AS (SELECT DISTINCT loop_id, start_tick AS onset FROM n),
  so AS (SELECT o.loop_id, o.onset, n.note_ord, n.pitch, n.len FROM o JOIN n ON n.loop_id = o.loop_id AND n.start_tick <= o.onset AND o.onset < n.end_tick),
  eo AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM so WHERE so.loop_id = o.loop_id AND so.onset = o.onset)),
  a AS (SELECT * FROM so UNION ALL SELECT eo.loop_id, eo.onset, n.note_ord, n.pitch, n.len FROM eo JOIN n ON n.loop_id = eo.loop_id AND n.start_tick = eo.onset)"""


@query("j4_sounding", OVER + " SELECT loop_id, onset, note_ord, pitch FROM a")
def j4(x: Tables) -> DataFrame:
    return midi.sounding(x.notes).select("loop_id", "onset", "note_ord", "pitch")


BASS = OVER + """, lo AS (SELECT loop_id, onset, pitch, len, row_number() OVER (PARTITION BY loop_id, onset ORDER BY pitch, note_ord) AS r FROM a),
  bl AS (SELECT loop_id, pitch % 12 AS pc, sum(len) AS v FROM lo WHERE r = 1 GROUP BY ALL),
  bass AS (SELECT k.loop_id, c.pc, coalesce(v, 0) AS value FROM (SELECT DISTINCT loop_id FROM n) k CROSS JOIN (SELECT range AS pc FROM range(12)) c LEFT JOIN bl ON bl.loop_id = k.loop_id AND bl.pc = c.pc)"""


@query("a6_bass_line", BASS + " SELECT loop_id, CAST(pc AS BIGINT) AS pc, CAST(value AS DOUBLE) AS value FROM bass")
def a6(x: Tables) -> DataFrame:
    return midi.bass_line(x.notes).select("loop_id", L("pc").cast("bigint").alias("pc"), "value")


#: All seven statistics, as d7.
STATS7 = STATS + ", " + BASS.removeprefix(f"WITH {PITCHED}, ") + f""", d7 AS (SELECT * FROM d UNION ALL SELECT loop_id, 6, 'bass_line', pc, value FROM bass)"""
SCALED = STATS7 + """, s AS (SELECT *, value / (sum(value) OVER w + 1e-9) AS v FROM d7 WINDOW w AS (PARTITION BY loop_id, fx)),
  x AS (SELECT loop_id, fx, feature, pc, (v - avg(v) OVER (PARTITION BY loop_id, fx)) / (0.1 + 0.01 * fx) AS v FROM s)"""
TURNED = SCALED + ", t AS (SELECT x.*, y.tonic, (pc - tonic + 12) % 12 AS o FROM x CROSS JOIN (SELECT range AS tonic FROM range(12)) y)"
LINEAR = TURNED + """, z AS (SELECT loop_id, tonic AS key_ix, 0.03 + sum(v * ((fx * 12 + o) * 37 % 101 - 50) / 100.0) AS z FROM t GROUP BY ALL
  UNION ALL SELECT loop_id, tonic + 12, -0.03 + sum(v * ((fx * 12 + o) * 53 % 103 - 51) / 100.0) FROM t GROUP BY ALL)"""
LOGP = LINEAR + ", q AS (SELECT loop_id, key_ix, z - max(z) OVER (PARTITION BY loop_id) AS y FROM z), p AS (SELECT loop_id, key_ix, y - ln(sum(exp(y)) OVER (PARTITION BY loop_id)) AS logp FROM q)"
RANKED = LOGP + f""", r AS (SELECT loop_id, key_ix, exp(logp) AS probability, row_number() OVER (PARTITION BY loop_id ORDER BY round(logp, 9) DESC, key_ix) AS rank,
  ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][CAST(key_ix % 12 + 1 AS INT)] AS key, CASE WHEN key_ix < 12 THEN 'Major' ELSE 'Minor' END AS mode FROM p)"""


def _scaled(x: Tables) -> DataFrame:
    return scoring.scaled(midi.all_statistics(x.notes), deviations(x), by_sum=True)


def _logp(x: Tables) -> DataFrame:
    return scoring.log_softmax(scoring.linear_scores(_scaled(x), model(x), BIAS))


def candidates(x: Tables) -> DataFrame:
    # scores are rounded before they are ranked, so that sums in another order rank alike
    return scoring.probabilities(_logp(x).withColumn("logp", F.round("logp", 9)))


@query("m1_scaled", SCALED + " SELECT loop_id, feature, CAST(pc AS BIGINT) AS pc, round(v, 6) + 0.0 AS value FROM x")
def m1(x: Tables) -> DataFrame:
    return _scaled(x).select("loop_id", "feature", L("pc").cast("bigint").alias("pc"), (F.round("value", 6) + 0.0).alias("value"))


@query("m2_transposed", TURNED + " SELECT loop_id, feature, CAST(tonic AS BIGINT) AS tonic, round(sum(v * (o + 1)), 5) + 0.0 AS checksum FROM t GROUP BY ALL")
def m2(x: Tables) -> DataFrame:
    turned = scoring.transposed(_scaled(x)).groupBy("loop_id", "feature", L("tonic").cast("bigint").alias("tonic"))
    return turned.agg((F.round(F.sum(L("value") * (L("offset") + 1)), 5) + 0.0).alias("checksum"))


@query("j6_model_join", TURNED + " SELECT loop_id, CAST(tonic AS BIGINT) AS tonic, count(*) AS pairs, round(sum(((fx * 12 + o) * 37 % 101 - 50) / 100.0), 6) + 0.0 AS weights FROM t GROUP BY ALL")
def j6(x: Tables) -> DataFrame:
    joined = scoring.transposed(_scaled(x)).join(F.broadcast(model(x).where("mode = 'Major'")), ["feature", "offset"])
    return joined.groupBy("loop_id", L("tonic").cast("bigint").alias("tonic")).agg(F.count("*").alias("pairs"), (F.round(F.sum("weight"), 6) + 0.0).alias("weights"))


@query("m3_linear", LINEAR + " SELECT loop_id, CAST(key_ix AS BIGINT) AS key_ix, round(z, 6) + 0.0 AS z FROM z")
def m3(x: Tables) -> DataFrame:
    return scoring.linear_scores(_scaled(x), model(x), BIAS).select("loop_id", L("key_ix").cast("bigint").alias("key_ix"), (F.round("z", 6) + 0.0).alias("z"))


@query("m4_log_softmax", LOGP + " SELECT loop_id, CAST(key_ix AS BIGINT) AS key_ix, round(logp, 6) + 0.0 AS logp FROM p")
def m4(x: Tables) -> DataFrame:
    return _logp(x).select("loop_id", L("key_ix").cast("bigint").alias("key_ix"), (F.round("logp", 6) + 0.0).alias("logp"))


@query("m8_probabilities", LOGP + " SELECT loop_id, CAST(key_ix AS BIGINT) AS key_ix, round(exp(logp), 6) + 0.0 AS probability FROM p")
def m8(x: Tables) -> DataFrame:
    return scoring.probabilities(_logp(x)).select("loop_id", L("key_ix").cast("bigint").alias("key_ix"), (F.round("probability", 6) + 0.0).alias("probability"))


@query("w4_ranked", RANKED + " SELECT loop_id, CAST(rank AS BIGINT) AS rank, key, mode FROM r")
def w4(x: Tables) -> DataFrame:
    return ranking.ranked(candidates(x)).select("loop_id", L("rank").cast("bigint").alias("rank"), "key", "mode")


@query("w5_suggestions", RANKED + " SELECT loop_id, CAST(rank AS BIGINT) AS rank, key, mode, round(probability, 4) + 0.0 AS probability, probability < 0.3 AS is_uncertain FROM r WHERE rank <= 3")
def w5(x: Tables) -> DataFrame:
    return ranking.suggestions(candidates(x)).select("loop_id", L("rank").cast("bigint").alias("rank"), "key", "mode", (F.round("probability", 4) + 0.0).alias("probability"), "is_uncertain")


JOINED = RANKED + ", c AS (SELECT r.*, d.pack, d.key_ AS tag_key, d.mode_ AS tag_mode FROM r JOIN {disk} d ON d.loop_id = r.loop_id WHERE key_ <> '' AND mode_ IN ('Major', 'Minor'))"


def _compared(x: Tables) -> DataFrame:
    tags = x.disk.select("loop_id", "pack", L("key_").alias("tag_key"), L("mode_").alias("tag_mode"))
    return ranking.compared(ranking.ranked(candidates(x)), tags)


@query("j7_compared", JOINED + " SELECT loop_id, key, mode, tag_key, tag_mode FROM c WHERE rank = 1")
def j7(x: Tables) -> DataFrame:
    return _compared(x).where("rank = 1").select("loop_id", "key", "mode", "tag_key", "tag_mode")


@query("a7_agreement", JOINED + """, ag AS (SELECT pack, loop_id, max(CASE WHEN rank = 1 AND key = tag_key THEN 1 ELSE 0 END) AS t, max(CASE WHEN rank = 1 AND key = tag_key AND mode = tag_mode THEN 1 ELSE 0 END) AS b,
  max(CASE WHEN rank <= 3 AND key = tag_key THEN 1 ELSE 0 END) AS h, max(CASE WHEN rank = 1 THEN probability END) AS p FROM c GROUP BY ALL)
  SELECT pack, count(*) AS loops, round(avg(t), 6) AS tonic, round(avg(b), 6) AS both, round(avg(h), 6) AS top3, round(avg(p), 4) AS confidence FROM ag GROUP BY pack""")
def a7(x: Tables) -> DataFrame:
    out = ranking.agreement(_compared(x), "pack")
    return out.select("pack", "loops", *(F.round(c, 6).alias(c) for c in ("tonic", "both", "top3")), F.round("confidence", 4).alias("confidence"))


@query("e8_apply_suggestion", RANKED + " SELECT d.loop_id, CASE WHEN NOT one_shot AND r.key IS NOT NULL THEN r.key ELSE key_ END AS key, CASE WHEN NOT one_shot AND r.key IS NOT NULL THEN r.mode ELSE mode_ END AS mode FROM {disk} d LEFT JOIN r ON r.loop_id = d.loop_id AND rank = 1")
def e8(x: Tables) -> DataFrame:
    best = ranking.suggestions(candidates(x), 1).select("loop_id", "key", "mode")
    own = x.disk.join(best, "loop_id", "left")
    known = L("key").isNotNull()
    return own.select("loop_id", e.set_unless_one_shot(known, L("one_shot"), L("key"), L("key_")).alias("key"), e.set_unless_one_shot(known, L("one_shot"), L("mode"), L("mode_")).alias("mode"))


# Both kinds of evidence: audio log probabilities stand in as a function of the descriptors of frames.

AUDIO_LOGP = """f AS (SELECT vec_id AS loop_id, embedding FROM embeddings), ax AS (SELECT loop_id, k.key_ix, CAST(embedding[CAST(k.key_ix + 1 AS INT)] AS DOUBLE) * 8 AS z FROM f CROSS JOIN (SELECT range AS key_ix FROM range(24)) k),
  ay AS (SELECT loop_id, key_ix, z - max(z) OVER (PARTITION BY loop_id) AS y FROM ax), au AS (SELECT loop_id, key_ix, y - ln(sum(exp(y)) OVER (PARTITION BY loop_id)) AS audio FROM ay)"""


def _audio_logp(x: Tables) -> DataFrame:
    rows = x.embeddings.select(L("vec_id").alias("loop_id"), F.posexplode(F.slice("embedding", 1, 24)).alias("key_ix", "v"))
    return scoring.log_softmax(rows.select("loop_id", "key_ix", (L("v").cast("double") * 8).alias("z")))


@query("j5_either", LOGP + ", " + AUDIO_LOGP + " SELECT coalesce(p.loop_id, au.loop_id) AS loop_id, CAST(coalesce(p.key_ix, au.key_ix) AS BIGINT) AS key_ix, p.loop_id IS NOT NULL AS has_midi, au.loop_id IS NOT NULL AS has_audio FROM p FULL OUTER JOIN au ON au.loop_id = p.loop_id AND au.key_ix = p.key_ix")
def j5(x: Tables) -> DataFrame:
    both = scoring.either(_audio_logp(x), _logp(x))
    return both.select("loop_id", L("key_ix").cast("bigint").alias("key_ix"), L("midi").isNotNull().alias("has_midi"), L("audio").isNotNull().alias("has_audio"))


@query("m7_combined", LOGP + ", " + AUDIO_LOGP + """, b AS (SELECT coalesce(p.loop_id, au.loop_id) AS loop_id, coalesce(p.key_ix, au.key_ix) AS key_ix, p.loop_id IS NOT NULL AS uses_midi, CASE WHEN p.logp IS NOT NULL AND au.audio IS NOT NULL THEN (p.logp + au.audio) / 2 END AS m, coalesce(au.audio, p.logp) AS one
    FROM p FULL OUTER JOIN au ON au.loop_id = p.loop_id AND au.key_ix = p.key_ix), mm AS (SELECT *, m - max(m) OVER (PARTITION BY loop_id) AS y FROM b)
  SELECT loop_id, CAST(key_ix AS BIGINT) AS key_ix, uses_midi, round(CASE WHEN m IS NULL THEN one ELSE y - ln(sum(exp(y)) OVER (PARTITION BY loop_id)) END, 6) + 0.0 AS logp FROM mm""")
def m7(x: Tables) -> DataFrame:
    return scoring.combined(_audio_logp(x), _logp(x)).select("loop_id", L("key_ix").cast("bigint").alias("key_ix"), "uses_midi", (F.round("logp", 6) + 0.0).alias("logp"))


# Audio: samples and frames from embeddings.


@query("f1_mono", "SELECT vec_id, round(sum((e + g) / 2), 5) + 0.0 AS total FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e, unnest(list_reverse(embedding))::DOUBLE AS g FROM embeddings) x GROUP BY vec_id")
def f1(x: Tables) -> DataFrame:
    wide = x.embeddings.withColumn("e", L("embedding").cast("array<double>"))
    mono = audio.mono(L("e"), F.reverse("e"))
    return wide.select("vec_id", (F.round(F.aggregate(mono, F.lit(0.0), lambda a, b: a + b), 5) + 0.0).alias("total"))


@query("f1_mixdown", """SELECT vec_id, CAST(i // c AS BIGINT) AS frame, round(sum(e) / c, 6) + 0.0 AS value FROM (SELECT vec_id, [1, 2, 6][CAST(vec_id % 3 + 1 AS INT)] AS c, unnest(embedding)::DOUBLE AS e, unnest(range(64)) AS i FROM embeddings) x
  WHERE i // c < 64 // c GROUP BY vec_id, i // c, c""")
def f1_mixdown(x: Tables) -> DataFrame:
    """Signals of one, two and six channels, all frames."""
    channels = F.get(F.array(*map(F.lit, (1, 2, 6))), (L("vec_id") % 3).cast("int"))
    rows = x.embeddings.select("vec_id", F.posexplode(audio.mixdown(L("embedding").cast("array<double>"), channels)).alias("frame", "value"))
    return rows.select("vec_id", L("frame").cast("bigint").alias("frame"), (F.round("value", 6) + 0.0).alias("value"))


@query("a8_audible", "SELECT vec_id, list_max(list_transform(embedding, lambda v: abs(v::DOUBLE * CASE WHEN vec_id % 5 = 0 THEN 0 ELSE 1 END))) > 1e-5 AS audible FROM embeddings")
def a8(x: Tables) -> DataFrame:
    samples = F.transform(L("embedding").cast("array<double>"), lambda v: v * F.when(L("vec_id") % 5 == 0, 0.0).otherwise(1.0))
    return x.embeddings.select("vec_id", audio.is_audible(samples).alias("audible"))


F2_RATE = 2048.0
F2 = """WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS n FROM embeddings),
  w AS (SELECT vec_id, n, x * (0.5 - 0.5 * cos(2 * pi() * n / 63)) AS x FROM s),
  d AS (SELECT vec_id, k, pow(sum(x * cos(2 * pi() * k * n / 64)), 2) + pow(sum(x * sin(2 * pi() * k * n / 64)), 2) AS p FROM w CROSS JOIN (SELECT range AS k FROM range(33)) ks GROUP BY vec_id, k),
  c AS (SELECT vec_id, k + 1 AS i, sum(p) OVER (PARTITION BY vec_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS t FROM d UNION ALL SELECT DISTINCT vec_id, 0, 0 FROM d),
  e AS (SELECT k, least(greatest(32.7032 * pow(2, (k - 0.5) / 36) / 32, 0), 33) AS pos FROM (SELECT range AS k FROM range(253)) r),
  v AS (SELECT a.vec_id, e.k, a.t * (1 - (pos - floor(pos))) + b.t * (pos - floor(pos)) AS t FROM e JOIN c a ON a.i = floor(pos) JOIN c b ON b.i = least(floor(pos) + 1, 33) AND b.vec_id = a.vec_id),
  m AS (SELECT vec_id, k, sqrt(greatest(lead(t) OVER (PARTITION BY vec_id ORDER BY k) - t, 0)) AS mag FROM v)
  SELECT vec_id AS loop_id, CAST(k AS BIGINT) AS band, round(mag, 5) + 0.0 AS mag FROM m WHERE k < 252"""


@query("f2_spectrogram", F2)
def f2(x: Tables) -> DataFrame:
    signals = x.embeddings.select(L("vec_id").alias("loop_id"), L("embedding").alias("samples"))
    frames = audio.spectrogram(signals, frame=64, hop=32, rate=F2_RATE, precision="double")
    return frames.select("loop_id", F.posexplode("bands").alias("band", "mag")).select("loop_id", L("band").cast("bigint").alias("band"), (F.round("mag", 5) + 0.0).alias("mag"))


#: Frames of 32 values, 16 apart: three of each signal; all bands.
F2_FRAMES = """WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS n FROM embeddings),
  w AS (SELECT vec_id, frame_ix, n - 16 * frame_ix AS n, x * (0.5 - 0.5 * cos(2 * pi() * (n - 16 * frame_ix) / 31)) AS x FROM s JOIN (SELECT range AS frame_ix FROM range(3)) f ON n BETWEEN 16 * frame_ix AND 16 * frame_ix + 31),
  d AS (SELECT vec_id, frame_ix, k, pow(sum(x * cos(2 * pi() * k * n / 32)), 2) + pow(sum(x * sin(2 * pi() * k * n / 32)), 2) AS p FROM w CROSS JOIN (SELECT range AS k FROM range(17)) ks GROUP BY ALL),
  c AS (SELECT vec_id, frame_ix, k + 1 AS i, sum(p) OVER (PARTITION BY vec_id, frame_ix ORDER BY k ROWS UNBOUNDED PRECEDING) AS t FROM d UNION ALL SELECT DISTINCT vec_id, frame_ix, 0, 0 FROM d),
  e AS (SELECT k, least(greatest(32.7032 * pow(2, (k - 0.5) / 36) / 64, 0), 17) AS pos FROM (SELECT range AS k FROM range(253)) r),
  v AS (SELECT a.vec_id, a.frame_ix, e.k, a.t * (1 - (pos - floor(pos))) + b.t * (pos - floor(pos)) AS t FROM e JOIN c a ON a.i = floor(pos) JOIN c b ON b.i = least(floor(pos) + 1, 17) AND b.vec_id = a.vec_id AND b.frame_ix = a.frame_ix),
  m AS (SELECT vec_id, frame_ix, k, sqrt(greatest(lead(t) OVER (PARTITION BY vec_id, frame_ix ORDER BY k) - t, 0)) AS mag FROM v)
  SELECT vec_id AS loop_id, CAST(frame_ix AS BIGINT) AS frame_ix, CAST(k AS BIGINT) AS band, round(mag, 5) + 0.0 AS mag FROM m WHERE k < 252"""


@query("f2_spectrogram_frames", F2_FRAMES)
def f2_frames(x: Tables) -> DataFrame:
    signals = x.embeddings.select(L("vec_id").alias("loop_id"), L("embedding").alias("samples"))
    frames = audio.spectrogram(signals, frame=32, hop=16, rate=F2_RATE, precision="double")
    long = frames.select("loop_id", L("frame_ix").cast("bigint").alias("frame_ix"), F.posexplode("bands").alias("band", "mag"))
    return long.select("loop_id", "frame_ix", L("band").cast("bigint").alias("band"), (F.round("mag", 5) + 0.0).alias("mag"))


TUNE = """tu AS (SELECT loop_id, atan2(sum(mag * mag * sin(2 * pi() * band / 3)), sum(mag * mag * cos(2 * pi() * band / 3))) * 3 / (2 * pi()) AS phase FROM {frames_long} f WHERE band BETWEEN 36 AND 215 GROUP BY loop_id),
  tn AS (SELECT loop_id, phase, CAST(round_even(least(greatest(phase, -1), 1), 0) AS INT) AS tune FROM tu)"""


@query("a9_tuning", f"WITH {TUNE} SELECT loop_id, round(phase, 5) AS phase, CAST(tune AS BIGINT) AS tune FROM tn")
def a9(x: Tables) -> DataFrame:
    return audio.tuning(x.frames).select("loop_id", F.round("phase", 5).alias("phase"), L("tune").cast("bigint").alias("tune"))


POWERS = """sq AS (SELECT *, sqrt(mag) AS s FROM {frames_long} f),
  pad AS (SELECT loop_id, frame_ix, band, s FROM sq UNION ALL SELECT loop_id, frame_ix, -band - 1, s FROM sq WHERE band < 36 UNION ALL SELECT loop_id, frame_ix, 503 - band, s FROM sq WHERE band >= 217),
  mv AS (SELECT loop_id, frame_ix, band, s, avg(s) OVER (PARTITION BY loop_id, frame_ix ORDER BY band ROWS BETWEEN 36 PRECEDING AND 35 FOLLOWING) AS mean, lead(s, 36) OVER w AS s1, lead(s, 57) OVER w AS s2, lead(s, 72) OVER w AS s3, lead(s, 84) OVER w AS s4, lead(s, 93) OVER w AS s5 FROM pad WINDOW w AS (PARTITION BY loop_id, frame_ix ORDER BY band)),
  pw AS (SELECT loop_id, frame_ix, band, pow(s, 4) AS raw, pow(greatest(s - mean, 0), 4) AS peak,
    pow(s + CASE WHEN band + 36 < 252 THEN 0.8 * s1 ELSE 0 END + CASE WHEN band + 57 < 252 THEN 0.64 * s2 ELSE 0 END + CASE WHEN band + 72 < 252 THEN 0.512 * s3 ELSE 0 END + CASE WHEN band + 84 < 252 THEN 0.4096 * s4 ELSE 0 END + CASE WHEN band + 93 < 252 THEN 0.32768 * s5 ELSE 0 END, 4) AS harm FROM mv WHERE band BETWEEN 0 AND 251)"""


@query("f3_powers", f"WITH {POWERS} SELECT loop_id, frame_ix, round(sum(raw), 4) AS raw, round(sum(peak), 4) AS peak, round(sum(harm), 3) AS harm FROM pw GROUP BY ALL")
def f3(x: Tables) -> DataFrame:
    own = audio.peak_and_harmonic(x.frames)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    return own.select("loop_id", "frame_ix", F.round(total(audio.raw_power(L("bands"))), 4).alias("raw"), F.round(total(L("peak")), 4).alias("peak"), F.round(total(L("harm")), 3).alias("harm"))


SEMI = f"""WITH {TUNE}, {POWERS}, ms AS (SELECT p.loop_id, p.frame_ix, m, sqrt(sum(raw)) AS raw, sqrt(sum(peak)) AS peak, sqrt(sum(harm)) AS harm FROM pw p JOIN tn ON tn.loop_id = p.loop_id
  CROSS JOIN (SELECT range AS m FROM range(84)) mm CROSS JOIN (SELECT range - 1 AS j FROM range(3)) jj WHERE p.band = (3 * m + j + tune + 252) % 252 GROUP BY ALL)"""


@query("f4_semitones", SEMI + " SELECT loop_id, frame_ix, CAST(m AS BIGINT) AS m, round(raw, 5) AS level FROM ms")
def f4(x: Tables) -> DataFrame:
    own = audio.frame_features(x.frames).select("loop_id", "frame_ix", F.posexplode("levels").alias("m", "level"))
    return own.select("loop_id", "frame_ix", L("m").cast("bigint").alias("m"), F.round("level", 5).alias("level"))


FOLD = SEMI + """, fo AS (SELECT loop_id, frame_ix, m % 12 AS pc, sum(CASE WHEN m >= 12 THEN raw ELSE 0 END) AS rm, sum(CASE WHEN m BETWEEN 12 AND 35 THEN raw ELSE 0 END) AS rb, sum(CASE WHEN m BETWEEN 36 AND 59 THEN raw ELSE 0 END) AS rd,
    sum(CASE WHEN m >= 12 THEN peak ELSE 0 END) AS pm, sum(CASE WHEN m BETWEEN 12 AND 35 THEN peak ELSE 0 END) AS pb, sum(CASE WHEN m >= 12 THEN harm ELSE 0 END) AS hm, sum(CASE WHEN m BETWEEN 12 AND 35 THEN harm ELSE 0 END) AS hb FROM ms GROUP BY ALL),
  nn AS (SELECT loop_id, frame_ix, pc, rb AS bass, sum(rb) OVER w AS energy, rm / (sum(rm) OVER w + 1e-9) AS rm, rb / (sum(rb) OVER w + 1e-9) AS rb, rd / (sum(rd) OVER w + 1e-9) AS rd, pm / (sum(pm) OVER w + 1e-9) AS pm, pb / (sum(pb) OVER w + 1e-9) AS pb,
    hm / (sum(hm) OVER w + 1e-9) AS hm, hb / (sum(hb) OVER w + 1e-9) AS hb FROM fo WINDOW w AS (PARTITION BY loop_id, frame_ix)),
  nf AS (SELECT loop_id, max(frame_ix) + 1 AS n FROM ms GROUP BY loop_id)"""


@query("f5_chroma", FOLD + " SELECT loop_id, frame_ix, CAST(pc AS BIGINT) AS pc, round(rm, 6) AS mix, round(rb, 6) AS bass FROM nn")
def f5(x: Tables) -> DataFrame:
    own = audio.frame_features(x.frames)
    rows = own.select("loop_id", "frame_ix", F.posexplode(F.arrays_zip("raw_mix", "raw_bass")).alias("pc", "v"))
    return rows.select("loop_id", "frame_ix", L("pc").cast("bigint").alias("pc"), F.round("v.raw_mix", 6).alias("mix"), F.round("v.raw_bass", 6).alias("bass"))


def _descriptors(x: Tables, *names: str) -> DataFrame:
    """The named descriptors, one row per loop and pitch class."""
    own = audio.descriptors(x.frames).select("loop_id", F.posexplode(F.arrays_zip(*map(audio.column_of, names))).alias("pc", "v"))
    return own.select("loop_id", L("pc").cast("bigint").alias("pc"), *((F.round(L("v")[audio.column_of(n)], 5) + 0.0).alias(n.lower() + ("_major" if "M" in n else "")) for n in names))


@query("f6_mean_chroma", FOLD + " SELECT loop_id, CAST(pc AS BIGINT) AS pc, round(avg(rm), 5) AS raw_mix, round(avg(hm), 5) AS harm_mix, round(avg(pm), 5) AS peak_mix, round(avg(rb), 5) AS raw_bass, round(avg(hb), 5) AS harm_bass, round(avg(pb), 5) AS peak_bass, round(avg(rd), 5) AS raw_mid FROM nn GROUP BY ALL")
def f6(x: Tables) -> DataFrame:
    return _descriptors(x, "raw_mix", "harm_mix", "peak_mix", "raw_bass", "harm_bass", "peak_bass", "raw_mid")


def _low(lo: int, hi: int) -> str:
    return f"SELECT loop_id, frame_ix, m, raw, row_number() OVER (PARTITION BY loop_id, frame_ix ORDER BY raw DESC, m) AS r FROM ms WHERE m BETWEEN {lo} AND {hi - 1}"


def _hot(name: str, alias: str) -> str:
    return f"(SELECT coalesce(sum(CASE WHEN raw > 0 THEN 1 ELSE 0 END), 0) FROM {name} q WHERE q.r = 1 AND q.loop_id = g.loop_id AND q.m % 12 = g.pc) / n AS {alias}"


@query("f7_low_notes", FOLD + f", l1 AS ({_low(12, 36)}), l2 AS ({_low(0, 24)}), l3 AS ({_low(24, 48)}), g AS (SELECT DISTINCT loop_id, pc FROM nn) SELECT loop_id, pc, round(lownote, 5) AS lownote, round(sub, 5) AS lown_sub, round(lownote, 5) AS lown_b2, round(b3, 5) AS lown_b3 FROM (SELECT g.loop_id, CAST(g.pc AS BIGINT) AS pc, {_hot('l1', 'lownote')}, {_hot('l2', 'sub')}, {_hot('l3', 'b3')} FROM g JOIN nf ON nf.loop_id = g.loop_id) z")
def f7(x: Tables) -> DataFrame:
    return _descriptors(x, "lownote", "lown_sub", "lown_b2", "lown_b3")


@query("f8_low_notes_weighted", FOLD + f", l1 AS ({_low(12, 36)}), g AS (SELECT loop_id, m % 12 AS pc, sum(raw) AS v FROM l1 WHERE r = 1 GROUP BY ALL), t AS (SELECT loop_id, sum(v) AS t FROM g GROUP BY loop_id), k AS (SELECT DISTINCT loop_id, pc FROM nn) SELECT k.loop_id, CAST(k.pc AS BIGINT) AS pc, round(coalesce(v, 0) / (t + 1e-9), 5) AS lownote_w FROM k JOIN t ON t.loop_id = k.loop_id LEFT JOIN g ON g.loop_id = k.loop_id AND g.pc = k.pc")
def f8(x: Tables) -> DataFrame:
    return _descriptors(x, "lownote_w")


SALIENCE = FOLD + ", sa AS (SELECT loop_id, frame_ix, max(rm) / (sum(rm) / 12 + 1e-9) AS s FROM nn GROUP BY ALL), sl AS (SELECT loop_id, frame_ix, s / sum(s) OVER (PARTITION BY loop_id) AS w FROM sa)"


@query("f9_salience", SALIENCE + " SELECT nn.loop_id, CAST(pc AS BIGINT) AS pc, round(sum(rm * w), 5) AS salw_mix FROM nn JOIN sl ON sl.loop_id = nn.loop_id AND sl.frame_ix = nn.frame_ix GROUP BY ALL")
def f9(x: Tables) -> DataFrame:
    return _descriptors(x, "salw_mix")


@query("f10_dominant", FOLD + ", do_ AS (SELECT *, row_number() OVER (PARTITION BY loop_id, frame_ix ORDER BY rm DESC, pc) AS r FROM nn) SELECT loop_id, CAST(pc AS BIGINT) AS pc, round(avg(CASE WHEN r = 1 THEN 1.0 ELSE 0.0 END), 5) AS dompc, round(max(rm), 5) AS maxchroma, round(avg(sqrt(rm)), 5) AS sqrtmix FROM do_ GROUP BY ALL")
def f10(x: Tables) -> DataFrame:
    return _descriptors(x, "dompc", "maxchroma", "sqrtmix")


@query("f11_slices", FOLD + """ SELECT nn.loop_id, CAST(pc AS BIGINT) AS pc, round(avg(CASE WHEN frame_ix = 0 THEN rm END), 5) AS first_mix, round(avg(CASE WHEN frame_ix < greatest(1, n // 4) THEN rm END), 5) AS firstq, round(avg(CASE WHEN frame_ix < 2 THEN rb END), 5) AS bass_first,
  round(avg(CASE WHEN frame_ix >= n - 2 THEN rb END), 5) AS bass_last, round(avg(CASE WHEN frame_ix < 2 THEN rm END), 5) AS mix_first2, round(avg(CASE WHEN frame_ix >= n - 2 THEN rm END), 5) AS mix_last2, round(avg(CASE WHEN frame_ix < 2 THEN rd END), 5) AS mid_first,
  round(avg(CASE WHEN frame_ix >= n - 2 THEN rd END), 5) AS mid_last FROM nn JOIN nf ON nf.loop_id = nn.loop_id GROUP BY ALL""")
def f11(x: Tables) -> DataFrame:
    return _descriptors(x, "first_mix", "firstq", "bass_first", "bass_last", "mix_first2", "mix_last2", "mid_first", "mid_last")


@query("f12_bass_energy", FOLD + ", g AS (SELECT loop_id, pc, sum(bass) AS v FROM nn GROUP BY ALL) SELECT loop_id, CAST(pc AS BIGINT) AS pc, round(v / (sum(v) OVER (PARTITION BY loop_id) + 1e-9), 5) AS bass_energy FROM g")
def f12(x: Tables) -> DataFrame:
    return _descriptors(x, "bass_energy")


@query("f13_bass_loud", FOLD + ", en AS (SELECT DISTINCT loop_id, frame_ix, energy FROM nn), q AS (SELECT loop_id, quantile_cont(energy, 0.75) AS t FROM en GROUP BY loop_id) SELECT nn.loop_id, CAST(pc AS BIGINT) AS pc, round(avg(CASE WHEN energy >= t THEN rb END), 5) AS bass_loud FROM nn JOIN q ON q.loop_id = nn.loop_id GROUP BY ALL")
def f13(x: Tables) -> DataFrame:
    return _descriptors(x, "bass_loud")



CHORDS = FOLD + """, tr AS (SELECT a.loop_id, a.frame_ix, a.pc, a.rb, a.rm + b4.rm + e.rm AS mj, a.rm + b3.rm + e.rm AS mi, a.hm + b4.hm + e.hm AS hj, a.hm + b3.hm + e.hm AS hi FROM nn a
    JOIN nn b4 ON b4.loop_id = a.loop_id AND b4.frame_ix = a.frame_ix AND b4.pc = (a.pc + 4) % 12 JOIN nn b3 ON b3.loop_id = a.loop_id AND b3.frame_ix = a.frame_ix AND b3.pc = (a.pc + 3) % 12 JOIN nn e ON e.loop_id = a.loop_id AND e.frame_ix = a.frame_ix AND e.pc = (a.pc + 7) % 12),
  ch AS (SELECT loop_id, frame_ix, pc, 'M' AS k, mj AS s, hj AS h FROM tr UNION ALL SELECT loop_id, frame_ix, pc, 'm', mi, hi FROM tr),
  cz AS (SELECT *, exp((s - max(s) OVER w) / (stddev_pop(s) OVER w + 1e-9) * 2) AS es, exp((h - max(h) OVER w) / (stddev_pop(h) OVER w + 1e-9) * 2) AS eh FROM ch WINDOW w AS (PARTITION BY loop_id, frame_ix)),
  cp AS (SELECT *, es / sum(es) OVER (PARTITION BY loop_id, frame_ix) AS p, eh / sum(eh) OVER (PARTITION BY loop_id, frame_ix) AS ph FROM cz)"""


@query("f14_chords", CHORDS + """ SELECT cp.loop_id, CAST(pc AS BIGINT) AS pc, round(avg(CASE WHEN k = 'M' THEN p END), 5) AS chordm_mix_major, round(avg(CASE WHEN k = 'm' THEN p END), 5) AS chordm_mix, round(avg(CASE WHEN k = 'M' THEN ph END), 5) AS chordm_harm_major, round(avg(CASE WHEN k = 'm' THEN ph END), 5) AS chordm_harm,
  round(avg(CASE WHEN k = 'M' AND frame_ix < 2 THEN p END), 5) AS chordm_first_mix_major, round(avg(CASE WHEN k = 'm' AND frame_ix < 2 THEN p END), 5) AS chordm_first_mix, round(avg(CASE WHEN k = 'M' AND frame_ix >= n - 2 THEN p END), 5) AS chordm_last_mix_major, round(avg(CASE WHEN k = 'm' AND frame_ix >= n - 2 THEN p END), 5) AS chordm_last_mix
  FROM cp JOIN nf ON nf.loop_id = cp.loop_id GROUP BY ALL""")
def f14(x: Tables) -> DataFrame:
    return _descriptors(x, "chordM_mix", "chordm_mix", "chordM_harm", "chordm_harm", "chordM_first_mix", "chordm_first_mix", "chordM_last_mix", "chordm_last_mix")


@query("f15_chord_bass", CHORDS + " SELECT loop_id, CAST(pc AS BIGINT) AS pc, round(avg(mj * rb), 5) AS chord_bass_m_major, round(avg(mi * rb), 5) AS chord_bass_m FROM tr GROUP BY ALL")
def f15(x: Tables) -> DataFrame:
    return _descriptors(x, "chord_bass_M", "chord_bass_m")


_MEAN = lambda v, where="": f"avg(CASE WHEN {where} THEN {v} END)" if where else f"avg({v})"
FIRST2, LAST2 = "frame_ix < 2", "frame_ix >= n - 2"
#: Descriptors that are aggregates over a pitch class of nn (with n frames), of the dominant class, and of chord posteriors.
OF_CHROMA = {
    "raw_mix": "avg(rm)", "harm_mix": "avg(hm)", "peak_mix": "avg(pm)", "raw_bass": "avg(rb)", "harm_bass": "avg(hb)", "peak_bass": "avg(pb)", "raw_mid": "avg(rd)",
    "first_mix": _MEAN("rm", "frame_ix = 0"), "firstq": _MEAN("rm", "frame_ix < greatest(1, n // 4)"), "maxchroma": "max(rm)", "sqrtmix": "avg(sqrt(rm))",
    "bass_first": _MEAN("rb", FIRST2), "bass_last": _MEAN("rb", LAST2), "mix_first2": _MEAN("rm", FIRST2), "mix_last2": _MEAN("rm", LAST2), "mid_first": _MEAN("rd", FIRST2), "mid_last": _MEAN("rd", LAST2),
}
OF_CHORDS = {f"chord{k}_{t}": _MEAN(v, f"k = '{k}'" + (f" AND {w}" if w else "")) for k in "Mm" for t, v, w in (("mix", "p", ""), ("harm", "ph", ""), ("first_mix", "p", FIRST2), ("last_mix", "p", LAST2))}
#: Every descriptor, as rows (loop_id, place, v) of dv.
ALL_DESCRIPTORS = CHORDS + f""", al AS (SELECT nn.*, nf.n FROM nn JOIN nf ON nf.loop_id = nn.loop_id), ac AS (SELECT cp.*, nf.n FROM cp JOIN nf ON nf.loop_id = cp.loop_id),
  l1 AS ({_low(12, 36)}), l2 AS ({_low(0, 24)}), l3 AS ({_low(24, 48)}), gd AS (SELECT DISTINCT loop_id, pc FROM nn),
  sa AS (SELECT loop_id, frame_ix, max(rm) / (sum(rm) / 12 + 1e-9) AS s FROM nn GROUP BY ALL), sl AS (SELECT loop_id, frame_ix, s / sum(s) OVER (PARTITION BY loop_id) AS w FROM sa),
  dm AS (SELECT *, row_number() OVER (PARTITION BY loop_id, frame_ix ORDER BY rm DESC, pc) AS r FROM nn),
  qe AS (SELECT loop_id, quantile_cont(energy, 0.75) AS t FROM (SELECT DISTINCT loop_id, frame_ix, energy FROM nn) en GROUP BY loop_id),
  lw AS (SELECT loop_id, m % 12 AS pc, sum(raw) AS v FROM l1 WHERE r = 1 GROUP BY ALL), lt AS (SELECT loop_id, sum(v) AS t FROM lw GROUP BY loop_id), be AS (SELECT loop_id, pc, sum(bass) AS v FROM nn GROUP BY ALL),
  nv AS (""" + " UNION ALL ".join(
    [f"SELECT loop_id, '{name}' AS name, pc, {v} AS v FROM al GROUP BY loop_id, pc" for name, v in OF_CHROMA.items()]
    + [f"SELECT loop_id, '{name}', pc, {v} FROM ac GROUP BY loop_id, pc" for name, v in OF_CHORDS.items()]
    + [f"SELECT g.loop_id, '{name}', g.pc, {_hot(low, 'v')} FROM gd g JOIN nf ON nf.loop_id = g.loop_id" for name, low in (("lownote", "l1"), ("lown_b2", "l1"), ("lown_sub", "l2"), ("lown_b3", "l3"))]
    + [
        "SELECT gd.loop_id, 'lownote_w', gd.pc, coalesce(lw.v, 0) / (t + 1e-9) FROM gd JOIN lt ON lt.loop_id = gd.loop_id LEFT JOIN lw ON lw.loop_id = gd.loop_id AND lw.pc = gd.pc",
        "SELECT nn.loop_id, 'salw_mix', pc, sum(rm * w) FROM nn JOIN sl ON sl.loop_id = nn.loop_id AND sl.frame_ix = nn.frame_ix GROUP BY nn.loop_id, pc",
        "SELECT loop_id, 'dompc', pc, avg(CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE 0 END) FROM dm GROUP BY loop_id, pc",
        "SELECT nn.loop_id, 'bass_loud', pc, avg(CASE WHEN energy >= t THEN rb END) FROM nn JOIN qe ON qe.loop_id = nn.loop_id GROUP BY nn.loop_id, pc",
        "SELECT loop_id, 'bass_energy', pc, v / (sum(v) OVER (PARTITION BY loop_id) + 1e-9) FROM be",
        "SELECT loop_id, 'chord_bass_M', pc, avg(mj * rb) FROM tr GROUP BY loop_id, pc",
        "SELECT loop_id, 'chord_bass_m', pc, avg(mi * rb) FROM tr GROUP BY loop_id, pc",
    ]
) + f"), dv AS (SELECT loop_id, CAST((list_position({list(audio.NAMES)}, name) - 1) * 12 + pc AS BIGINT) AS place, v FROM nv)"


@query("f16_assembled", ALL_DESCRIPTORS + " SELECT loop_id, place, round(v, 5) + 0.0 AS value, CAST(432 AS BIGINT) AS size FROM dv")
def f16(x: Tables) -> DataFrame:
    """All 36 descriptors of 12 classes at their places."""
    values = audio.as_vector(audio.descriptors(x.frames)).select("loop_id", F.size("values").cast("bigint").alias("size"), F.posexplode("values").alias("place", "value"))
    return values.select("loop_id", L("place").cast("bigint").alias("place"), (F.round("value", 5) + 0.0).alias("value"), "size")


def synthetic_networks(features: int, hidden: int = 3, count: int = 2) -> scoring.Networks:
    """Weights by formula, as the trained ones are not public; all of them are exact in single precision."""
    nets = []
    for k in range(count):
        i = np.arange(features * 12 * hidden)
        w1 = ((i * (37 + 16 * k) % 101 - 50) / 128.0).reshape(features * 12, hidden)
        v = ((np.arange(hidden * 2) * (13 + k) % 11 - 5) / 8.0).reshape(hidden, 2)
        nets.append((w1, np.arange(hidden) * 0.125 - 0.125, v, np.array([0.0625, -0.0625])))
    return scoring.Networks(0.125 + 0.015625 * np.arange(features), nets)


NETWORK = STATS7 + """, x AS (SELECT loop_id, fx, pc, (value - avg(value) OVER (PARTITION BY loop_id, fx)) / 1000 / (0.125 + 0.015625 * fx) AS v FROM d7),
  h AS (SELECT loop_id, k, tonic, hh, greatest(sum(v * ((((fx * 12 + (pc - tonic + 12) % 12) * 3 + hh) * (37 + 16 * k)) % 101 - 50) / 128.0) + hh * 0.125 - 0.125, 0) AS a FROM x CROSS JOIN (SELECT range AS tonic FROM range(12)) t CROSS JOIN (SELECT range AS hh FROM range(3)) q CROSS JOIN (SELECT range AS k FROM range(2)) ks GROUP BY loop_id, k, tonic, hh),
  z AS (SELECT loop_id, k, tonic + 12 * m AS key_ix, CASE m WHEN 0 THEN 0.0625 ELSE -0.0625 END + sum(a * (((hh * 2 + m) * (13 + k)) % 11 - 5) / 8.0) AS z FROM h CROSS JOIN (SELECT range AS m FROM range(2)) ms GROUP BY loop_id, k, tonic, m),
  y AS (SELECT loop_id, k, key_ix, z - max(z) OVER w AS y FROM z WINDOW w AS (PARTITION BY loop_id, k)), p AS (SELECT loop_id, k, key_ix, y - ln(sum(exp(y)) OVER (PARTITION BY loop_id, k)) AS p FROM y)
  SELECT loop_id, CAST(key_ix AS BIGINT) AS key_ix, round(avg(p), 5) + 0.0 AS logp FROM p GROUP BY ALL"""


def _statistic_vectors(x: Tables) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, FEATURES)), L("feature"))
    rows = midi.all_statistics(x.notes).groupBy("loop_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("f"), "pc", "value"))).alias("s"))
    return rows.select("loop_id", F.transform("s", lambda s: s["value"] / 1000).alias("values"))


@query("m5_network", NETWORK)
def m5(x: Tables) -> DataFrame:
    scores = scoring.network_scores(_statistic_vectors(x), synthetic_networks(len(FEATURES)))
    return scores.select("loop_id", L("key_ix").cast("bigint").alias("key_ix"), (F.round("logp", 5) + 0.0).alias("logp"))


@query("m6_network_file", NETWORK)
def m6(x: Tables) -> DataFrame:
    """m5 with networks that went through the bytes of a file."""
    networks = scoring.Networks.parse(synthetic_networks(len(FEATURES)).serialised(), len(FEATURES))
    return scoring.network_scores(_statistic_vectors(x), networks).select("loop_id", L("key_ix").cast("bigint").alias("key_ix"), (F.round("logp", 5) + 0.0).alias("logp"))


@query("m6_network_keys", "SELECT CAST(floor(vec_id / 10) AS BIGINT) AS loop_id, CAST(24 AS BIGINT) AS keys, 1.0::DOUBLE AS total FROM embeddings GROUP BY 1")
def m6_keys(x: Tables) -> DataFrame:
    """A network on the audio descriptors gives 24 probabilities that sum to one."""
    networks = scoring.Networks.parse(synthetic_networks(36, count=1).serialised())
    scores = scoring.network_scores(audio.as_vector(audio.descriptors(x.frames)), networks)
    return scores.groupBy("loop_id").agg(F.count("*").alias("keys"), F.round(F.sum(F.exp("logp")), 1).alias("total"))


#: Loops with samples and loops with MIDI events overlap; a fifth of the samples are silent.
SAMPLED = "SELECT vec_id AS loop_id, vec_id, embedding FROM {embeddings} e"
SILENT = "vec_id % 5 = 0"
PAIRED = "(" + EVENTS + " SELECT loop_id, row_number() OVER (PARTITION BY loop_id ORDER BY track, seq) AS note_ord, start_tick, tick AS end_tick, pitch, channel FROM p WHERE kind = 'off' AND before_ = 'on')"

#: Log probabilities of the audible loops: frames of 32 values, 16 apart, through all 36 descriptors and two networks, as al.
_BANDS = F2_FRAMES.removeprefix("WITH ").replace("FROM embeddings)", f"FROM embeddings WHERE NOT ({SILENT}))").split("  SELECT vec_id AS loop_id")[0]
_FRAMED = _BANDS + ", framed AS (SELECT vec_id AS loop_id, frame_ix, 3 AS n_frames, k AS band, mag FROM m WHERE k < 252)"


def network_sql(inputs: str, features: str) -> str:
    """Log probabilities (loop_id, key_ix, p by network k) of the synthetic networks, as CTEs from rows (loop_id, fx, pc, v) of features."""
    return f"""{features} AS ({inputs}), nx AS (SELECT loop_id, fx, pc, (v - avg(v) OVER (PARTITION BY loop_id, fx)) / (0.125 + 0.015625 * fx) AS v FROM {features}),
  nh AS (SELECT loop_id, k, tonic, hh, greatest(sum(v * ((((fx * 12 + (pc - tonic + 12) % 12) * 3 + hh) * (37 + 16 * k)) % 101 - 50) / 128.0) + hh * 0.125 - 0.125, 0) AS a FROM nx CROSS JOIN (SELECT range AS tonic FROM range(12)) t CROSS JOIN (SELECT range AS hh FROM range(3)) q CROSS JOIN (SELECT range AS k FROM range(2)) ks GROUP BY loop_id, k, tonic, hh),
  nz AS (SELECT loop_id, k, tonic + 12 * m AS key_ix, CASE m WHEN 0 THEN 0.0625 ELSE -0.0625 END + sum(a * (((hh * 2 + m) * (13 + k)) % 11 - 5) / 8.0) AS z FROM nh CROSS JOIN (SELECT range AS m FROM range(2)) ms GROUP BY loop_id, k, tonic, m),
  ny AS (SELECT loop_id, k, key_ix, z - max(z) OVER w AS y FROM nz WINDOW w AS (PARTITION BY loop_id, k)), np AS (SELECT loop_id, k, key_ix, y - ln(sum(exp(y)) OVER (PARTITION BY loop_id, k)) AS p FROM ny)"""


AUDIO_NETWORK = f"WITH {_FRAMED}, " + ALL_DESCRIPTORS.removeprefix("WITH ").replace("{frames_long} f", "framed f") + ", " + network_sql("SELECT loop_id, place // 12 AS fx, place % 12 AS pc, v FROM dv", "fv") + " SELECT loop_id, key_ix, avg(p) AS audio FROM np GROUP BY ALL"
SCORED = f"""WITH loud AS ({AUDIO_NETWORK}), played AS ({LOGP.replace("{notes} x", PAIRED + " x")} SELECT loop_id, key_ix, logp AS midi FROM p), lps AS (SELECT DISTINCT loop_id FROM ({SAMPLED}) s UNION SELECT DISTINCT loop_id FROM {{midi_events}} n),
  both_ AS (SELECT coalesce(u.loop_id, d.loop_id) AS loop_id, coalesce(u.key_ix, d.key_ix) AS key_ix, d.loop_id IS NOT NULL AS uses_midi, CASE WHEN audio IS NULL THEN midi WHEN midi IS NULL THEN audio ELSE (audio + midi) / 2 END AS z FROM loud u FULL OUTER JOIN played d ON d.loop_id = u.loop_id AND d.key_ix = u.key_ix),
  lp AS (SELECT *, z - max(z) OVER w - ln(sum(exp(z - max_)) OVER w) AS logp FROM (SELECT *, max(z) OVER (PARTITION BY loop_id) AS max_ FROM both_) b WINDOW w AS (PARTITION BY loop_id)),
  rk AS (SELECT *, row_number() OVER (PARTITION BY loop_id ORDER BY round(logp, 9) DESC, key_ix) AS rank, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][CAST(key_ix % 12 + 1 AS INT)] AS key, CASE WHEN key_ix < 12 THEN 'Major' ELSE 'Minor' END AS mode FROM lp)"""
SUGGESTED = SCORED + """ SELECT loop_id, CAST(rank AS BIGINT) AS rank, key, mode, round(exp(logp), 4) + 0.0 AS probability, uses_midi, '' AS error_code FROM rk WHERE rank <= 3
  UNION ALL SELECT loop_id, 0, '', '', 0.0, false, CASE WHEN loop_id IN (SELECT vec_id FROM embeddings) THEN 'silent_audio' ELSE 'no_audio' END FROM lps WHERE loop_id NOT IN (SELECT loop_id FROM both_)"""


def _evidence(x: Tables) -> tuple:
    """samples, notes, networks, model, deviations, bias: what keys are scored from."""
    samples = x.sql(SAMPLED).select("loop_id", F.transform("embedding", lambda v: F.when(F.expr(SILENT), F.lit(0.0)).otherwise(v.cast("double"))).alias("samples"))
    return samples, midi.paired_notes(x.midi_events), synthetic_networks(36), model(x), deviations(x), BIAS


SHORT_FRAMES = {"frame": 32, "hop": 16, "rate": F2_RATE, "precision": "double"}


@query("m7_suggested", SUGGESTED)
def m7_suggested(x: Tables) -> DataFrame:
    """From samples and notes to suggestions: descriptors and networks on one side, statistics and the linear model on the other, and a row with an error for each loop without either."""
    evidence = _evidence(x)
    loops = evidence[0].select("loop_id").union(x.midi_events.select("loop_id")).distinct()
    out = analysis.suggested(loops, *evidence, **SHORT_FRAMES)
    out = out.select("loop_id", L("rank").cast("bigint").alias("rank"), "key", "mode", (F.round("probability", 4) + 0.0).alias("probability"), "uses_midi", "error_code")
    return out.fillna(0, ["rank", "probability"]).fillna("", ["key", "mode", "error_code"]).fillna(False, ["uses_midi"])


@query("a7_agreement_by_midi", SCORED + """, c AS (SELECT rk.*, d.key_ AS tag_key, d.mode_ AS tag_mode FROM rk JOIN {disk} d ON d.loop_id = rk.loop_id WHERE d.key_ <> '' AND d.mode_ IN ('Major', 'Minor')),
  ag AS (SELECT uses_midi, loop_id, max(CASE WHEN rank = 1 AND key = tag_key THEN 1 ELSE 0 END) AS t, max(CASE WHEN rank = 1 AND key = tag_key AND mode = tag_mode THEN 1 ELSE 0 END) AS b, max(CASE WHEN rank <= 3 AND key = tag_key THEN 1 ELSE 0 END) AS h, max(CASE WHEN rank = 1 THEN exp(logp) END) AS p FROM c GROUP BY ALL)
  SELECT uses_midi, count(*) AS loops, round(avg(t), 6) AS tonic, round(avg(b), 6) AS both, round(avg(h), 6) AS top3, round(avg(p), 4) AS confidence FROM ag GROUP BY uses_midi""")
def a7_by_midi(x: Tables) -> DataFrame:
    """Agreement of suggestions from samples and notes with the tags, for loops with notes and without."""
    scores = analysis.analysed(*_evidence(x), **SHORT_FRAMES).withColumn("logp", F.round("logp", 9))
    tags = x.disk.select("loop_id", L("key_").alias("tag_key"), L("mode_").alias("tag_mode"))
    out = ranking.agreement(ranking.compared(ranking.ranked(scoring.probabilities(scores)), tags), "uses_midi")
    return out.select("uses_midi", "loops", *(F.round(c, 6).alias(c) for c in ("tonic", "both", "top3")), F.round("confidence", 4).alias("confidence"))


def flagship(x: Tables) -> DataFrame:
    """The three likeliest keys of each loop from its notes."""
    return w5(x)
