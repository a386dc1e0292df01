"""The spectrogram of a synthetic loop of four chords, and the descriptors' properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import analysis, audio, midi, scoring
from cadenza.sources import smf


# Published descriptors of the four chords below, and a Standard MIDI File with its statistics.
DESCRIPTORS = {
    "raw_mix": [0.2391, 0.0214, 0.0383, 0.0066, 0.1017, 0.1619, 0.0264, 0.1736, 0.0148, 0.1661, 0.0064, 0.0436],
    "harm_mix": [0.2519, 0.0145, 0.0530, 0.0103, 0.0768, 0.1956, 0.0159, 0.1670, 0.0126, 0.1645, 0.0078, 0.0301],
    "peak_mix": [0.2570, 0.0127, 0.0316, 0.0000, 0.1067, 0.1761, 0.0163, 0.1803, 0.0040, 0.1750, 0.0002, 0.0401],
    "raw_bass": [0.1899, 0.0386, 0.0082, 0.0078, 0.0129, 0.1968, 0.0346, 0.1703, 0.0191, 0.2663, 0.0096, 0.0460],
    "lownote": [0.2727, 0.0000, 0.0000, 0.0000, 0.0000, 0.3636, 0.0000, 0.1818, 0.0000, 0.1818, 0.0000, 0.0000],
    "salw_mix": [0.2471, 0.0190, 0.0406, 0.0039, 0.0968, 0.1621, 0.0203, 0.1935, 0.0112, 0.1535, 0.0041, 0.0481],
    "bass_loud": [0.1159, 0.0576, 0.0282, 0.0280, 0.0451, 0.2262, 0.0830, 0.1106, 0.0481, 0.1919, 0.0288, 0.0364],
    "maxchroma": [0.6118, 0.0854, 0.1521, 0.0308, 0.2212, 0.6152, 0.0905, 0.6329, 0.0512, 0.4963, 0.0280, 0.1901],
    "chordM_mix": [0.1272, 0.0151, 0.0068, 0.0112, 0.0023, 0.2184, 0.0009, 0.0952, 0.0134, 0.0226, 0.0159, 0.0013],
    "chordm_harm": [0.0574, 0.0017, 0.0864, 0.0009, 0.0400, 0.0712, 0.0081, 0.0312, 0.0011, 0.1675, 0.0190, 0.0019],
    "mid_last": [0.0015, 0.0000, 0.5967, 0.0002, 0.0000, 0.0000, 0.0000, 0.2295, 0.0000, 0.0000, 0.0000, 0.1721],
    "chord_bass_M": [0.1668, 0.0040, 0.0019, 0.0011, 0.0021, 0.1609, 0.0034, 0.1455, 0.0034, 0.1528, 0.0016, 0.0083],
}
SMF = (
    "4d546864000000060000000101e04d54726b0000009800902d64003950009924640a903c500a405050892400822c903900003c0000400046802d000a"
    "902964003550009924640a9039500a3c5050892400822c903500003900003c00468029000a902b64003750009924640a903b500a3e5050892400822c"
    "903700003b00003e0046802b000a902d64003950009924640a903c500a405050892400822c903900003c0000400046802d0000ff2f00"
)
STATISTICS = ("duration", "count", "bass", "first", "last", "lowest", "bass_line")
OF_SMF = [
    [1160, 0, 380, 0, 760, 870, 0, 870, 0, 2130, 0, 390],
    [3, 0, 1, 0, 2, 2, 0, 2, 0, 5, 0, 1],
    [0, 0, 0, 0, 0, 470, 0, 470, 0, 940, 0, 0],
    [0, 0, 0, 0, 0, 0, 0, 0, 0, 2, 0, 0],
    [0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0],
    [0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0],
    [0, 0, 0, 0, 0, 1410, 0, 1410, 0, 2820, 0, 0],
]


def chords_loop():
    """C, Am, F, G with bass: 4.5 seconds at 22,050 Hz, each note with its octave."""
    n, out = 24_806, []
    for k, (bass, triad) in enumerate(((36, (60, 64, 67)), (33, (57, 60, 64)), (41, (53, 57, 60)), (43, (55, 59, 62)))):
        t = np.arange(k * n, (k + 1) * n + 1) / audio.SAMPLE_RATE
        x = np.zeros(len(t))
        for note, level in zip((bass, *triad), (0.30, 0.20, 0.15, 0.12), strict=True):
            hz = 440 * 2 ** ((note - 69) / 12)
            x += level * np.sin(2 * np.pi * hz * t) + 0.3 * level * np.sin(4 * np.pi * hz * t)
        out.append(x if k == 3 else x[:n])
    return np.concatenate(out)[:99_225].astype(np.float32)


@pytest.fixture(scope="module")
def loop(spark):
    return spark.createDataFrame([(1, chords_loop().tolist())], "loop_id long, samples array<float>")


def test_spectrogram(loop):
    rows = audio.spectrogram(loop).orderBy("frame_ix").collect()
    assert len(rows) == 11 and rows[0].n_frames == 11
    x = np.array([r.bands for r in rows])
    assert x.shape == (11, audio.BANDS)
    # the published sum of this signal's spectrogram in single precision
    assert x.sum() == pytest.approx(97556.8519, rel=1e-4)


def test_descriptors(loop):
    got = audio.as_rows(audio.descriptors(audio.spectrogram(loop))).toPandas()
    wide = got.pivot(index="feature", columns="pc", values="value").loc[audio.NAMES].to_numpy()
    assert wide.shape == (36, 12) and np.isfinite(wide).all()
    for name in ("raw_mix", "harm_mix", "peak_mix", "lownote", "dompc", "salw_mix", "bass_energy"):
        assert wide[audio.NAMES.index(name)].sum() == pytest.approx(1, abs=1e-6)
    assert int(wide[audio.NAMES.index("chordM_first_mix")].argmax()) == 0  # it begins with C major


def test_descriptors_equal_published_values(loop):
    wide = audio.descriptors(audio.spectrogram(loop)).first()
    for name, want in DESCRIPTORS.items():
        assert wide[audio.column_of(name)] == pytest.approx(want, abs=2e-4)


def test_statistics_of_a_midi_file_equal_published_values(spark):
    events = smf.midi_events(spark.createDataFrame([(1, bytes.fromhex(SMF))], "loop_id long, smf binary"))
    notes = midi.paired_notes(events)
    rows = midi.all_statistics(notes).collect()
    got = {(r.feature, r.pc): r.value for r in rows}
    assert {(n, pc): v for n, vs in zip(STATISTICS, OF_SMF, strict=True) for pc, v in enumerate(vs)} == got


def test_nothing_is_shuffled_between_samples_and_descriptors(loop):
    own = audio.descriptors_of_samples(loop)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInPandas") == 1
    by_frames = audio.descriptors(audio.spectrogram(loop))
    assert by_frames._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    for a, b in zip(own.first()[1:], by_frames.first()[1:], strict=True):
        assert a == pytest.approx(b, abs=1e-12)


def test_loops_of_one_frame_and_of_silence_have_finite_descriptors(spark):
    rows = [(1, [0.5, -0.5] * 50), (2, [0.0] * 300), (3, [1e-3] * 40_000)]
    wide = audio.descriptors_of_samples(spark.createDataFrame(rows, "loop_id long, samples array<float>")).collect()
    assert [r.loop_id for r in wide] == [1, 2, 3]
    assert all(np.isfinite(v).all() for r in wide for v in r[1:])


def test_nearly_equal_chord_scores_keep_their_digits():
    c = np.full((1, 12), 1 / 12) + 1e-11 * np.arange(12)
    s = audio.triads(c)
    z = 2 * (s - s.mean()) / (s.std() + audio.EPSILON)
    assert np.log(audio.chords(c)) == pytest.approx(z - np.log(np.exp(z).sum()), abs=1e-9)


@pytest.mark.parametrize("channels", [1, 2, 3, 6])
def test_mixdown_of_any_number_of_channels(spark, channels):
    rng = np.random.default_rng(channels)
    x = rng.normal(size=(50, channels))
    rows = [(1, x.ravel().tolist(), channels), (2, x.ravel().tolist()[:-1], channels), (3, [], channels), (4, None, channels), (5, [1.0], 0)]
    got = {r.id: r.m for r in spark.createDataFrame(rows, "id int, s array<double>, c int").select("id", audio.mixdown(F.col("s"), F.col("c")).alias("m")).collect()}
    assert got[1] == pytest.approx(x.mean(axis=1).tolist())
    assert len(got[2]) == 49 and got[3] == [] and got[4] is None and got[5] is None


def test_a_note_of_any_length_and_late_ends(spark):
    notes = [(1, 1, 0, 1 << 60, 40, 0), (1, 2, 480, 960, 50, 0), (1, 3, 960, 960, 60, 0), (1, 4, 960, 1000, 62, 0), (2, 1, 5, 5, 40, 0)]
    df = spark.createDataFrame(notes, "loop_id long, note_ord long, start_tick long, end_tick long, pitch long, channel long")
    want = {(l, o, n) for l in (1, 2) for o in {x[2] for x in notes if x[0] == l} for (m, n, a, b, *_) in notes if m == l and a <= o < b} | {(2, 5, 1)}
    assert {(r.loop_id, r.onset, r.note_ord) for r in midi.sounding(df).collect()} == want


def test_bass_line_by_sweep_equals_the_lowest_of_all_sounding_notes(spark):
    """100,000 notes of one loop, a third of them long; and loops with ties, notes of no length and negative pitches of none."""
    rng = np.random.default_rng(2)
    n = 100_000
    start = rng.integers(0, 40_000, n) * 10
    length = np.where(rng.random(n) < 0.001, rng.integers(0, 100_000, n), rng.integers(0, 40, n))
    rows = [(1, i, int(a), int(a + d), int(p), int(c)) for i, (a, d, p, c) in enumerate(zip(start, length, rng.integers(0, 128, n), rng.integers(0, 11, n), strict=True))]
    rows += [(loop, i, int(a), int(a + d), int(p), 0) for loop in range(2, 60) for i, (a, d, p) in enumerate(zip(rng.integers(0, 9, 12), rng.integers(0, 6, 12), rng.integers(40, 44, 12), strict=True))]
    notes = spark.createDataFrame(rows, "loop_id long, note_ord long, start_tick long, end_tick long, pitch long, channel long").repartition(7)
    low = midi.sounding(notes).groupBy("loop_id", "onset").agg(F.min(F.struct("pitch", "note_ord", "length")).alias("n"))
    want = {(r.loop_id, r.pc): r.v for r in low.groupBy("loop_id", (F.col("n.pitch") % 12).alias("pc")).agg(F.sum("n.length").cast("double").alias("v")).collect()}
    got = {(r.loop_id, r.pc): r.value for r in midi.bass_line(notes).collect()}
    assert len(got) == 59 * 12 and {k: v for k, v in got.items() if v} == want


def test_silence_is_rejected(spark):
    rows = spark.createDataFrame([(1, [0.0] * 100), (2, []), (3, None), (4, [0.5])], "loop_id long, samples array<float>")
    assert [r.ok for r in rows.select("loop_id", audio.is_audible("samples").alias("ok")).orderBy("loop_id").collect()] == [False, False, False, True]


def test_networks_round_trip():
    rng = np.random.default_rng(0)
    nets = scoring.Networks(np.ones(36), [(rng.normal(size=(432, 4)), rng.normal(size=4), rng.normal(size=(4, 2)), np.zeros(2)) for _ in range(2)])
    raw = nets.serialised()
    again = scoring.Networks.parse(raw)
    assert np.allclose(again.nets[1][0], nets.nets[1][0], atol=1e-6)
    for bad in (raw[:-4], raw + b"\0" * 4, b"KDM2" + raw[4:], b""):
        with pytest.raises(ValueError):
            scoring.Networks.parse(bad)


def test_bass_line_takes_notes_of_no_length_only_in_silence(spark):
    notes = spark.createDataFrame([(1, 1, 0, 100, 60, 0), (1, 2, 50, 50, 40, 0), (1, 3, 200, 200, 47, 0), (1, 4, 0, 500, 30, 9)], "loop_id long, note_ord long, start_tick long, end_tick long, pitch long, channel long")
    got = {(r.onset, r.note_ord) for r in midi.sounding(notes).collect()}
    assert got == {(0, 1), (50, 1), (200, 3)}
    assert midi.statistics(notes.where("channel = 9")).count() == 0


def test_samples_and_notes_lead_to_suggestions_or_errors(spark):
    """Loop 1 has both kinds of evidence, 2 samples only, 3 notes only and silence, 4 silence, 5 drums only and no samples, 6 empty samples."""
    rng = np.random.default_rng(5)
    nets = scoring.Networks(np.ones(36), [(rng.normal(size=(432, 4)), rng.normal(size=4), rng.normal(size=(4, 2)), np.zeros(2)) for _ in range(2)])
    loop = chords_loop().tolist()
    samples = spark.createDataFrame([(1, loop), (2, loop), (3, [0.0] * 100), (4, [0.0] * 100), (6, [])], "loop_id long, samples array<float>")
    notes = spark.createDataFrame([(1, 1, 0, 9, 60, 0), (3, 1, 0, 9, 60, 0), (5, 1, 0, 9, 60, 9)], "loop_id long, note_ord long, start_tick long, end_tick long, pitch long, channel long")
    model = spark.createDataFrame([(f, o, m, float((i * 7 + o) % 5)) for i, f in enumerate(STATISTICS) for o in range(12) for m in ("Major", "Minor")], "feature string, offset int, mode string, weight double")
    std = spark.createDataFrame([(f, 0.5) for f in STATISTICS], "feature string, std double")
    loops = spark.range(1, 7).withColumnRenamed("id", "loop_id")
    evidence = (samples, notes, nets, model, std, (0.1, -0.1))
    rows = analysis.suggested(loops, *evidence).collect()
    assert {(r.loop_id, r.error_code) for r in rows if r.error_code} == {(4, "silent_audio"), (5, "no_audio"), (6, "silent_audio")}
    assert {(r.loop_id, r["rank"], r.uses_midi) for r in rows if not r.error_code} == {(i, k, i != 2) for i in (1, 2, 3) for k in (1, 2, 3)}
    scores = {(r.loop_id, r.key_ix): r.logp for r in analysis.analysed(*evidence).collect()}
    alone = {r.key_ix: r.logp for r in analysis.midi_scores(notes, model, std, (0.1, -0.1)).where("loop_id = 3").collect()}
    wide = audio.descriptors_of_samples(samples.where("loop_id = 2")).first()
    heard = nets.log_p(np.array([wide[audio.column_of(n)] for n in audio.NAMES])[None])[0]
    mean = np.array([(heard[k] + alone[k]) / 2 for k in range(24)])
    mean -= np.log(np.exp(mean).sum())
    for k in range(24):
        assert scores[2, k] == pytest.approx(heard[k], abs=1e-6) and scores[3, k] == pytest.approx(alone[k]) and scores[1, k] == pytest.approx(mean[k], abs=1e-6)
