"""Audio descriptors of loops: mixdown, spectrogram, tuning, and 36 descriptors of 12 pitch classes.

A loop is one row of samples, at most MAX_SECONDS of which are used. All that its descriptors need, tuning and loudness over its frames included,
is computed where that row is, by numpy on the frames of one loop at a time; no shuffle lies between samples and descriptors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.containers import bounded_batches

# Fixed values of the descriptors.
SAMPLE_RATE, MAX_SECONDS = 22_050, 60
FRAME, HOP = 16_384, 8_192
BANDS, PER_OCTAVE, LOWEST_HZ = 252, 36, 32.7032
SEMITONES = 84
SHIFTS = [0, 36, 57, 72, 84, 93]
EPSILON = 1e-9
SILENCE = 1e-5
NAMES = [
    "raw_mix", "harm_mix", "peak_mix", "raw_bass", "harm_bass", "peak_bass", "lownote", "raw_mid", "firstq",
    "salw_mix", "dompc", "lown_sub", "lown_b2", "lown_b3", "bass_first", "bass_last", "bass_loud", "lownote_w",
    "first_mix", "maxchroma", "sqrtmix", "bass_energy", "mix_first2", "mix_last2", "mid_first", "mid_last",
    "chordM_mix", "chordm_mix", "chordM_harm", "chordm_harm", "chordM_first_mix", "chordm_first_mix",
    "chordM_last_mix", "chordm_last_mix", "chord_bass_M", "chord_bass_m",
]


def column_of(name: str) -> str:
    """The column of a descriptor in wide tables, where names that differ in case only would clash."""
    if name.startswith("chord_bass"):
        return "chord_bass_major" if name.endswith("M") else "chord_bass_minor"
    return name.replace("chordM", "chord_major").replace("chordm", "chord_minor")


def mono(left: Column, right: Column) -> Column:
    """Mean of two channels."""
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


def mixdown(interleaved: Column, channels: Column) -> Column:
    """Mean of any number of channels whose samples are interleaved; what is left of a last, incomplete frame is dropped.

    Null without samples or with no channel; one channel is itself.
    """
    mean = lambda i: F.aggregate(F.slice(interleaved, i * channels + 1, channels), F.lit(0.0), lambda a, v: a + v, lambda a: a / channels)
    whole = F.floor(F.size(interleaved) / channels).cast("int")
    frames = F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), mean)).otherwise(F.array().cast("array<double>"))
    one = F.transform(interleaved, lambda v: v.cast("double"))
    return F.when(interleaved.isNotNull() & (channels > 0), F.when(channels == 1, one).otherwise(frames))


def loudest(samples: Column) -> Column:
    """Largest magnitude of the first 60 seconds; null without samples."""
    return F.array_max(F.transform(F.slice(samples, 1, SAMPLE_RATE * MAX_SECONDS), lambda x: F.abs(x)))


def is_audible(samples: Column) -> Column:
    return F.coalesce(loudest(samples) > SILENCE, F.lit(False))


def band_edges(frame: int, rate: float, bands: int = BANDS) -> np.ndarray:
    """Edges of the bands as places in the running sum of a frame's power."""
    k = np.arange(bands + 1)
    return np.clip(LOWEST_HZ * 2 ** ((k - 0.5) / PER_OCTAVE) / (rate / frame), 0, frame // 2 + 1)


def frame_bands(samples: np.ndarray, frame: int, hop: int, rate: float, single: bool) -> np.ndarray:
    """Frames x bands. In single precision the window, power and running sum are float32, as the descriptors' reference values need."""
    kind = np.float32 if single else np.float64
    x = np.asarray(samples, dtype=kind)
    if len(x) < frame:
        x = np.concatenate([x, np.zeros(frame - len(x), dtype=kind)])
    cut = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop] * np.hanning(frame).astype(kind)
    spectrum = np.fft.rfft(cut, axis=1)
    power = (spectrum.real**2 + spectrum.imag**2).astype(kind)
    total = np.concatenate([np.zeros((len(cut), 1)), np.cumsum(power, axis=1, dtype=kind)], axis=1).astype(np.float64)
    edges = band_edges(frame, rate)
    low = np.floor(edges).astype(int)
    high, part = np.minimum(low + 1, total.shape[1] - 1), edges - low
    at = total[:, low] * (1 - part) + total[:, high] * part
    return np.sqrt(np.maximum(np.diff(at, axis=1), 0)).astype(kind)


def spectrogram(loops: DataFrame, frame: int = FRAME, hop: int = HOP, rate: float = SAMPLE_RATE, precision: str = "single") -> DataFrame:
    """(loop_id, frame_ix, n_frames, bands) from (loop_id, samples); samples never cross a shuffle."""
    bounded_batches(loops.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for loop, samples in zip(b["loop_id"], b["samples"], strict=True):
                x = frame_bands(samples[: int(rate * MAX_SECONDS)], frame, hop, rate, precision == "single")
                yield pd.DataFrame({"loop_id": loop, "frame_ix": np.arange(len(x)), "n_frames": len(x), "bands": [*x.astype(np.float64)]})

    return loops.select("loop_id", "samples").mapInPandas(run, "loop_id long, frame_ix long, n_frames long, bands array<double>")


def _weights() -> tuple[Column, Column]:
    """Sine and cosine parts of a frame's energy over the three bands of a semitone."""
    middle = F.slice("bands", 37, 180)
    part = lambda f: F.aggregate(F.zip_with(middle, F.array(*(F.lit(f(2 * math.pi * k / 3)) for k in range(36, 216))), lambda v, w: v * v * w), F.lit(0.0), lambda a, x: a + x)
    return part(math.sin), part(math.cos)


def _phase(s: Column, c: Column) -> Column:
    return F.atan2(s, c) / (2 * math.pi) * 3


def _tune(phase: Column) -> Column:
    return F.bround(F.least(F.greatest(phase, F.lit(-1.0)), F.lit(1.0))).cast("int")


def tuning(frames: DataFrame) -> DataFrame:
    """(loop_id, phase, tune): the phase of the energy over the three bands of a semitone, rounded half to even to -1, 0 or 1."""
    s, c = _weights()
    sums = frames.select("loop_id", s.alias("s"), c.alias("c")).groupBy("loop_id").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    phase = _phase(F.col("s"), F.col("c"))
    return sums.select("loop_id", phase.alias("phase"), _tune(phase).alias("tune"))


def raw_power(bands: Column) -> Column:
    return F.transform(bands, lambda v: v * v)


def peak_and_harmonic(frames: DataFrame) -> DataFrame:
    """frames with peak and harmonic powers of each band: numpy on batches of whole frames, no shuffle.

    With s the roots of the bands: peak is max(s - mean over [k-36, k+35], reflected at the ends, 0)^4, harmonic
    the fourth power of the sum of 0.8^i s[k + shift_i] over the shifts inside.
    """

    @F.pandas_udf("peak array<double>, harm array<double>")
    def powers(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            peak, harm = peak_and_harmonic_powers(np.stack([np.asarray(x, dtype=float) for x in b]) if len(b) else np.zeros((0, BANDS)))
            yield pd.DataFrame({"peak": [*peak], "harm": [*harm]})

    return frames.withColumn("powers_", powers("bands")).withColumns({"peak": F.col("powers_.peak"), "harm": F.col("powers_.harm")}).drop("powers_")


# The kernel: frames x bands of one loop.


def peak_and_harmonic_powers(bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sqrt(bands)
    wide = np.pad(s, ((0, 0), (36, 35)), mode="symmetric")
    total = np.concatenate([np.zeros((len(s), 1)), np.cumsum(wide, axis=1)], axis=1)
    peak = np.maximum(s - (total[:, 72:] - total[:, :-72]) / 72, 0)
    harm = np.zeros_like(s)
    for i, shift in enumerate(SHIFTS):
        harm[:, : s.shape[1] - shift] += 0.8**i * s[:, shift:]
    return peak**4, harm**4


_ANGLE = 2 * math.pi * np.arange(36, 216) / 3


def tune_of(bands: np.ndarray) -> int:
    """The tune of a loop, as in tuning."""
    energy = (bands[:, 36:216] ** 2).sum(axis=0)
    phase = math.atan2(energy @ np.sin(_ANGLE), energy @ np.cos(_ANGLE)) / (2 * math.pi) * 3
    return round(min(max(phase, -1.0), 1.0))


def levels(power: np.ndarray, tune: int) -> np.ndarray:
    """frames x 84: root of the power of the three bands around each semitone, shifted by the tuning, wrapping round."""
    middle = 3 * np.arange(SEMITONES) + tune
    return np.sqrt(sum(power[:, (middle + j) % BANDS] for j in (-1, 0, 1)))


def folded(m: np.ndarray, a: int, b: int) -> np.ndarray:
    """Sums of semitones [a, b), whole octaves from a C, by pitch class."""
    return m[:, a:b].reshape(len(m), -1, 12).sum(axis=1)


def normalised(c: np.ndarray) -> np.ndarray:
    return c / (c.sum(axis=-1, keepdims=True) + EPSILON)


def chroma(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised folds of a frame's whole range and of its bass."""
    return normalised(folded(m, 12, 84)), normalised(folded(m, 12, 36))


def loudest_class(m: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """frames x 12: one-hot class of the first of the loudest semitones in [a, b), and its level there; zero where all is silent."""
    at = m[:, a:b].argmax(axis=1) + a
    level = m[np.arange(len(m)), at][:, None] * (np.arange(12) == (at % 12)[:, None])
    return (level > 0).astype(float), level


def triads(c: np.ndarray) -> np.ndarray:
    """frames x 24: sums of the notes of 12 major, then 12 minor triads."""
    third, fifth = [np.roll(c, -k, axis=1) for k in (4, 3)], np.roll(c, -7, axis=1)
    return np.concatenate([c + t + fifth for t in third], axis=1)


def chords(c: np.ndarray) -> np.ndarray:
    """Softmax of twice the standardised scores of the triads."""
    s = triads(c)
    z = 2 * (s - s.mean(axis=1, keepdims=True)) / (s.std(axis=1, keepdims=True) + EPSILON)
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loop_descriptors(bands: np.ndarray) -> np.ndarray:
    """36 x 12: the descriptors of one loop, in the order of NAMES, from its frames (at least one) x bands."""
    n, tune = len(bands), tune_of(bands)
    peak, harm = peak_and_harmonic_powers(bands)
    raw = levels(bands**2, tune)
    (mix, bass), (peak_mix, peak_bass), (harm_mix, harm_bass) = map(chroma, (raw, levels(peak, tune), levels(harm, tune)))
    mid, bass_fold = normalised(folded(raw, 36, 60)), folded(raw, 12, 36)
    (low, low_level), (sub, _), (b3, _) = (loudest_class(raw, a, b) for a, b in ((12, 36), (0, 24), (24, 48)))
    salience = mix.max(axis=1) / (mix.mean(axis=1) + EPSILON)
    energy = bass_fold.sum(axis=1)
    chord, chord_h, both = chords(mix), chords(harm_mix), triads(mix)
    first2, last2, mean = slice(0, 2), slice(max(0, n - 2), n), lambda x: x.mean(axis=0)
    out = {
        "raw_mix": mean(mix), "harm_mix": mean(harm_mix), "peak_mix": mean(peak_mix), "raw_bass": mean(bass), "harm_bass": mean(harm_bass), "peak_bass": mean(peak_bass),
        "raw_mid": mean(mid), "lownote": mean(low), "lown_b2": mean(low), "lown_sub": mean(sub), "lown_b3": mean(b3), "lownote_w": normalised(low_level.sum(axis=0)),
        "salw_mix": salience @ mix / (salience.sum() or 1.0), "dompc": mean(np.eye(12)[mix.argmax(axis=1)]), "maxchroma": mix.max(axis=0), "sqrtmix": mean(np.sqrt(mix)),
        "first_mix": mix[0], "firstq": mean(mix[: max(1, n // 4)]), "mix_first2": mean(mix[first2]), "mix_last2": mean(mix[last2]),
        "mid_first": mean(mid[first2]), "mid_last": mean(mid[last2]), "bass_first": mean(bass[first2]), "bass_last": mean(bass[last2]),
        "bass_energy": normalised(bass_fold.sum(axis=0)), "bass_loud": mean(bass[energy >= np.percentile(energy, 75)]),
        "chord_bass_M": mean(both[:, :12] * bass), "chord_bass_m": mean(both[:, 12:] * bass),
    }
    for k, half in (("M", slice(0, 12)), ("m", slice(12, 24))):
        out |= {f"chord{k}_mix": mean(chord)[half], f"chord{k}_harm": mean(chord_h)[half], f"chord{k}_first_mix": mean(chord[first2])[half], f"chord{k}_last_mix": mean(chord[last2])[half]}
    return np.stack([out[name] for name in NAMES])


DESCRIPTORS = ", ".join(f"{column_of(name)} array<double>" for name in NAMES)


def _wide(loops: list, values: list[np.ndarray]) -> pd.DataFrame:
    columns = {column_of(name): [v[i] for v in values] for i, name in enumerate(NAMES)}
    return pd.DataFrame({"loop_id": pd.Series(loops, dtype="int64")} | columns)


def descriptors_of_samples(loops: DataFrame, frame: int = FRAME, hop: int = HOP, rate: float = SAMPLE_RATE, precision: str = "single") -> DataFrame:
    """One row per loop with the descriptors of NAMES, each an array of 12 under its column_of, from (loop_id, samples).

    A loop is one row, and all its frames come out of that row: nothing is shuffled between samples and descriptors.
    """
    bounded_batches(loops.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            frames = [frame_bands(s[: int(rate * MAX_SECONDS)], frame, hop, rate, precision == "single").astype(float) for s in b["samples"]]
            yield _wide(b["loop_id"].tolist(), [*map(loop_descriptors, frames)])

    return loops.select("loop_id", "samples").mapInPandas(run, f"loop_id long, {DESCRIPTORS}")


def _bands(part: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    part = part.sort_values("frame_ix")
    return part, np.stack([np.asarray(b, dtype=float) for b in part["bands"]])


def descriptors(frames: DataFrame) -> DataFrame:
    """descriptors_of_samples from frames that are at hand, (loop_id, frame_ix, bands): at most MAX_SECONDS of frames a loop meet in one shuffle."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return _wide([part["loop_id"].iloc[0]], [loop_descriptors(_bands(part)[1])])

    return frames.select("loop_id", "frame_ix", "bands").groupBy("loop_id").applyInPandas(run, f"loop_id long, {DESCRIPTORS}")


def frame_features(frames: DataFrame) -> DataFrame:
    """One row per frame of (loop_id, frame_ix, bands): the levels of its 84 semitones, and chroma of the whole range and of the bass."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part, bands = _bands(part)
        m = levels(bands**2, tune_of(bands))
        mix, bass = chroma(m)
        return pd.DataFrame({"loop_id": part["loop_id"], "frame_ix": part["frame_ix"], "levels": [*m], "raw_mix": [*mix], "raw_bass": [*bass]})

    return frames.select("loop_id", "frame_ix", "bands").groupBy("loop_id").applyInPandas(run, "loop_id long, frame_ix long, levels array<double>, raw_mix array<double>, raw_bass array<double>")


def as_vector(loops: DataFrame) -> DataFrame:
    """(loop_id, values): the descriptors in order, 36 * 12 values."""
    return loops.select("loop_id", F.concat(*map(column_of, NAMES)).alias("values"))


def as_rows(loops: DataFrame) -> DataFrame:
    """(loop_id, feature, pc, value)."""
    long_ = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(column_of(n)).alias("v")) for n in NAMES)))
    return loops.select("loop_id", long_.alias("x")).select("loop_id", F.col("x.feature").alias("feature"), F.posexplode("x.v").alias("pc", "value"))
