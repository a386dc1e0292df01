"""Scores of the 24 keys: scaling, transposition, linear and network models, log-softmax, combination.

Key index t is tonic t Major, 12 + t tonic t Minor. Models are tables or files given by the caller.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

EPSILON = 1e-9
KEYS = 24
DESCRIPTORS_PER_NETWORK = 36


def scaled(features: DataFrame, std: DataFrame, by_sum: bool) -> DataFrame:
    """Long features (loop_id, feature, pc, value) of 12 classes: divided by their sum if by_sum, centred, divided by the feature's std."""
    row = Window.partitionBy("loop_id", "feature")
    value = F.col("value") / (F.sum("value").over(row) + EPSILON) if by_sum else F.col("value")
    own = features.withColumn("value", value)
    own = own.withColumn("value", F.col("value") - F.avg("value").over(row))
    return own.join(F.broadcast(std), "feature").select("loop_id", "feature", "pc", (F.col("value") / F.col("std")).alias("value"))


def transposed(features: DataFrame) -> DataFrame:
    """Each feature as seen from the 12 tonics: offset is the class minus the tonic."""
    tonics = F.explode(F.sequence(F.lit(0), F.lit(11))).alias("tonic")
    return features.select("*", tonics).withColumn("offset", F.pmod(F.col("pc") - F.col("tonic"), F.lit(12)))


def linear_scores(features: DataFrame, model: DataFrame, bias: tuple[float, float]) -> DataFrame:
    """(loop_id, key_ix, z) from scaled features and weights (feature, offset, mode, weight).

    The table of weights has features * 24 rows, whatever the corpus.
    """
    wide = model.groupBy("feature", "offset").pivot("mode", ["Major", "Minor"]).agg(F.first("weight"))
    joined = transposed(features).join(F.broadcast(wide), ["feature", "offset"])
    sums = joined.groupBy("loop_id", "tonic").agg(F.sum(F.col("value") * F.col("Major")).alias("Major"), F.sum(F.col("value") * F.col("Minor")).alias("Minor"))
    both = F.explode(F.array(
        F.struct(F.col("tonic").alias("key_ix"), (F.col("Major") + bias[0]).alias("z")),
        F.struct((F.col("tonic") + 12).alias("key_ix"), (F.col("Minor") + bias[1]).alias("z")),
    ))
    return sums.select("loop_id", both.alias("s")).select("loop_id", "s.key_ix", "s.z")


def log_softmax(scores: DataFrame, z: str = "z", out: str = "logp") -> DataFrame:
    """scores with log probabilities over each loop's rows."""
    loop = Window.partitionBy("loop_id")
    top = scores.withColumn("top_", F.max(z).over(loop))
    total = F.log(F.sum(F.exp(F.col(z) - F.col("top_"))).over(loop))
    return top.withColumn(out, F.col(z) - F.col("top_") - total).drop("top_")


def probabilities(scores: DataFrame, logp: str = "logp", out: str = "probability") -> DataFrame:
    """scores with probabilities that sum to one over each loop's rows."""
    loop = Window.partitionBy("loop_id")
    own = scores.withColumn("e_", F.exp(F.col(logp) - F.max(logp).over(loop)))
    return own.withColumn(out, F.col("e_") / F.sum("e_").over(loop)).drop("e_")


def either(audio: DataFrame, midi: DataFrame) -> DataFrame:
    """(loop_id, key_ix, audio, midi): log probabilities side by side, null where a loop lacks one."""
    one = audio.select("loop_id", "key_ix", F.col("logp").alias("audio"))
    return one.join(midi.select("loop_id", "key_ix", F.col("logp").alias("midi")), ["loop_id", "key_ix"], "full_outer")


def combined(audio: DataFrame, midi: DataFrame) -> DataFrame:
    """(loop_id, key_ix, logp, uses_midi): the mean of both log distributions, renormalised, or the one that there is."""
    both = either(audio, midi).withColumn("uses_midi", F.col("midi").isNotNull())
    mean = F.when(F.col("audio").isNotNull() & F.col("midi").isNotNull(), (F.col("audio") + F.col("midi")) / 2)
    own = both.withColumn("z", F.coalesce(mean, F.col("audio"), F.col("midi")))
    shifted = log_softmax(own, "z", "shared_")
    return shifted.select("loop_id", "key_ix", F.when(mean.isNotNull(), F.col("shared_")).otherwise(F.col("z")).alias("logp"), "uses_midi")


def without_scores(loops: DataFrame, scores: DataFrame) -> DataFrame:
    """Loops that neither audio nor MIDI could score: error rows."""
    return loops.join(scores.select("loop_id").distinct(), "loop_id", "left_anti").select("loop_id", F.lit("no_key_evidence").alias("error_code"))


@dataclass
class Networks:
    """An ensemble: standard deviations of the descriptors, and per network W1, b1, V, c."""

    std: np.ndarray
    nets: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def parse(cls, raw: bytes, features: int = DESCRIPTORS_PER_NETWORK) -> Networks:
        """Read a KDM1 file: three little-endian counts, deviations, then the networks in single precision; its size must fit exactly."""
        if len(raw) < 16 or raw[:4] != b"KDM1":
            raise ValueError("not a key model")
        count, n, hidden = struct.unpack("<3I", raw[4:16])
        inputs = n * 12
        shapes = [(inputs, hidden), (hidden,), (hidden, 2), (2,)]
        each = sum(int(np.prod(s)) for s in shapes)
        if n != features or not count or len(raw) != 16 + 4 * (n + count * each):
            raise ValueError("corrupt key model")
        flat, at, nets = np.frombuffer(raw, dtype="<f4", offset=16), n, []
        for _ in range(count):
            parts = []
            for shape in shapes:
                size = int(np.prod(shape))
                parts.append(flat[at : at + size].reshape(shape))
                at += size
            nets.append(tuple(parts))
        return cls(flat[:n], nets)

    def serialised(self) -> bytes:
        hidden = len(self.nets[0][1])
        floats = [self.std, *(p.ravel() for net in self.nets for p in net)]
        return b"KDM1" + struct.pack("<3I", len(self.nets), len(self.std), hidden) + np.concatenate(floats).astype("<f4").tobytes()

    def log_p(self, features: np.ndarray) -> np.ndarray:
        """loops x descriptors x 12 -> loops x 24."""
        x = (features - features.mean(axis=2, keepdims=True)) / self.std[None, :, None]
        seen = np.stack([np.roll(x, -t, axis=2).reshape(len(x), -1) for t in range(12)], axis=1)
        out = np.zeros((len(x), KEYS))
        for w1, b1, v, c in self.nets:
            z = np.maximum(seen @ w1.astype(float) + b1, 0) @ v + c
            z = np.concatenate([z[:, :, 0], z[:, :, 1]], axis=1)
            top = z.max(axis=1, keepdims=True)
            out += (z - top - np.log(np.exp(z - top).sum(axis=1, keepdims=True))) / len(self.nets)
        return out


def network_scores(descriptors: DataFrame, networks: Networks, values: str = "values") -> DataFrame:
    """(loop_id, key_ix, logp) from one array of descriptors * 12 values a loop.

    The ensemble is one file of fixed size and is broadcast.
    """
    shared = descriptors.sparkSession.sparkContext.broadcast(networks)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            x = np.stack([np.asarray(v, dtype=float) for v in b]).reshape(len(b), -1, 12) if len(b) else np.zeros((0, len(shared.value.std), 12))
            yield pd.Series([*shared.value.log_p(x)])

    rows = descriptors.select("loop_id", F.posexplode(score(values)).alias("key_ix", "logp"))
    return rows


def key_of(key_ix: Column) -> tuple[Column, Column]:
    """Tonic name and mode of a key index."""
    from ..functions.vocabulary import NOTE_NAMES

    return F.get(F.array(*map(F.lit, NOTE_NAMES)), (key_ix % 12).cast("int")), F.when(key_ix < 12, "Major").otherwise("Minor")
