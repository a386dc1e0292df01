"""Keys of loops from what they sound like: samples and notes in, ranked suggestions and errors out.

Samples end in one map stage: mixdown aside, spectrogram, descriptors and networks all work on a loop's own row, and only 24 numbers a loop leave it. Notes are
dealt by loop. Both kinds of evidence meet in one join by loop and key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import audio, midi, ranking, scoring

#: Why a loop has no suggestion: samples that are missing, and samples that are empty or silent, in loops without usable notes.
NO_AUDIO, SILENT = "no_audio", "silent_audio"


def audio_scores(samples: DataFrame, networks: scoring.Networks, **frames) -> DataFrame:
    """(loop_id, key_ix, logp) of the audible loops of (loop_id, samples); frames are the settings of the spectrogram. No shuffle."""
    audible = samples.where(audio.is_audible(F.col("samples")))
    return scoring.network_scores(audio.as_vector(audio.descriptors_of_samples(audible, **frames)), networks)


def midi_scores(notes: DataFrame, model: DataFrame, std: DataFrame, bias: tuple[float, float]) -> DataFrame:
    """(loop_id, key_ix, logp) of the loops with pitched notes, by the linear model on the seven statistics."""
    return scoring.log_softmax(scoring.linear_scores(scoring.scaled(midi.all_statistics(notes), std, by_sum=True), model, bias)).select("loop_id", "key_ix", "logp")


def analysed(samples: DataFrame, notes: DataFrame, networks: scoring.Networks, model: DataFrame, std: DataFrame, bias: tuple[float, float], **frames) -> DataFrame:
    """(loop_id, key_ix, logp, uses_midi) of every loop with audible samples, pitched notes, or both."""
    return scoring.combined(audio_scores(samples, networks, **frames), midi_scores(notes, model, std, bias))


def errors(loops: DataFrame, samples: DataFrame, notes: DataFrame) -> DataFrame:
    """(loop_id, error_code) of the loops that have neither audible samples nor pitched notes.

    Found from the samples' loudness and the notes' loops alone, without scoring anything again. loops has each loop once.
    """
    heard = samples.select("loop_id", audio.is_audible(F.col("samples")).alias("audible")).groupBy("loop_id").agg(F.max("audible").alias("audible"))
    played = midi.pitched(notes).select("loop_id").distinct().withColumn("played", F.lit(True))
    both = loops.select("loop_id").join(heard, "loop_id", "left").join(played, "loop_id", "left")
    why = F.when(F.col("audible").isNull(), NO_AUDIO).otherwise(SILENT)
    return both.where("played is null and not coalesce(audible, false)").select("loop_id", why.alias("error_code"))


def suggested(loops: DataFrame, samples: DataFrame, notes: DataFrame, networks: scoring.Networks, model: DataFrame, std: DataFrame, bias: tuple[float, float], n: int = 3, **frames) -> DataFrame:
    """The best n keys of each loop (rank, key, mode, probability, is_uncertain, label, uses_midi), and one row with an error_code for each loop that has none."""
    scores = analysed(samples, notes, networks, model, std, bias, **frames)
    # scores are rounded before they are ranked, so that sums in another order rank alike
    best = ranking.suggestions(scoring.probabilities(scores.withColumn("logp", F.round("logp", 9))), n)
    columns = ["loop_id", "rank", "key", "mode", "probability", "is_uncertain", "label", "uses_midi"]
    return best.select(*columns).unionByName(errors(loops, samples, notes), allowMissingColumns=True)
