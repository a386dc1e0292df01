"""Quality grades by ordinal cumulative-link regression on hashed words.

    P(grade <= k | text) = sigmoid(threshold_k - w . x)

One weight vector w over hashed words serves all grades, ordered thresholds separate them. x has, for each distinct
word, the logarithm of one plus its count, divided by the cube root of the number of distinct words. The model
gives each text its expected grade and the probability of at least the top grade; texts with a tail
probability of at least the cut are selected. The cut keeps KEEP of the top-grade rows of the sample that were held out of the training.

The fit takes a bounded sample of graded rows (SAMPLE are expected, by hash of the identifier). Words of fewer than
MIN_ROWS rows of it have no weight, as they would learn rows by heart. Parts of the sample are trained by AdaGrad in parallel, numpy in tasks, and averaged, ROUNDS times. Scoring covers every text whole. Null and
empty texts have x = 0. Rows without grade teach nothing; without any graded row all texts have grade 0, tail 0 and are not selected.
Several grades of one document count as several rows; repeated rows are graded alike, an empty table gives an empty one, and columns named like
a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import free_name, stored, text_batches

WORD = regex.compile(r"\w+|[^\w\s]+")
DIMENSIONS = 1 << 16
SAMPLE = 20_000
PARTS = 8
#: One part in so many is held out for the cut.
HELD_OUT = 5
ROUNDS = 4
EPOCHS = 6
RATE = 0.7
MIN_ROWS = 8
DECAY = 1e-5
KEEP = 0.98
CACHE_WORDS = 1_000_000


class Hashed(dict):
    """Word -> place in w, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        place = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % DIMENSIONS
        return place


def features(text: str | None, hashed: Hashed) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a whole text."""
    words = WORD.findall(text.lower()) if text else []
    places, counts = np.unique(np.fromiter(map(hashed.__getitem__, words), dtype=np.int32, count=len(words)), return_counts=True)
    return places, np.log1p(counts) / max(1, len(places)) ** (1 / 3)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    w: np.ndarray
    #: First threshold, then logarithms of the gaps, so that thresholds stay in order.
    gaps: np.ndarray

    @property
    def thresholds(self) -> np.ndarray:
        return self.gaps[0] + np.concatenate([[0.0], np.cumsum(np.exp(self.gaps[1:]))])

    def at_least(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, row by row."""
        return _sigmoid(np.asarray(z)[:, None] - self.thresholds)

    def learn(self, rows: list[tuple[int, np.ndarray, np.ndarray]], squares: Model) -> None:
        """One pass of AdaGrad over rows of grade, places, values."""
        for grade, at, x in rows:
            z = float(self.w[at] @ x)
            t = np.concatenate([[-np.inf], self.thresholds, [np.inf]])
            low, high = _sigmoid(t[grade] - z), _sigmoid(t[grade + 1] - z)
            g = (1 - low - high) * x + DECAY * self.w[at]
            squares.w[at] += g * g
            self.w[at] -= RATE * g / np.sqrt(squares.w[at])
            p = max(high - low, 1e-9)
            by_threshold = np.zeros(len(t) - 2)
            if grade < len(by_threshold):
                by_threshold[grade] -= high * (1 - high) / p
            if grade:
                by_threshold[grade - 1] += low * (1 - low) / p
            above = np.cumsum(by_threshold[::-1])[::-1]
            dg = np.concatenate([above[:1], above[1:] * np.exp(self.gaps[1:])])
            squares.gaps += dg * dg
            self.gaps -= RATE * dg / np.sqrt(squares.gaps)


def _trainer(shared):
    """A grouped function that trains the broadcast model on one part; shared holds the model and which places have a weight."""

    def local(g: pd.DataFrame) -> pd.DataFrame:
        model, weighed = shared.value
        own = Model(model.w.copy(), model.gaps.copy())
        squares = Model(np.full(DIMENSIONS, 1.0), np.full(len(own.gaps), 10.0))
        g = g.sort_values("turn")
        data = []
        for grade, at, x in zip(g["grade"], g["at"], g["x"], strict=True):
            at, x = np.asarray(at, dtype=np.int64), np.asarray(x, dtype=float)
            data.append((grade, at[weighed[at]], x[weighed[at]]))
        for _ in range(EPOCHS):
            own.learn(data, squares)
        return pd.DataFrame({"n": [len(g)], "w": [own.w.astype(np.float32)], "gaps": [own.gaps]})

    return local


def fit(graded: DataFrame, grades: int, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> tuple[Model, float] | None:
    """Model and cut from rows with text and grade 0 .. grades - 1; None without such rows."""
    spark = graded.sparkSession
    text_batches(spark)
    known = graded.where(F.col(grade_col).between(0, grades - 1))
    n = known.count()
    if not n:
        return None
    taken = known.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) < min(1.0, sample / n) * (1 << 30))

    def hash_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = Hashed()
        for b in batches:
            x = [features(t, hashed) for t in b["text"]]
            yield pd.DataFrame({"part": b["part"], "turn": b["turn"], "grade": b["grade"], "at": [a for a, _ in x], "x": [v for _, v in x]})

    turn = F.xxhash64(F.lit("turn"), F.col(id_col).cast("string"))
    own = taken.select(F.when(F.pmod(F.shiftright(turn, 20), F.lit(HELD_OUT)) > 0, F.pmod(turn, F.lit(PARTS))).cast("int").alias("part"), turn.alias("turn"), F.col(grade_col).cast("int").alias("grade"), F.col(text_col).alias("text"))
    rows = stored(own.mapInPandas(hash_words, "part int, turn long, grade int, at array<int>, x array<double>"), "ordinal-rows")
    train = rows.where("part is not null")
    often = train.select(F.explode("at").alias("at")).groupBy("at").count().where(F.col("count") >= MIN_ROWS)
    weighed = np.zeros(DIMENSIONS, dtype=bool)
    weighed[[r.at for r in often.collect()]] = True
    model = Model(np.zeros(DIMENSIONS), np.concatenate([[-(grades - 2) / 2], np.zeros(grades - 2)]))
    for _ in range(ROUNDS):
        local = _trainer(spark.sparkContext.broadcast((model, weighed)))
        parts = train.groupBy("part").applyInPandas(local, "n long, w array<float>, gaps array<double>").collect()
        total = sum(r.n for r in parts)
        if not total:
            break
        model = Model(sum(np.asarray(r.w) * (r.n / total) for r in parts), sum(np.asarray(r.gaps) * (r.n / total) for r in parts))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def tail(at: pd.Series, x: pd.Series) -> pd.Series:
        z = [float(shared.value.w[np.asarray(a, dtype=np.int64)] @ np.asarray(v)) for a, v in zip(at, x, strict=True)]
        return pd.Series(shared.value.at_least(z)[:, -1] if z else [], dtype=float)

    top = rows.where((F.col("grade") == grades - 1) & F.col("part").isNull())
    cut = top.select(F.percentile(tail("at", "x"), F.lit(1 - KEEP)).alias("c")).first().c
    return model, 0.5 if cut is None else float(cut)


def grade_documents(docs: DataFrame, fitted: tuple[Model, float] | None, text_col: str = "text") -> DataFrame:
    """docs with expected_grade, tail_probability and selected."""
    if fitted is None:
        return docs.withColumns({"expected_grade": F.lit(0.0), "tail_probability": F.lit(0.0), "selected": F.lit(False)})
    text_batches(docs.sparkSession)
    model, cut = fitted
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected double, tail double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashed = Hashed()
        for texts in batches:
            z = [float(shared.value.w[at] @ x) for at, x in (features(t, hashed) for t in texts)]
            p = shared.value.at_least(z)
            yield pd.DataFrame({"expected": p.sum(axis=1), "tail": p[:, -1]})

    own = free_name(docs, "grade")
    out = docs.withColumn(own, score(F.col(text_col)))
    return out.withColumns({"expected_grade": F.col(f"{own}.expected"), "tail_probability": F.col(f"{own}.tail"), "selected": F.col(f"{own}.tail") >= cut}).drop(own)
