"""Language identification by unigram piece models that sum over all segmentations.

Pieces come from a fixed public vocabulary. Per language each piece has a probability; a word's
probability is the sum over all ways to cut it into pieces of the product of theirs, by the forward
algorithm. A text's score per language is the sum of its words' log probabilities; the
best language is predicted. The score is its posterior at equal priors, given the text's mean word (the geometric mean of its words'
probabilities), so that it does not run to one with the length of the text.

Probabilities are fitted by expectation-maximisation on word counts of a bounded sample of labelled rows
(PER_LANGUAGE rows a language are expected, chosen by hash of the identifier). Each step is a Spark job over the counts; only the
table of pieces by languages reaches the driver. To learn from, letter runs of over CHUNK letters are cut into parts; texts are
scored on whole runs of any length.

A text that is null or has no letter is `und` with score 0. Ties go to the language that comes first in the alphabet. Without any
labelled row, and so with an empty table, everything is `und`. Repeated rows are scored alike; columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name, stored, text_batches

UNKNOWN = "und"
PER_LANGUAGE = 1500
ROUNDS = 2
#: Added to each expected count.
SMOOTHING = 0.02
CHUNK = 32
START = "▁"
#: Words by languages that a worker remembers.
CACHE_CELLS = 4_000_000
LETTERS = regex.compile(r"\p{L}+")


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    return [sp.id_to_piece(i) for i in ids if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return LETTERS.findall(text.lower())


def in_parts(words: list[str]) -> list[str]:
    """Words of at most CHUNK letters."""
    return [w[i : i + CHUNK] for w in words for i in range(0, len(w), CHUNK)]


#: Probabilities below this are computed with scaling.
LEAST_P = 1e-250


class Pieces:
    """Where the pieces of a vocabulary occur in words."""

    def __init__(self, pieces: list[str]):
        # capitals never occur in lower-cased words
        own = sorted({p for p in pieces if p == p.lower() and any(c.isalpha() for c in p)} | {START})
        if len(own) >= 65535:
            raise ValueError("the vocabulary must have fewer than 65,535 pieces")
        self.unknown = len(own)
        self.size = len(own) + 1
        #: Every prefix of a piece -> the piece's number, or -1.
        self.prefixes = {p[:k]: -1 for p in own for k in range(1, len(p))} | {p: i for i, p in enumerate(own)}
        self.longest = max(map(len, own))

    def arcs(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Word, start, end and piece of each occurrence, by end, then word; single letters that are no piece count as unknown."""
        get, unknown, codes = self.prefixes.get, self.unknown, []
        add = codes.append
        for w, word in enumerate(words):
            s = START + word
            n = len(s)
            for j in range(n):
                base = (w * 64 + j) * 64
                v = get(s[j])
                add((base + j + 1) * 65536 + (v if v is not None and v >= 0 else unknown))
                if v is None:
                    continue
                for e in range(j + 2, n + 1):
                    v = get(s[j:e])
                    if v is None:
                        break
                    if v >= 0:
                        add((base + e) * 65536 + v)
        code = np.array(codes, dtype=np.int64)
        piece, end, start, word = code & 65535, (code >> 16) & 63, (code >> 22) & 63, code >> 28
        order = np.lexsort((word, end))
        return word[order], start[order], end[order], piece[order]

    def forward(self, words: list[str], theta: np.ndarray, arcs=None) -> np.ndarray:
        """Probabilities of all beginnings: word x position x language."""
        word, start, end, piece = arcs if arcs is not None else self.arcs(words)
        alpha = np.zeros((len(words), max(map(len, words)) + 2, theta.shape[1]))
        alpha[:, 0] = 1
        bounds = np.searchsorted(end, np.arange(alpha.shape[1] + 1))
        for e in range(1, alpha.shape[1]):
            lo, hi = bounds[e], bounds[e + 1]
            if lo < hi:
                w = word[lo:hi]
                first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                alpha[w[first], e] = np.add.reduceat(alpha[w, start[lo:hi]] * theta[piece[lo:hi]], first, axis=0)
        return alpha

    def log_p(self, words: list[str], theta: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(words), theta.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) <= CHUNK]
        if short:
            own = [words[i] for i in short]
            whole = self.forward(own, theta)[np.arange(len(own)), [len(w) + 1 for w in own]]
            out[short] = np.log(np.maximum(whole, LEAST_P))
            # numbers too small to be exact: the path that scales them
            small = {short[i] for i in np.flatnonzero((whole <= LEAST_P).any(axis=1))}
        else:
            small = set()
        for i, w in enumerate(words):
            if len(w) > CHUNK or i in small:
                out[i] = self.long_log_p(w, theta)
        return out

    def long_log_p(self, word: str, theta: np.ndarray) -> np.ndarray:
        """The same for a word of any length, piece by piece of its beginnings: of these only as many are kept as the longest piece reaches back."""
        s, get = START + word, self.prefixes.get
        n, reach = len(s), self.longest + 1
        ahead, scale = np.zeros((reach, theta.shape[1])), np.zeros(theta.shape[1])
        ahead[0] = 1
        for j in range(n):
            here = ahead[j % reach].copy()
            ahead[j % reach] = 0
            if j % 16 == 15:  # before numbers get too small
                most = np.maximum(np.maximum(ahead.max(axis=0), here), 1e-300)
                ahead /= most
                here /= most
                scale += np.log(most)
            v = get(s[j])
            ahead[(j + 1) % reach] += here * theta[v if v is not None and v >= 0 else self.unknown]
            for e in range(j + 2, n + 1) if v is not None else ():
                v = get(s[j:e])
                if v is None:
                    break
                if v >= 0:
                    ahead[e % reach] += here * theta[v]
        return np.log(np.maximum(ahead[n % reach], 1e-300)) + scale

    def expected(self, words: list[str], counts: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, one language."""
        arcs = word, start, end, piece = self.arcs(words)
        alpha = self.forward(words, theta, arcs)[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[np.arange(len(words)), [len(w) + 1 for w in words]] = 1
        for e in range(alpha.shape[1] - 1, 0, -1):
            here = end == e
            np.add.at(beta, (word[here], start[here]), theta[piece[here], 0] * beta[word[here], e])
        total = np.maximum(beta[:, 0], 1e-300)
        uses = alpha[word, start] * theta[piece, 0] * beta[word, end] / total[word] * counts[word]
        return np.bincount(piece, weights=uses, minlength=self.size)


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    #: piece x language
    theta: np.ndarray


def _sample(labelled: DataFrame, per_language: int, id_col: str, lang_col: str) -> DataFrame:
    """About per_language rows of each language, by a hash of the identifier."""
    n = labelled.groupBy(lang_col).agg(F.count("*").alias("n")).collect()
    if not n:
        return labelled.limit(0)
    rate = F.create_map(*[F.lit(x) for r in n for x in (r[0], min(1.0, per_language / r.n))])
    return labelled.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) < rate[F.col(lang_col)] * float(1 << 30))


def fit(labelled: DataFrame, pieces: list[str], per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on rows with text and lang; see the module for the bound of the sample."""
    text_batches(labelled.sparkSession)
    own = Pieces(pieces)
    shared = labelled.sparkSession.sparkContext.broadcast(own)
    sample = _sample(labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()), per_language, id_col, lang_col)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                words = pd.Series(in_parts([w for t in texts for w in words_of(t)]), dtype=object).value_counts()
                yield pd.DataFrame({"lang": lang, "word": words.index, "n": words.to_numpy()})

    words = sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInPandas(split, "lang string, word string, n long")
    words = stored(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    languages = sorted(r.lang for r in words.select("lang").distinct().collect())
    theta = np.full((own.size, max(1, len(languages))), 1 / own.size)
    for _ in range(ROUNDS if languages else 0):
        now = labelled.sparkSession.sparkContext.broadcast(theta)

        def count(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(now.value)
            for b in batches:
                for lang, g in b.groupby("lang"):
                    at = languages.index(lang)
                    for i in range(0, len(g), 2000):
                        part = g.iloc[i : i + 2000]
                        total[:, at] += shared.value.expected(part["word"].tolist(), part["n"].to_numpy(dtype=float), now.value[:, at : at + 1])
            piece, at = total.nonzero()
            yield pd.DataFrame({"piece": piece, "at": at, "n": total[piece, at]})

        rows = words.mapInPandas(count, "piece int, at int, n double").groupBy("piece", "at").agg(F.sum("n").alias("n")).toPandas()
        theta = np.full_like(theta, SMOOTHING)
        theta[rows["piece"], rows["at"]] += rows["n"]
        theta /= theta.sum(axis=0)
    return Model(languages, own, theta)


class Scorer:
    """Scores batches of texts; remembers words."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages)), dtype=np.float32)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
        """Log probability of each text in each language, NaN without letters; numbers of words."""
        split = [words_of(t) if t else [] for t in texts]
        if self.rows.size > CACHE_CELLS:
            self.known, self.rows = {}, self.rows[:0]
        new = [w for w in dict.fromkeys(w for ws in split for w in ws) if w not in self.known]
        for i in range(0, len(new), 4000):
            part = new[i : i + 4000]
            self.known.update(zip(part, range(len(self.rows), len(self.rows) + len(part)), strict=True))
            self.rows = np.vstack([self.rows, self.model.pieces.log_p(part, self.model.theta).astype(np.float32)])
        out = np.full((len(texts), len(self.model.languages)), np.nan)
        for i, ws in enumerate(split):
            if ws:
                out[i] = self.rows[[*map(self.known.__getitem__, ws)]].sum(axis=0, dtype=np.float64)
        return out, [len(ws) for ws in split]


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language of each whole text and its posterior; columns of these names are replaced."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            langs, scores = [], []
            if shared.value.languages:
                for row, n in zip(*scorer.texts(texts.tolist()), strict=True):
                    if np.isnan(row[0]):
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        langs.append(shared.value.languages[int(row.argmax())])
                        scores.append(float(1 / np.exp((row - row.max()) / n).sum()))
            else:
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            yield pd.DataFrame({"lang": langs, "score": scores})

    own = free_name(docs, "lid")
    out = docs.withColumn(own, run(F.col(text_col)))
    return out.withColumn(lang_pred, F.col(f"{own}.lang")).withColumn(score, F.col(f"{own}.score")).drop(own)


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the identifier as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))
