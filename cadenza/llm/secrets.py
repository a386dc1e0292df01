"""Secret scan: fixed shapes, and a battery of randomness tests for strings of no fixed shape.

Shapes (kinds assign, access, hex) are searched in every whole text. Every run of 20 or
more characters of the base-64 alphabets is a candidate of kind random, also within a shape: there it tells a generated value from a chosen one:

- its encoding is inferred (hex, base 32, alphanumeric, base 64), which fixes the alphabet size A;
- three tests look at it: chi-squared over the alphabet, number of runs above and below the middle, serial
  correlation of neighbours;
- the null hypothesis for a discovery is written language: symbols and neighbours as often as in all
  documents. Chi-squared then has a larger mean and spread, the middle is crossed more or less often than half the time, and
  neighbours are correlated, all known from the counts of the corpus and the length, so that a short string needs to be more
  even than a long one. Each test has a p-value of "this is language" towards what uniform symbols would give, and Fisher's sum joins them;
- a candidate that cannot be uniform either, by Fisher's sum of the same tests against uniform symbols, has p-value 1;
- Benjamini-Hochberg on the joint p-values, within strata of length, over the candidates of all
  documents, bounds the share of false discoveries.

Corpus counts cover every document and reach the driver only as 128 x 128 counts of neighbours and a fixed
grid of p-value counts. Null and empty texts have no spans, an empty table gives an empty one; repeated rows count as often as they
occur and get the same spans. A column of the result's name is replaced. Positions are code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import text_batches

KINDS = ("assign", "access", "hex", "random")
SPANS = "array<struct<kind:string,start:int,end:int,p_value:double>>"

#: The shapes, fixed by contract.
_WORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"(?:{_WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings from narrow to wide; the first that has all characters of a string is its encoding.
ENCODINGS = (
    ("hex", DIGITS + "abcdef"),
    ("hex upper", DIGITS + "ABCDEF"),
    ("base32", UPPER + "234567"),
    ("lower", DIGITS + LOWER),
    ("upper", DIGITS + UPPER),
    ("alphanumeric", DIGITS + UPPER + LOWER),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
    ("any", UPPER + LOWER + DIGITS + "+/-_="),
)
_SETS = [frozenset(a) for _, a in ENCODINGS]
_PLACES = [{c: i for i, c in enumerate(a)} for _, a in ENCODINGS]
#: Lower ends of the length strata, and the grid of log10 p-values on which counts are kept.
STRATA = (20, 28, 40, 64, 128)
GRID = 1000
LOWEST = -40.0
RATE = 0.05
UNIFORM_AT_LEAST = 0.01


def shapes(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed shapes."""
    low, out = text.lower(), []
    if any(c in low for c in CUES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_tail(x: float, k: int) -> float:
    """Upper tail by Wilson and Hilferty's cube root."""
    v = 2 / (9 * k)
    return _normal_tail(((x / k) ** (1 / 3) - 1 + v) / math.sqrt(v))


class Statistics(NamedTuple):
    """What the tests see of a string: its encoding's number, length, chi-squared, symbols of the upper half, crossings of the middle, serial correlation."""

    code: int
    n: int
    chi2: float
    high: int
    crossings: int
    serial: float


class Language(NamedTuple):
    """The null hypothesis, by encoding: sums of squared and cubed symbol probabilities; share of neighbours on two sides of the middle and their correlation."""

    symbols: list[tuple[float, float]]
    neighbours: list[tuple[float, float]]


def statistics(token: str) -> Statistics:
    chars = frozenset(token.rstrip("=") or token)
    code = next(i for i, s in enumerate(_SETS) if chars <= s)
    place, size = _PLACES[code], len(_PLACES[code])
    x = np.array([place[c] for c in (token.rstrip("=") if code < len(_SETS) - 1 else token)])
    n = len(x)
    up, d = x >= size // 2, x - x.mean()
    chi2 = float((np.bincount(x, minlength=size) ** 2).sum()) * size / n - n
    return Statistics(code, n, chi2, int(up.sum()), int((up[1:] != up[:-1]).sum()), float((d[1:] * d[:-1]).sum() / max((d * d).sum(), 1e-9)))


def _fisher(*ps: float) -> float:
    """Fisher's joint p-value of three."""
    h = -sum(math.log(max(p, 1e-300)) for p in ps)
    return min(1.0, math.exp(-h) * (1 + h + h * h / 2))


def uniform_p(s: Statistics) -> float:
    """Joint p-value of the three tests for symbols drawn uniformly."""
    a, b = s.high, s.n - s.high
    p_runs = p_serial = 0.0
    if a and b and s.n > 2:
        mean = 2 * a * b / s.n + 1
        var = max((mean - 1) * (mean - 2) / (s.n - 1), 1e-9)
        p_runs = 2 * _normal_tail(abs(s.crossings + 1 - mean) / math.sqrt(var))
        p_serial = 2 * _normal_tail(abs(s.serial) * math.sqrt(s.n))
    return _fisher(_chi2_tail(max(s.chi2, 1e-9), len(_PLACES[s.code]) - 1), p_runs, p_serial)


def battery(token: str) -> tuple[int, float, float]:
    """Encoding number, chi-squared, and joint p-value of the three uniformity tests."""
    s = statistics(token)
    return s.code, s.chi2, uniform_p(s)


def language_p(code: int, chi2: float, n: int, moments: list[tuple[float, float]]) -> float:
    """Lower tail of chi-squared for n symbols drawn as often as the corpus has them."""
    size, (s2, s3) = len(_PLACES[code]), moments[code]
    mean = size * ((n - 1) * s2 + 1) - n
    var = (size / n) ** 2 * (4 * n**3 * max(s3 - s2 * s2, 0) + 2 * n * n * s2 * s2)
    return _normal_tail((mean - chi2) / math.sqrt(max(var, 1e-9)))


def crossings_p(s: Statistics, share: float) -> float:
    """Tail, towards half, of the number of crossings if each pair of neighbours crosses the middle with that probability."""
    pairs = max(1, s.n - 1)
    z = (s.crossings - pairs * share) / math.sqrt(max(pairs * share * (1 - share), 1e-9))
    return _normal_tail(z if share < 0.5 else -z)


def serial_p(s: Statistics, correlation: float) -> float:
    """Tail, towards none, of the serial correlation of n symbols whose neighbours have that correlation."""
    mean = correlation - (1 + 3 * correlation) / s.n  # short strings show less of it
    z = (s.serial - mean) * math.sqrt(s.n / max(1 - correlation**2, 1e-9))
    return _normal_tail(z if correlation < 0 else -z)


def joint_p(s: Statistics, language: Language) -> float:
    """Fisher's joint p-value of "this is language"; 1 if the string cannot be uniform either."""
    if uniform_p(s) < UNIFORM_AT_LEAST:
        return 1.0
    share, correlation = language.neighbours[s.code]
    return _fisher(language_p(s.code, s.chi2, s.n, language.symbols), crossings_p(s, share), serial_p(s, correlation))


def moments_of(counts: np.ndarray) -> list[tuple[float, float]]:
    """Sums of squared and cubed symbol probabilities for each encoding, from character counts (one is added to each)."""
    out = []
    for _, alphabet in ENCODINGS:
        p = np.array([counts[ord(c)] + 1.0 for c in alphabet])
        p /= p.sum()
        out.append((float((p**2).sum()), float((p**3).sum())))
    return out


def neighbours_of(pairs: np.ndarray) -> list[tuple[float, float]]:
    """For each encoding, the share of neighbours on two sides of the middle and their correlation, from counts of pairs (one in all is added to each symbol's)."""
    out = []
    for _, alphabet in ENCODINGS:
        at, size = [ord(c) for c in alphabet], len(alphabet)
        p = pairs[np.ix_(at, at)] + 1 / size
        p /= p.sum()
        x = np.arange(size, dtype=float)
        left, right = p.sum(axis=1), p.sum(axis=0)
        a, b = x - left @ x, x - right @ x
        up = x >= size // 2
        out.append((float(p[np.ix_(up, ~up)].sum() + p[np.ix_(~up, up)].sum()), float(a @ p @ b / math.sqrt((left @ a**2) * (right @ b**2)))))
    return out


def pair_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each ASCII character is followed by each other in all documents; what is not ASCII counts as a question mark, the end as a line's."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(128 * 128, dtype=np.int64)
        for b in batches:
            for t in b["t"]:
                x = np.frombuffer(t.encode("ascii", "replace") + b"\n", dtype=np.uint8).astype(np.int32)
                total += np.bincount(x[:-1] * 128 + x[1:], minlength=128 * 128)
        c = total.nonzero()[0]
        yield pd.DataFrame({"c": c, "n": total[c]})

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInPandas(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(128 * 128, dtype=np.int64)
    for r in rows:
        out[r.c] = r.n
    return out.reshape(128, 128)


def language_of(docs: DataFrame, text: str = "text") -> Language:
    """The null hypothesis from all documents."""
    pairs = pair_counts(docs, text)
    return Language(moments_of(pairs.sum(axis=1)), neighbours_of(pairs))


def _stratum(n: int) -> int:
    return sum(n >= s for s in STRATA) - 1


def _cell(p: float) -> int:
    """Place on the grid of p-values; 0 is the smallest."""
    return min(GRID - 1, max(0, int((1 - max(LOWEST, math.log10(max(p, 1e-300))) / LOWEST) * GRID)))


def candidates(text: str, language: Language) -> list[tuple[int, int, float]]:
    """Start, end and joint p-value of each candidate."""
    return [(*m.span(), joint_p(statistics(m[0]), language)) for m in CANDIDATE.finditer(text)]


def thresholds(docs: DataFrame, language: Language, text: str = "text", rate: float = RATE) -> list[int]:
    """For each stratum of length, the highest grid cell that Benjamini and Hochberg's step-up rule rejects; -1 for none."""

    def grid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(STRATA), GRID), dtype=np.int64)
        for b in batches:
            for t in b["t"]:
                for start, end, p in candidates(t, language):
                    total[_stratum(end - start), _cell(p)] += 1
        s, c = total.nonzero()
        yield pd.DataFrame({"s": s, "c": c, "n": total[s, c]})

    counts = np.zeros((len(STRATA), GRID), dtype=np.int64)
    source = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    for r in source.mapInPandas(grid, "s int, c int, n long").groupBy("s", "c").agg(F.sum("n").alias("n")).collect():
        counts[r.s, r.c] = r.n
    return [step_up(row, rate) for row in counts]


def step_up(counts: np.ndarray, rate: float = RATE) -> int:
    """The highest cell of one stratum that Benjamini and Hochberg reject: with k of n p-values up to its upper end, that end is at most rate * k / n."""
    upper = 10 ** (LOWEST * (1 - (np.arange(GRID) + 1) / GRID))
    ok = np.nonzero((counts > 0) & (upper <= rate * counts.cumsum() / max(1, counts.sum())))[0]
    return int(ok[-1]) if len(ok) else -1


def find_secrets(docs: DataFrame, text: str = "text", spans: str = "spans", rate: float = RATE) -> DataFrame:
    """docs with an array of spans (kind, start, end, p_value), by start, then kind in the order of KINDS.

    Of fixed shapes p_value is null; of kind random it is the joint one of "this is language".
    """
    text_batches(docs.sparkSession)
    language = language_of(docs, text)
    cells = thresholds(docs, language, text, rate)
    order = {k: i for i, k in enumerate(KINDS)}

    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        rows = []
        for t in texts:
            found = []
            if t:
                fixed = shapes(t)
                found = [(*s, None) for s in fixed]
                found += [("random", s, e, p) for s, e, p in candidates(t, language) if p < 1 and _cell(p) <= cells[_stratum(e - s)]]
                found.sort(key=lambda x: (x[1], order[x[0]]))
            rows.append([dict(zip(("kind", "start", "end", "p_value"), x, strict=True)) for x in found])
        return pd.Series(rows)

    return docs.withColumn(spans, scan(F.col(text)))
