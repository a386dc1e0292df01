"""BPE encoding and decoding with a published word-end vocabulary.

Each word's symbols form a doubly linked list. A heap holds (merge rank, position) of
neighbouring pairs; a popped entry that no longer describes a live pair is stale and skipped.
Merging lowers the list by one symbol and pushes at most two new pairs, so that a word of n
symbols takes O(n log n) steps however long it is. Words repeat, so each Python worker keeps the
encodings of recent words.

Null texts encode as empty ones: no ids, decoded text ''. Repeated rows and ties have no
influence, since every row is encoded by itself.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_batches

#: Fixed values of the published vocabulary file: its splitting pattern, white space and word end.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

# Fixed values of Unicode 16, whose classes the tokenizers library has: letters and digits that are not yet in version 15.1, which is Python's.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
]
# Small letters that the library gives and Python's tables do not have; ranges are shifted as a whole.
SMALL = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB),
    (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
SMALL_OF = {c: to + c - first for first, last, to in SMALL for c in range(first, last + 1)}


@lru_cache(maxsize=1)
def newer_letters() -> frozenset[str]:
    """Characters that regex, whose tables are newer, takes for letters or digits, and that the library's tables do not have."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    known = {c for first, last in LETTERS_16 for c in range(first, last + 1)}
    return frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn" and ord(c) not in known)


def _class(characters: frozenset[str]) -> str:
    """The inside of a class of these characters, as ranges."""
    codes = sorted(map(ord, characters))
    starts = [i for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    return "".join(f"\\U{codes[i]:08X}-\\U{codes[j - 1]:08X}" for i, j in zip(starts, [*starts[1:], len(codes)], strict=True))


@lru_cache(maxsize=1)
def older_split() -> regex.Pattern:
    """SPLIT in the library's classes, for the rare texts where that makes a difference."""
    newer = _class(newer_letters())
    split = SPLIT.replace(r"[\p{L}]+|[\p{N}]", rf"[\p{{L}}--[{newer}]]+|[\p{{N}}--[{newer}]]").replace(r"[^\s\p{L}\p{N}]+", rf"[[^\s\p{{L}}\p{{N}}]||[{newer}]]+")
    return regex.compile(split, regex.V1)


class NewerLetter(ValueError):
    """A word has a character that the library's tables class or lower-case otherwise."""


#: Words whose encodings a worker keeps; the memory is emptied when it is full.
CACHE_WORDS = 400_000
CACHE_LENGTH = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder for one vocabulary file of the tokenizers library's format."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        #: (left id, right id) -> (rank, merged id)
        self.merges = {
            (self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b])
            for rank, (a, b) in enumerate(merges)
        }
        self.names = {i: s for s, i in (self.vocab | self.special).items()}
        self.bytes = byte_symbols()
        self.inner = [self.vocab[s] for s in self.bytes]
        self.final = [self.vocab[s + WORD_END] for s in self.bytes]
        self.words = regex.compile(SPLIT)
        self.newer = newer_letters() | frozenset(map(chr, SMALL_OF))
        by_length = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, by_length))) if by_length else None
        self.cache: dict[str, bytes] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges to one word's symbols, lowest rank first, leftmost first in a tie."""
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n
        heap = []
        for i in range(n - 1):
            found = self.merges.get((ids[i], ids[i + 1]))
            if found:
                heap.append((found[0], i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue  # stale: one of the pair has been merged since
            ids[i] = self.merges[a, b][1]
            alive[j] = False
            after = right[i] = right[j]
            if after >= 0:
                left[after] = i
                if found := self.merges.get((ids[i], ids[after])):
                    heapq.heappush(heap, (found[0], i, ids[i], ids[after]))
            before = left[i]
            if before >= 0 and (found := self.merges.get((ids[before], ids[i]))):
                heapq.heappush(heap, (found[0], before, ids[before], ids[i]))
        return [x for x, there in zip(ids, alive) if there]

    def word(self, word: str, older: bool = False) -> bytes:
        """The packed ids of a word. Words with newer letters are not kept, and are refused unless the text was split in the library's classes."""
        newer = not word.isascii() and not self.newer.isdisjoint(word)
        if newer and not older:
            raise NewerLetter(word)
        raw = word.encode("utf-8")
        ids = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        packed = struct.pack(f"<{(n := len(out := self.merge(ids)))}I", *out)
        if len(word) <= CACHE_LENGTH and not newer:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = packed
        return packed

    def plain(self, text: str) -> list[bytes]:
        """The packed ids of each word of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        get, word, text = self.cache.get, self.word, text.lower()
        try:
            return [get(w) or word(w) for w in self.words.findall(text)]
        except NewerLetter:
            return [get(w) or word(w, True) for w in older_split().findall(text.translate(SMALL_OF))]

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if self.specials is None or "<|" not in text:
            return b"".join(self.plain(text))
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += self.plain(text[at : m.start()])
            out.append(struct.pack("<I", self.special[m[0]]))
            at = m.end()
        return b"".join([*out, *self.plain(text[at:])])

    def decode(self, packed: bytes) -> str:
        """The vocabulary strings one after another; this vocabulary names no decoder, so a space parts them."""
        names = self.names
        return " ".join([names[i] for i in np.frombuffer(packed, dtype="<u4").tolist()])


_codecs: dict[str, Codec] = {}


def _codec(key: str, spec) -> Codec:
    """This worker's codec for a broadcast vocabulary."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(json.loads(spec.value))
    return _codecs[key]


def codec_columns(spark, vocabulary: str) -> tuple:
    """Column functions (encode, decode) for the vocabulary file at that path.

    encode(text) gives binary, the ids as little-endian unsigned 32-bit integers; decode(ids) gives
    the text. The vocabulary is one file of fixed size, so it is broadcast.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    key, shared = hashlib.sha1(spec.encode()).hexdigest(), spark.sparkContext.broadcast(spec)
    text_batches(spark)

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        run = _codec(key, shared).encode
        return pd.Series([run(t) if t else b"" for t in texts], dtype=object)

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        run = _codec(key, shared).decode
        return pd.Series([run(bytes(x)) if x is not None else "" for x in ids], dtype=object)

    return encode, decode


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """docs with the columns ids (binary, see codec_columns) and n_tokens of each whole text.

    Columns of docs with these names are replaced.
    """
    encode, _ = codec_columns(docs.sparkSession, vocabulary)
    return docs.withColumn(ids, encode(F.col(text))).withColumn(n_tokens, (F.octet_length(F.col(ids)) / 4).cast("long"))


def decode_documents(encoded: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encoded with the text that its ids stand for."""
    _, decode = codec_columns(encoded.sparkSession, vocabulary)
    return encoded.withColumn(decoded, decode(F.col(ids)))


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of integers, for those who want them in SQL."""
    size = (F.octet_length(ids) / 4).cast("int")
    at = lambda i, k: F.conv(F.hex(F.substring(ids, i * 4 + k + 1, F.lit(1))), 16, 10).cast("int")
    word = lambda i: at(i, 0) + at(i, 1) * 256 + at(i, 2) * 65536 + at(i, 3) * 16777216
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), word)).otherwise(F.array().cast("array<int>"))
