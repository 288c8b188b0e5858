"""Byte-pair encoding and decoding with a published vocabulary.

A word becomes a doubly linked list of symbols. A priority queue holds the
merges that may apply, ordered by rank and then by place; an entry whose two
symbols have changed meanwhile is stale and skipped. Short words keep the ranks
of their pairs in a list, whose least is looked for anew after each merge. Decoding joins the
vocabulary strings, one space between tokens, as the published file names no
decoder.

The file's normalisation is NFC, white space to one space and lower case; words
are cut by its own pattern and white space is dropped. The strings of its
special tokens are found in the raw text first.

Defined cases: a null text is the empty text (no tokens); a null id is kept;
texts of any length are encoded whole; rows that repeat give repeated rows.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import partial
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks of text whose pieces a worker remembers in each of two generations; when one is full the older is let go.
CACHE_WORDS = 400_000

#: Words of up to so many symbols are merged by a list of ranks, longer ones by a priority queue.
SHORT = 32
#: A rank after all others: the pair has no merge.
NO_MERGE = 1 << 40


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    table = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return [table[b] for b in range(256)]


#: Letters and digits below this code point are matched by a small bitmap; the whole range is compiled when first met.
NEAR = 0x530
FAR = re.compile(f"[^\x00-{chr(NEAR - 1)}]")
#: str.split() also splits at these four, which are no white space in the vocabulary's pattern.
SEPARATORS = re.compile("[\x1c-\x1f]")
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


# What the library's Unicode tables have and Python's unicodedata lacks, as ranges of code points.
NEWER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEWER_DIGITS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Capitals of those tables: first, last, and the lower case of the first.
NEWER_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
LOWER = {a + n: low + n for a, b, low in NEWER_CAPITALS for n in range(b - a + 1)} | {0x3A3: 0x3C3}  # the capital sigma has one lower case here
HAS_CAPITAL = re.compile("[" + "".join(map(chr, LOWER)) + "]")


def class_pattern(pattern: str, top: int) -> str:
    """The pattern with its letter and number classes written as ranges, by unicodedata and the newer ones above, and white space as above."""
    newer = {"L": NEWER_LETTERS, "N": NEWER_DIGITS}

    def ranges(kind: str) -> str:
        more = {cp for a, b in newer[kind] for cp in range(a, b + 1)}
        found: list[list[int]] = []
        for cp in range(top):
            if unicodedata.category(chr(cp))[0] == kind or cp in more:
                if found and found[-1][1] == cp - 1:
                    found[-1][1] = cp
                else:
                    found.append([cp, cp])
        return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in found)

    return pattern.replace(r"\p{L}", ranges("L")).replace(r"\p{N}", ranges("N")).replace(r"\s", WHITE.pattern[1:-2])


class Bpe:
    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.rank: dict[int, int] = {}  # by the left symbol's id, shifted, with the right one's
        self.merged: list[int] = []
        for n, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[self.vocab[left] << 20 | self.vocab[right]] = n
            self.merged.append(self.vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        cut = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.cut = cut["pattern"]["Regex"]
        self.near = re.compile(class_pattern(self.cut, NEAR)).findall
        self._far = None
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        alphabet = byte_alphabet()
        self.inner = [self.vocab.get(c) for c in alphabet]
        self.final = [self.vocab.get(c + self.end) for c in alphabet]

    def word_ids(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        symbols = [*map(self.inner.__getitem__, data[:-1]), self.final[data[-1]]]
        if None in symbols:
            symbols = [s for s in symbols if s is not None]
        if len(symbols) <= SHORT:
            return self.short_ids(symbols)
        rank, merged = self.rank.get, self.merged
        queue, left = [], symbols[0] if symbols else -1
        for at, right in enumerate(symbols[1:]):
            r = rank(left << 20 | right)
            if r is not None:
                queue.append(r << 32 | at)
            left = right
        if not queue:
            return symbols
        n = len(symbols)
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            at, r = entry & 0xFFFFFFFF, entry >> 32
            nxt = after[at]
            if nxt >= n or rank(symbols[at] << 20 | symbols[nxt]) != r:
                continue  # stale: one of the two has been merged meanwhile
            symbol = symbols[at] = merged[r]
            symbols[nxt] = -1
            later = after[at] = after[nxt]
            if later < n:
                before[later] = at
                r = rank(symbol << 20 | symbols[later])
                if r is not None:
                    heappush(queue, r << 32 | at)
            prior = before[at]
            if prior >= 0:
                r = rank(symbols[prior] << 20 | symbol)
                if r is not None:
                    heappush(queue, r << 32 | prior)
        return [s for s in symbols if s >= 0]

    def short_ids(self, symbols: list[int]) -> list[int]:
        rank = self.rank.get
        ranks = [rank(a << 20 | b, NO_MERGE) for a, b in zip(symbols, symbols[1:])]
        while ranks and (r := min(ranks)) != NO_MERGE:
            at = ranks.index(r)
            symbol = symbols[at] = self.merged[r]
            del symbols[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(symbols[at - 1] << 20 | symbol, NO_MERGE)
            if at < len(ranks):
                ranks[at] = rank(symbol << 20 | symbols[at + 1], NO_MERGE)
        return symbols

    def chunks(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """The special token (or None) and the chunks between white space of each stretch of a text."""
        last = 0
        if self.special_at is not None:
            for m in self.special_at.finditer(text):
                yield None, self.split(text[last : m.start()])
                yield self.special[m[0]], []
                last = m.end()
        yield None, self.split(text[last:])

    def split(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if HAS_CAPITAL.search(text):
                text = text.translate(LOWER)
        text = text.lower()
        return [c for c in WHITE.split(text) if c] if SEPARATORS.search(text) else text.split()

    def chunk_words(self, chunk: str) -> list[str]:
        """No word spans white space, so that each chunk can be cut alone."""
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return (self.near if FAR.search(chunk) is None else self.far())(chunk)

    def far(self):
        if self._far is None:
            self._far = re.compile(class_pattern(self.cut, 0x110000)).findall
        return self._far

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for token, chunks in self.chunks(text):
            if token is not None:
                out.append(token)
            for w in (w for c in chunks for w in self.chunk_words(c)):
                out += self.word_ids(w)
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids if i in self.strings)


class Remembered(dict):
    """Chunk of text to whatever ``make`` derives from its ids; two generations of CACHE_WORDS entries, so that usual chunks stay."""

    def __init__(self, bpe: Bpe, make):
        super().__init__()
        self.bpe, self.make = bpe, make
        self.older: dict = {}
        self.short: dict[str, tuple[int, ...]] = {}

    def __missing__(self, chunk: str):
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        made = self.older.get(chunk)
        if made is None:
            made = self.make(self.ids(chunk))
        self[chunk] = made
        return made

    def ids(self, chunk: str) -> list[int]:
        if len(self.short) >= CACHE_WORDS:
            self.short.clear()
        out: list[int] = []
        for w in self.bpe.chunk_words(chunk):
            got = self.short.get(w)
            if got is None:
                got = self.short[w] = tuple(self.bpe.word_ids(w))
            out += got
        return out

    def of(self, text: str | None) -> list:
        """What ``make`` gave for each chunk and special token of a text."""
        get = self.__getitem__
        out: list = []
        for token, chunks in self.bpe.chunks(text or ""):
            if token is not None:
                out.append(self.make([token]))
            out += map(get, chunks)
        return out


def id_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_models: dict[str, Bpe] = {}
_remembered: dict[tuple[str, str], Remembered] = {}


def key_of(definition: str) -> str:
    return hashlib.sha1(definition.encode()).hexdigest()


def model_of(definition: str) -> Bpe:
    key = key_of(definition)
    if key not in _models:
        _models.clear()
        _models[key] = Bpe(definition)
    return _models[key]


def plain(bpe: Bpe, ids: list[int]) -> tuple[int, ...]:
    return tuple(ids)


def as_bytes(bpe: Bpe, ids: list[int]) -> bytes:
    return id_bytes(ids)


def as_strings(bpe: Bpe, ids: list[int]) -> tuple[str, str, int]:
    return " ".join(map(str, ids)), bpe.decode(ids), len(ids)


def remembered(definition: str, make: Callable[[Bpe, list[int]], object]) -> Remembered:
    """The worker's memory for one of the forms above; it outlives a task, as the worker does."""
    key = (key_of(definition), make.__name__)
    if key not in _remembered:
        _remembered.clear()
        bpe = model_of(definition)
        gc.freeze()  # the collector need not walk the tables and the memory again and again; nothing here is cyclic
        gc.set_threshold(500_000, 20, 100)
        _remembered[key] = Remembered(bpe, partial(make, bpe))
    return _remembered[key]


def published(spark, path: str | None):
    """The tokenizer's file as a broadcast of a fixed size (under 2 MB)."""
    with open(path or default_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with the column ``ids`` (array of int) added or replaced."""
    file = published(docs.sparkSession, path)
    out = docs.drop(ids)
    schema = out.withColumn(ids, F.expr("array(0)")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = remembered(file.value, plain)
        for b in batches:
            yield b.assign(**{ids: [[i for w in words.of(t) for i in w] for t in b[text]]})

    return out.mapInPandas(run, schema)


def decode(docs: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """``docs`` with the decoded ``text`` of the column ``ids``; null ids decode to the empty text."""
    file = published(docs.sparkSession, path)
    out = docs.drop(text)
    schema = out.withColumn(text, F.lit("")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = model_of(file.value)
        for b in batches:
            yield b.assign(**{text: [bpe.decode(list(x)) if x is not None else "" for x in b[ids]]})

    return out.mapInPandas(run, schema)


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, in one pass."""
    file = published(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = remembered(file.value, as_strings)
        for b in batches:
            rows = []
            for t in b["text"]:
                got = [w for w in words.of(t) if w[2]]
                shown = (" ".join(w[0] for w in got).encode(), " ".join(w[1] for w in got).encode("utf-8", "surrogatepass"))
                rows.append((sum(w[2] for w in got), *(hashlib.sha256(x).hexdigest() for x in shown)))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(doc_id=b["doc_id"].to_numpy())[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
