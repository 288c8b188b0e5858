"""Phrase collocations by language: phrases that occur more often together than their parts let expect.

Texts (A-Z lower-cased) are cut at PIECE_BREAKS into pieces and at blanks and tabs into words. Counting is exact and has three passes:

1. Texts become shards of up to SHARD words of one language, stored as whole-number word ids with a list of words; pieces are set apart by the id 0.
2. Each shard sorts its suffixes by numpy prefix doubling until they are in order up to ``most`` words. Where neighbours in that order share
   at least n words (the LCP), they form an interval; an interval's size is the count of an n-gram of the shard. The shard sends every n-gram as a 48-bit key
   and a count, in sorted blocks, one a key range. Each range is merged by key, and answers each block with a bit an n-gram:
   whether its key has ``least`` occurrences in all shards.
3. The shard finds its intervals again and emits, as text, the n-grams whose bit is set; their counts are summed by language and phrase.
   Keys that meet by chance only send some more n-grams; the final sum is by the text itself, so that counts are exact.

So n-grams below the bar, which are most, travel as 7 bytes and never as text. A frequent phrase is one row a shard, whatever the number of its
occurrences, so that no key is hot. Ranges and shards grow in number with the corpus, not in size.

Parts of a frequent phrase are at least as frequent, so that scores come from joins within the table of frequent phrases.

Defined cases: a null text is empty; a null language is ``und``; empty texts and pieces without words give nothing; a text longer than a shard is cut
into shards that overlap by ``most`` - 1 words, of which only the first owner counts a phrase; repeated rows all count; an empty table gives no rows.
Other columns are ignored. Ties go to the higher count, then to the smaller phrase by its UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import dropped, session_settings, stored

#: Where a piece ends; blanks and tabs are between words.
PIECE_BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
#: Words and breaks of a shard, bytes of text cut at once, and n-grams of a merged key range.
SHARD, CHUNK, RANGE = 1_500_000, 4 << 20, 1_500_000
KEY_BYTES = 6
#: Rows of an Arrow batch of texts.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(BLANKS)] = 1
_CLASS[list(PIECE_BREAKS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(ids, words): the words of some UTF-8 bytes as numbers from 1, with a 0 for a break between them."""
    kind = _CLASS[data]
    inside = np.concatenate([[False], kind == 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    breaks = np.cumsum(kind == 2, dtype=np.int32)
    if not len(starts):
        return np.zeros(1 if len(breaks) and breaks[-1] else 0, np.int32), []
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[kind == 0]])]).dictionary_encode()
    before = breaks[starts]  # a start is no break itself
    apart = np.diff(before, prepend=0) > 0
    place = np.arange(len(starts)) + np.cumsum(apart)
    ids = np.zeros(len(starts) + int(apart.sum()) + (1 if breaks[-1] > before[-1] else 0), np.int32)
    ids[place] = found.indices.to_numpy() + 1
    return ids, found.dictionary.to_pylist()


def chunks(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of about CHUNK bytes that end after a blank or a break; a longer word stays whole."""
    at = 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data):
            gaps = np.flatnonzero(_CLASS[data[end - CHUNK : end]])
            if len(gaps):
                end = end - CHUNK + int(gaps[-1]) + 1
                break
            end += CHUNK
        yield data[at : min(end, len(data))]
        at = end


class Shard:
    """Words of one language that a task has gathered."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: np.ndarray, words: list[bytes]) -> None:
        own = np.zeros(len(words) + 1, np.int32)
        for n, w in enumerate(words):
            own[n + 1] = self.number.setdefault(w, len(self.number) + 1)
        self.parts.append(own[ids])
        self.size += len(ids)

    def rows(self, lang: str, most: int) -> list[tuple]:
        """(lang, own, ids, words): slices of up to SHARD positions, each with the words that phrases begun in it may need."""
        ids = np.concatenate(self.parts)
        out, words = [], list(self.number)
        for at in range(0, len(ids), SHARD):
            some = ids[at : at + SHARD + most - 1]
            used = np.unique(some[some > 0])
            if len(used):
                new = np.zeros(len(words) + 1, np.int32)
                new[used] = np.arange(1, len(used) + 1)
                out.append((lang, min(SHARD, len(ids) - at), new[some].astype("<i4").tobytes(), b" ".join(words[i - 1] for i in used)))
        return out


def shards(docs: DataFrame, most: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """(shard, lang, own, words_in, ids, words) of all texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Shard] = {}
        task, count = TaskContext.get().partitionId(), 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal count
            for name in sorted(held):
                for lang, own, ids, words in held[name].rows(name, most):
                    n = int(np.count_nonzero(np.frombuffer(ids, "<i4")[:own]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([task << 32 | count], pa.int64()), pa.array([lang]), pa.array([own], pa.int32()), pa.array([n], pa.int64()), pa.array([ids], pa.binary()), pa.array([words], pa.binary())],
                        names=["shard", "lang", "own", "words_in", "ids", "words"],
                    )
                    count += 1
            held.clear()

        for b in batches:
            langs = b.column("lang")
            for name in langs.unique().to_pylist():
                own = b.column("data").filter(pa.compute.equal(langs, name))
                ends = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1]
                data = np.frombuffer(own.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(own) and ends[-1] > ends[0] else np.zeros(0, np.uint8)
                for part in chunks(data):
                    held.setdefault(name, Shard()).add(*words_of(part))
                    if sum(s.size for s in held.values()) >= SHARD:
                        yield from out()
        yield from out()

    # a text ends with a break, so that no phrase reaches into the next
    lines = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n")).cast("binary").alias("data"))
    return lines.mapInArrow(cut, "shard bigint, lang string, own int, words_in bigint, ids binary, words binary")


def suffix_array(s: np.ndarray, most: int) -> np.ndarray:
    """The positions of words (not of breaks), sorted by the ``most`` ids from there on at least, by prefix doubling."""
    rank, h = s.astype(np.int64), 1
    while True:
        second = np.zeros(len(s), np.int64)
        second[: len(s) - h] = rank[h:] if h < len(s) else 0
        second[rank == 0] = 0
        key = rank * (int(rank.max(initial=0)) + 1) + second
        order = np.argsort(key)
        h *= 2
        if h >= most:
            return order[s[order] > 0].astype(np.int64)
        ahead = key[order]
        new = np.zeros(len(s), np.int64)
        new[order] = np.cumsum(np.diff(ahead, prepend=ahead[:1]) != 0)
        # breaks stay the smallest, with rank 0; words come after
        rank = np.where(s > 0, new + 1, 0)


def intervals(s: np.ndarray, own: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to ``most``: (begin, count) of the distinct n-grams that begin in the first ``own`` positions."""
    order = suffix_array(s, most)
    mine = order[order < own]
    padded = np.concatenate([s, np.zeros(most, s.dtype)])
    out = []
    valid, same = np.ones(len(mine), bool), np.ones(max(0, len(mine) - 1), bool)
    for n in range(most):
        word = padded[mine + n]
        valid = valid & (word > 0)
        same = same & (word[1:] == word[:-1]) & (word[1:] > 0)  # the LCP with the one before is over n
        first = np.flatnonzero(np.concatenate([[True], ~same])) if len(mine) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(mine)))
        kept = valid[first]
        out.append((mine[first[kept]], count[kept]))
    return out


def keyed(lang: str, s: np.ndarray, words: list[bytes], grams: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, count, begin, n) of all n-grams in the order of their 64-bit keys."""
    seed = xxhash.xxh32_intdigest(lang.encode())
    of_word = np.array([0, *(xxhash.xxh64_intdigest(w, seed) for w in words)], dtype=np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    keys = []
    with np.errstate(over="ignore"):
        for n, (begin, _) in enumerate(grams):
            key = np.full(len(begin), n + 1, np.uint64)
            for at in range(n + 1):
                key = (key ^ (key >> np.uint64(29))) * mix + of_word[s[begin + at]]
            key = (key ^ (key >> np.uint64(32))) * mix
            keys.append(key ^ (key >> np.uint64(29)))
    key, count, begin = np.concatenate(keys), np.concatenate([c for _, c in grams]), np.concatenate([b for b, _ in grams])
    size = np.repeat(np.arange(1, len(grams) + 1), [len(b) for b, _ in grams])
    order = np.argsort(key)
    return key[order], count[order], begin[order], size[order]


def opened(r, most: int):
    """(ids, words, key, count, begin, n) of a stored shard."""
    s, words = np.frombuffer(r.ids, "<i4"), r.words.split(b" ")
    return s, words, *keyed(r.lang, s, words, intervals(s, int(r.own), most))


def packed_counts(count: np.ndarray) -> bytes:
    """A byte a count; from 255 on, 255 and the count in eight bytes at the end."""
    return np.minimum(count, 255).astype(np.uint8).tobytes() + count[count >= 255].astype("<i8").tobytes()


def unpacked_counts(data: bytes, n: int) -> np.ndarray:
    count = np.frombuffer(data[:n], np.uint8).astype(np.int64)
    count[count == 255] = np.frombuffer(data[n:], "<i8")
    return count


def frequent(docs: DataFrame, least: int = 10, most: int = 3, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f) of all phrases of up to ``most`` words with f >= ``least`` occurrences, (lang, n) with the words of each language)."""
    spark = docs.sparkSession
    with session_settings(spark, SETTINGS):
        table = stored(shards(docs, most, text, lang), "phrase-shards")
    totals = stored(table.groupBy("lang").agg(F.sum("words_in").alias("n")), "language-words")
    words = totals.agg(F.sum("n")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, words * most / RANGE)))))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                _, _, key, count, _, _ = opened(r, most)
                of = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
                ends = np.searchsorted(of, np.arange((1 << bits) + 1))
                keys = short_key(key, bits).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
                filled = np.flatnonzero(np.diff(ends))
                yield pd.DataFrame({
                    "part": filled, "shard": r.shard, "n": np.diff(ends)[filled],
                    "keys": [keys[ends[p] : ends[p + 1]].T.tobytes() for p in filled], "counts": [packed_counts(count[ends[p] : ends[p + 1]]) for p in filled],
                })

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        """A bit for each n-gram of each block: whether its key is frequent."""
        sizes = group["n"].to_numpy()
        key = np.zeros(int(sizes.sum()), np.uint64)
        count = np.zeros(len(key), np.int64)
        ends = np.cumsum(sizes)
        for a, z, k, c in zip(ends - sizes, ends, group["keys"], group["counts"]):
            wide = np.zeros((z - a, 8), np.uint8)
            wide[:, :KEY_BYTES] = np.frombuffer(k, np.uint8).reshape(KEY_BYTES, -1).T
            key[a:z], count[a:z] = wide.view("<u8").ravel(), unpacked_counts(c, z - a)
        order = np.argsort(key)
        first = np.flatnonzero(np.diff(key[order], prepend=~key[order][:1]))
        often = np.add.reduceat(count[order], first) >= least
        kept = np.empty(len(key), bool)
        kept[order] = np.repeat(often, np.diff(np.append(first, len(key))))
        return pd.DataFrame({"part": group["part"], "shard": group["shard"], "n": sizes, "kept": [np.packbits(kept[a:z]).tobytes() for a, z in zip(ends - sizes, ends)]})

    def tell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The frequent n-grams of a shard as text."""
        found: dict[str, list] = {"lang": [], "phrase": [], "size": [], "f": []}
        right = right.sort_values("part")
        for r in left.itertuples():
            s, words, _, count, begin, size = opened(r, most)
            kept = np.concatenate([np.unpackbits(np.frombuffer(k, np.uint8), count=n) for k, n in zip(right["kept"], right["n"])]).astype(bool)
            text = np.array([None, *(w.decode() for w in words)], dtype=object)
            for n in range(1, most + 1):
                rows = kept & (size == n)
                at = begin[rows]
                phrase = text[s[at]]
                for k in range(1, n):
                    phrase = phrase + " " + text[s[at + k]]
                found["phrase"].append(phrase)
                found["f"].append(count[rows])
                found["size"].append(np.full(len(at), n, np.int32))
                found["lang"].append(np.full(len(at), r.lang, dtype=object))
        return pd.DataFrame({k: np.concatenate(v) for k, v in found.items()} if found["f"] else {k: [] for k in found})

    # one shard a batch: a shard is some megabytes
    with session_settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}):
        rows = table.select("shard", "lang", "own", "ids", "words")
        sent = rows.mapInPandas(send, "part int, shard bigint, n int, keys binary, counts binary")
        bits_back = stored(sent.groupBy("part").applyInPandas(merge, "part int, shard bigint, n int, kept binary"), "phrase-bits")
    told = rows.groupBy("shard").cogroup(bits_back.groupBy("shard")).applyInPandas(tell, "lang string, phrase string, size int, f bigint")
    counted = stored(told.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "frequent-phrases")
    dropped(table)
    dropped(bits_back)
    return counted, totals


def short_key(key: np.ndarray, bits: int) -> np.ndarray:
    """The KEY_BYTES * 8 bits of a key below its ``bits`` leading ones, which the range stands for."""
    return (key << np.uint64(bits)) >> np.uint64(64 - 8 * KEY_BYTES)


def collocations(docs: DataFrame, top: int = 2_000, least: int = 10, most: int = 3, cover: int = 50, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``most`` words.

    score = floor(1000000 * a * a / (l * r)) of the cut with the lowest, the smallest k on ties. A phrase within a longer one that has
    at least ``cover`` percent of its occurrences is left out.
    """
    counted, totals = frequent(docs, least, most, text, lang)
    words = F.split("phrase", " ", -1)
    phrases = counted.where(F.col("size") >= 2).select("lang", "phrase", "size", F.col("f").alias("a"))
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    cut = phrases.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.withColumn("_left", part(F.lit(1), F.col("k"))).withColumn("_right", part(F.col("k") + 1, F.col("size") - F.col("k")))
    left = counted.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l"))
    right = counted.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r"))
    both = cut.join(left, ["lang", "_left"]).join(right, ["lang", "_right"])
    wide = both.withColumn("score", F.expr("CAST((CAST(a AS DECIMAL(13,0)) * CAST(a AS DECIMAL(13,0)) * CAST(1000000 AS DECIMAL(7,0))) DIV (CAST(l AS DECIMAL(13,0)) * CAST(r AS DECIMAL(13,0))) AS BIGINT)"))
    lowest = wide.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # every shorter phrase within a longer one, with the longer one's count
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    covering = phrases.where("size > 2").select("lang", F.col("a").alias("longer"), F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(covering, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score").withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
