"""A Katz backoff model of any order: fitted, stored in partitioned tables, and evaluated on every text.

Counts r up to K are discounted by Good-Turing, d_r = (r*/r - x) / (1 - x) with
r* = (r + 1) n_(r+1) / n_r and x = (K + 1) n_(K+1) / n_1, each order by its own counts of
counts; a context keeps the mass that this frees for the words it has not seen, shared in
proportion to their probabilities at the next lower order, so that each distribution sums to
one exactly: over all training words and one class of unknown words, whose probability is the
mass that the unigram discounts free. A token is evaluated recursively: its n-gram if that was
seen, else the context's backoff weight times the token's probability one order below.

Where counts of counts allow no such discounts K is lowered; where no K is left,
0.5 is taken off each count up to 5. A context (or a whole table) without any
discounted count gets one more event in its denominator, which is its free mass.

The stored model is a trie: a row of level n holds, for one partition, the contexts (ids of
grams of level n - 1), their followers (word ids) and counts, and each context's sums; a gram's
id is its place. ``fit`` writes it, ``score`` reads it for texts of any kind, and ``fit_and_score``
does both in one exchange for the corpus that it learns from.

How it runs: the corpus is tokenised once into blocks (distinct word digests, and tokens as
indexes into them). Order by order, a block sends its distinct grams whose context is known to the
partitions that own the contexts; an owner sums what all blocks send, stores its part of
the level, and replies to each block with counts and ids in the order sent. So no row a token is
shuffled, and the next order's contexts are single numbers. At the highest order a block is sent no
reply for contexts whose events all lie within it. There are about TOKENS / PART_TOKENS
partitions, and a block sends nothing to those that it has no gram for. Contexts that hold over
1 / (4 * partitions) of all tokens are spread over SPREAD partitions; only their sums are
put together on the driver (4 * partitions contexts at most).

Words are held by their 64-bit XXH64.

Defined cases: a null or empty text is one end token; an id that is null is
scored and held out; with no training text every token is unknown (probability
one); rows that repeat count each; texts of any length are taken whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import removed, session_settings, shared_dir, stored

K = 5
ORDER = 3
BLOCK_TOKENS = 500_000
PART_TOKENS = 1_000_000
SPREAD = 8
END = xxhash.xxh64_intdigest(b"\nend")  # no word holds a line feed
START_ID, UNKNOWN_ID, FIRST_ID = 0, 1, 2
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


#: Made once: a corpus is sent in many small messages.
_COMPRESSOR, _DECOMPRESSOR = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(a: np.ndarray) -> bytes:
    """Compressed by byte planes: the high bytes of small numbers vanish."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else np.zeros((0, 0), np.uint8)
    return _COMPRESSOR.compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(_DECOMPRESSOR.decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def packed_rising(a: np.ndarray) -> bytes:
    return packed(np.diff(a.astype(np.uint64), prepend=np.uint64(0)))


def unpacked_rising(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<u8"), dtype=np.uint64)


def by_part(rows: np.ndarray, parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``rows``, in the order of ``parts``, cut by part."""
    cuts = np.concatenate([[0], np.nonzero(np.diff(parts))[0] + 1, [len(parts)]]) if len(parts) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(parts[a]), rows[a:b]


def words_by_part(words: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of the words of each part, rising; one sort, however many parts there are."""
    part = (mixed(words) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    yield from by_part(order, part[order])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def discounts(n: np.ndarray, k: int = K) -> np.ndarray:
    """d_0..d_K for the counts of counts n_1..n_(K+1) (``n[0]`` is n_1); d_0 is unused, counts above have no discount."""
    for top in range(k, 0, -1):
        r = np.arange(1, top + 1)
        if (n[: top + 1] > 0).all():
            x = (top + 1) * n[top] / n[0]
            if x < 1:
                d = ((r + 1) * n[1 : top + 1] / (r * n[:top]) - x) / (1 - x)
                if ((d > 0) & (d < 1)).all():
                    return np.concatenate([[1.0], d, np.ones(k - top)])
    r = np.arange(1, k + 1)
    return np.concatenate([[1.0], (r - 0.5) / r])


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts less their discount."""
    c = np.asarray(c, dtype=np.int64)
    return np.where(c > K, 1.0, d[np.minimum(c, K)]) * c


def freed_mass(small: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What the discounts free in each context, in events; ``small``: a row a context, how many followers have counts 1 to K."""
    return small @ (np.arange(1, K + 1) * (1 - d[1 : K + 1]))


def seen_mass(low: np.ndarray, big: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The discounted counts, one order below, of all followers of each context: ``low`` says how many of them have counts
    1 to K there, ``big`` is the sum of the larger counts."""
    return low @ (np.arange(1, K + 1) * d[1 : K + 1]) + big


def sums_of(of: np.ndarray, count: np.ndarray, below: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """small, low and big of ``n`` contexts from their followers' counts at this order and below."""
    small = np.stack([np.bincount(of[count == r], minlength=n) for r in range(1, K + 1)], axis=1)
    low = np.stack([np.bincount(of[below == r], minlength=n) for r in range(1, K + 1)], axis=1)
    return small, low, np.bincount(of, np.where(below > K, below, 0), n)


def counts_of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2]


class Unigrams:
    """Probabilities by training count: ``p(c)``; c = 0 is the class of all unknown words."""

    def __init__(self, total: int, kinds: int, n: np.ndarray):
        self.total, self.kinds, self.d = int(total), int(kinds), discounts(np.asarray(n))
        freed = float((np.arange(1, K + 1) * np.asarray(n)[:K] * (1 - self.d[1 : K + 1])).sum())
        self.of = total if freed > 0 else total + 1
        self.unknown = (freed if freed > 0 else 1.0) / self.of

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(np.asarray(c) > 0, discounted(c, self.d) / self.of, self.unknown)


@dataclass
class Hot:
    """The spread contexts of a level, sorted, and their sums over all partitions."""

    ctx: np.ndarray
    small: np.ndarray
    low: np.ndarray
    big: np.ndarray

    @classmethod
    def none_yet(cls, ctx: np.ndarray) -> Hot:
        return cls(ctx, np.zeros((len(ctx), K)), np.zeros((len(ctx), K)), np.zeros(len(ctx)))


@dataclass
class Model:
    """Statistics of a fitted model; its levels lie in tables below ``path``, a row a partition."""

    path: str
    order: int
    parts: int
    texts: int = 0
    sums: list[int] = field(default_factory=list)
    d: dict[int, np.ndarray] = field(default_factory=dict)
    hot: dict[int, Hot] = field(default_factory=dict)

    @property
    def uni(self) -> Unigrams:
        return Unigrams(self.sums[0], self.sums[1], np.array(self.sums[2:]))

    def table(self, spark: SparkSession, level: int) -> DataFrame:
        return spark.read.schema(OWNED).parquet(f"{self.path}/level-{level}").where("kind = 1")

    def save(self, spark: SparkSession) -> None:
        hot = {n: [h.ctx.tolist(), h.small.tolist(), h.low.tolist(), h.big.tolist()] for n, h in self.hot.items()}
        text = json.dumps({"order": self.order, "parts": self.parts, "texts": self.texts, "sums": self.sums, "d": {n: d.tolist() for n, d in self.d.items()}, "hot": hot})
        spark.createDataFrame([(text,)], "statistics string").coalesce(1).write.parquet(f"{self.path}/statistics")


def load(spark: SparkSession, path: str) -> Model:
    got = json.loads(spark.read.parquet(f"{path}/statistics").first()[0])
    hot = {int(n): Hot(np.array(c, dtype=np.uint64), np.array(s, dtype=float).reshape(-1, K), np.array(w, dtype=float).reshape(-1, K), np.array(b, dtype=float)) for n, (c, s, w, b) in got["hot"].items()}
    return Model(path, got["order"], got["parts"], got["texts"], got["sums"], {int(n): np.array(d) for n, d in got["d"].items()}, hot)


class Numbers(dict):
    """Words to numbers, in the order in which they are first met."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


def blocks_of(docs: DataFrame, held: F.Column, size: int) -> DataFrame:
    """The tokenised corpus: a row a block of some ``size`` tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number = TaskContext.get().partitionId(), 0
        names = Numbers({b"\n": 0})
        ids, flags, rows, total = [], [], [], 0

        def flush() -> pd.DataFrame:
            digest = xxhash.xxh64_intdigest
            h = np.array([END, *map(digest, list(names)[1:])], dtype=np.uint64)
            words, place = np.unique(h, return_inverse=True)
            tokens = place[np.concatenate(rows)].astype(np.uint32)
            train = sum(len(r) for r, f in zip(rows, flags) if not f)
            one = {"block": task << 24 | number, "n": len(tokens), "train": train, "texts": len(flags) - sum(flags), "ids": ids[:], "held": flags[:],
                   "lens": packed(np.array([len(r) for r in rows], dtype=np.int32)), "tokens": packed(tokens), "words": packed_rising(words)}
            return pd.DataFrame([one])

        for b in batches:
            for doc_id, text, flag in zip(b["doc_id"].tolist() if b["doc_id"].notna().all() else [None if pd.isna(x) else x for x in b["doc_id"]], b["text"], b["held"]):
                found = (text or "").encode("utf-8", "surrogatepass").lower().split()
                found.append(b"\n")
                row = np.fromiter(map(names.__getitem__, found), dtype=np.int32, count=len(found))
                ids.append(doc_id)
                flags.append(bool(flag))
                rows.append(row)
                total += len(row)
                if total >= size:
                    yield flush()
                    number += 1
                    names = Numbers({b"\n": 0})
                    ids, flags, rows, total = [], [], [], 0
        if rows:
            yield flush()

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), held.alias("held"))
    return texts.mapInPandas(run, f"block bigint, n bigint, train bigint, texts bigint, ids array<{kind}>, held array<boolean>, lens binary, tokens binary, words binary")


class Block:
    """A block with what the owners have replied so far: level by level its distinct grams, in the order in which they are sent."""

    def __init__(self, row, model: Model, fitting: bool):
        self.model, self.uni = model, model.uni
        self.words = unpacked_rising(row.words)
        self.tokens = unpacked(row.tokens, "<u4").astype(np.int32)
        self.lens = unpacked(row.lens, "<i4").astype(np.int64)
        self.first = np.cumsum(self.lens) - self.lens  # where the texts start
        self.train = np.repeat(~np.array(row.held, dtype=bool), self.lens) if fitting else None
        self.parts = np.uint64(model.parts)
        self.replies = row

    def trained(self, at: np.ndarray, n: int) -> np.ndarray:
        """How often each gram occurs in training texts; ``at``: the gram of each token, or -1."""
        if self.train is None:
            return np.zeros(n, np.uint32)
        return np.bincount(at[self.train & (at >= 0)], minlength=n).astype(np.uint32)

    def take_words(self) -> None:
        """Level 1: word ids and counts as replied; unknown words become one."""
        of_part = dict(words_by_part(self.words, self.model.parts))
        self.count, self.id = np.zeros(len(self.words), np.int64), np.full(len(self.words), UNKNOWN_ID, np.uint64)
        for r in self.replies.r1:
            mine = of_part[r["part"]]
            self.count[mine], self.id[mine] = unpacked(r["n"], "<u8"), unpacked(r["id"], "<u8")
        self.word_id, self.word_count = self.id, self.count
        by_id, self.rank = np.unique(self.id, return_inverse=True)  # words in the order of their ids, the unknown ones alike
        self.by_rank, self.kinds = by_id, len(by_id)
        self.at = self.tokens  # the gram of the level so far that ends at each token
        self.p = self.uni.p(self.count)[self.tokens]
        # of the contexts, the last of which is the start of a text: their number of events, denominators and least probability below
        self.below_of, self.floor = np.full(len(self.words) + 1, float(self.uni.of)), np.full(len(self.words) + 1, self.uni.unknown)
        self.id = np.append(np.where(self.count > 0, self.id, NONE), np.uint64(START_ID))
        self.total = np.append(self.count, self.model.texts)
        self.seen_here = self._seen_here(self.tokens, len(self.words))

    def _seen_here(self, at: np.ndarray, n: int) -> np.ndarray:
        """The training events of each context that lie in this block."""
        return np.append(self.trained(at, n), 0 if self.train is None else self.train[self.first].sum())

    def grams(self, level: int) -> None:
        """The distinct grams of ``level`` whose context is known, sorted by part, context and follower."""
        self.level_at = self.at
        before = np.empty_like(self.at)
        before[1:] = self.at[:-1]
        before[self.first] = len(self.id) - 1
        known = np.nonzero((before >= 0) & (self.total[before] > 0))[0]
        ctx, rank = before[known], self.rank[self.tokens[known]]
        base = mixed(self.id + np.uint64(level)) % self.parts
        hot = np.isin(self.id, self.model.hot[level].ctx)
        part = base[ctx]
        far = np.nonzero(hot[ctx])[0]
        part[far] = (part[far] + mixed(self.by_rank[rank[far]] ^ (self.id[ctx[far]] << np.uint64(7))) % np.uint64(SPREAD)) % self.parts
        by_id = np.empty(len(self.id), np.int64)
        by_id[np.argsort(self.id, kind="stable")] = np.arange(len(self.id))
        key = (part.astype(np.int64) * len(self.id) + by_id[ctx]) * self.kinds + rank
        del part, far
        keys, at = np.unique(key, return_inverse=True)
        del key
        self.before_id, self.before_total, self.before_hot = self.id, self.total, hot
        self.at = np.full(len(self.tokens), -1, np.int32)
        self.at[known] = at
        one = np.empty(len(keys), np.int64)
        one[at] = known  # a token at which each gram ends
        self.one, self.ctx, self.follower = one, before[one], self.tokens[one]
        rest = keys // self.kinds
        new = np.concatenate([[True], rest[1:] != rest[:-1]]) if len(rest) else np.zeros(0, bool)
        self.head = np.nonzero(new)[0]  # where a context begins
        self.part_of = (rest // len(self.id)).astype(np.int64)
        self.run = np.cumsum(new) - 1  # the context's run of each gram
        self.n = self.trained(self.at, len(self.one))
        # at the last level a context whose events all lie in this block needs no reply
        of_run = self.ctx[self.head]
        self.local = (self.total[of_run] == self.seen_here[of_run]) & ~hot[of_run] & (self.train is not None) & (level == self.model.order)
        self.asked_runs = np.nonzero(~self.local)[0]
        self.asked = np.nonzero(~self.local[self.run])[0]

    def sent(self, block: int) -> Iterator[dict]:
        """What goes to each owner: what it is asked, and what it need only store."""
        lower = self.lower_counts()
        followers = np.where(self.word_count[self.follower] > 0, self.word_id[self.follower], np.uint64(UNKNOWN_ID))
        stored_only = np.nonzero(self.local[self.run] & (self.n > 0))[0]
        for local, rows in ((False, self.asked), (True, stored_only)):
            for p, mine in by_part(rows, self.part_of[rows]):
                run = self.run[mine]
                heads = np.nonzero(np.concatenate([[True], run[1:] != run[:-1]]))[0]
                runs = np.diff(np.append(heads, len(mine))).astype(np.uint32)
                n = self.n[mine]
                yield {"part": p, "block": block, "local": local, "ctx": packed_rising(self.before_id[self.ctx[mine[heads]]]), "runs": packed(runs), "fol": packed(followers[mine]),
                       "n": packed(n), "lower": packed(lower[mine][n > 0].astype(np.uint64))}

    def take(self, level: int, replies, last: bool) -> None:
        """Counts, ids and sums of the grams as replied; then the probability of each token at this level."""
        model, size = self.model, len(self.one)
        count, ids = np.where(self.local[self.run], self.n, 0).astype(np.int64), np.full(size, NONE, np.uint64)
        mine = np.nonzero(self.local[self.run] & (self.n > 0))[0]
        small, low, big = sums_of(self.run[mine], count[mine], self.lower_counts()[mine], len(self.head))
        rows = dict(by_part(self.asked, self.part_of[self.asked]))
        runs = dict(by_part(self.asked_runs, self.part_of[self.head[self.asked_runs]]))
        for r in replies if replies is not None else ():
            mine, own_runs = rows[r["part"]], runs[r["part"]]
            count[mine] = unpacked(r["n"], "<u8")
            if not last:
                own = np.full(len(mine), NONE, np.uint64)
                own[count[mine] > 0] = unpacked_rising(r["id"])
                ids[mine] = own
            small[own_runs], low[own_runs], big[own_runs] = unpacked(r["small"], "<u8").reshape(-1, K), unpacked(r["low"], "<u8").reshape(-1, K), unpacked(r["big"], "<u8")
        of_run = self.ctx[self.head]  # each run's context
        hot = np.nonzero(self.before_hot[of_run])[0]
        at = np.searchsorted(model.hot[level].ctx, self.before_id[of_run[hot]])
        small[hot], low[hot], big[hot] = model.hot[level].small[at], model.hot[level].low[at], model.hot[level].big[at]
        mass = seen_mass(low, big, model.d[level - 1])
        freed, total = freed_mass(small, model.d[level]), self.before_total[of_run]
        of = np.where(freed > 0, total, total + 1)
        free = np.where(freed > 0, freed, 1.0) / of
        weight = free / np.maximum(1 - mass / self.below_of[of_run], self.floor[of_run])
        below = self.p[self.one]
        p = np.where(count > 0, discounted(count, model.d[level]) / of[self.run], weight[self.run] * below)
        tokens = np.nonzero(self.at >= 0)[0]
        self.p[tokens] = p[self.at[tokens]]
        if not last:
            # the grams as contexts of the next level: their own shorter context is the gram that ends at the same token one level below
            of_below, floor_below = np.full(len(self.before_id), np.nan), np.full(len(self.before_id), np.nan)
            of_below[of_run], floor_below[of_run] = of, weight * self.floor[of_run]
            short = np.append(self.level_at[self.one], len(self.before_id) - 1)
            self.below_of, self.floor = of_below[short], floor_below[short]
            self.id, self.total = np.append(ids, np.uint64(START_ID)), np.append(count, model.texts)
            self.seen_here = self._seen_here(self.at, size)
            self.count = count

    def lower_counts(self) -> np.ndarray:
        """The count one order below of each gram of the level at hand."""
        at = self.level_at[self.one]
        return np.where(at >= 0, self.count[at], 0)


class Level:
    """A part of a level of the model: contexts, and their followers and counts, both in the order of ids."""

    def __init__(self, part: int, parts: int, ctx: np.ndarray, runs: np.ndarray, fol: np.ndarray, n: np.ndarray, small: np.ndarray, low: np.ndarray, big: np.ndarray):
        self.part, self.parts, self.ctx, self.runs, self.fol, self.n, self.small, self.low, self.big = part, parts, ctx, runs, fol, n, small, low, big
        self.followers, rank = np.unique(fol, return_inverse=True)
        self.keys = np.repeat(np.arange(len(ctx)), runs) * max(1, len(self.followers)) + rank

    @classmethod
    def of_sent(cls, part: int, parts: int, sent: pd.DataFrame) -> Level:
        """Summed up from what the blocks sent."""
        ctx = np.concatenate([np.repeat(unpacked_rising(c), unpacked(r, "<u4")) for c, r in zip(sent["ctx"], sent["runs"])])
        fol = np.concatenate([unpacked(x, "<u8") for x in sent["fol"]])
        n = np.concatenate([unpacked(x, "<u4") for x in sent["n"]])
        some = n > 0
        ctx, fol, n = ctx[some], fol[some], n[some]
        lower = np.concatenate([np.zeros(0, np.uint64), *(unpacked(x, "<u8") for x in sent["lower"])])
        contexts, at = np.unique(ctx, return_inverse=True)
        followers, rank = np.unique(fol, return_inverse=True)
        keys, place = np.unique(at * max(1, len(followers)) + rank, return_inverse=True)
        total = np.bincount(place, n, len(keys)).astype(np.int64)
        below = np.zeros(len(keys), np.int64)
        below[place] = lower
        of = keys // max(1, len(followers))
        return cls(part, parts, contexts, np.bincount(of, minlength=len(contexts)), followers[keys % max(1, len(followers))], total, *sums_of(of, total, below, len(contexts)))

    @classmethod
    def of_table(cls, part: int, parts: int, table: pd.DataFrame) -> Level:
        none = np.zeros(0, np.int64)
        if not len(table):
            return cls(part, parts, none.astype(np.uint64), none, none.astype(np.uint64), none, np.zeros((0, K)), np.zeros((0, K)), none)
        r = table.iloc[0]
        return cls(part, parts, unpacked_rising(r["ctx"]), unpacked(r["runs"], "<u8").astype(np.int64), unpacked(r["fol"], "<u8"), unpacked(r["n"], "<u8").astype(np.int64),
                   unpacked(r["small"], "<u8").reshape(-1, K), unpacked(r["low"], "<u8").reshape(-1, K), unpacked(r["big"], "<u8"))

    def row(self) -> dict:
        return {"kind": 1, "block": -1, "ctx": packed_rising(self.ctx), "runs": packed(self.runs.astype(np.uint64)), "fol": packed(self.fol), "n": packed(self.n.astype(np.uint64)), **packed_sums(self.small, self.low, self.big)}

    def reply(self, r, last: bool) -> dict:
        ctx, runs, fol = unpacked_rising(r.ctx), unpacked(r.runs, "<u4"), unpacked(r.fol, "<u8")
        at = np.minimum(np.searchsorted(self.ctx, ctx), max(0, len(self.ctx) - 1))
        known = self.ctx[at] == ctx if len(self.ctx) else np.zeros(len(ctx), bool)
        count, ids = np.zeros(len(fol), np.int64), np.zeros(0, np.uint64)
        small, low, big = np.zeros((len(ctx), K)), np.zeros((len(ctx), K)), np.zeros(len(ctx))
        if len(self.keys):
            rank = np.minimum(np.searchsorted(self.followers, fol), len(self.followers) - 1)
            key = np.repeat(at, runs) * len(self.followers) + rank
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[place] == key) & (self.followers[rank] == fol) & np.repeat(known, runs)
            count = np.where(hit, self.n[place], 0)
            ids = place[hit].astype(np.uint64) * np.uint64(self.parts) + np.uint64(self.part + FIRST_ID)
            small[known], low[known], big[known] = self.small[at[known]], self.low[at[known]], self.big[at[known]]
        out = {"kind": 0, "block": r.block, "n": packed(count.astype(np.uint64)), **packed_sums(small, low, big)}
        return out if last else out | {"id": packed_rising(ids)}


def packed_sums(small: np.ndarray, low: np.ndarray, big: np.ndarray) -> dict[str, bytes]:
    return {"small": packed(small.astype(np.uint64).ravel()), "low": packed(low.astype(np.uint64).ravel()), "big": packed(big.astype(np.uint64))}


OWNED = "kind int, part int, block bigint, ctx binary, runs binary, fol binary, n binary, id binary, small binary, low binary, big binary"
COLUMNS = [c.split()[0] for c in OWNED.split(", ")]


WORDS_SENT = "part int, block bigint, words binary, n binary"
GRAMS_SENT = "part int, block bigint, local boolean, ctx binary, runs binary, fol binary, n binary, lower binary"


def messages(rows: list[dict], schema: str) -> pd.DataFrame:
    """All that a block sends as one batch: its rows are as many as the parts, and a batch for each of them costs far more than what is in it."""
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def sent_words(batches: Iterator[pd.DataFrame], parts: int, fitting: bool) -> Iterator[pd.DataFrame]:
    """A batch a block: its words and their counts to each part that owns some."""
    for b in batches:
        for row in b.itertuples():
            words, lens = unpacked_rising(row.words), unpacked(row.lens, "<i4")
            n = np.zeros(len(words), np.uint32)
            if fitting:
                train = np.repeat(~np.array(row.held, dtype=bool), lens)
                n = np.bincount(unpacked(row.tokens, "<u4")[train], minlength=len(words)).astype(np.uint32)
            yield messages([{"part": p, "block": row.block, "words": packed_rising(words[mine]), "n": packed(n[mine])} for p, mine in words_by_part(words, parts)], WORDS_SENT)


def sent_grams(batches: Iterator[pd.DataFrame], model: Model, fitting: bool, level: int) -> Iterator[pd.DataFrame]:
    """A batch a block: its grams to each part that owns some of their contexts."""
    for b in batches:
        for row in b.itertuples():
            k = filled(row, model, fitting, level - 1)
            k.grams(level)
            yield messages(list(k.sent(row.block)), GRAMS_SENT)


def owned(rows: list[dict], part: int) -> pd.DataFrame:
    out = pd.DataFrame(rows).reindex(columns=COLUMNS).assign(part=part)
    return out.astype(object).where(out.notna(), None)


class Run:
    """One pass of a corpus through the levels: with ``model.path`` written (fitting) or read (scoring)."""

    def __init__(self, docs: DataFrame, held: F.Column, model: Model, fitting: bool):
        self.docs, self.held, self.model, self.fitting = docs, held, model, fitting
        self.spark = docs.sparkSession
        self.kind = docs.schema["doc_id"].dataType.simpleString()
        self.name = f"graphloom_blocks_{uuid.uuid4().hex}"
        self.blocks = f"{shared_dir(self.spark)}/graphloom/{self.name}"
        self.work = model.path if fitting else f"{shared_dir(self.spark)}/graphloom/katz-{uuid.uuid4().hex}"

    def __enter__(self) -> Run:
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        blocks_of(self.docs, self.held, BLOCK_TOKENS).write.option("path", self.blocks).bucketBy(buckets, "block").saveAsTable(self.name)
        self.corpus = self.spark.table(self.name)
        if self.fitting:
            n, texts = self.corpus.agg(F.sum("n"), F.sum("texts")).first()
            self.model.texts = texts or 0
            self.model.parts = max(1, -(-(n or 0) // PART_TOKENS), min(buckets, (n or 0) // 20_000))
        return self

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        removed(self.spark, self.blocks)
        for level in range(1, self.model.order + 1):
            removed(self.spark, f"{self.work}/level-{level}/kind=0")

    def owners(self, sent: DataFrame, level: int, own, last: bool = False) -> DataFrame:
        """Deal what was sent to its owners, store what they make, and return it."""
        grouped = sent.groupBy("part")
        if self.fitting:
            made = grouped.applyInPandas(lambda g: own(g, None), OWNED)
        else:
            made = grouped.cogroup(self.model.table(self.spark, level).groupBy("part")).applyInPandas(lambda g, t: own(g, t) if len(g) else owned([], 0), OWNED)
        path = f"{self.work}/level-{level}"
        made.write.partitionBy("kind").parquet(path)
        return self.spark.read.schema(OWNED).parquet(path)

    def replies(self, level: int) -> DataFrame:
        table = self.spark.read.schema(OWNED).parquet(f"{self.work}/level-{level}").where("kind = 0")
        return table.groupBy("block").agg(F.collect_list(F.struct("part", "n", "id", "small", "low", "big")).alias(f"r{level}"))

    def with_replies(self, levels: int) -> DataFrame:
        out = self.corpus
        for level in range(1, levels + 1):
            out = out.join(self.replies(level), "block", "inner" if level == 1 else "left")
        return out

    def words(self) -> None:
        parts, fitting, model = self.model.parts, self.fitting, self.model

        def own(group: pd.DataFrame, table: pd.DataFrame | None) -> pd.DataFrame:
            part = int(group["part"].iloc[0])
            sent = [unpacked_rising(x) for x in group["words"]]
            if table is None:
                every, place = np.unique(np.concatenate(sent), return_inverse=True)
                total = np.bincount(place, np.concatenate([unpacked(x, "<u4") for x in group["n"]]), len(every)).astype(np.int64)
                every, total = every[total > 0], total[total > 0]
                ids = np.empty(len(every), np.uint64)
                ids[np.argsort(-total, kind="stable")] = np.arange(len(every), dtype=np.uint64) * np.uint64(parts) + np.uint64(part + FIRST_ID)  # usual words have small ids
            elif len(table):
                r = table.iloc[0]
                every, total, ids = unpacked_rising(r["fol"]), unpacked(r["n"], "<u8").astype(np.int64), unpacked(r["id"], "<u8")
            else:
                every, total, ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
            out = []
            for block, words in zip(group["block"], sent):
                n, own_id = np.zeros(len(words), np.uint64), np.full(len(words), UNKNOWN_ID, np.uint64)
                if len(every):
                    at = np.minimum(np.searchsorted(every, words), len(every) - 1)
                    hit = every[at] == words
                    n[hit], own_id[hit] = total[at[hit]], ids[at[hit]]
                out.append({"kind": 0, "block": block, "n": packed(n), "id": packed(own_id)})
            if table is None:
                out.append({"kind": 1, "block": -1, "fol": packed_rising(every), "n": packed(total.astype(np.uint64)), "id": packed(ids)})
                out.append({"kind": 2, "block": -1, "n": packed(np.concatenate([[total.sum(), len(total)], counts_of_counts(total)]).astype(np.int64))})
            return owned(out, part)

        sent = self.corpus.mapInPandas(lambda batches: sent_words(batches, parts, fitting), WORDS_SENT)
        made = self.owners(sent, 1, own)
        if fitting:
            sums = sum((unpacked(r.n, "<i8") for r in made.where("kind = 2").select("n").collect()), np.zeros(K + 3, np.int64))  # a row a part
            model.sums, model.d[1] = sums.tolist(), discounts(sums[2:])

    def heavy(self, level: int) -> np.ndarray:
        """The contexts of ``level`` that hold so many tokens that they are spread: 4 * parts at most."""
        model = self.model
        parts, least = model.parts, max(1, model.sums[0] // (4 * model.parts))

        def frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples():
                    n = unpacked(r.n, "<u8")
                    ids = unpacked(r.id, "<u8") if level == 2 else np.arange(len(n), dtype=np.uint64) * np.uint64(parts) + np.uint64(r.part + FIRST_ID)
                    yield pd.DataFrame({"id": ids[n > least].view(np.int64)})

        found = model.table(self.spark, level - 1).select("part", "n", "id").mapInPandas(frequent, "id bigint").collect()
        return np.unique(np.array([START_ID, *(r.id for r in found)], dtype=np.uint64))

    def level(self, level: int) -> None:
        model, fitting, parts, last = self.model, self.fitting, self.model.parts, level == self.model.order
        if fitting:
            heavy = self.heavy(level)
            model.hot[level] = Hot.none_yet(heavy)
        hot = model.hot[level].ctx

        def own(group: pd.DataFrame, table: pd.DataFrame | None) -> pd.DataFrame:
            part = int(group["part"].iloc[0])
            held = Level.of_sent(part, parts, group) if table is None else Level.of_table(part, parts, table)
            out = [held.reply(r, last) for r in group.itertuples() if not r.local]
            if table is None:
                out.append(held.row())
                out.append({"kind": 2, "block": -1, "n": packed(counts_of_counts(held.n).astype(np.int64))})
                big = np.nonzero(np.isin(held.ctx, hot))[0]  # their sums are those of this part only
                out.append({"kind": 3, "block": -1, "ctx": packed(held.ctx[big]), **packed_sums(held.small[big], held.low[big], held.big[big])})
            return owned(out, part)

        sent = self.with_replies(level - 1).mapInPandas(lambda batches: sent_grams(batches, model, fitting, level), GRAMS_SENT)
        made = self.owners(sent, level, own, last)
        if fitting:
            model.d[level] = discounts(sum((unpacked(r.n, "<i8") for r in made.where("kind = 2").select("n").collect()), np.zeros(K + 1, np.int64)))
            for r in made.where("kind = 3").select("ctx", "small", "low", "big").collect():
                at = np.searchsorted(hot, unpacked(r.ctx, "<u8"))
                model.hot[level].small[at] += unpacked(r.small, "<u8").reshape(-1, K)
                model.hot[level].low[at] += unpacked(r.low, "<u8").reshape(-1, K)
                model.hot[level].big[at] += unpacked(r.big, "<u8")

    def levels(self) -> None:
        self.words()
        for level in range(2, self.model.order + 1):
            self.level(level)

    def scores(self) -> DataFrame:
        model, fitting = self.model, self.fitting

        def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            uni = model.uni
            base_of = np.log10(uni.total + 0.5 * (uni.kinds + 1))
            for b in batches:
                for row in b.itertuples():
                    k = filled(row, model, fitting, model.order)
                    tokens, docs = k.word_count[k.tokens], len(k.lens)
                    doc = np.repeat(np.arange(docs), k.lens)
                    yield pd.DataFrame({
                        "doc_id": row.ids, "held_out": row.held, "n_tokens": k.lens, "n_known": np.bincount(doc, tokens > 0, docs).astype(np.int64), "train_tokens": uni.total,
                        "base_score": np.bincount(doc, np.log10(tokens + 0.5) - base_of, docs), "score": np.bincount(doc, np.log10(k.p), docs),
                    })

        rows = self.with_replies(model.order).mapInPandas(final, f"doc_id {self.kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
        return stored(rows, "katz-scores")


def filled(row, model: Model, fitting: bool, levels: int) -> Block:
    block = Block(row, model, fitting)
    block.take_words()
    for level in range(2, levels + 1):
        block.grams(level)
        block.take(level, getattr(row, f"r{level}"), level == model.order)
    return block


#: A batch may hold several blocks; and each exchange is let go once the next is stored.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": "32m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def fitted(docs: DataFrame, held: F.Column, order: int, path: str | None, scoring: bool) -> tuple[Model, DataFrame | None]:
    spark = docs.sparkSession
    if order < 1:
        raise ValueError("a model has an order of one at least")
    model = Model(path or f"{shared_dir(spark)}/graphloom/katz-model-{uuid.uuid4().hex}", order, 1)
    with session_settings(spark, SETTINGS), Run(docs, held, model, True) as run:
        run.levels()
        model.save(spark)
        return model, run.scores() if scoring else None


def fit(docs: DataFrame, held: F.Column | None = None, order: int = ORDER, path: str | None = None) -> Model:
    """Learn from the rows of ``docs`` that do not meet ``held``; the tables go below ``path`` (else the shared folder), for ``load``."""
    return fitted(docs, F.lit(False) if held is None else held, order, path, False)[0]


def score(model: Model, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out (true), n_tokens, n_known, train_tokens, base_score, score) of texts by a stored model."""
    spark = docs.sparkSession
    with session_settings(spark, SETTINGS), Run(docs, F.lit(True), model, False) as run:
        run.levels()
        return run.scores()


def fit_and_score(docs: DataFrame, held: F.Column, order: int = ORDER, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``held`` is a condition on ``docs``: its rows take no part in training.
    """
    return fitted(docs, held, order, path, True)[1]
