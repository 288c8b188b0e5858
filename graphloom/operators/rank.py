"""Personalised PageRank."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.storage import bucketed, dropped, stored

DAMPING, ROUNDS = 0.85, 20
STORE_EVERY = 2
#: Nodes of a bucket, on average; their ranks and the edges at them are what a task holds.
BUCKET_NODES = 1 << 19
#: Edges that a task deals at once.
DEAL_EDGES = 1 << 20
#: A number within blocks is that of the bucket, shifted, and a place in it.
SHIFT = 33

_DEALT, _DEALT_COLUMNS = "b int, part string, s binary, t binary, tag binary", ["b", "part", "s", "t", "tag"]
_PARTS, _COLUMNS = "b int, other int, part string, i binary, j binary, x binary", ["b", "other", "part", "i", "j", "x"]
_SENT, _SENT_COLUMNS = "b int, other int, sums boolean, x binary", ["b", "other", "sums", "x"]


def _place(n: np.ndarray) -> np.ndarray:
    return (n & ((1 << SHIFT) - 1)).astype(np.int32)


def _blocks(edges: pd.DataFrame) -> pd.DataFrame:
    """The edges (s, t) into one bucket, once each: per bucket that they come from a block of them, and what that bucket has to send.

    Parallel edges weigh the root of their number. The strength is that of the given edges: of a node all of whose edges are given, the weights out of it too.
    """
    s, t = edges["s"].to_numpy(), edges["t"].to_numpy()
    order = np.lexsort((t, s))
    s, t = s[order], t[order]
    at = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (t[1:] != t[:-1])])
    w, s, t = np.sqrt(np.diff(np.r_[at, len(s)])), s[at], t[at]
    b, to, fresh = int(t[0] >> SHIFT), _place(t), np.r_[True, s[1:] != s[:-1]]
    rows = [(b, b, "strength", b"", b"", np.bincount(to, w).tobytes())]
    cuts = np.r_[np.flatnonzero(np.r_[True, (s[1:] >> SHIFT) != (s[:-1] >> SHIFT)]), len(s)]
    for a, z in zip(cuts[:-1], cuts[1:]):
        which = (np.cumsum(fresh[a:z]) - 1).astype(np.int32)
        rows.append((b, int(s[a] >> SHIFT), "edges", which.tobytes(), to[a:z].tobytes(), b"" if (w[a:z] == 1).all() else w[a:z].tobytes()))  # weights are mostly one
        rows.append((int(s[a] >> SHIFT), b, "route", _place(s[a:z][fresh[a:z]]).tobytes(), b"", b""))
    return pd.DataFrame(rows, columns=_COLUMNS)


def _packed(a: np.ndarray) -> bytes:
    """Compressed by byte planes, so that the high bytes of small numbers vanish."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else np.zeros((0, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def _rising(a: np.ndarray) -> bytes:
    return _packed(np.diff(a, prepend=a.dtype.type(0)))


def _unrisen(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(_unpacked(data, kind), dtype=kind)


def _bucket(n: np.ndarray, buckets: int, near: int) -> np.ndarray:
    """The bucket of each number; those that differ only in the bits of ``near`` lie in one."""
    h = (n & ~np.int64(near)).view(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _cut(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(1, np.int64)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    at = _cut(keys)
    for a, z in zip(at[:-1], at[1:]):
        yield int(keys[a]), slice(a, z)


def _gathered(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of many batches at once."""
    held, n = [], 0
    for d in batches:
        held.append([d[c].to_numpy() for c in columns])
        n += len(d)
        if n >= DEAL_EDGES:
            yield [np.concatenate(c) for c in zip(*held)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


def _deal_nodes(buckets: int, near: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches):
        for (n,) in _gathered(batches, ["id"]):
            n = np.unique(n)
            b = _bucket(n, buckets, near)
            order = np.argsort(b, kind="stable")
            n, b = n[order], b[order]
            yield pd.DataFrame([(k, "node", b"", _rising(n[at]), b"") for k, at in _runs(b)], columns=_DEALT_COLUMNS)

    return run


def _deal_seeds(buckets: int, near: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches):
        for n, p in _gathered(batches, ["id", "p"]):
            b = _bucket(n, buckets, near)
            order = np.lexsort((n, b))
            n, p, b = n[order], p[order], b[order]
            yield pd.DataFrame([(k, "seed", p[at].tobytes(), _rising(n[at]), b"") for k, at in _runs(b)], columns=_DEALT_COLUMNS)

    return run


def _deal_edges(buckets: int, near: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Each edge (s, t, tag) goes to the bucket of t, and turned round, with another tag, to that of s."""

    def run(batches):
        for s, t, tag in _gathered(batches, ["s", "t", "tag"]):
            s, t, tag = np.r_[s, t], np.r_[t, s], np.r_[tag << 1, tag << 1 | 1]
            b = _bucket(t, buckets, near)
            order = np.lexsort((t, b))
            s, t, tag, b = s[order], t[order], tag[order], b[order]
            yield pd.DataFrame([(k, "edge", _packed(s[at]), _rising(t[at]), _packed(tag[at])) for k, at in _runs(b)], columns=_DEALT_COLUMNS)

    return run


def _laid(rows: pd.DataFrame, buckets: int, near: int, once: bool) -> pd.DataFrame:
    """A bucket's parts: its nodes and their strengths, its seeds, and for each other bucket the edges between the two.

    Parallel edges weigh the root of their number; with ``once`` rows of one tag are one edge. Of the two ends of an edge the hub is the one with
    more edges between the two buckets, ties to the smaller number; both buckets find the same. The edge is kept by the other end's bucket ("edges":
    which hub, in their order, and the place of the end), and the hub's keeps the places of its hubs ("route").
    """
    b = int(rows["b"].iat[0])
    of = {k: rows[rows["part"] == k] for k in ("node", "edge", "seed")}
    none = np.zeros(0, np.int64)
    own = np.unique(np.concatenate([none, *(_unrisen(x, np.int64) for x in of["node"]["t"])]))
    s = np.concatenate([none, *(_unpacked(x, np.int64) for x in of["edge"]["s"])])
    t = np.concatenate([none, *(_unrisen(x, np.int64) for x in of["edge"]["t"])])
    tag = np.concatenate([none, *(_unpacked(x, np.int64) for x in of["edge"]["tag"])])
    order = np.lexsort((tag, s, t) if once else (s, t))
    s, t, tag = s[order], t[order], tag[order]
    pair = np.r_[True, (s[1:] != s[:-1]) | (t[1:] != t[:-1])] if len(s) else np.zeros(0, bool)
    if once and len(s):
        fresh = pair | np.r_[True, tag[1:] != tag[:-1]]
        s, t, pair = s[fresh], t[fresh], pair[fresh]
    del tag, order
    at = np.flatnonzero(pair)
    many, s, t = np.diff(np.r_[at, len(s)]), s[at], t[at]
    places = np.union1d(own, t)  # an end that is no node takes part as well, but is not given
    to = np.searchsorted(places, t).astype(np.int32)
    strength = np.bincount(to, np.sqrt(many), len(places))
    known = np.isin(places, own, assume_unique=True)
    out = [(b, b, "nodes", _rising(places), np.packbits(known).tobytes() if not known.all() else b"", _packed(strength))]
    seeds = np.concatenate([none, *(_unrisen(x, np.int64) for x in of["seed"]["t"])])
    if len(seeds):
        mass = np.concatenate([np.frombuffer(x) for x in of["seed"]["s"]])
        place = np.minimum(np.searchsorted(places, seeds), max(0, len(places) - 1))
        hit = places[place] == seeds if len(places) else np.zeros(len(seeds), bool)
        place, mass = place[hit], mass[hit]
        out.append((b, b, "seed", b"", place.astype(np.int32).tobytes(), mass.tobytes()))
        out.append((b, b, "lone", b"", b"", np.float64(mass[strength[place] == 0].sum()).tobytes()))
    other = _bucket(s, buckets, near)
    order = np.lexsort((to, s, other))
    other, s, t, to, many = other[order], s[order], t[order], to[order], many[order]
    one = np.r_[True, (s[1:] != s[:-1]) | (other[1:] != other[:-1])] if len(s) else np.zeros(0, bool)
    which = np.cumsum(one) - 1  # the other end, of those in its bucket
    _, back, mine = np.unique(other * np.int64(max(1, len(places))) + to, return_inverse=True, return_counts=True)
    degree, mine = np.bincount(which)[which], mine[back]
    theirs = (degree > mine) | ((degree == mine) & (s < t))  # the hub is the other end
    if theirs.any():
        o, hub = other[theirs], np.unique(which[theirs], return_inverse=True)[1]
        first = _cut(o)[:-1]
        k = hub - np.repeat(hub[first], np.diff(np.r_[first, len(o)]))
        kept = pd.DataFrame({"s": (o.astype(np.int64) << SHIFT) + k, "t": (np.int64(b) << SHIFT) + to[theirs]})
        laid = _blocks(kept.loc[kept.index.repeat(many[theirs])] if (many > 1).any() else kept)
        for r in laid[laid["part"] == "edges"].itertuples():
            out.append((b, r.other, "edges", _rising(np.frombuffer(r.i, np.int32)), _packed(np.frombuffer(r.j, np.int32)), _packed(np.frombuffer(r.x)) if r.x else b""))
    for o, part in _runs(other[~theirs]):
        out.append((b, o, "route", _rising(np.unique(to[~theirs][part])), b"", b""))
    return pd.DataFrame(out, columns=_COLUMNS)


def _block(i: bytes, j: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """Of the edges from another bucket's hubs: which of them, the place of the other end, and the weight."""
    return _unrisen(i, np.int32), _unpacked(j, np.int32), _unpacked(x, np.float64) if x else 1.0


def _round(parts: pd.DataFrame, sent: pd.DataFrame, base: float, damping: float) -> tuple[np.ndarray, dict, np.ndarray]:
    """A bucket's ranks from what others sent; with its parts, and its strengths. ``base`` scales the seeds' masses."""
    of = {(p, o): (i, j, x) for o, p, i, j, x in zip(parts["other"], parts["part"], parts["i"], parts["j"], parts["x"])}
    b = int(parts["b"].iat[0])
    strength = _unpacked(of["nodes", b][2], np.float64)
    r = np.zeros(len(strength))
    for o, sums, x in zip(sent["other"], sent["sums"], sent["x"]):
        x = np.frombuffer(x)
        if sums:
            r[_unrisen(of["route", o][0], np.int32)] += x
        else:
            which, to, w = _block(*of["edges", o])
            np.add.at(r, to, x[which] * w)
    r *= damping
    if ("seed", b) in of:
        _, at, mass = of["seed", b]
        np.add.at(r, np.frombuffer(at, np.int32), base * np.frombuffer(mass))
    return r, of, strength


def _step(base: float, damping: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What a bucket sends on, by strength: the ranks of its hubs, and to the hubs of others the sums over their edges to it."""

    def run(parts: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        b = int(parts["b"].iat[0])
        r, of, strength = _round(parts, sent, base, damping)
        each = np.divide(r, strength, out=np.zeros(len(r)), where=strength > 0)
        out = []
        if each.any():  # without mass nothing travels
            for (part, o), (i, j, x) in of.items():
                if part == "route":
                    out.append((o, b, False, each[_unrisen(i, np.int32)]))
                elif part == "edges":
                    which, to, w = _block(i, j, x)
                    out.append((o, b, True, np.bincount(which, each[to] * w)))
        return pd.DataFrame([(o, b, sums, x.tobytes()) for o, b, sums, x in out if x.any()], columns=_SENT_COLUMNS)

    return run


def _last(base: float, damping: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A bucket's nodes and their scores."""

    def run(parts: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        r, of, _ = _round(parts, sent, base, damping)
        ids, known, _ = of["nodes", int(parts["b"].iat[0])]
        out = pd.DataFrame({"id": _unrisen(ids, np.int64), "score": r})
        return out[np.unpackbits(np.frombuffer(known, np.uint8), count=len(out)).astype(bool)] if known else out

    return run


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, near: int = 0) -> DataFrame:
    """(id, score) of every distinct node: exactly ``rounds`` rounds from the seeds' masses (id, mass), which are scaled to one.

    Edges are followed both ways; parallel edges are one of the root of their number, self-loops go. An end that is no node is walked over, but not
    given. Mass on nodes without edges returns to the seeds. Without mass all scores are zero.

    Ids that are no bigint are numbered first. Bigint ids are walked as they are; rows of edges with a column ``tag`` (not below zero) are one edge where both ends
    and the tag agree, so that they need not be made distinct before, and ids that differ only in the bits of ``near`` lie together.

    Nodes and edges are dealt once to buckets, the edges as compressed blocks to those of both ends, where they are made distinct and kept by one of them. A
    round moves, for two buckets, two numbers an end with several edges between them (a hub): its rank to the bucket of the edges, and their sum to it. So a
    round's bytes grow with the hubs of pairs of buckets, and no row an edge is moved. A task holds one bucket with all edges at it, also those of a node of large degree.
    """
    total = seeds.agg(F.sum("mass")).first()[0] or 0.0
    every = nodes.select("id")
    if total <= 0:
        return every.distinct().withColumn("score", F.lit(0.0))
    p = seeds.groupBy("id").agg((F.sum("mass") / total).alias("p")).where("p > 0 AND id IS NOT NULL")
    ends = edges.where("source_id <> target_id")
    if nodes.schema["id"].dataType.simpleString() == "bigint":
        once = "tag" in edges.columns
        tagged = ends.select(F.col("source_id").alias("s"), F.col("target_id").alias("t"), F.col("tag") if once else F.lit(0).cast("bigint").alias("tag"))
        unnamed = every.where("id IS NULL").limit(1).select("id", F.lit(0.0).alias("score"))
        return _walk(every.where("id IS NOT NULL"), tagged, p, rounds, damping, near, once).unionAll(unnamed)
    met = every.unionAll(ends.select("source_id")).unionAll(ends.select("target_id")).distinct()
    numbers = stored(met.withColumn("n", F.monotonically_increasing_id()), "node-numbers")
    first = ends.join(numbers.select(F.col("id").alias("source_id"), F.col("n").alias("s")), "source_id").select("s", "target_id")
    inner = first.join(numbers.select(F.col("id").alias("target_id"), F.col("n").alias("t")), "target_id").select("s", "t", F.lit(0).cast("bigint").alias("tag"))
    own = numbers.join(every.select(F.col("id").alias("_id")), F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    scores = _walk(own.select(F.col("n").alias("id")), inner, p.join(numbers, "id").select(F.col("n").alias("id"), "p"), rounds, damping, near, False)
    return own.join(scores.withColumnRenamed("id", "n"), "n").select("id", "score")


def _walk(nodes: DataFrame, edges: DataFrame, p: DataFrame, rounds: int, damping: float, near: int, once: bool) -> DataFrame:
    spark = nodes.sparkSession
    buckets = max(3 * spark.sparkContext.defaultParallelism, -(-nodes.count() // BUCKET_NODES))
    rows = nodes.mapInPandas(_deal_nodes(buckets, near), _DEALT).unionAll(edges.mapInPandas(_deal_edges(buckets, near), _DEALT)).unionAll(p.mapInPandas(_deal_seeds(buckets, near), _DEALT))
    with bucketed(rows, "blocks", "b", lambda g: g.applyInPandas(lambda d: _laid(d, buckets, near, once), _PARTS)) as parts:
        lone = sum(np.frombuffer(r.x)[0] for r in parts.where("part = 'lone'").select("x").collect())  # a number a bucket: only seeds can hold mass without an edge
        base, sent, last = 1.0, spark.createDataFrame([], _SENT), None
        for k in range(rounds):
            sent = parts.groupBy("b").cogroup(sent.groupBy("b")).applyInPandas(_step(base, damping), _SENT)
            base = (1 - damping) + damping * lone * base
            if k % STORE_EVERY == STORE_EVERY - 1:
                sent = stored(sent, "rank")
                if last is not None:
                    dropped(last)
                last = sent
        scores = stored(parts.groupBy("b").cogroup(sent.groupBy("b")).applyInPandas(_last(base, damping), "id bigint, score double"), "scores")
        if last is not None:
            dropped(last)
    return scores
