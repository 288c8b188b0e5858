"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits the vectors at the median of their projection on the line
between two random ones. A query goes through all trees with one shared priority
queue, always on to the node that lies nearest by the margins on its way, until
the leaves reached hold a budget of vectors; these candidates are then ranked by their
exact inner product in double precision.

The budget is measured on the table itself: the exact neighbours of TRIED of the queries
are found by brute force (one pass, linear in the table), and the budget is the
least that reaches a share of RECALL of them, and SEARCH at least. So it grows with
the table as far as the recall needs it.

The forest is fitted on a bounded sample: the SAMPLE distinct vectors with the
smallest hash. Every vector is indexed: it is routed to one leaf of each tree. The
forest and the leaf sizes are what is broadcast (TREES * SAMPLE / LEAF nodes at
most), and SEEDS vectors of the sample, which are candidates of every query: the k-th best of
them is a bar below which no leaf need report a candidate. Neighbouring leaves share a bucket of up
to BUCKET vectors, so that a query travels once a bucket; leaves beyond that are split. A crowded bucket, with
over QUERIES queries, is searched in turns, and only such a bucket is sent more than once. Equal vectors are one class; a class carries the
smallest of its ids, as many as a result can use, so that a vector with very many copies is
searched once. Classes are numbered in the order of their smallest ids, and the number is their name: an id
with several vectors is in several classes.

Defined cases: vectors that are null, zero, or
hold null or non-finite components take no part, nor do rows with a null id; vectors have
neighbours among those of their own dimension, each dimension with a forest of its own; a vec_id with
several vectors is a query with each; ties go to the smaller id; repeated rows count once; with
fewer candidates than asked for, all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import stored

TREES, LEAF, SAMPLE, SEARCH, SEEDS = 5, 128, 20_000, 6_000, 4_000
BUCKET, QUERIES = 16_000, 20_000
#: The share of the exact neighbours to be found, and the queries on which the budget for it is measured.
RECALL, TRIED = 0.95, 200


class Forest:
    """Nodes of all trees in flat arrays; a child below zero is leaf number -child - 1."""

    def __init__(self, sample: np.ndarray, population: int, trees: int = TREES, leaf: int = LEAF, seed: int = 7):
        self.planes: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.children: list[list[int]] = []
        self.roots: list[int] = []
        self.leaves = 0
        random = np.random.default_rng(seed)
        least = max(4, int(leaf * len(sample) / max(1, population)))
        for _ in range(trees):
            self.roots.append(self._grow(sample, np.arange(len(sample)), least, random))
        self.plane = np.array(self.planes, dtype=np.float32).reshape(-1, sample.shape[1])
        self.cut = np.array(self.cuts, dtype=np.float32)
        self.child = np.array(self.children, dtype=np.int64).reshape(-1, 2)

    def _grow(self, x: np.ndarray, rows: np.ndarray, least: int, random) -> int:
        if len(rows) > least:
            for _ in range(5):
                a, b = random.choice(rows, 2, replace=False)
                plane = x[a].astype(np.float64) - x[b]
                norm = np.linalg.norm(plane)
                if norm > 0:
                    plane /= norm
                    along = x[rows] @ plane
                    cut = float(np.median(along))
                    right = along > cut
                    if 0 < right.sum() < len(rows):
                        node = len(self.planes)
                        self.planes.append(plane)
                        self.cuts.append(cut)
                        self.children.append([0, 0])
                        self.children[node] = [self._grow(x, rows[~right], least, random), self._grow(x, rows[right], least, random)]
                        return node
        self.leaves += 1
        return -self.leaves

    def route(self, x: np.ndarray) -> np.ndarray:
        """[row, tree]: the leaf of each vector."""
        out = np.empty((len(x), len(self.roots)), dtype=np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root, dtype=np.int64)
            while (inner := np.nonzero(at >= 0)[0]).size:
                node = at[inner]
                side = np.einsum("ij,ij->i", x[inner], self.plane[node]) > self.cut[node]
                at[inner] = self.child[node, side.astype(np.int64)]
            out[:, t] = -at - 1
        return out

    def search(self, q: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
        """The leaves to look into, nearest first, until they hold ``wanted`` vectors."""
        margin = (self.plane @ q - self.cut).tolist() if len(self.plane) else []
        queue = [(-np.inf, r) for r in self.roots]
        heapq.heapify(queue)
        found, held = [], 0
        while queue and held < wanted:
            far, node = heapq.heappop(queue)
            while node >= 0:
                m = margin[node]
                left, right = self.child[node]
                near, other = (right, left) if m > 0 else (left, right)
                heapq.heappush(queue, (max(far, abs(m)), int(other)))
                node = int(near)
            found.append(-node - 1)
            held += sizes[-node - 1]
        return found

    def needed(self, q: np.ndarray, sizes: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """The least budget with which a search for ``q`` reaches each vector; ``leaves`` has its leaves, as of ``route``."""
        order = np.array(self.search(q, sizes, int(sizes.sum()) + 1), dtype=np.int64)
        before = np.zeros(len(sizes), dtype=np.int64)
        before[order] = np.cumsum(sizes[order]) - sizes[order]
        return before[leaves].min(axis=1) + 1


def typed(vectors: DataFrame, embedding: str = "embedding") -> tuple[str, str]:
    """The SQL and the numpy type in which the vectors lose nothing."""
    single = vectors.schema[embedding].dataType.elementType.typeName() in ("float", "byte", "short")
    return ("array<float>", "<f4") if single else ("array<double>", "<f8")


def classes(vectors: DataFrame, keep: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(rep, ids, v): the distinct usable vectors with the ``keep`` smallest of their ids; rep is a number of the vector, in the order of the smallest ids.

    To be stored before use, since the numbers are those of the run."""
    v = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast(typed(vectors, embedding)[0]).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)).distinct()
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    grouped = usable.withColumn("_r", rank).where(F.col("_r") <= keep).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    by_id = [F.col("ids")[0], F.xxhash64("v"), F.col("v")]
    return grouped.repartitionByRange(*by_id).sortWithinPartitions(*by_id).select(F.monotonically_increasing_id().alias("rep"), "ids", "v")


def matrix(column: pd.Series, dims: int, kind: str) -> np.ndarray:
    return np.concatenate(column.to_numpy()).astype(kind).reshape(-1, dims) if len(column) else np.zeros((0, dims), kind)


def best_of(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest of each row, with all ties of the last."""
    most = min(k, score.shape[1])
    bar = np.partition(score, score.shape[1] - most, axis=1)[:, score.shape[1] - most]
    return np.nonzero(score >= bar[:, None])


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The inner product of each row with its like, summed in one order whatever the batch."""
    return np.einsum("ij,ij->i", x, y)


class Buckets:
    """Which bucket each leaf's vectors lie in: neighbouring leaves together up to ``size``, larger leaves split."""

    def __init__(self, sizes: np.ndarray, size: int):
        self.split = np.maximum(1, -(-sizes // size))
        self.first = np.zeros(len(sizes), dtype=np.int64)
        bucket, held = -1, size
        for leaf, n in enumerate(sizes.tolist()):
            if held + n > size:
                bucket, held = bucket + 1, 0
            self.first[leaf] = bucket
            held += n
            if self.split[leaf] > 1:
                bucket, held = bucket + int(self.split[leaf]) - 1, size
        self.count = bucket + 1

    def of(self, leaves: np.ndarray, reps: np.ndarray) -> np.ndarray:
        return self.first[leaves] + (reps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % self.split[leaves]

    def asked(self, leaves: np.ndarray) -> dict[int, np.ndarray]:
        """The leaves to look into by bucket."""
        every = np.repeat(self.first[leaves], self.split[leaves])
        every = every + np.arange(len(every)) - np.repeat(np.cumsum(self.split[leaves]) - self.split[leaves], self.split[leaves])
        again = np.repeat(leaves, self.split[leaves])
        order = np.argsort(every, kind="stable")
        found, cuts = np.unique(every[order], return_index=True)
        return dict(zip(found.tolist(), np.split(again[order], cuts[1:])))


def budget(kept: DataFrame, seekers: DataFrame, forest: Forest, sizes: np.ndarray, k: int, dims: int, kind: str) -> int:
    """The least search budget that reaches RECALL of the exact neighbours of TRIED of the ``seekers``."""
    tried = seekers.orderBy(F.xxhash64("v", F.lit(1)), "rep").limit(TRIED).toPandas()  # TRIED rows at most
    x, reps = matrix(tried["v"], dims, kind), tried["rep"].to_numpy()
    sent = kept.sparkSession.sparkContext.broadcast(x)

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y = matrix(b["v"], dims, kind)
            score = sent.value.astype(np.float64) @ y.astype(np.float64).T
            score[reps[:, None] == b["rep"].to_numpy()[None, :]] = -np.inf
            most = min(k, len(y))
            near = np.argpartition(score, len(y) - most, axis=1)[:, len(y) - most :].ravel()
            q = np.repeat(np.arange(len(score)), most)
            yield pd.DataFrame({"q": q, "rep": b["rep"].to_numpy()[near], "score": score[q, near], "v": [y[i].tobytes() for i in near]})

    found = kept.select("rep", "v").mapInPandas(exact, "q long, rep bigint, score double, v binary").where(F.col("score") > float("-inf"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    true = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select("q", "v").toPandas()  # TRIED * k rows at most
    if not len(true):
        return 0
    leaves = forest.route(np.frombuffer(b"".join(true["v"]), dtype=kind).reshape(-1, dims))
    of = true["q"].to_numpy()
    needs = np.sort(np.concatenate([forest.needed(x[q], sizes, leaves[of == q]) for q in np.unique(of)]))
    return int(needs[int(np.ceil(RECALL * len(needs))) - 1])


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, search: int | None = None, trees: int = TREES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, its ``k`` nearest others.

    ``search`` is the budget of vectors to look at; it is measured if none is given.
    """
    cast, kind = typed(vectors)
    kept = stored(classes(vectors, k + 1), "vectors")
    queries = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").cast("bigint").alias("query_id"), F.col("embedding").cast(cast).alias("v")).distinct()
    asked = stored(queries.join(kept.select("v", "rep"), "v").select("query_id", "rep"), "queries")
    sizes = sorted(r.d for r in kept.select(F.size("v").alias("d")).distinct().collect())
    # an id with several vectors is no neighbour of its own, so that more classes are ranked by as many
    wide = k - 1 + (asked.groupBy("query_id").count().agg(F.max("count")).first()[0] or 1)
    found = [scored_classes(kept.where(F.size("v") == d), asked, d, kind, wide, search, trees) for d in sizes]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    once = reduce(DataFrame.unionAll, found).groupBy("q", "rep").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    top = once.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= wide + 1).drop("_r")
    with_ids = top.join(kept.select("rep", "ids"), "rep").select("q", F.explode("ids").alias("vec_id"), "score")
    listed = with_ids.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, wide + 1).alias("_l"))  # (wide + 1) * (k + 1) at most
    mine = asked.join(listed, asked["rep"] == listed["q"]).select("query_id", F.slice(F.filter("_l", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("_l"))
    return mine.select("query_id", F.posexplode("_l")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.s")).alias("score"))


def scored_classes(kept: DataFrame, asked: DataFrame, dims: int, kind: str, k: int, search: int | None, trees: int) -> DataFrame:
    """(q, rep, score): for the asked classes among ``kept``, which are of one dimension, their best candidates and themselves."""
    spark = kept.sparkSession
    population = kept.count()
    sample = kept.orderBy(F.xxhash64("v"), "rep").limit(SAMPLE).select("rep", "v").toPandas()  # SAMPLE rows at most
    vectors = matrix(sample["v"], dims, kind)
    forest = Forest(vectors.astype(np.float32), population, trees)
    leaves_in_all = forest.leaves
    sent = spark.sparkContext.broadcast((forest, vectors[:SEEDS].astype(np.float64), sample["rep"].to_numpy()[:SEEDS]))

    def leaf_sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(leaves_in_all, dtype=np.int64)
        for b in batches:
            n += np.bincount(sent.value[0].route(matrix(b["v"], dims, "<f4")).ravel(), minlength=len(n))
        yield pd.DataFrame({"leaf": np.nonzero(n)[0], "n": n[n > 0]})

    sizes = np.zeros(leaves_in_all, dtype=np.int64)
    for leaf, n in kept.select("v").mapInPandas(leaf_sizes, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n")).collect():  # a row a leaf
        sizes[leaf] = n
    seekers = kept.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "v")
    wanted = max(SEARCH, budget(kept, seekers, forest, sizes, k, dims, kind)) if search is None else search
    placed = spark.sparkContext.broadcast((sizes, Buckets(sizes, BUCKET)))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, reps = matrix(b["v"], dims, kind), b["rep"].to_numpy()
            leaves, raw = sent.value[0].route(x.astype(np.float32)), [r.tobytes() for r in x]
            for t in range(leaves.shape[1]):
                bucket = placed.value[1].of(leaves[:, t], reps)
                for turn in range(int(turns.value[bucket].max(initial=0))):
                    mine = np.flatnonzero(turns.value[bucket] > turn)
                    yield pd.DataFrame({"bucket": bucket[mine], "turn": turn, "leaf": leaves[mine, t], "rep": reps[mine], "v": [raw[i] for i in mine]})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, seeds, seed_reps = sent.value
        for b in batches:
            x, reps = matrix(b["v"], dims, kind), b["rep"].to_numpy()
            for at in range(0, len(x), 200):
                some, own = x[at : at + 200], reps[at : at + 200]
                score = some.astype(np.float64) @ seeds.T
                score[own[:, None] == seed_reps[None, :]] = -np.inf
                n = min(k, score.shape[1])
                bar = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n] if n == k else np.full(len(some), -np.inf)
                rows = [(bucket, q, leaves) for q, v in enumerate(some) for bucket, leaves in placed.value[1].asked(np.array(trees.search(v.astype(np.float32), placed.value[0], wanted), dtype=np.int64)).items()]
                of = np.array([q for _, q, _ in rows], dtype=np.int64)
                yield pd.DataFrame({"bucket": [r[0] for r in rows], "rep": own[of], "v": [some[q].tobytes() for q in of], "bar": bar[of], "leaves": [r[2].astype(np.int32).tobytes() for r in rows]})

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x, y, reps, own = np.zeros((0, dims)), np.zeros((0, dims)), np.zeros(0, np.int64), left["rep"].to_numpy()
        q, at_y, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(left) and len(right):
            right = right.sort_values("leaf")
            y = np.frombuffer(b"".join(right["v"]), dtype=kind).reshape(-1, dims).astype(np.float64)
            reps, leaf = right["rep"].to_numpy(), right["leaf"].to_numpy()
            x = np.frombuffer(b"".join(left["v"]), dtype=kind).reshape(-1, dims).astype(np.float64)
            bar = left["bar"].to_numpy()
            looks = [np.frombuffer(c, dtype=np.int32) for c in left["leaves"]]
            row, into = np.repeat(np.arange(len(left)), [len(c) for c in looks]), np.concatenate(looks)
            order = np.argsort(into, kind="stable")
            row, into = row[order], into[order]
            found, cuts = np.unique(into, return_index=True)
            starts, ends = np.searchsorted(leaf, found), np.searchsorted(leaf, found, side="right")
            for a, z, who in zip(starts, ends, np.split(row, cuts[1:])):
                for at in range(0, len(who) if z > a else 0, 2_000):
                    some = who[at : at + 2_000]
                    score = x[some] @ y[a:z].T
                    i, j = best_of(score, k + 1)
                    above = score[i, j] >= bar[some[i]] - 1e-9
                    i, j = i[above], j[above]
                    q.append(some[i])
                    at_y.append(a + j)
                    scores.append(score[i, j])
        q, at_y, scores = np.concatenate(q), np.concatenate(at_y), np.concatenate(scores)
        # of each query the k + 1 best classes of this bucket
        order = np.lexsort((reps[at_y], -scores, q))
        q, at_y = q[order], at_y[order]
        once = np.ones(len(q), dtype=bool)
        once[1:] = (q[1:] != q[:-1]) | (reps[at_y[1:]] != reps[at_y[:-1]])  # another tree's leaf may hold it as well
        q, at_y = q[once], at_y[once]
        most = np.arange(len(q)) - np.searchsorted(q, q) <= k
        q, at_y = q[most], at_y[most]
        return pd.DataFrame({"q": own[q], "rep": reps[at_y], "score": products(x[q], y[at_y])})

    def seeded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, seeds, seed_reps = sent.value
        for b in batches:
            x, reps = matrix(b["v"], dims, "<f8"), b["rep"].to_numpy()
            for at in range(0, len(x), 500):
                score = x[at : at + 500] @ seeds.T
                i, j = best_of(score, k + 1)
                yield pd.DataFrame({"q": reps[at : at + 500][i], "rep": seed_reps[j], "score": products(x[at : at + 500][i], seeds[j])})

    turns_of = np.zeros(placed.value[1].count, dtype=np.int64)
    asks = stored(seekers.mapInPandas(probe, "bucket bigint, rep bigint, v binary, bar double, leaves binary"), "probes")
    for bucket, n in asks.groupBy("bucket").count().collect():  # a row a bucket
        turns_of[bucket] = -(-n // QUERIES)
    turns = spark.sparkContext.broadcast(turns_of)  # a bucket that no query visits is not sent
    crowded = spark.createDataFrame([(b, int(n)) for b, n in enumerate(turns_of.tolist()) if n > 1], "bucket bigint, turns bigint")  # fewer than probes / QUERIES
    turn = F.pmod(F.xxhash64("rep"), F.coalesce("turns", F.lit(1)))
    probes = asks.join(F.broadcast(crowded), "bucket", "left").select("bucket", turn.alias("turn"), "rep", "v", "bar", "leaves")
    indexed = kept.select("rep", "v").mapInPandas(index, "bucket bigint, turn bigint, leaf bigint, rep bigint, v binary")
    ranked = probes.groupBy("bucket", "turn").cogroup(indexed.groupBy("bucket", "turn")).applyInPandas(rerank, "q bigint, rep bigint, score double")
    seeds = seekers.mapInPandas(seeded, "q bigint, rep bigint, score double")
    own = seekers.select(F.col("rep").alias("q"), "rep", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("score"))
    return ranked.unionAll(seeds).unionAll(own)
