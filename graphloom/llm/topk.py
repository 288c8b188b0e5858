"""Exact top-k by inner product over whole-number vectors: norm-bucketed retrieval.

Each component x becomes floor(1024 * x). The vectors are dealt by length into a stored table, the longest first, so that a
batch of it is a bucket of nearly equal lengths. The queries go over the whole table in blocks of at most BLOCK_BYTES, which are
broadcast. A query carries a bar, a score that its k-th best reaches: first the k-th best of the SEEDS longest
vectors, then the k-th best of what the task has met. In a bucket whose longest vector has length m, the query q needs a cosine
of bar / (|q| * m), the local threshold:

* above 1, the bucket holds nothing for the query;
* from COORDINATE on, coordinates prune: a vector with that cosine to q has each coordinate in an interval around q's, so
  that sorted columns of q's FOCUS largest coordinates give the candidates;
* below, lengths prune: only vectors of length bar / |q| or more, a beginning of the bucket, are multiplied.

What is left is verified by its product in whole numbers: by floats while no sum can pass 2**53, else by 64-bit integers.
Bounds are computed with slack, so that rounding loses no candidate. A task returns at most k rows a query; no vector is shuffled to a query.
Work is in proportion to queries times what pruning leaves; for vectors of one length without near neighbours that is nearly all.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id; zero and empty vectors do.
Vectors have products with those of their own dimension. Rows that repeat id and vector count once; a query's
candidates are the rows of other ids; an id with several vectors asks with each and is found with each. Ties go to the
smaller id. Other columns are ignored. An empty table gives no rows. Scores beyond 64 bits end the query with an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import dropped, shared_dir, stored

SCALE = 1024
#: Queries are broadcast in blocks of so many bytes of vectors; vectors a file of the stored table; longest vectors that set the first bars.
BLOCK_BYTES, ROWS, LEAST_ROWS, SEEDS = 16 << 20, 65_536, 4_096, 4_096
#: The local threshold from which coordinates prune, and the coordinates that do.
COORDINATE, FOCUS = 0.9, 4
#: Queries multiplied at once.
STEP = 256
RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


def whole_numbers(embedding: Column) -> Column:
    """floor(1024 * x) of each component as a long."""
    return F.transform(embedding, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("bigint"))


def usable(embedding: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(batch.num_rows, dims)


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


def products(q: np.ndarray, y: np.ndarray, limit: float) -> np.ndarray:
    """The exact inner products of the rows; ``limit`` is the product of the greatest lengths, which no sum passes."""
    if limit < 2**53:
        return q.astype(np.float64) @ y.astype(np.float64).T
    if limit < 2**63 * (1 - 1e-9):
        return q @ y.T
    exact = q.astype(object) @ y.astype(object).T
    if exact.size and max(abs(exact.max()), abs(exact.min())) >= 2**63:
        raise OverflowError("an inner product passes 64 bits")
    return exact.astype(np.int64)


class Best:
    """The k best rows of each query so far: score descending, then id; ``bar`` is what a further row must reach."""

    def __init__(self, bar: np.ndarray, k: int):
        self.k, self.bar = k, bar.copy()
        self.q, self.vec, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, q: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        if not len(q):
            return
        q, vec, score = np.concatenate([self.q, q]), np.concatenate([self.vec, vec]), np.concatenate([self.score, score.astype(np.int64)])
        order = np.lexsort((vec, -score, q))
        q, vec, score = q[order], vec[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = q[place == self.k - 1]
        kth = score[place == self.k - 1].astype(np.float64)
        kth = np.where(np.abs(kth) < 2**53, kth, np.nextafter(kth, -np.inf))  # never above the whole number
        self.bar[last] = np.maximum(self.bar[last], kth)
        kept = place < self.k
        self.q, self.vec, self.score = q[kept], vec[kept], score[kept]


class Block:
    """Some queries: numbers, ids, vectors, lengths and bars."""

    def __init__(self, n: np.ndarray, ids: np.ndarray, x: np.ndarray, bar: np.ndarray):
        self.n, self.ids, self.x, self.bar = n, ids, x, bar
        self.length = lengths(x)

    def search(self, best: Best, ids: np.ndarray, y: np.ndarray) -> None:
        """Add what a bucket holds for the queries."""
        long = lengths(y)
        order = np.argsort(-long, kind="stable")
        ids, y, long = ids[order], y[order], long[order]
        limit = float(self.length.max() * long[0]) * (1 + 1e-9)
        reach = self.length * long[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reach > 0, best.bar / reach, np.where(best.bar > 0, np.inf, -np.inf))
        by_coordinate = (local >= COORDINATE) & (local <= 1 + 1e-9)
        self._by_coordinate(best, np.nonzero(by_coordinate)[0], local, ids, y, long, limit)
        self._by_length(best, np.nonzero(local < COORDINATE)[0], ids, y, long, limit)

    def _by_length(self, best: Best, who: np.ndarray, ids: np.ndarray, y: np.ndarray, long: np.ndarray, limit: float) -> None:
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(best.bar[who] > 0, best.bar[who] / self.length[who] * (1 - 1e-9), 0.0)
        upto = np.searchsorted(-long, -least, side="right")
        by_size = np.argsort(upto, kind="stable")
        for at in range(0, len(who), STEP):
            some, n = who[by_size[at : at + STEP]], int(upto[by_size[at : at + STEP]].max())
            score = products(self.x[some], y[:n], limit)
            i, j = np.nonzero((score >= best.bar[some][:, None]) & (self.ids[some][:, None] != ids[None, :n]))
            best.add(some[i], ids[j], score[i, j])

    def _by_coordinate(self, best: Best, who: np.ndarray, local: np.ndarray, ids: np.ndarray, y: np.ndarray, long: np.ndarray, limit: float) -> None:
        if not len(who):
            return
        unit = y / np.maximum(long, 1e-300)[:, None]
        own = self.x[who] / self.length[who][:, None]
        focus = np.argsort(-np.abs(own), axis=1, kind="stable")[:, :FOCUS]
        at, t = np.take_along_axis(own, focus, axis=1), np.minimum(local[who], 1.0)[:, None]
        half = np.sqrt(np.maximum(0, 1 - at**2) * np.maximum(0, 1 - t**2))
        low, high = np.where(at <= -t, -1.0, at * t - half) - 1e-6, np.where(at >= t, 1.0, at * t + half) + 1e-6
        first, last = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        sorted_rows = {}
        for f in np.unique(focus):
            sorted_rows[f] = np.argsort(unit[:, f], kind="stable")
            column, of = unit[sorted_rows[f], f], focus == f
            first[of], last[of] = np.searchsorted(column, low[of]), np.searchsorted(column, high[of], side="right")
        fewest = (last - first).argmin(axis=1)
        for n, q in enumerate(who):
            c = fewest[n]
            rows = sorted_rows[focus[n, c]][first[n, c] : last[n, c]]
            for d in range(focus.shape[1]):
                if d != c and len(rows):
                    value = unit[rows, focus[n, d]]
                    rows = rows[(value >= low[n, d]) & (value <= high[n, d])]
            rows = rows[ids[rows] != self.ids[q]]
            if len(rows):
                score = products(self.x[q : q + 1], y[rows], limit)[0]
                good = score >= best.bar[q]
                best.add(np.full(int(good.sum()), q), ids[rows[good]], score[good])


def with_bars(queries: DataFrame, kept: DataFrame, k: int, dims: int) -> DataFrame:
    """``queries`` (query_id, v) with ``bar``: the k-th best score among the SEEDS longest vectors, if there are as many."""
    longest = kept.orderBy(F.desc("norm2"), "id", "v").limit(SEEDS).select("id", "v").toPandas()  # SEEDS rows at most
    ids = longest["id"].to_numpy()
    seeds = np.array(longest["v"].tolist(), dtype=np.int64).reshape(len(longest), dims)
    sent = queries.sparkSession.sparkContext.broadcast((ids, seeds))

    def bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seeds = sent.value
        for b in batches:
            x, own = matrix(b, dims), b.column("query_id").to_numpy(zero_copy_only=False)
            block = Block(own, own, x, np.full(len(x), -np.inf))
            best = Best(block.bar, k)
            if len(x) and len(seeds):
                block._by_length(best, np.arange(len(x)), ids, seeds, lengths(seeds), float(block.length.max() * lengths(seeds).max()) * (1 + 1e-9))
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("v"), pa.array(best.bar)], names=["query_id", "v", "bar"])

    return queries.select("query_id", "v").mapInArrow(bars, "query_id bigint, v array<bigint>, bar double")


def top_products(vectors: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the ``k`` others of the largest inner product."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vec_id).isNotNull() & usable(F.col(embedding))).select(F.col(vec_id).cast("bigint").alias("id"), whole_numbers(F.col(embedding)).alias("v")).distinct()
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    whole = stored(rows.withColumn("norm2", squares), "vectors")
    path = f"{shared_dir(spark)}/graphloom/top-products-{uuid.uuid4().hex}"
    sizes = whole.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("asked")).collect()  # a row a dimension
    found = [r for r in sizes if r.asked]
    for r in found:
        _search(whole.where(F.size("v") == r.d), r.d, r.n, r.asked, every, k, path)
    dropped(whole)
    if not found:
        return spark.createDataFrame([], RESULT)
    near = spark.read.schema("n bigint, query_id bigint, vec_id bigint, score bigint, d int").parquet(path)
    order = Window.partitionBy("d", "n").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(whole: DataFrame, dims: int, count: int, asked: int, every: int, k: int, path: str) -> None:
    """Append (n, query_id, vec_id, score, d) to the table at ``path``: of each task and query the k best; n tells the queries apart."""
    spark = whole.sparkSession
    parts = max(-(-count // ROWS), min(spark.sparkContext.defaultParallelism, -(-count // LEAST_ROWS)))
    by_length = [F.desc("norm2"), F.xxhash64("id", "v")]
    kept = stored(whole.repartitionByRange(parts, *by_length).sortWithinPartitions(*by_length), "by-length")
    queries = stored(with_bars(kept.where(F.col("id") % every == 0).withColumnRenamed("id", "query_id"), kept, k, dims).withColumn("n", F.monotonically_increasing_id()), "queries")
    blocks = -(-asked * dims * 8 // BLOCK_BYTES) or 1
    for block in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == block).toPandas()  # about BLOCK_BYTES
        if not len(some):
            continue
        x = np.array(some["v"].tolist(), dtype=np.int64).reshape(len(some), dims)
        sent = spark.sparkContext.broadcast(Block(some["n"].to_numpy(), some["query_id"].to_numpy(), x, some["bar"].to_numpy(dtype=np.float64)))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries = sent.value
            best = Best(queries.bar, k)
            for b in batches:
                if b.num_rows:
                    queries.search(best, b.column("id").to_numpy(zero_copy_only=False), matrix(b, dims))
            yield pa.RecordBatch.from_arrays([pa.array(queries.n[best.q]), pa.array(queries.ids[best.q]), pa.array(best.vec), pa.array(best.score), pa.array(np.full(len(best.q), dims, np.int32))], names=["n", "query_id", "vec_id", "score", "d"])

        near = kept.select("id", "v").mapInArrow(search, "n bigint, query_id bigint, vec_id bigint, score bigint, d int")
        near.write.mode("append").parquet(path)
        sent.destroy()
    dropped(queries)
    dropped(kept)
