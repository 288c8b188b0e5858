"""Vector codes: each part of a vector becomes the index of the nearest entry of that part's codebook.

Each component x becomes floor(1024 * x), a whole number; vectors are cut into PARTS consecutive parts. The codebooks start as
the parts of the ENTRIES smallest ids. A round assigns every part to the nearest entry (squared Euclidean distance, ties to the
lower index) and puts the componentwise floor of the mean in the entry's place; entries without parts stay.

The training rows are stored as columnar NumPy blocks, a component a row, and a round is one RDD ``treeAggregate`` over them:
within a block the distances to all entries grow dimension by dimension in one table of (rows, entries), ``np.add.at`` adds
components and counts to 64-bit tensors of the codebooks' size, and the tensors merge through a reduction tree. So what moves is one pair of
tensors a task, whatever the rows, and what reaches the driver is one pair a round. Codebooks are broadcast; they have PARTS * ENTRIES * (dimension / PARTS) numbers.

Defined cases: rows whose vector is null or holds null or non-finite components go; all other rows stay, also those with a null id,
which comes after all ids, and repeated rows, which all count in the means. An id with several vectors starts one entry, with the least of them. Fewer ids
than ENTRIES start fewer entries. A dimension that PARTS does not divide has parts that differ by one component, the longer first.
Vectors of different dimensions have codebooks of their own. An empty table gives no rows. Other columns are ignored. Distances that could pass 64 bits end the job with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import dropped, stored
from graphloom.llm.topk import matrix, usable, whole_numbers

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors a stored block, and vectors whose distances to all entries are held at once.
BLOCK, STEP = 8_192, 1_024

Books = list[np.ndarray]


def kept(vectors: DataFrame, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """(vec_id, label, v): the rows with a usable vector, in whole numbers."""
    return vectors.where(usable(F.col(embedding))).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), whole_numbers(F.col(embedding)).alias("v"))


def cuts(dims: int, parts: int) -> list[tuple[int, int]]:
    ends = np.cumsum([len(p) for p in np.array_split(np.arange(dims), parts)])
    return [(int(e - n), int(e)) for e, n in zip(ends, [len(p) for p in np.array_split(np.arange(dims), parts)])]


def nearest_entry(columns: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry; ``columns`` is (dimension, rows), ``book`` (entries, dimension)."""
    dims, n = columns.shape
    index, least = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not dims or not n:
        return index, least
    span = max(int(columns.max()), int(book.max())) - min(int(columns.min()), int(book.min()))
    if span * span * dims >= 2**63:
        raise OverflowError("a squared distance could pass 64 bits")
    kind = np.int32 if span * span * dims < 2**31 and max(abs(int(book.max())), abs(int(book.min())), abs(int(columns.max())), abs(int(columns.min()))) < 2**31 else np.int64
    columns, book = columns.astype(kind), book.astype(kind)
    for at in range(0, n, STEP):
        some = columns[:, at : at + STEP]
        far = np.zeros((some.shape[1], len(book)), dtype=kind)
        off = np.empty_like(far)
        for j in range(dims):
            np.subtract(some[j][:, None], book[:, j][None, :], out=off)
            np.multiply(off, off, out=off)
            far += off
        index[at : at + STEP] = far.argmin(axis=1)
        least[at : at + STEP] = far[np.arange(far.shape[0]), index[at : at + STEP]]
    return index, least


def blocks(rows: DataFrame, dims: int) -> DataFrame:
    """(n, data): the vectors of up to BLOCK rows as a (dims, n) matrix of 64-bit numbers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b, dims)
            for at in range(0, len(x), BLOCK):
                some = np.ascontiguousarray(x[at : at + BLOCK].T)
                yield pa.RecordBatch.from_arrays([pa.array([some.shape[1]], pa.int32()), pa.array([some.astype("<i8").tobytes()], pa.binary())], names=["n", "data"])

    return rows.select("v").mapInArrow(cut, "n int, data binary")


def first_books(rows: DataFrame, dims: int, parts: int, entries: int) -> Books:
    """The parts of the vectors of the ``entries`` smallest ids."""
    ids = rows.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()  # ``entries`` rows at most
    known = [r.vec_id for r in ids if r.vec_id is not None]
    wanted = F.col("vec_id") <= max(known) if known else F.lit(False)
    if len(known) < len(ids):
        wanted = wanted | F.col("vec_id").isNull()
    start = rows.where(wanted).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.asc_nulls_last("vec_id")).collect()  # as many
    x = np.array([r.v for r in start], dtype=np.int64).reshape(len(start), dims)
    return [x[:, a:z] for a, z in cuts(dims, parts)]


def train(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """The codebooks after ``rounds`` rounds over all ``rows`` (vec_id, v), which are of one dimension."""
    sc = rows.sparkSession.sparkContext
    books, where = first_books(rows, dims, parts, entries), cuts(dims, parts)
    table = stored(blocks(rows, dims), "part-blocks")
    data = table.rdd.map(lambda r: np.frombuffer(r.data, dtype="<i8").reshape(dims, r.n))
    depth = 2 if data.getNumPartitions() <= 1_024 else 3
    for _ in range(rounds):
        sent = sc.broadcast(books)

        def add(held, block: np.ndarray, sent=sent):
            """Sums and counts with those of one more block."""
            books = sent.value
            sums, counts = held or ([np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books])
            for (a, z), book, total, count in zip(where, books, sums, counts):
                index, _ = nearest_entry(block[a:z], book)
                np.add.at(count, index, 1)
                for j in range(z - a):
                    np.add.at(total[:, j], index, block[a + j])
            return sums, counts

        held = data.treeAggregate(None, add, merge, depth)
        if held:
            books = [np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], b) for b, total, n in zip(books, *held)]
        sent.destroy()
    dropped(table)
    return books


def merge(a, b):
    """Sums and counts of both."""
    if a is None or b is None:
        return b if a is None else a
    return [x + y for x, y in zip(a[0], b[0])], [x + y for x, y in zip(a[1], b[1])]


def encode(rows: DataFrame, books: Books, dims: int, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, code, error): two hex digits a part, and the squared distances to the entries, summed."""
    sent, where = rows.sparkSession.sparkContext.broadcast(books), cuts(dims, parts)
    digits = np.array([f"{n:02x}" for n in range(256)])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.ascontiguousarray(matrix(b, dims).T)
            text, error = np.full(b.num_rows, ""), np.zeros(b.num_rows, np.int64)
            for (a, z), book in zip(where, sent.value):
                index, least = nearest_entry(x[a:z], book)
                text, error = np.char.add(text, digits[index]), error + least
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(text.tolist(), pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.select("vec_id", "label", "v").mapInArrow(code, schema)


def digest(books: Books) -> str:
    """SHA-256 of all entries' components by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of every usable row, by codebooks trained on all of them."""
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits name up to 256 entries")
    rows = stored(kept(vectors), "vectors")
    sizes = sorted(r.d for r in rows.select(F.size("v").alias("d")).distinct().collect())  # a row a dimension
    coded = []
    for d in sizes:
        own = rows.where(F.size("v") == d)
        books = train(own, d, parts, entries, rounds)
        coded.append(encode(own, books, d, parts).withColumn("codebooks_sha256", F.lit(digest(books))))
    if not coded:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit("").alias("codebooks_sha256"))
    return reduce(DataFrame.unionAll, coded)


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` (stored once) with ``label_error``: the errors of all rows of the label; null labels are one label.

    The sums are made before the shuffle and joined back, so that a label with very many rows is no group of its own.
    """
    whole = stored(coded, "vector-codes")
    sums = whole.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return whole.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
