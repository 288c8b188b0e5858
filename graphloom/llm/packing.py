"""Best-fit packing of token sequences, planned on a histogram of lengths.

Pieces of one length are alike, so the plan works on how many there are of each
length: lengths go from long to short, each to the open sequence with the least
room that still holds it, and whole runs of alike sequences are filled at once.
Pieces then take the planned slots by joining on their rank within their length.

What reaches the driver is the histogram (at most ``capacity`` rows). The plan is
bounded too: a length splits off at most two groups of alike sequences, and each
filling of a group leaves it less than half its room, so that no group is filled
more than log2(capacity) times; this gives at most 3 * capacity * log2(capacity)
runs (147,456 for 4,096), which is what the broadcast of the plan rests on.

Defined cases: a null text is empty and packs as its end token; a document longer
than the capacity is cut into full pieces and a rest; repeated rows are packed
once each; an empty table gives no rows; a null id is kept.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.bpe import as_bytes, id_bytes, published, remembered
from graphloom.llm.common import stored

CAPACITY = 4096
#: Pieces of one length that are ranked in one task.
RANK_BLOCK = 1_000


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset, pieces a sequence).

    Piece number t of a run lies in sequence ``first + t // each`` at
    ``offset + (t % each) * length``.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted; each with groups of alike open sequences
    groups: dict[int, list[tuple[int, int]]] = {}
    fresh = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first = capacity, fresh
                n = -(-left // (capacity // length))
                fresh += n
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, capacity - room, each))
                put(room - each * length, first, full)
            rest = min(left - full * each, each) if full < n else 0
            if rest:
                runs.append((length, rank + full * each, rest, first + full, capacity - room, each))
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), n - full - bool(rest))
            left -= full * each + rest
            rank += full * each + rest
    return runs


def tokenised_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids with ``keep_ids``) of every document."""
    file = published(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = remembered(file.value, as_bytes)
        end, step = id_bytes([end_id]), 4 * capacity
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, text in zip(b["doc_id"], b["text"]):
                data = b"".join(words.of(text)) + end
                for n, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(n)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if keep_ids:
                        out["ids"].append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            yield pd.DataFrame({k: v for k, v in out.items() if keep_ids or k != "ids"})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(run, schema)


def copies_apart(ranked: DataFrame) -> DataFrame:
    """A row a copy, with ranks from ``_rank`` on: runs of ``RANK_BLOCK`` copies first, which are dealt anew before they become rows."""
    last = F.col("_copies") - 1
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(RANK_BLOCK).cast("bigint")))
    runs = ranked.withColumn("_at", start).repartition("length", "_rank", "_at")
    each = F.explode(F.sequence("_at", F.least(last, F.col("_at") + RANK_BLOCK - 1)))
    return runs.withColumn("_at", each).withColumn("_rank", F.col("_rank") + F.col("_at")).drop("_at")


def place(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a column ``length`` from 1 to ``capacity``) with sequence_id and offset.

    ``pieces`` should be a stored table: it is read once for the histogram, once
    for the sizes of the rank blocks and once for the slots.
    """
    spark = pieces.sparkSession
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    blocks = spark.createDataFrame([(n, -(-c // RANK_BLOCK)) for n, c in histogram.items()], "length bigint, _blocks int")
    once = pieces.groupBy(*pieces.columns).agg(F.count(F.lit(1)).alias("_copies"))  # rows repeated in full are one row with a number
    dealt = once.join(F.broadcast(blocks), "length").withColumn("_block", F.pmod(F.xxhash64(*order), "_blocks").cast("int")).drop("_blocks")
    sizes = dealt.groupBy("length", "_block").agg(F.sum("_copies").alias("count"))
    before = sizes.select("length", "_block", (F.sum("count").over(Window.partitionBy("length").orderBy("_block")) - F.col("count")).alias("_before"))
    in_block = F.sum("_copies").over(Window.partitionBy("length", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    first = dealt.withColumn("_in", F.coalesce(in_block, F.lit(0))).join(before, ["length", "_block"]).withColumn("_rank", F.col("_before") + F.col("_in"))
    ranked = copies_apart(first)
    slots = spark.createDataFrame(plan(histogram, capacity), "_length bigint, _first bigint, _n bigint, _seq bigint, _offset bigint, _each bigint")
    inside = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_n"))
    t = F.col("_rank") - F.col("_first")
    return (
        ranked.join(F.broadcast(slots), inside)
        .withColumn("sequence_id", F.col("_seq") + F.floor(t / F.col("_each")))
        .withColumn("offset", F.col("_offset") + (t % F.col("_each")) * F.col("length"))
        .drop("_block", "_before", "_in", "_copies", "_rank", "_length", "_first", "_n", "_seq", "_offset", "_each")
    )


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    pieces = stored(tokenised_pieces(docs, path, capacity, end_id, keep_ids), "pieces")
    out = place(pieces, ["doc_id", "piece", "ids_crc32"], capacity)
    return out.select(*pieces.columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, of pieces that kept their ids: sequence_id, ids, and where each piece starts."""
    row = F.struct("offset", "doc_id", "piece", "ids")
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(row)).alias("_p"))  # at most ``capacity`` pieces
    return parts.select("sequence_id", F.flatten(F.transform("_p", lambda p: p["ids"])).alias("ids"), F.transform("_p", lambda p: p["offset"]).alias("starts"), F.transform("_p", lambda p: p["doc_id"]).alias("doc_ids"))
