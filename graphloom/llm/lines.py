"""Line deduplication on overlapping windows of three consecutive lines.

The non-blank lines of a document, trimmed, are taken three at a time; a window
that occurs more than once in all documents keeps its first occurrence (the
smallest document id, then the earliest place), and the lines that later
occurrences cover are removed. Covered places of overlapping windows merge, so
that a repeated passage goes as a whole and nothing is removed twice.

Only DataFrame functions are used. Windows are compared by 96 bits of hash. The
hashes are aggregated before they are shuffled; the join that finds the later
occurrences reads one row a repeated window on its other side, so that adaptive
execution can split a window that very many documents hold.

Defined cases: a null text stays null; a document of fewer than three non-blank
lines has no window and stays as it is; documents without a removed line keep
their text exactly; rows that repeat a doc_id and a text are one document; a null
id comes first. Blank lines stay where they are. Only spaces are trimmed, so that a line with a
carriage return differs from one without. Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(_id, _t, _n, _w, _c): a row a window; ``_n`` is its number, ``_w`` and ``_c`` its hashes."""
    hashed = F.transform("_lines", lambda x: F.xxhash64(x))
    checked = F.transform("_lines", lambda x: F.hash(x))
    steps = F.when(F.size("_h") >= size, F.sequence(F.lit(0), F.size("_h") - size))

    def over(column: str, n, how) -> F.Column:
        return how(*(F.get(column, n + k) for k in range(size)))

    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"), F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.trim(x)).alias("_lines"))
    each = rows.select("_id", "_t", hashed.alias("_h"), checked.alias("_k"))
    return each.select("_id", "_t", F.posexplode(F.transform(steps, lambda n: F.struct(over("_h", n, F.xxhash64).alias("w"), over("_k", n, F.hash).alias("c"))))).select("_id", "_t", F.col("pos").alias("_n"), F.col("col.w").alias("_w"), F.col("col.c").alias("_c"))


def repeated(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(_id, _t, _at): for each document the spans (first, last) of line numbers to remove.

    A window that overlaps its own first occurrence, as in a line said four times, leaves the lines of that first occurrence.
    """
    all_windows = windows(docs, size)
    place = F.struct("_id", "_t", "_n")
    firsts = all_windows.groupBy("_w", "_c").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where("_first <> _last").drop("_last")
    same = F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_t") == F.col("_first._t"))
    start = F.when(same, F.greatest("_n", F.col("_first._n") + size)).otherwise(F.col("_n"))
    later = all_windows.join(firsts, ["_w", "_c"]).where(place != F.col("_first"))
    return later.groupBy("_id", "_t").agg(F.collect_set(F.struct(start.alias("a"), (F.col("_n") + size - 1).alias("b"))).alias("_at"))  # one document's windows


def dedupe(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``."""
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"))  # no other column's name can clash
    gone = repeated(docs, size).select(F.col("_id").alias("_gone_id"), F.col("_t").alias("_gone_t"), "_at")
    keyed = whole.select("_row", F.col("_row.text").alias("text"))
    joined = keyed.join(gone, F.col("_row.doc_id").eqNullSafe(F.col("_gone_id")) & (F.xxhash64("text") == F.col("_gone_t")), "left")
    lines = F.split("text", "\n")
    filled = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    split = joined.withColumn("_split", F.when(F.col("_at").isNotNull(), lines)).withColumn("_filled", F.when(F.col("_at").isNotNull(), filled))
    # the places of the lines that removed windows cover, merged
    covered = F.array_distinct(F.flatten(F.transform("_at", lambda s: F.slice("_filled", s["a"] + 1, s["b"] - s["a"] + 1))))
    left = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), covered)
    kept = F.array_join(F.transform(left, lambda i: F.get("_split", i)), "\n")
    return split.withColumn("_row", F.when(F.col("_at").isNull(), F.col("_row")).otherwise(F.col("_row").withField("text", kept))).select("_row.*")
