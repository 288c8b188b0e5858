"""Files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_COMMITS, MOST_FILES = 500, 50


def recent(commits: DataFrame, most: int = MOST_COMMITS) -> DataFrame:
    """The rows (commit, seq, file) of the ``most`` commits with the largest seq, then commit."""
    newest = commits.select("commit", "seq").distinct().orderBy(F.desc("seq"), F.desc("commit")).limit(most)
    return commits.join(newest.select("commit"), "commit", "left_semi")


def pairs(commits: DataFrame, most_files: int = MOST_FILES) -> DataFrame:
    """(file_a, file_b, count) with file_a < file_b; commits of one file or over ``most_files`` are left out before the pairing.

    A commit's rows are sorted by file once; repeats go, the size is counted and each file meets those after it on that order, so that no commit is
    joined with itself and a bulk commit is counted without being held as one array.
    """
    w = Window.partitionBy("commit").orderBy("file")
    own = commits.where("commit IS NOT NULL").select("commit", "file", ((F.row_number().over(w) == 1) | ~F.col("file").eqNullSafe(F.lag("file").over(w))).alias("_new")).where("_new")
    sized = own.select("commit", "file", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n")).where(F.col("_n").between(2, most_files))
    after = sized.select(F.col("file").alias("file_a"), F.collect_list("file").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    each = after.where("file_a IS NOT NULL").select("file_a", F.explode("_after").alias("file_b"))
    return each.groupBy("file_a", "file_b").agg(F.count("*").alias("count"))


def skipped_bulk_commits(commits: DataFrame, most_files: int = MOST_FILES) -> DataFrame:
    return commits.groupBy("commit").agg(F.countDistinct("file").alias("_n")).agg(F.count(F.when(F.col("_n") > most_files, 1)).alias("skipped"))


def upsert(known: DataFrame, more: DataFrame) -> DataFrame:
    """Add the counts of ``more``, whose files may come in either order, to those of ``known``."""
    ordered = more.select(F.least("file_a", "file_b").alias("file_a"), F.greatest("file_a", "file_b").alias("file_b"), "count").where("file_a < file_b")
    return known.unionByName(ordered).groupBy("file_a", "file_b").agg(F.sum("count").alias("count"))


def top_coupled(counts: DataFrame, file: str, limit: int = 10) -> DataFrame:
    near = counts.where((F.col("file_a") == file) | (F.col("file_b") == file))
    other = F.when(F.col("file_a") == file, F.col("file_b")).otherwise(F.col("file_a"))
    return near.select(other.alias("other_file"), "count").orderBy(F.desc("count"), "other_file").limit(limit)


def top_coupled_each(counts: DataFrame, limit: int) -> DataFrame:
    """For every file its ``limit`` partners."""
    both = counts.select(F.col("file_a").alias("file"), F.col("file_b").alias("other_file"), "count").unionAll(counts.select(F.col("file_b").alias("file"), F.col("file_a").alias("other_file"), "count"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("count"), "other_file"))
    return both.withColumn("rank", rank).where(F.col("rank") <= limit)


def with_coupling(impact: DataFrame, counts: DataFrame, file: str) -> DataFrame:
    """Impact rows (file_path, …) with how often their file changed together with ``file``."""
    near = counts.where((F.col("file_a") == file) | (F.col("file_b") == file)).select(F.when(F.col("file_a") == file, F.col("file_b")).otherwise(F.col("file_a")).alias("file_path"), F.col("count").alias("co_changes"))
    return impact.join(near, "file_path", "left").na.fill(0, ["co_changes"])
