"""What has changed since the last index, and whether that can be applied file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CHANGED_SHARE = 0.3
BUILD_FILES = ("build.gradle", "build.gradle.kts", "pom.xml")


def checksums(files: DataFrame) -> DataFrame:
    """(file_path, checksum) of (file_path, content): SHA-256 in hex."""
    return files.select("file_path", F.sha2(F.col("content").cast("binary"), 256).alias("checksum"))


def classify(scan: DataFrame, tracked: DataFrame) -> DataFrame:
    """(file_path, state): new, deleted, changed or same; equal times need no checksum to be the same."""
    a = scan.select("file_path", F.col("last_modified").alias("t1"), F.col("checksum").alias("c1"), F.lit(True).alias("_now"))
    b = tracked.select("file_path", F.col("last_modified").alias("t0"), F.col("checksum").alias("c0"), F.lit(True).alias("_then"))
    state = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "deleted").when((F.col("t1") == F.col("t0")) | (F.col("c1") == F.col("c0")), "same").otherwise("changed")
    return a.join(b, "file_path", "full_outer").select("file_path", state.alias("state"))


def decision(states: DataFrame, shapes: DataFrame, stored_shapes: DataFrame, forced: bool = False) -> DataFrame:
    """(reason): ``none``, ``fast``, or the first reason for a full index, in the order in which they count."""
    java = F.col("file_path").endswith(".java")
    build = F.regexp_extract("file_path", "([^/]*)$", 1).isin(*BUILD_FILES)
    moved = F.col("state") != "same"
    shaped = states.join(shapes.select("file_path", F.col("shape_hash").alias("_s1")), "file_path", "left").join(stored_shapes.select("file_path", F.col("shape_hash").alias("_s0")), "file_path", "left")
    changed_java = java & (F.col("state") == "changed")

    def any_of(condition) -> F.Column:
        return F.coalesce(F.max(condition.cast("int")), F.lit(0)) == 1

    facts = shaped.agg(
        any_of(moved).alias("moved"), any_of(build & moved).alias("build"), any_of((F.col("state") == "new") & ~build).alias("new"), any_of((F.col("state") == "deleted") & ~build).alias("deleted"),
        any_of(~java & ~build & (F.col("state") == "changed")).alias("other"), F.count(F.when(changed_java, 1)).alias("n"), F.count(F.when(java & (F.col("state") != "deleted"), 1)).alias("all"),
        any_of(changed_java & F.col("_s0").isNull()).alias("unknown"), any_of(changed_java & ~F.col("_s0").eqNullSafe(F.col("_s1"))).alias("shape"),
    )
    reason = (
        F.when(~F.col("moved") & F.lit(not forced), "none").when(F.lit(forced), "forced").when(F.col("new"), "new file").when(F.col("deleted"), "deleted file")
        .when(F.col("other"), "non-Java change").when(F.col("n") > F.col("all") * MOST_CHANGED_SHARE, "over 30 %").when(F.col("build"), "build file changed")
        .when(F.col("unknown"), "no stored shape").when(F.col("shape"), "shape changed").otherwise("fast")
    )
    return facts.select(reason.alias("reason"))


def shape_hash(lines: DataFrame) -> DataFrame:
    """(file_path, shape_hash) of (file_path, line): the sorted canonical lines of a file's declarations, hashed."""
    return lines.groupBy("file_path").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("shape_hash"))  # the lines of one file


def same_ids(fresh: DataFrame, known: DataFrame) -> bool:
    """Whether two sets of ids are equal."""
    a, b = fresh.select("id"), known.select("id")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
