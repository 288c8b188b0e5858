"""Degree rankings and neighbour summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ids import short_label
from graphloom.functions.paths import below_package_sql, is_under_test_dir
from graphloom.operators.graph import CodeGraph


def fan(g: CodeGraph, direction: str, limit: int | None = 10, package: str | None = None, types_only: bool = False) -> DataFrame:
    """(id, type, n): nodes by how many edges come in (``in``) or go out (``out``); libraries are never ranked.

    Edges are counted before they meet the nodes, so that a hub's edges combine
    where they are read. Ties go to the smaller id.
    """
    end = "target_id" if direction == "in" else "source_id"
    counted = g.edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("n"))
    kept = g.nodes.where("type <> 'LIBRARY'")
    if types_only:
        kept = kept.where("type <> 'METHOD'")
    if package is not None:
        kept = kept.where(below_package_sql("qualified_name", package))
    out = kept.select("id", "type").join(counted, "id")
    return out if limit is None else out.orderBy(F.desc("n"), "id").limit(limit)


def neighbour_summary(g: CodeGraph, node_id: str, direction: str, first: int = 8) -> DataFrame:
    """By edge type: neighbours in all, those in tests, and the first labels with how often they occur."""
    here, there = ("target_id", "source_id") if direction == "in" else ("source_id", "target_id")
    near = g.edges.where(F.col(here) == node_id).select(F.col("type").alias("edge_type"), F.col(there).alias("id"))
    labelled = near.join(g.nodes.select("id", "file_path"), "id", "left").withColumn("label", short_label("id"))
    each = labelled.groupBy("edge_type", "label").agg(F.count("*").alias("n"), F.sum(is_under_test_dir("file_path").cast("long")).alias("t"))
    text = F.concat("label", F.when(F.col("n") > 1, F.concat(F.lit(" ×"), F.col("n").cast("string"))).otherwise(""))
    rows = each.groupBy("edge_type").agg(F.sum("n").alias("total"), F.sum("t").alias("in_tests"), F.sort_array(F.collect_list(text)).alias("_l"))
    return rows.select("edge_type", "total", "in_tests", F.array_join(F.slice("_l", 1, first), ", ").alias("labels"))


def library_usage(g: CodeGraph, dependencies: DataFrame) -> DataFrame:
    """Declared dependencies (ord, group_id, artifact, version) with how many of their types are used."""
    used = g.nodes.where("type = 'LIBRARY'").groupBy(F.col("code_snippet").alias("coordinate")).agg(F.count("*").alias("n"))
    return dependencies.withColumn("coordinate", F.concat_ws(":", "group_id", "artifact")).join(used, "coordinate", "left").select("ord", "coordinate", "version", F.coalesce("n", F.lit(0)).alias("used_types"))
