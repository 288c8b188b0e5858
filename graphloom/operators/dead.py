"""Code that nothing seems to use, in tiers of confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions.ids import is_constructor
from graphloom.functions.paths import is_production_sql, is_test_source
from graphloom.operators.graph import CodeGraph
from graphloom.sources.storage import stored


def without_incoming(g: CodeGraph) -> DataFrame:
    return g.nodes.join(g.edges.select(F.col("target_id").alias("id")).distinct(), "id", "left_anti")


def used_only_by_tests(g: CodeGraph) -> DataFrame:
    """Nodes with incoming edges, none of which starts in production code; an unknown path counts as test."""
    production = g.nodes.where(is_production_sql("file_path")).select(F.col("id").alias("source_id"))
    incoming = g.edges.select(F.col("target_id").alias("id"), "source_id")
    from_production = incoming.join(production, "source_id", "left_semi").select("id").distinct()
    return g.nodes.join(incoming.select("id").distinct(), "id", "left_semi").join(from_production, "id", "left_anti")


def live_subtypes(g: CodeGraph) -> DataFrame:
    """(id) of the types below a supertype that something else refers to.

    The live set spreads from each referred supertype down, a level at a time, until nothing is added; a type joins it once, so that
    cycles end too.
    """
    up = g.edges.where(F.col("type").isin("IMPLEMENTS", "EXTENDS")).select(F.col("source_id").alias("sub"), F.col("target_id").alias("sup")).distinct()
    referred = g.edges.where(~F.col("type").isin("IMPLEMENTS", "EXTENDS")).select(F.col("target_id").alias("sup")).distinct()
    live = stored(up.join(referred, "sup", "left_semi").select(F.col("sub").alias("id")).distinct(), "live")
    frontier = live
    while True:
        new = up.join(frontier.select(F.col("id").alias("sup")), "sup", "left_semi").select(F.col("sub").alias("id")).distinct().join(live, "id", "left_anti")
        frontier = stored(new, "live-level")
        if frontier.isEmpty():
            break
        live = live.unionAll(frontier)
    return live


def candidates(g: CodeGraph, entry_points: DataFrame | None = None) -> DataFrame:
    """(id, type, tier) of all candidates; roots, constructors and types with a live supertype are none."""
    rooted = ~F.col("type").isin(*schema.ROOT_TYPES) & ~((F.col("type") == "METHOD") & is_constructor("id"))
    bare = without_incoming(g).where(rooted).select("id", "type", "file_path")
    live = live_subtypes(g).distinct().withColumn("_live", F.lit(True))
    joined = bare.join(live, "id", "left")
    entry = g.entry_points if entry_points is None else entry_points
    if entry is None:
        joined = joined.withColumn("_entry", F.lit(False))
    else:
        joined = joined.join(entry.select(F.col("node_id").alias("id")).distinct().withColumn("_entry", F.lit(True)), "id", "left")
    strong = F.col("type").isin(*schema.HIGH_CONFIDENCE_TYPES) & ~F.coalesce("_entry", F.lit(False))
    tier = (
        F.when(is_test_source("file_path"), "TEST_SOURCE")
        .when(F.coalesce("_live", F.lit(False)), F.lit(None))
        .when(F.col("type").isin(*schema.FRAMEWORK_ENTRY_TYPES, *schema.SQL_TYPES), "LOW")
        .when(strong, "HIGH")
        .otherwise("MEDIUM")
    )
    tested = used_only_by_tests(g).where(rooted & (F.col("type") != "LIBRARY")).select("id", "type", F.lit("USED_ONLY_BY_TESTS").alias("tier"))
    return joined.select("id", "type", tier.alias("tier")).where("tier IS NOT NULL").unionAll(tested)


def tier_summary(found: DataFrame) -> DataFrame:
    """(tier_order, tier, type, n) in the order in which tiers are shown."""
    order = F.array_position(F.array(*map(F.lit, schema.TIERS)), F.col("tier")).cast("int")
    return found.groupBy("tier", "type").agg(F.count("*").alias("n")).select(order.alias("tier_order"), "tier", "type", "n")


def unreferenced(g: CodeGraph) -> DataFrame:
    """The older, untiered list: no incoming edge, five kinds left out."""
    left_out = ("CONFIGURATION", "ENTITY", "ENUM", "RECORD", "FE_MODEL")
    return without_incoming(g).where(~F.col("type").isin(*left_out)).select("id", "type")
