"""Packages: derivation, coupling and cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import in_package, is_test_source
from graphloom.operators.degree import fan
from graphloom.operators.graph import CodeGraph
from graphloom.sources.storage import stored


def _cut(c: Column) -> Column:
    head = F.regexp_extract(c, r"(?s)^(.+)\.[^.]*$", 1)
    return F.when(head == "", c).otherwise(head)


def with_package(g: CodeGraph, *more: str) -> DataFrame:
    """``nodes`` (id, type, qualified_name, file_path and the columns ``more``) with ``package``: what is before the last dot, cut on while it is a Java type.

    Types nested in types are doubled up, a join and a stored table each time; most projects need none. Nodes of one package are many,
    so that they never meet as rows of one key: only distinct packages that are types are joined, and what is left of them is stored, so that its size is known.
    """
    first = g.nodes.select("id", "type", "qualified_name", "file_path", *more, _cut(F.col("qualified_name")).alias("_p"))
    java = g.nodes.where((F.col("type") != "METHOD") & F.col("file_path").endswith(".java")).select(F.col("id").alias("_type"))
    named = stored(first.select(F.col("_p").alias("_type")).distinct(), "packages")
    # a type around a type is the package of that one, so that all types that are cut away are among the packages
    nested = java.join(named, "_type", "left_semi").distinct().withColumn("_up", _cut(F.col("_type"))).where("_up <> _type").select("_type", "_up")
    step = nested = stored(nested, "nested-types")
    # the outermost package of each type, by doubling along type -> what is before its last dot
    while not step.join(nested.select(F.col("_type").alias("_up")), "_up", "left_semi").isEmpty():
        further = step.select(F.col("_type").alias("_up"), F.col("_up").alias("_far"))
        step = stored(step.join(further, "_up", "left").select("_type", F.coalesce("_far", "_up").alias("_up")), "nested-types")
    return first.join(step, F.col("_p") == F.col("_type"), "left").select("id", "type", "qualified_name", "file_path", *more, F.coalesce("_up", "_p").alias("package"))


def package_edges(g: CodeGraph, packages: DataFrame) -> DataFrame:
    """(source_package, target_package, n) of edges between different packages, both ends known."""
    of = packages.select("id", "package")
    left = g.edges.join(of.select(F.col("id").alias("source_id"), F.col("package").alias("source_package")), "source_id")
    both = left.join(of.select(F.col("id").alias("target_id"), F.col("package").alias("target_package")), "target_id")
    return both.where("source_package <> target_package").groupBy("source_package", "target_package").agg(F.count("*").alias("n"))


def package_summary(packages: DataFrame, between: DataFrame) -> DataFrame:
    """Nodes of each package and its edges and partners in both directions."""
    sizes = packages.groupBy("package").agg(F.count("*").alias("nodes"))
    out = between.groupBy(F.col("source_package").alias("package")).agg(F.count("*").alias("out_packages"), F.sum("n").alias("out_edges"))
    into = between.groupBy(F.col("target_package").alias("package")).agg(F.count("*").alias("in_packages"), F.sum("n").alias("in_edges"))
    return sizes.join(out, "package", "left").join(into, "package", "left").na.fill(0)


def two_cycles(between: DataFrame) -> DataFrame:
    """Pairs of packages with edges both ways."""
    back = between.select(F.col("source_package").alias("target_package"), F.col("target_package").alias("source_package"), F.col("n").alias("backward"))
    both = between.join(back, ["source_package", "target_package"]).where("source_package < target_package")
    return both.select(F.col("source_package").alias("lo"), F.col("target_package").alias("hi"), F.col("n").alias("forward"), "backward")


def top_types(g: CodeGraph, package: str, limit: int = 3, pool: int = 40) -> DataFrame:
    """Production types of a package with the most outgoing edges, out of the first ``pool``."""
    ranked = fan(g, "out", pool, package, types_only=True)
    paths = g.nodes.select("id", "file_path", "qualified_name").where(in_package("qualified_name", package))
    return ranked.join(paths, "id").where(~is_test_source("file_path")).select("id", "type", "n").orderBy(F.desc("n"), "id").limit(limit)
