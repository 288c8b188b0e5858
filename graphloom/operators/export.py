"""Graphs as JSON, Mermaid and PlantUML lines, and replies within a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.ids import mermaid_id
from graphloom.sources.storage import stored

# The style class of each node type in a Mermaid graph.
STYLES = {
    "controller": ("CONTROLLER", "FE_COMPONENT"),
    "service": ("SERVICE", "COMMAND_HANDLER", "QUERY_HANDLER", "FE_SERVICE"),
    "data": ("REPOSITORY", "ENTITY", "VIEW", "MAPPER", "SQL_TABLE", "SQL_VIEW"),
    "domain": ("AGGREGATE", "COMMAND", "QUERY", "DOMAIN_EVENT", "EVENT_APPLIER"),
}
COLOURS = {"controller": "#4a90d9", "service": "#7cb342", "data": "#f5a623", "domain": "#9c5fb5", "other": "#9e9e9e"}


def _style():
    out = F.lit("other")
    for name, types in STYLES.items():
        out = F.when(F.col("type").isin(*types), name).otherwise(out)
    return out


def json_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): a JSON object a node and an edge, escaped."""
    n = nodes.select(F.lit("node").alias("part"), F.to_json(F.struct("id", "type", "name", F.col("qualified_name").alias("qualifiedName"), F.col("file_path").alias("filePath"))).alias("line"))
    return n.unionAll(edges.select(F.lit("edge"), F.to_json(F.struct("type", F.col("source_id").alias("source"), F.col("target_id").alias("target")))))


def _placed(nodes: DataFrame, edges: DataFrame, packages: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(nodes with their package, edges with both ends among the nodes).

    Ends are counted together with the ids of the nodes, so that ids alone are moved. What the count finds odd, ends without a node and
    ids of several nodes, is little as a rule; edges and nodes are held against that and stay where they lie. Nodes of one id
    meet all packages of that id, as in a join.
    """
    ends = edges.select(F.col("source_id").alias("id")).unionAll(edges.select(F.col("target_id").alias("id")))
    counts = nodes.select("id", F.lit(1).alias("n")).unionAll(ends.withColumn("n", F.lit(0))).groupBy("id").agg(F.sum("n").alias("n"))
    odd = stored(counts.where("n <> 1"), "odd-ids")
    unknown = odd.where("n = 0").select("id")
    inner = edges.where("source_id IS NOT NULL AND target_id IS NOT NULL")
    for end in ("source_id", "target_id"):
        inner = inner.join(unknown.withColumnRenamed("id", end), end, "left_anti")
    if packages is not None:
        return nodes.join(packages.select("id", "package"), "id"), inner
    repeated = nodes.join(odd.where("n > 1"), "id", "left_semi")
    single = nodes.where("id IS NOT NULL").join(odd.where("n > 1"), "id", "left_anti").select("id", "name", "type", "package")
    return single.unionAll(repeated.select("id", "name", "type").join(repeated.select("id", "package"), "id").select("id", "name", "type", "package")), inner


def mermaid_rows(nodes: DataFrame, edges: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(section, package, line): node lines by package, edge lines and style lines; both ends of an edge must be there.

    Ids come from node ids, so that equal names stay apart. Nodes with a column package need no ``packages`` (id, package).
    """
    placed, inner = _placed(nodes, edges, packages)
    n = placed.select(F.lit(1).alias("section"), "package", F.concat(F.lit("    "), mermaid_id("id"), F.lit('["'), F.col("name"), F.lit("<br/>"), F.col("type"), F.lit('"]')).alias("line"))
    e = inner.select(F.lit(2), F.lit(""), F.concat(F.lit("  "), mermaid_id("source_id"), F.lit(" -->|"), F.col("type"), F.lit("| "), mermaid_id("target_id")))
    s = nodes.select(F.lit(3), F.lit(""), F.concat(F.lit("  class "), mermaid_id("id"), F.lit(" "), _style()))
    return n.unionAll(e).unionAll(s)


def plantuml_rows(nodes: DataFrame, edges: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(section, package, line): node lines by package and edge lines, of tables as for ``mermaid_rows``."""
    placed, inner = _placed(nodes, edges, packages)
    n = placed.select(F.lit(1).alias("section"), "package", F.concat(F.lit("  ["), F.col("name"), F.lit("] as "), mermaid_id("id"), F.lit(" <<"), F.col("type"), F.lit(">>")).alias("line"))
    return n.unionAll(inner.select(F.lit(2), F.lit(""), F.concat(mermaid_id("source_id"), F.lit(" --> "), mermaid_id("target_id"), F.lit(" : "), F.col("type"))))


def write_mermaid(rows: DataFrame, path: str) -> None:
    """The whole graph as text files whose names sort in the order of the lines."""
    head = rows.sparkSession.createDataFrame([(0, "", "graph LR"), *((4, "", f"  classDef {k} fill:{v}") for k, v in COLOURS.items())], rows.schema)
    opened = rows.where("section = 1").select("package").distinct()
    groups = opened.select(F.lit(1), "package", F.concat(F.lit('  subgraph "'), F.col("package"), F.lit('"'))).withColumn("_o", F.lit(0)).unionAll(opened.select(F.lit(1), "package", F.lit("  end")).withColumn("_o", F.lit(2)))
    every = rows.unionAll(head).withColumn("_o", F.lit(1)).unionAll(groups)
    every.orderBy("section", "package", "_o", "line").select("line").write.text(path)


def fitting(rows: DataFrame, order: list[str], line: str, budget: int = 6000) -> DataFrame:
    """The longest head of the rows (in that order) whose lines, each with a line end, fit the budget; one pass.

    A line takes a character at least, so that only the first ``budget`` rows in the order can fit and meet in one task.
    """
    head = rows.orderBy(*order).limit(budget + 1)
    used = F.sum(F.length(line) + 1).over(Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return head.withColumn("_used", used).where(F.col("_used") <= budget).drop("_used")
