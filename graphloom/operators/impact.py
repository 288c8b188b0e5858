"""From changed lines to symbols, and from symbols to what depends on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.ids import declaring_class
from graphloom.functions.paths import is_guard_test
from graphloom.operators.graph import CodeGraph
from graphloom.operators.search import first_and_more
from graphloom.operators.traverse import search, search_many


def changed_spans(hunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, path): the spans (id, path, begin, end) that hunks (path, begin_b, end_b) touch, lines counted from 0 and the end left out.

    A hunk without lines is a deletion between two lines and touches a span only if both neighbours lie in it.
    The join is on the path first, so that only the spans of one file are compared with its hunks.
    """
    lines = (F.col("end_b") > F.col("begin_b")) & (F.col("begin_b") + 1 <= F.col("end")) & (F.col("end_b") >= F.col("begin"))
    gap = (F.col("end_b") == F.col("begin_b")) & (F.col("begin_b") >= F.col("begin")) & (F.col("begin_b") + 1 <= F.col("end"))
    return hunks.join(spans, "path").where(lines | gap).select("id", "path").distinct()


def islands(spans: DataFrame) -> DataFrame:
    """(path, begin, end): the spans of each path merged where they overlap or follow line on line."""
    upto = F.max("end").over(Window.partitionBy("path").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select("path", "begin", "end", F.coalesce(F.col("begin") > upto + 1, F.lit(True)).alias("_new"))
    numbered = marked.withColumn("_island", F.sum(F.col("_new").cast("int")).over(Window.partitionBy("path").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("path", "_island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("_island")


def covered_hunks(hunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, begin_b, end_b, covered): whether every line of a hunk lies in some span; lines as in ``changed_spans``.

    A hunk may lie across several spans that follow each other, so that it is held against their union. A deletion lies between two lines,
    and is covered only if one span holds both.
    """
    own, adds = hunks.select("path", "begin_b", "end_b").distinct(), F.col("end_b") > F.col("begin_b")
    merged = own.where(adds).join(islands(spans), "path").where((F.col("begin_b") + 1 >= F.col("begin")) & (F.col("end_b") <= F.col("end")))
    single = own.where(~adds).join(spans, "path").where((F.col("begin_b") >= F.col("begin")) & (F.col("begin_b") + 1 <= F.col("end")))
    whole = merged.unionByName(single, allowMissingColumns=True).select("path", "begin_b", "end_b").distinct().withColumn("covered", F.lit(True))
    return own.join(whole, ["path", "begin_b", "end_b"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def innermost(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, line, id): for each line the smallest span around it, then the later one, then the smaller id."""
    inside = lines.join(spans, "path").where((F.col("line") >= F.col("begin")) & (F.col("line") <= F.col("end")))
    order = F.struct((F.col("end") - F.col("begin")).alias("size"), (-F.col("begin")).alias("late"), "id")
    return inside.groupBy("path", "line").agg(F.min(order)["id"].alias("id"))


def new_and_removed(indexed: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids that were only parsed, and ids that were only indexed."""
    a, b = indexed.select("id").distinct(), parsed.select("id").distinct()
    return b.join(a, "id", "left_anti"), a.join(b, "id", "left_anti")


def dependents(g: CodeGraph, node_id: str, depth: int) -> DataFrame:
    """(id): what depends on a node, as ``dependents_each``."""
    one = g.nodes.sparkSession.createDataFrame([(node_id,)], "id string")
    return dependents_each(g, one, depth).select("id")


def dependents_each(g: CodeGraph, changed: DataFrame, depth: int) -> DataFrame:
    """(start, id): what depends on each id of ``changed``, all in one search.

    Of a method these are its callers. Of a type they are the types among its own callers and all callers of each method that it declares; the
    methods of a type that only uses the type are none, since they need not call into it. A node does not depend on itself.
    """
    own = changed.select("id").distinct()
    declared = g.edges.where("type = 'DECLARES_METHOD'").select(F.col("source_id").alias("id"), F.col("target_id").alias("_method")).join(own, "id")
    starts = own.select(F.col("id").alias("start"), F.lit("").alias("_of"), "id").unionAll(declared.select(F.col("id").alias("start"), F.col("_method").alias("_of"), F.col("_method").alias("id")))
    found = search_many(g, starts.select(F.struct("start", "_of").alias("start"), "id"), depth, "in")
    is_method = F.instr("id", "#") > 0
    kept = found.where((F.col("start._of") != "") | (F.instr("start.start", "#") > 0) | ~is_method)
    return kept.select(F.col("start.start").alias("start"), "id").where("start <> id").distinct()


def guard_summary(g: CodeGraph, found: DataFrame) -> DataFrame:
    """(side, type, n): dependents in tests and in production by type."""
    placed = g.nodes.select("id", "type", "file_path").join(found, "id", "left_semi")
    return placed.groupBy(F.when(is_guard_test("file_path"), "test").otherwise("production").alias("side"), "type").agg(F.count("*").alias("n"))


#: The node types that a report on a change names one by one.
SIGNIFICANT = ["AGGREGATE", "DOMAIN_EVENT", "COMMAND", "COMMAND_HANDLER", "PROJECTION_HANDLER"]


def guard_rollup(g: CodeGraph, found: DataFrame, limit: int = 12) -> DataFrame:
    """(part, rank, label, n, more): what a change may break, rolled up.

    ``significant``: the first ``limit`` production nodes of the significant types by id, with how many ``more`` there are; ``other``: the number
    of production nodes of each other type, the most first, ties to the smaller type; ``test``: the number of nodes in tests, if any.
    """
    part = F.when(is_guard_test("file_path"), "test").when(F.col("type").isin(SIGNIFICANT), "significant").otherwise("other")
    placed = g.nodes.select("id", "type", "file_path").join(found.select("id").distinct(), "id", "left_semi").select(part.alias("part"), "id", "type")
    named = first_and_more(placed.where("part = 'significant'"), ["part"], ["id"], limit).select("part", "rank", F.col("id").alias("label"), F.lit(1).cast("bigint").alias("n"), "more")
    label = F.when(F.col("part") == "other", F.col("type")).otherwise("")
    counts = placed.where("part <> 'significant'").groupBy("part", label.alias("label")).agg(F.count("*").alias("n"))  # a row a type
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "label"))
    return named.unionAll(counts.select("part", rank.alias("rank"), "label", "n", F.lit(0).cast("bigint").alias("more")))


def dependents_of_change(g: CodeGraph, changed: DataFrame, depth: int) -> DataFrame:
    """(id): the callers of all changed ids and the classes of calling methods, without what itself changed."""
    found = search(g, changed, depth, "in").select("id")
    classes = found.where(F.instr("id", "#") > 0).select(declaring_class("id").alias("id"))
    known = classes.join(g.nodes.select("id"), "id", "left_semi")
    return found.unionAll(known).distinct().join(changed.select("id").distinct(), "id", "left_anti")


def tests_reached(g: CodeGraph, found: DataFrame) -> DataFrame:
    return g.nodes.join(found, "id", "left_semi").where(is_guard_test("file_path")).select("id", "type", "file_path")
