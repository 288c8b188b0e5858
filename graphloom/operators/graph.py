"""A code graph: its tables and the lookups on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CodeGraph:
    nodes: DataFrame
    edges: DataFrame
    methods: DataFrame | None = None
    entry_points: DataFrame | None = None

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def nodes_where(self, type: str | None = None, name: str | None = None, file_path: str | None = None) -> DataFrame:
        out = self.nodes
        for column, value in (("type", type), ("name", name), ("file_path", file_path)):
            if value is not None:
                out = out.where(F.col(column) == value)
        return out.orderBy("id")

    def edges_from(self, node_id: str, type: str | None = None) -> DataFrame:
        return self._edges("source_id", node_id, type)

    def edges_to(self, node_id: str, type: str | None = None) -> DataFrame:
        return self._edges("target_id", node_id, type)

    def _edges(self, end: str, node_id: str, type: str | None) -> DataFrame:
        out = self.edges.where(F.col(end) == node_id)
        return (out if type is None else out.where(F.col("type") == type)).orderBy("type", "source_id", "target_id")

    def methods_of(self, *node_ids: str) -> DataFrame:
        return self.methods.where(F.col("node_id").isin(*node_ids)).orderBy("node_id", "name")

    def induced_edges(self, kept: DataFrame) -> DataFrame:
        """The edges with both ends among ``kept`` (a column id)."""
        ids = kept.select("id").distinct()
        one = self.edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi")
        return one.join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("type", "source_id", "target_id")

    def counts(self) -> DataFrame:
        n = self.nodes.agg(F.count("*").alias("node_count"), F.countDistinct(F.when(F.col("file_path") != "", F.col("file_path"))).alias("file_count"))
        return n.crossJoin(self.edges.agg(F.count("*").alias("edge_count")))  # one row by one row

    def type_histogram(self) -> DataFrame:
        return self.nodes.groupBy("type").agg(F.count("*").alias("n"))

    def degrees(self) -> DataFrame:
        """(id, degree) over both directions of the nodes that have an edge."""
        ends = self.edges.select(F.col("source_id").alias("id")).unionAll(self.edges.select(F.col("target_id").alias("id")))
        return ends.groupBy("id").agg(F.count("*").alias("degree"))

    def resolve(self, symbol: str) -> DataFrame:
        """The one node that a symbol names, with up to four others it could be (``others``).

        An exact id with a dot or a hash wins; else names, qualified names, ids and
        their dotted endings are compared without case; types go before methods, then
        the more connected, then the smaller id.
        """
        s = symbol.lower()
        hit = (F.lower("name") == s) | (F.lower("qualified_name") == s) | (F.lower("id") == s) | F.lower("id").endswith("." + s)
        found = self.nodes.where((F.col("id") == symbol) | hit)
        ranked = found.join(self.degrees(), "id", "left").select(
            "id", "type", F.coalesce("degree", F.lit(0)).alias("degree"),
            ((F.col("id") == symbol) & F.lit("." in symbol or "#" in symbol)).alias("_exact"), (F.col("type") == "METHOD").alias("_method"),
        )
        top = ranked.orderBy(F.desc("_exact"), "_method", F.desc("degree"), "id").limit(6)
        order = F.struct((~F.col("_exact")).alias("x"), "_method", (-F.col("degree")).alias("d"), "id", "type", "degree")
        one = top.agg(F.sort_array(F.collect_list(order)).alias("_l")).where(F.size("_l") > 0)
        others = F.array_join(F.transform(F.slice("_l", 2, 4), lambda x: x["id"]), ",")
        return one.select(F.col("_l")[0]["id"].alias("id"), F.col("_l")[0]["type"].alias("type"), F.col("_l")[0]["degree"].alias("degree"), F.when(F.col("_l")[0]["x"], others).otherwise("").alias("others"), (F.col("_l")[0]["x"] & (F.size("_l") > 5)).alias("more"))

    def resolve_method(self, owner: str, name: str, params: str | None = None) -> DataFrame:
        """Methods ``owner#name[(params)]``: the owner by DECLARES_METHOD, else by the id; parameters without case."""
        methods = self.nodes.where((F.col("type") == "METHOD") & (F.lower("name") == name.lower()))
        declared = self.edges.where("type = 'DECLARES_METHOD'").select(F.col("source_id").alias("_owner"), F.col("target_id").alias("id"))
        o = owner.lower()
        placed = methods.join(declared, "id", "left").withColumn("_owner", F.lower(F.coalesce("_owner", F.substring_index("id", "#", 1))))
        out = placed.where((F.col("_owner") == o) | F.col("_owner").endswith("." + o))
        if params is not None:
            wanted = "".join(params.split()).lower()
            out = out.where(F.lower(F.regexp_extract("id", r"(?s)\((.*)\)$", 1)) == wanted)
        return out.select("id", "type", "name", "file_path").distinct().orderBy("id")
