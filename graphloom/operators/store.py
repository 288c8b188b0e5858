"""Changes to stored tables, as new tables: upserts, deletes, cascades, and an atomic switch of versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.search import first_per_key


def upsert(known: DataFrame, more: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``known`` with the rows of ``more`` put in the place of those with the same key; within ``more`` the last in ``order`` wins."""
    newest = first_per_key(more, keys, [F.desc(c) for c in order]) if order else more.dropDuplicates(keys)
    return known.join(newest.select(*keys), keys, "left_anti").unionByName(newest)


def by_path_order(nodes: DataFrame) -> DataFrame:
    """One node an id: of colliding ids the later file in path order wins."""
    return first_per_key(nodes, ["id"], [F.desc("file_path"), F.desc("line_number")])


def save_edges(known: DataFrame, more: DataFrame) -> DataFrame:
    return known.unionByName(more).dropDuplicates(["type", "source_id", "target_id"])


def delete_nodes(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the nodes of ``gone`` (id) and what belongs to them: edges both ways, methods, entry points, return classes."""
    ends = {"nodes": ["id"], "edges": ["source_id", "target_id"], "methods": ["node_id"], "entry_points": ["node_id"], "method_return_class": ["method_id"]}
    ids = gone.select("id").distinct()
    out = dict(tables)
    for name, columns in ends.items():
        for c in columns if name in out else []:
            out[name] = out[name].join(ids.select(F.col("id").alias(c)), c, "left_anti").select(*out[name].columns)
    return out


def delete_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """Delete the nodes of some files and the files' own rows."""
    gone = tables["nodes"].join(paths, "file_path", "left_semi").select("id")
    out = delete_nodes(tables, gone)
    for name in ("file_shapes", "indexed_files"):
        if name in out:
            out[name] = out[name].join(paths, "file_path", "left_anti").select(*tables[name].columns)
    return out


def delete_edges_owned_by(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges that start in the files go; those that end there stay."""
    own = nodes.join(paths, "file_path", "left_semi").select(F.col("id").alias("source_id"))
    return edges.join(own, "source_id", "left_anti").select(*edges.columns)


def delete_return_classes_of(table: DataFrame, class_id: str) -> DataFrame:
    return table.where(~F.col("method_id").startswith(class_id + "#"))


def entry_points_in(nodes: DataFrame, entry_points: DataFrame, paths: DataFrame) -> DataFrame:
    """(node_id): the entry points among the nodes of some files."""
    return entry_points.select("node_id").intersect(nodes.join(paths, "file_path", "left_semi").select(F.col("id").alias("node_id")))


def truncated(tables: dict[str, DataFrame], names: list[str]) -> dict[str, DataFrame]:
    """All tables, the named ones without rows, for a batch that starts them anew."""
    return {n: df.limit(0) if n in names else df for n, df in tables.items()}


class Catalog:
    """Versions of a project's tables under one folder; a version counts once the pointer names it.

    A batch writes all its tables to a folder of its own and then adds a pointer, a small file whose
    name is its number and whose text is the folder. Pointers are renamed into place whole and never replaced, and the highest counts, so
    that a reader finds the old version or the new one at any time; a batch that fails leaves the old one, and
    of two batches at once the later fails.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _newest(self) -> int:
        fs, folder = self._fs(), self._path("versions")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def version(self) -> str | None:
        newest = self._newest()
        return self.spark.read.text(f"{self.root}/versions/{newest:012d}").first()[0] if newest else None

    def table(self, name: str) -> DataFrame:
        version = self.version()
        if version is None:
            raise LookupError(f"{self.root} is not indexed")
        return self.spark.read.parquet(f"{self.root}/{version}/{name}")

    def batch(self, tables: dict[str, DataFrame]) -> str:
        """Write ``tables`` as the next version; tables that are not given stay out of it."""
        number, version = self._newest() + 1, uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{version}/{name}")
        fs = self._fs()
        fs.mkdirs(self._path("versions"))
        fresh, pointer = self._path(f"pointer-{version}"), self._path(f"versions/{number:012d}")
        out = fs.create(fresh, False)
        out.write(bytearray(version.encode()))
        out.close()
        if fs.exists(pointer) or not fs.rename(fresh, pointer):
            fs.delete(fresh, False)
            raise RuntimeError(f"another batch has written version {number} of {self.root}")
        return version
