"""Keep a table of file checksums fresh from a folder: by a listing, or as a stream of arrivals."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.incremental import classify
from graphloom.operators.search import first_per_key
from graphloom.operators.store import Catalog, upsert
from graphloom.sources.storage import stored

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (file_path, last_modified, checksum) of the files that appear under ``folder``."""
    raw = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(folder)
    return raw.select(F.col("path").alias("file_path"), F.unix_millis("modificationTime").alias("last_modified"), F.sha2("content", 256).alias("checksum"))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, last_modified, checksum) of all files now under ``folder``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return raw.select(F.col("path").alias("file_path"), F.unix_millis("modificationTime").alias("last_modified"), F.sha2("content", 256).alias("checksum"))


def arrivals(spark: SparkSession, folder: str, root: str, checkpoint: str) -> DataFrame:
    """Take in the files that have appeared under ``folder`` and stop; the tracked table is a new version of ``root``.

    The state of the stream makes a second call read only later files; an upsert
    by path makes a batch that is run again harmless. A stream of files knows paths only: ``sync`` finds what has changed or gone.
    """
    catalog = Catalog(spark, root)

    def apply(batch: DataFrame, _: int) -> None:
        newest = first_per_key(batch, ["file_path"], [F.desc("last_modified"), F.desc("checksum")])
        known = catalog.table("indexed_files") if catalog.version() else newest.limit(0)
        catalog.batch({"indexed_files": upsert(known, newest, ["file_path"])})

    query = changed_files(spark, folder).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return catalog.table("indexed_files")


def sync(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """(file_path, state) of ``folder`` against the tracked table of ``root``: new, changed, deleted or same; the table is then that of now.

    Without a difference no new version is written.
    """
    catalog = Catalog(spark, root)
    now = stored(listed(spark, folder), "listing")
    known = catalog.table("indexed_files") if catalog.version() else now.limit(0)
    states = stored(classify(now, known), "states")
    if not states.where("state <> 'same'").isEmpty():
        catalog.batch({"indexed_files": now})
    return states


class Marks:
    """Notes beside the tables of ``root`` that something has changed: a file for each, under a name of its own.

    A sync clears the notes that it has seen before it listed the folder and no others, so that one made meanwhile
    stays for the next sync, and all stay when it fails.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/marks")
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def make(self) -> str:
        name = uuid.uuid4().hex
        self.fs.create(self.folder.suffix(f"/{name}"), False).close()
        return name

    def seen(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.folder)) if self.fs.exists(self.folder) else []

    def clear(self, names: list[str]) -> None:
        for name in names:
            self.fs.delete(self.folder.suffix(f"/{name}"), False)


def sync_if_marked(spark: SparkSession, folder: str, root: str, work: Callable[[SparkSession, str, str], DataFrame] = sync) -> DataFrame | None:
    """What ``work`` (by default ``sync``) returns, where marks of change lie beside ``root``; None without a mark.

    Two syncs at once do no harm: of two batches the later fails, and its marks stay.
    """
    marks = Marks(spark, root)
    seen = marks.seen()
    if not seen:
        return None
    states = work(spark, folder, root)
    marks.clear(seen)
    return states


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type, value) by tumbling window and type; on a stream, rows later than ``late`` are left out."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = timed.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
