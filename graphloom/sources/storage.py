"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, GroupedData, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the cluster sets it; else, on a local master only, a temporary folder, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: The files of a query's exchanges go with its end, and not only when the driver collects the last trace of them.
LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def exchanges_let_go(spark: SparkSession) -> Iterator[None]:
    """For queries whose rows are stored, so that nothing reads their exchanges again."""
    before = spark.conf.get(LET_GO, None)
    spark.conf.set(LET_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(LET_GO) if before is None else spark.conf.set(LET_GO, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read back: a cut in the lineage that outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/graphloom/{label}-{uuid.uuid4().hex}"
    with exchanges_let_go(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, once nothing reads it any more; a round of an iteration lets the one before go."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def bucketed(df: DataFrame, label: str, column: str, make: Callable[[GroupedData], DataFrame] | None = None) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder, dealt once by ``column`` into as many buckets as a shuffle has partitions; or what ``make`` makes of its groups.

    A join on the column then moves the other side alone, however often it is done. The table goes at the end, so that what is made of it has to be stored before.
    """
    spark, name = df.sparkSession, f"graphloom_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/graphloom/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartition(buckets, column)
    with exchanges_let_go(spark):
        (placed if make is None else make(placed.groupBy(column))).write.option("path", path).bucketBy(buckets, column).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
