"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.storage import dropped, shared_dir, stored, table

__all__ = ["WORD_PATTERN", "ascii_lower", "dropped", "held_out", "removed", "session_settings", "shared_dir", "stored", "table"]

#: ASCII blanks separate words: a space and the controls 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for the rows kept out of training; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The settings for the jobs that run inside; afterwards those that held before."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that an operator wrote and no longer needs."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
