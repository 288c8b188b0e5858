"""A corpus in four stages: drop toxic documents, drop repeated lines, keep one of each near-duplicate group, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of ``documents``. The last returns a row a
packed piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

Two stages have no SQL form (a trained score and exact near copies), so that there is no SQL for the whole. The near-copy
stage is tested against brute force, line dedup by its query's SQL, and of the whole the offsets and the capacity of the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import lines, packing, simhash, toxicity
from graphloom.llm.common import stored, table

#: The near-duplicate stage: words a shingle, and the Jaccard similarity from which documents are copies.
SHINGLE, SHARE = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedupe(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_each(docs, SHINGLE, SHARE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("best-fit packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
