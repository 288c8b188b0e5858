"""Texts joined with the needles that they contain, without comparing each text with each needle.

Texts are cut into their distinct grams (runs of GRAM characters), of which those stay that are in a needle. A needle is met by one of its grams, the
one that the fewest texts hold, and the texts so found are verified. So the work follows the rarest grams, and a gram that every text holds
is used only by needles that have no other. Needles shorter than GRAM are grams of their own length, and need no verification.

A null text or needle, and an empty needle, is in no pair; repeated rows count once; upper and lower case differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.storage import stored

GRAM = 4


def grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def containing(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(text_id, needle_id): ``texts`` (text_id, text) that contain ``needles`` (needle_id, needle)."""
    texts, needles = texts.select("text_id", "text").where("text IS NOT NULL"), needles.select("needle_id", "needle").where("length(needle) > 0").distinct()
    lengths = sorted(r.n for r in needles.select(F.least(F.length("needle"), F.lit(GRAM)).alias("n")).distinct().collect())  # GRAM rows at most
    if not lengths:
        return texts.select("text_id").limit(0).crossJoin(needles.select("needle_id").limit(0))  # no rows on either side
    out = []
    for n in lengths:
        some = needles.where(F.length("needle") >= GRAM if n == GRAM else F.length("needle") == n)
        cut = some.select("needle_id", "needle", F.explode(grams(F.col("needle"), n)).alias("gram"))
        held = stored(texts.select("text_id", F.explode(grams(F.col("text"), n)).alias("gram")).join(cut.select("gram").distinct(), "gram", "left_semi"), "grams")
        if n < GRAM:
            out.append(held.join(cut, "gram").select("text_id", "needle_id"))
            continue
        often = held.groupBy("gram").agg(F.count("*").alias("_often"))
        met = cut.join(often, "gram", "left").groupBy("needle_id", "needle").agg(F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("_often"), "gram")).alias("_rarest"))
        candidates = held.join(met.select("needle_id", "needle", F.col("_rarest.gram").alias("gram")), "gram").select("text_id", "needle_id", "needle")
        out.append(candidates.join(texts, "text_id").where(F.contains("text", "needle")).select("text_id", "needle_id"))
    return reduce(DataFrame.unionAll, out).distinct()


def least_contained(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(text_id, needle_id): for each text the smallest id of a needle in it."""
    return containing(texts, needles).groupBy("text_id").agg(F.min("needle_id").alias("needle_id"))


def api_calls(services: DataFrame, controllers: DataFrame) -> DataFrame:
    """(text_id, needle_id): services (id, code_snippet) that name the route of controllers (id, name): a slash and the name without ``Controller``, in lower case."""
    route = F.concat(F.lit("/"), F.lower(F.regexp_replace("name", "Controller$", "")))
    return containing(services.select(F.col("id").alias("text_id"), F.col("code_snippet").alias("text")), controllers.select(F.col("id").alias("needle_id"), route.alias("needle")))


def injections(components: DataFrame, services: DataFrame) -> DataFrame:
    """(text_id, needle_id): components (id, content) whose file injects services (id, name)."""
    call = F.concat(F.lit("inject("), "name", F.lit(")"))
    return containing(components.select(F.col("id").alias("text_id"), F.col("content").alias("text")), services.select(F.col("id").alias("needle_id"), call.alias("needle")))
