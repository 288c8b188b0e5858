"""Preference formatting: one prompt, two masked completions.

A chosen and a rejected conversation share a longest common prefix of turns,
which is rendered once as the prompt. What follows on each side is the
completion; its mask names the character spans of the assistant's words, which
are what a loss is taken on. Only DataFrame functions are used.

Defined cases: null roles and texts are empty; a null conversation has no turns;
equal conversations give empty completions; turns are ordered by (turn, role,
text), so that ties and repeated rows have one order; an empty table gives no
rows. Other columns are kept. A conversation is one row, as it is one training
example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "<|end|>\n"
ASSISTANT = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role,text>>) of a table of (conv_id, turn, role, text)."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("_t")).select("conv_id", F.transform("_t", lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def with_last_of_partner(talks: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): rejected ends with the last turn of the partner, the conversation whose id differs in the lowest bit.

    A conversation without a partner, or with a null id, gets an empty last turn.
    """
    last = talks.select(F.col("conv_id").alias("_partner"), F.get("turns", F.size("turns") - 1)["text"].alias("_last"))
    both = talks.join(last, F.col("conv_id").bitwiseXOR(F.lit(1)) == F.col("_partner"), "left")
    ending = F.transform(F.slice("turns", -1, 1), lambda t: F.struct(t["role"].alias("role"), F.coalesce("_last", F.lit("")).alias("text")))
    return both.select("conv_id", F.col("turns").alias("chosen"), F.concat(F.slice("turns", 1, F.greatest(F.size("turns") - 1, F.lit(0))), ending).alias("rejected"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations share at their start."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    differ = F.array_position(same, F.lit(False))
    return F.when(differ > 0, differ - 1).otherwise(F.size(same)).cast("int")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(AFTER_ROLE), t["text"], F.lit(CLOSE))), "")


def loss_spans(turns: Column) -> Column:
    """``start-end`` of each assistant text in the rendered turns, joined by commas."""
    head, tail = len(OPEN) + len(AFTER_ROLE), len(CLOSE)
    sizes = F.transform(turns, lambda t: F.struct((F.length(t["role"]) + head).alias("h"), F.length(t["text"]).alias("n"), (t["role"] == ASSISTANT).alias("own")))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        start = state["at"] + s["h"]
        span = F.concat(F.when(state["out"] == "", F.lit("")).otherwise(F.lit(",")), start.cast("string"), F.lit("-"), (start + s["n"]).cast("string"))
        return F.struct((start + s["n"] + tail).alias("at"), F.concat(state["out"], F.when(s["own"], span).otherwise(F.lit(""))).alias("out"))

    return F.aggregate(sizes, zero, step, lambda s: s["out"])


def preference(pairs: DataFrame) -> DataFrame:
    """``pairs`` with prompt, n_prompt_turns and, for each side, completion and mask, in place of the conversations."""
    none = F.array().cast("array<struct<role:string,text:string>>")

    def clean(c: str) -> Column:
        return F.transform(F.coalesce(c, none), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))

    kept = [c for c in pairs.columns if c not in ("chosen", "rejected", "prompt", "n_prompt_turns", "chosen_mask", "rejected_mask")]
    cut = pairs.select(F.struct(*(pairs[c] for c in kept)).alias("_row"), clean("chosen").alias("_c"), clean("rejected").alias("_r")).withColumn("n_prompt_turns", common_turns(F.col("_c"), F.col("_r")))

    def rest(c: str) -> Column:
        return F.slice(c, F.col("n_prompt_turns") + 1, F.greatest(F.size(c) - F.col("n_prompt_turns"), F.lit(0)))

    return cut.select(
        "_row.*",
        "n_prompt_turns",
        rendered(F.slice("_c", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        rendered(rest("_c")).alias("chosen"),
        loss_spans(rest("_c")).alias("chosen_mask"),
        rendered(rest("_r")).alias("rejected"),
        loss_spans(rest("_r")).alias("rejected_mask"),
    )
