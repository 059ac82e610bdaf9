"""Preference formatting: one prompt, two masked completions.

A pair is a chosen and a rejected conversation with the same pair_id. Their
longest common prefix of turns (equal role and text) is rendered once as the
prompt; what follows in either is a completion. A completion's mask lists the
character spans that are learned from: the text of assistant turns with its
end mark, but not the role headers nor other roles' turns.

DataFrame functions only, one shuffle: both sides' turns are unioned with a
side mark and grouped by pair. A conversation is one row of the result, so its
turns meet in one task by nature; pairs are spread by their id.

Cases: turns are ordered by their number, equal numbers by role and text; null
role or text is empty; turns with a null pair_id are left out; a pair with one
side only has that side's whole conversation in its completion, an empty
other completion and ``complete`` false; equal conversations have empty
completions; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BETWEEN, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
LEARNED_ROLE = "assistant"


def render(turns: Column) -> Column:
    """Text of an array of turns (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(BETWEEN), t["text"], F.lit(CLOSE))), "")


def mask(turns: Column, role: str = LEARNED_ROLE) -> Column:
    """Spans (start, end) of `render`'s characters that belong to turns of ``role``, end mark included."""
    fixed = len(OPEN) + len(BETWEEN)
    whole = lambda t: F.length(t["role"]) + F.length(t["text"]) + (fixed + len(CLOSE))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state, t):
        start = state["at"] + fixed + F.length(t["role"])
        end = state["at"] + whole(t)
        own = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct(end.cast("int").alias("at"), F.when(t["role"] == role, F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, begin, add)["spans"]


def preference_pairs(chosen: DataFrame, rejected: DataFrame, role: str = LEARNED_ROLE) -> DataFrame:
    """pair_id, complete, prompt_turns, prompt, and text and mask of the chosen and the rejected completion.

    Both inputs are turns: pair_id, turn, role, text.
    """
    side = lambda df, mark: df.select("pair_id", F.lit(mark).alias("side"), F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = side(chosen, 0).unionByName(side(rejected, 1)).where("pair_id is not null")
    own = lambda mark: F.sort_array(F.collect_list(F.when(F.col("side") == mark, F.col("t"))))
    pairs = turns.groupBy("pair_id").agg(own(0).alias("c"), own(1).alias("r"))
    shared = F.least(F.size("c"), F.size("r"))
    same = F.transform(F.sequence(F.lit(0), shared - 1), lambda i: (F.get("c", i)["role"] == F.get("r", i)["role"]) & (F.get("c", i)["text"] == F.get("r", i)["text"]))
    first = F.array_position(F.concat(F.when(shared > 0, same).otherwise(F.array().cast("array<boolean>")), F.array(F.lit(False))), False)
    pairs = pairs.withColumn("prompt_turns", (first - 1).cast("int"))
    rest = lambda name: F.slice(name, F.col("prompt_turns") + 1, F.greatest(F.size(name) - F.col("prompt_turns"), F.lit(0)))
    pairs = pairs.select("pair_id", "prompt_turns", ((F.size("c") > 0) & (F.size("r") > 0)).alias("complete"), F.slice("c", F.lit(1), F.col("prompt_turns")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return pairs.select(
        "pair_id", "complete", "prompt_turns", render(F.col("p")).alias("prompt"),
        render(F.col("c")).alias("chosen"), mask(F.col("c"), role).alias("chosen_mask"),
        render(F.col("r")).alias("rejected"), mask(F.col("r"), role).alias("rejected_mask"),
    )


def spans_text(spans: Column) -> Column:
    """Spans as ``start-end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")


def stale_replies(turns: DataFrame) -> DataFrame:
    """A rejected side for conversations (conv_id, turn, role, text): the last assistant turn says what the first one said, or nothing if there is one only.

    Of assistant turns with the same least number the least text is the first;
    all with the greatest number are the last. Null text is empty. Turns with a
    null conv_id are left out before anything moves.
    """
    turns = turns.where("conv_id is not null").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    reply = F.col("role") == LEARNED_ROLE
    first_last = turns.where(reply & F.col("turn").isNotNull()).groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("first"), F.max("turn").alias("last_turn"))
    joined = turns.join(first_last, "conv_id", "left")
    stale = F.when(F.col("first.turn") < F.col("last_turn"), F.col("first.text")).otherwise(F.lit(""))
    return joined.select("conv_id", "turn", "role", F.when(reply & (F.col("turn") == F.col("last_turn")), stale).otherwise(F.col("text")).alias("text"))
