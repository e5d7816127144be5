"""Preference pairs: the longest common turn prefix once as prompt, and two completions with loss spans.

Only DataFrame operations.  A conversation is one output row's worth of text, so its turns are gathered by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"))


def rendered(turn: Column) -> Column:
    return F.concat(header(turn["role"]), F.coalesce(turn["text"], F.lit("")), F.lit("\n"))


def joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def spans(turns: Column, role: str) -> Column:
    """Character spans [start, end) of the texts of ``role`` (and their line ends) in the rendered turns."""

    def step(state, turn):
        start = state["at"] + F.length(header(turn["role"]))
        to = state["at"] + F.length(rendered(turn))
        mine = F.array(F.struct(start.alias("start"), to.alias("to")))
        return F.struct(to.alias("at"), F.when(turn["role"] == role, F.concat(state["spans"], mine)).otherwise(state["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,to:int>>")
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])


def preference_pairs(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """(pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans) of (pair_id, side, turn, role, text).

    side is 'chosen' or 'rejected'.  Turns are in order of turn, then role and text, so repeated turn numbers have one
    order; null roles and texts are compared as nulls and rendered empty.  If one side is missing or a prefix of the
    other, its completion is empty.  Rows with a null pair_id are of no pair and give none, so they never meet in one group;
    repeated rows are turns each; a side that is neither belongs to no completion; very long conversations are rendered
    whole; an empty table gives none; other columns are ignored.
    """
    def side(name: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("side") == name, F.struct("turn", "role", "text"))))

    turns = turns.where("pair_id is not null").select("pair_id", "side", "turn", "role", "text")
    pairs = turns.groupBy("pair_id").agg(side("chosen").alias("c"), side("rejected").alias("r"))
    shared = F.least(F.size("c"), F.size("r"))
    differs = F.array_position(F.transform(F.slice("c", F.lit(1), shared), lambda x, i: ~(x["role"].eqNullSafe(F.col("r")[i]["role"]) & x["text"].eqNullSafe(F.col("r")[i]["text"]))), True)
    pairs = pairs.withColumn("n", F.when(differs > 0, differs - 1).otherwise(shared).cast("int"))

    def rest(name: str) -> Column:
        return F.slice(F.col(name), F.col("n") + 1, F.greatest(F.size(name) - F.col("n"), F.lit(0)))

    return pairs.select(
        "pair_id", F.col("n").alias("n_prompt_turns"), joined(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        joined(rest("c")).alias("chosen"), joined(rest("r")).alias("rejected"),
        spans(rest("c"), role).alias("chosen_spans"), spans(rest("r"), role).alias("rejected_spans"),
    )
