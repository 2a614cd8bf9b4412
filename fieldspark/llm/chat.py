"""Preference formatting: one prompt and two masked completions for each pair of conversations.

The turns of a pair's chosen and rejected conversation meet in one shuffle. The longest prefix of turns that both share
is rendered once, as the prompt; the turns after it are rendered as two completions, in segments of which those that the
assistant wrote carry the loss. A pair becomes one training example, so its turns are held in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(turn["role"], F.lit("")), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def _segments(turns: Column, trained: str) -> Column:
    """Text and loss of each turn's header and body; the loss covers the bodies of the trained role."""
    loss = lambda t: F.coalesce(t["role"] == trained, F.lit(False)).cast("int")
    return F.flatten(F.transform(turns, lambda t: F.array(F.struct(_head(t).alias("text"), F.lit(0).alias("loss")), F.struct(_body(t).alias("text"), loss(t).alias("loss")))))


def format_pairs(turns: DataFrame, pair: Column, chosen: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """(pair_id, n_prompt, n_chosen, n_rejected, prompt, chosen, rejected) of rows that are turns.

    pair: which pair a turn belongs to; chosen: whether to its chosen conversation, otherwise to its rejected one (null: to
    neither). Turns are in the order of turn_col (nulls first), then role and text; repeated rows are repeated turns. Null
    roles and texts are rendered as empty, and equal each other only as nulls. chosen and rejected: array<struct<text,
    loss>>. A pair of which one conversation is missing has an empty prompt and an empty array for it. Rows of a null
    pair are left out. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    side = lambda on: F.sort_array(F.collect_list(F.when(on, turn)))
    pairs = turns.filter(pair.isNotNull()).groupBy(pair.alias("pair_id")).agg(side(chosen).alias("c"), side(~chosen).alias("r"))
    both = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", 1, both), F.slice("r", 1, both), lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    pairs = pairs.withColumn("differs", F.array_position(same, F.lit(False)))
    pairs = pairs.withColumn("n", F.when(F.col("differs") > 0, F.col("differs") - 1).otherwise(both).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    prompt = F.array_join(F.transform(F.slice("c", 1, F.col("n")), lambda t: F.concat(_head(t), _body(t))), "")
    return pairs.select("pair_id", F.col("n").alias("n_prompt"), (F.size("c") - F.col("n")).alias("n_chosen"), (F.size("r") - F.col("n")).alias("n_rejected"), prompt.alias("prompt"), _segments(rest("c"), trained).alias("chosen"), _segments(rest("r"), trained).alias("rejected"))
