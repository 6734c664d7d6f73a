"""Preference formatting: a chosen and a rejected conversation as one prompt and two completions with loss masks.

The longest common prefix of turns is rendered once as the prompt; what follows in either conversation is a completion,
whose mask lists the character spans to learn from: the text and end mark of assistant turns. All in DataFrame functions.

Defined cases: a null role is `user` and a null text empty; rows with a null conversation id are ignored, rows of one
turn number are ordered by role and text; a conversation whose partner is missing meets an empty one; equal conversations
give two empty completions; markers inside a text are broken by a backslash, so that a rendering can be read back; an
empty table gives an empty result; columns of the turns besides these are ignored, those of the pairs are kept, whatever their
names, but for the ones named as the results are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.runtime import unused

#: The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURN = "struct<role:string,text:string>"
MADE = ("prompt_turns", "prompt", "chosen", "chosen_spans", "rejected", "rejected_spans")


def gather(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order."""
    rows = turns.filter("conv_id is not null").select("conv_id", F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_ = F.array_sort(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(sorted_, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations begin with alike."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(first > 0, (first - 1).cast("int")).otherwise(F.least(F.size(a), F.size(b)))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit("\n"))


def _body(t: Column) -> Column:
    return F.concat(F.replace(t["text"], F.lit("<|"), F.lit("<\\|")), F.lit(CLOSE), F.lit("\n"))


def render(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(_head(t), _body(t))))


def loss_spans(turns: Column) -> Column:
    """The character spans (start, end excluded) of assistant texts and end marks in render(turns)."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_head(t))
        end = begin + F.length(_body(t))
        own = F.when(t["role"] == "assistant", F.array(F.struct(begin.alias("start"), (end - 1).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], own).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs with prompt_turns, prompt, and for either side its completion and spans, in place of the turn arrays."""
    empty = F.array().cast(f"array<{TURN}>")
    a, b = F.coalesce(chosen, empty), F.coalesce(rejected, empty)
    kept = [c for c in pairs.columns if c not in (chosen, rejected, *MADE)]
    x, y, n = (unused(pairs.columns, c) for c in ("x", "y", "n"))
    counted = pairs.withColumns({x: a, y: b}).withColumn(n, common_turns(F.col(x), F.col(y)))
    tail = lambda c: F.slice(c, F.col(n) + 1, F.greatest(F.size(c), F.lit(1)))
    out = counted.select(*kept, F.col(n).alias("prompt_turns"), F.slice(x, F.lit(1), F.col(n)).alias("prompt"), tail(x).alias("chosen"), tail(y).alias("rejected"))
    return out.select(
        *kept, "prompt_turns", render(F.col("prompt")).alias("prompt"), render(F.col("chosen")).alias("chosen"), loss_spans(F.col("chosen")).alias("chosen_spans"),
        render(F.col("rejected")).alias("rejected"), loss_spans(F.col("rejected")).alias("rejected_spans"),
    )


def pair_neighbours(conversations: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): conversations 2k and 2k + 1 of (conv_id, turns) as a pair; either may be missing."""
    even = conversations.filter(F.pmod("conv_id", F.lit(2)) == 0).select(F.expr("conv_id div 2").alias("pair_id"), F.col("turns").alias("chosen"))
    odd = conversations.filter(F.pmod("conv_id", F.lit(2)) == 1).select(F.expr("(conv_id - 1) div 2").alias("pair_id"), F.col("turns").alias("rejected"))
    return even.join(odd, "pair_id", "full")
