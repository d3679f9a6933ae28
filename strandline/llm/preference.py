"""Preference formatting of chosen and rejected conversations, in DataFrame operations only.

``format_pairs`` takes turns (pair, side, turn, role, text), finds the longest common prefix of turns of the two sides,
renders it once as the prompt, and renders the rest of each side as a completion. A mask gives the completion's
characters as runs ``length:train``; only what an assistant says, with its end mark, trains.

Defined cases: turns sort by turn (nulls first), then role, then text, so ties have an order; a null role or text is
empty; two turns are equal if role and text are; a side without turns has an empty completion, and equal sides have
empty completions both; a null pair or side is left out; marks inside a text are broken by a blank so that they can't
end a turn; equal turns repeated in the input stay repeated; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
SIDES = ("chosen", "rejected")


def _head(x: Column) -> Column:
    return F.concat(F.lit(START), x["role"], F.lit("\n"))


def _body(x: Column) -> Column:
    text = F.replace(F.replace(x["text"], F.lit(START), F.lit("<| im_start|>")), F.lit(END), F.lit("<| im_end|>"))
    return F.concat(text, F.lit(END + "\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(_head(x), _body(x))), "")


def _mask(turns: Column) -> Column:
    runs = F.transform(turns, lambda x: F.concat(F.length(_head(x)).cast("string"), F.lit(":0,"), F.length(_body(x)).cast("string"), F.when(x["role"] == "assistant", ":1").otherwise(":0")))
    return F.array_join(runs, ",")


def _trained(turns: Column) -> Column:
    return F.aggregate(turns, F.lit(0).cast("long"), lambda s, x: s + F.when(x["role"] == "assistant", F.length(_body(x))).otherwise(0))


def format_pairs(turns: DataFrame, pair: str = "pair", dealt: tuple[str, ...] = ()) -> DataFrame:
    """(pair, n_prefix, prompt, and for each side its completion, mask and number of training characters).

    ``dealt`` names columns, the same for all turns of a pair, by which rows are dealt to tasks already: then they stay there.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = [F.sort_array(F.collect_list(F.when(F.col("side") == s, turn))).alias(s) for s in SIDES]
    both = turns.where(F.col(pair).isNotNull() & F.col("side").isin(*SIDES)).groupBy(*dealt, pair).agg(*sides)
    short = F.least(F.size("chosen"), F.size("rejected"))
    same = F.zip_with(F.slice("chosen", F.lit(1), short), F.slice("rejected", F.lit(1), short), lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    differ = F.array_position(same, F.lit(False))
    both = both.withColumn("n_prefix", F.when(differ == 0, short).otherwise(differ - 1).cast("int"))
    rest = {s: F.slice(s, F.col("n_prefix") + 1, F.size(s)) for s in SIDES}
    out = [F.col(pair), F.col("n_prefix").cast("long").alias("n_prefix"), _render(F.slice("chosen", F.lit(1), F.col("n_prefix"))).alias("prompt")]
    for s in SIDES:
        out += [_render(rest[s]).alias(s), _mask(rest[s]).alias(f"{s}_mask"), _trained(rest[s]).alias(f"{s}_train")]
    return both.select(*out)


def swapped_pairs(conversations: DataFrame) -> DataFrame:
    """Turns of pairs (with ``dealt``), one pair per conversation, all its turns on both sides: chosen as it is, rejected with
    the last reply of the neighbour (conv_id with its lowest bit flipped) as the text of its own last reply.

    The last reply is the assistant's turn with the greatest (turn, text); turns equal to it are all replaced. Where either
    conversation has no reply there is nothing to prefer: the sides are equal, and all of it is prompt. Rows without a
    conv_id are left out. Neighbours are dealt to one task, so a single shuffle serves both steps.
    """
    c = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text", F.shiftright("conv_id", 1).alias("dealt"))
    odd, reply = F.col("conv_id").bitwiseAND(F.lit(1)) == 1, F.col("role") == "assistant"
    both = Window.partitionBy("dealt")
    last = [F.max(F.when(reply & is_own, F.struct("turn", "text"))).over(both) for is_own in (~odd, odd)]
    c = c.select("*", last[0].alias("even"), last[1].alias("odd"))
    own, other = F.when(odd, F.col("odd")).otherwise(F.col("even")), F.when(odd, F.col("even")).otherwise(F.col("odd"))
    c = c.select("conv_id", "turn", "role", "text", "dealt", own.alias("own"), other.alias("other"))
    swap = reply & F.col("own").isNotNull() & F.col("other").isNotNull() & F.col("turn").eqNullSafe(F.col("own.turn")) & F.col("text").eqNullSafe(F.col("own.text"))
    sides = F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")), F.struct(F.lit("rejected").alias("side"), F.when(swap, F.col("other.text")).otherwise(F.col("text")).alias("text")))
    return c.select(F.col("conv_id").alias("pair"), "dealt", "turn", "role", F.explode(sides).alias("s")).select("pair", "dealt", "turn", "role", "s.side", "s.text")
