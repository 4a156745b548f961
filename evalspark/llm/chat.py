"""Chat formatting: logged snapshots collapse to the longest conversation, which is then rendered.

Logs often hold a conversation many times, once after each turn. Every turn gets a hash, and a rolling hash over the
turns names each prefix (128 bits). Conversations equal as a whole become one, with a count; those whose hash occurs as a proper
prefix of a longer one go by an anti-join. Prefix hashes are made distinct before they are shuffled, so a first turn
that a third of all conversations share is one row. Only DataFrame functions are used.

Defined cases: turns are ordered by number (null first), role and text; null roles and texts differ from empty ones for
equality and are rendered empty; a null conv_id is a conversation of its own; an empty table gives no rows. One
conversation is one output row and so must fit in one; conversations are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import stored

# The template of a turn.
TURN_HEAD, TURN_BODY, TURN_END = "<|", "|>\n", "<|end|>\n"


def _turn_hash(seed: int) -> Column:
    return lambda t: F.xxhash64(F.lit(seed), t["role"].isNull(), F.coalesce(t["role"], F.lit("")), t["text"].isNull(), F.coalesce(t["text"], F.lit("")))


def _prefixes(turns: str) -> Column:
    """Rolling hashes (h1, h2) of the first 1, 2, ... turns."""
    pairs = F.transform(turns, lambda t: F.struct(_turn_hash(1)(t).alias("x1"), _turn_hash(2)(t).alias("x2")))
    kind = "array<struct<h1: bigint, h2: bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.array().cast(kind).alias("all"))

    def step(acc, x):
        h1, h2 = F.xxhash64(acc["h1"], x["x1"], x["x2"]), F.xxhash64(acc["h2"], x["x2"], x["x1"])
        return F.struct(h1.alias("h1"), h2.alias("h2"), F.concat(acc["all"], F.array(F.struct(h1.alias("h1"), h2.alias("h2")))).alias("all"))

    return F.aggregate(pairs, start, step, lambda acc: acc["all"])


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, prefixes) with turns in order."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", "role", "text").alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return grouped.withColumn("prefixes", _prefixes("turns"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, n_turns, n_copies): conversations that are no prefix of another; equal ones once, as the smallest id."""
    convs = stored(conversations(turns), "chat-conversations").withColumn("n_turns", F.size("prefixes")).withColumn("whole", F.element_at("prefixes", -1))
    heads = (convs.groupBy("n_turns", "whole.h1", "whole.h2")
             .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"), F.max(F.col("conv_id").isNull()).alias("nameless")))
    inner = (convs.filter("n_turns > 1").select(F.posexplode(F.slice("prefixes", 1, F.col("n_turns") - 1)).alias("at", "p"))
             .select((F.col("at") + 1).alias("n_turns"), "p.h1", "p.h2").distinct())
    kept = heads.join(inner, ["n_turns", "h1", "h2"], "left_anti")
    same = F.col("c.conv_id").eqNullSafe(F.col("k.conv_id"))
    return convs.select("conv_id", "turns").alias("c").join(kept.alias("k"), same).select("c.conv_id", "turns", "n_turns", "n_copies")


def render(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(TURN_HEAD), F.coalesce(t["role"], F.lit("")), F.lit(TURN_BODY), F.coalesce(t["text"], F.lit("")), F.lit("\n" + TURN_END))))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of every maximal conversation."""
    return maximal(turns).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.col("n_copies").cast("long").alias("n_copies"), render(F.col("turns")).alias("rendered"))
