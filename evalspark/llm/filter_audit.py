"""Interaction audit of five text filters: what each removes, alone and after others, in every order.

Documents become cells (part, mask of failed filters) with counts; there are at most 32 cells a part. A recursive CTE over
the 32 masks extends every filter prefix by an unused letter and carries the bits applied so far; each level emits what its
last filter does to a mask: kept, removed here, or failing but removed before. Cells meet these rows by mask, so the
recursion has the same size (325 prefixes x 32 masks) however many documents or parts there are.

Defined cases: a null text is empty; a null source is the part ''; a document with a null doc_id is never a repeat (filter E)
and makes none; rows repeating a doc_id are documents of their own, and none of them is smaller than the other; a document
has a label if any row of ``labels`` with its id says so; an empty table has no parts. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import UPPER, hash_pair

LETTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"

STEPS_SQL = """
WITH RECURSIVE step (prefix, filter, mask, applied, before) AS (
  SELECT '', '', mask, 0, 0 FROM (SELECT explode(sequence(0, 31)) AS mask)
  UNION ALL
  SELECT concat(prefix, letter), letter, mask, applied | shiftleft(1, ascii(letter) - 65), applied
  FROM (SELECT *, explode(filter(array('A', 'B', 'C', 'D', 'E'), x -> instr(prefix, x) = 0)) AS letter FROM step)
)
SELECT prefix, filter, mask, length(prefix) AS step, mask & applied = 0 AS kept, mask & before = 0 AND mask & applied <> 0 AS removed,
       mask & before <> 0 AND mask & (applied - before) <> 0 AS redundant, mask = applied - before AS unique_fails
FROM step WHERE prefix <> ''
"""


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    fails = [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * capitals > 5 * F.char_length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by source and failed filters."""
    text = F.coalesce("text", F.lit(""))
    h1, h2 = hash_pair(text)
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), text_mask(text).alias("mask"), h1.alias("h1"), h2.alias("h2"))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(flag("quality"), flag("toxic"))
    named = rows.filter("id is not null").join(marks, "id", "left").fillna(0, ["quality", "toxic"])
    # Rows of one id first, so that the smallest id of a group comes with its number of rows; then one row per text, part and label.
    keys = ["h1", "h2", "part", "mask", "quality", "toxic"]
    same_id = named.groupBy("id", *keys).agg(F.count(F.lit(1)).alias("n"))
    groups = same_id.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    least = groups.groupBy("h1", "h2").agg(F.min("first.id").alias("least"))
    firsts = F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = groups.join(least, ["h1", "h2"]).select("part", "quality", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), firsts.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - firsts).alias("n")))).alias("c"))
    nameless = rows.filter("id is null").select("part", F.lit(0).alias("quality"), F.lit(0).alias("toxic"), "mask", F.lit(1).cast("long").alias("n"))
    return (split.select("part", "quality", "toxic", "c.mask", "c.n").unionByName(nameless).filter("n > 0").groupBy("part", "mask")
            .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("bad")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, filter_order and step, with the counts of that step's filter."""
    steps = docs.sparkSession.sql(STEPS_SQL)
    count = lambda flag, n="n": F.sum(F.when(F.col(flag), F.col(n)).otherwise(0)).alias(flag)
    # 10,400 rows at any size of the tables
    done = cells(docs, labels).join(F.broadcast(steps), "mask").groupBy("part", "prefix", "filter", "step").agg(
        count("kept"), count("removed"), count("redundant"), count("unique_fails"),
        F.sum(F.when(F.col("removed"), F.col("good")).otherwise(0)).alias("good_lost"), F.sum(F.when(F.col("removed"), F.col("bad")).otherwise(0)).alias("toxic_lost"))
    full = steps.filter(f"step = {len(LETTERS)}").select(F.col("prefix").alias("filter_order")).distinct()
    orders = full.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("n")).select(
        "filter_order", F.substring("filter_order", F.lit(1), F.col("n")).alias("prefix"))  # 600 rows
    out = done.join(F.broadcast(orders), "prefix")
    shapley = F.expr("sum(removed) over (partition by part, filter)")  # 120 rows each, one per order
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))
