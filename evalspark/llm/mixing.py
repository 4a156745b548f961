"""Mixing sources to target weights by weighted fair queueing.

Every source queues its documents in a fixed shuffled order (md5 of the id), up to ``max_repeats`` times over. A copy's
virtual finish time is the words its source has sent by then, divided by the source's target. Copies of all sources are
range-sorted by finish time and the list is cut where the total budget is reached, so all sources arrive at their
targets together. Sums are taken in two levels (buckets of the shuffle order inside a source, buckets of finish time
over all), so no source and no sorted list lies in one task.

Targets: sources by code point (null last) weigh 5, 2, 1, 5, ... and share the words of all sources; a target stops at
``max_repeats`` times its source's words and the excess goes to the others by weight until none is above.

Defined cases: a null or empty text has size 0 and is never taken; rows that agree in doc_id, source and size are one
queue entry of their joint size, taken or left together; a null source is a source of its own, a null doc_id an id like
any other; an empty table gives no rows. Driver memory: five numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspark.llm.common import stored

WEIGHTS = (5.0, 2.0, 1.0)
BUCKET_ROWS = 50_000
_ENTRY = ["doc_id", "source", "size"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(entries: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """(source, source_size, n_docs, source_place, target) from (source, words): water filling over one row per source."""
    sources = entries.groupBy("source").agg(F.sum("words").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_place")
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (sources.withColumns({"source_place": place, "weight": weight, "cap": F.col("source_size") * max_repeats})
              .withColumns({"spent": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                            "rest_weight": F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
                            "all_words": F.sum("source_size").over(everything)}))
    # In order of cap per weight: what the capped sources leave is shared from the first source that stays below its cap.
    level = (F.col("all_words") - F.col("spent")) / F.col("rest_weight")
    filled = filled.withColumn("own_level", F.when(level * F.col("weight") <= F.col("cap"), level))
    filled = filled.withColumn("level", F.first("own_level", ignorenulls=True).over(everything))
    target = F.when(F.col("all_words") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    return filled.select("source", "source_size", "n_docs", "source_place", target.alias("target"))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, source, size, n_rows, source_size, target, copies) per queue entry: how often the mix takes it."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    entries = stored(sized.groupBy(*_ENTRY).agg(F.count(F.lit(1)).alias("n_rows")).withColumns(
        {"words": F.col("size") * F.col("n_rows"),
         "shuffle": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))}), "mix-entries")
    targets = stored(source_targets(entries, weights, max_repeats), "mix-targets")
    totals = targets.agg(F.sum("source_size").alias("words"), F.max("n_docs").alias("largest"), F.sum("n_docs").alias("docs")).first()
    budget, n_docs = totals["words"] or 0, totals["docs"] or 0
    digits = 1
    while (totals["largest"] or 0) / 16 ** digits > bucket_rows:
        digits += 1
    # Words sent up to each entry in its source: sum of earlier buckets, then inside the bucket.
    queued = entries.withColumn("bucket", F.substring("shuffle", 1, digits))
    buckets = queued.groupBy("source", "bucket").agg(F.sum("words").alias("bucket_words"))
    buckets = buckets.withColumn("before", F.coalesce(F.sum("bucket_words").over(
        Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("source", "bucket").orderBy("shuffle", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = queued.withColumn("inside", F.sum("words").over(inside)).alias("q")
    same_source = F.col("q.source").eqNullSafe(F.col("b.source"))
    queued = (queued.join(buckets.alias("b"), same_source & (F.col("q.bucket") == F.col("b.bucket")))
              .select("q.*", (F.col("inside") + F.col("before")).alias("sent")).alias("q")
              .join(targets.alias("b"), same_source).select("q.*", "b.source_size", "b.target", "b.source_place"))
    queued = stored(queued, "mix-queue")
    copies = (queued.filter(F.col("size") > 0)
              .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
              .withColumn("finish", (F.col("sent") + F.col("turn") * F.col("source_size")) / F.col("target")))
    # Cut the sorted list at the budget: whole slots of finish time first, then inside the slot that crosses it.
    slots = 16 * max(1, n_docs * max_repeats // bucket_rows)
    copies = copies.withColumn("slot", F.least(F.floor(F.col("finish") * slots), F.lit(4 * slots)).cast("long"))
    sums = copies.groupBy("slot").agg(F.sum("words").alias("slot_words"))
    sums = sums.withColumn("upto", F.sum("slot_words").over(Window.orderBy("slot")))
    crossing = sums.filter(F.col("upto") >= budget).agg(
        F.min(F.struct("slot", (F.col("upto") - F.col("slot_words")).alias("before"))).alias("c")).first()["c"]
    edge, spent = (crossing["slot"], crossing["before"]) if crossing else (0, 0)
    order = Window.orderBy("finish", "source_place", "shuffle", "doc_id", "size", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = copies.filter(F.col("slot") == edge).withColumn("upto", F.sum("words").over(order) + spent).filter(F.col("upto") <= budget)
    taken = copies.filter(F.col("slot") < edge).select(*_ENTRY).unionByName(last.select(*_ENTRY))
    taken = taken.groupBy(*_ENTRY).agg(F.count(F.lit(1)).alias("copies"))
    on = [F.col(f"q.{k}").eqNullSafe(F.col(f"t.{k}")) for k in _ENTRY]
    return (queued.alias("q").join(taken.alias("t"), on[0] & on[1] & on[2], "left")
            .select("q.doc_id", "q.source", "q.size", "q.n_rows", "q.source_size", "q.target", F.coalesce("t.copies", F.lit(0)).cast("int").alias("copies")))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """The input rows, each as often as the mix takes it."""
    chosen = plan(docs, weights, max_repeats).filter(F.col("copies") > 0).select(*_ENTRY, "copies")
    rows = docs.select(F.struct(*docs.columns).alias("row"), word_count(F.col("text")).alias("row_size"))
    on = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("row.source").eqNullSafe(F.col("source")) & (F.col("row_size") == F.col("size"))
    return rows.join(chosen, on).select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


def taken_words(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    return (plan(docs, weights, max_repeats).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies"))
