"""Connected components of an undirected link table, by smallest-label propagation with label jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import stored


def components(links: DataFrame, rounds: int = 60, known: DataFrame | None = None) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); the label is the smallest node reachable.

    ``known`` may hold the labels of a part of these links: then only what the other links join is worked out anew.
    Each round takes the smallest label among neighbours and then the label of that label, so paths shorten by
    doubling. Both steps aggregate before they shuffle (``min``), which keeps hubs harmless. Rounds end when no label
    changes; tables are written each round.
    """
    both = stored(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("other"))).filter("node <> other").distinct(), "links")
    first = both.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("label"))
    if known is not None:
        first = first.join(known.select("node", F.col("label").alias("before")), "node", "left").select("node", F.coalesce("before", "label").alias("label"))
    labels = stored(first, "labels")
    for _ in range(rounds):
        offered = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("offer")), "other").select("node", "offer")
        # Hooking: what a node hears is passed on to its present label as well, so whole trees merge at once.
        heard = offered.join(labels, "node").select("node", "label", "offer")
        passed = heard.filter("offer < label").select(F.col("label").alias("node"), "offer")
        offers = offered.unionByName(passed).groupBy("node").agg(F.min("offer").alias("offer"))
        hooked = labels.join(offers, "node", "left").select("node", F.least("label", "offer").alias("next"), F.col("label").alias("old"))
        jump = hooked.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = stored(hooked.join(jump, "next", "left").select("node", F.least("next", "far").alias("label"), "old"), "labels")
        changed = new.filter("label < old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
