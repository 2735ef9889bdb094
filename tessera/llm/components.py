"""Connected components of a link table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of links (a, b; bigint).

    Each round takes the smallest label among a node and its neighbours and then the label of that label,
    so a component's depth at least halves. Labels and links stay distributed; rounds are written to the
    shared folder. Loops, repeated links and an empty table are fine.
    """
    both = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        jumped = labels.select(F.col("node").alias("to"), F.col("component").alias("jump"))
        after = staged(lower.join(jumped, "to").select("node", "old", F.least("to", "jump").alias("component")))
        labels = after.select("node", "component")
        if after.where("component <> old").limit(1).count() == 0:
            return labels


def merged_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) when links (a, b; bigint) join components() that are known: only these are linked anew."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_"))
    known = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    top = components(known.select(F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b")))
    moved = labels.join(top.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    fresh = top.join(labels.select("node"), "node", "left_anti")
    return staged(moved.select("node", F.coalesce("top", "component").alias("component")).union(fresh.select("node", "component")))
