"""Connected components of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plinth.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label for every node with a link; the label is the smallest node of its component.

    Each round takes the least label among a node and its neighbours and then
    the label of that label, so paths halve. Partial minima are taken before
    each shuffle, so a node with very many links is no hot key.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = scratch.keep(both.where("u <> v").distinct(), f"{name}-links")
    labels = scratch.keep(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")), f"{name}-labels0")
    k = 0
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["node"] == near["u"]).select("node", "label", F.least("label", "near").alias("next"))
        up = labels.select(F.col("node").alias("_n"), F.col("label").alias("_up"))
        step = least.join(up, least["next"] == up["_n"], "left").select("node", F.least("next", F.coalesce("_up", "next")).alias("next"), "label")
        k += 1
        made = scratch.keep(step, f"{name}-step{k}")
        changed = made.where("next <> label").limit(1).count()
        labels = made.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
