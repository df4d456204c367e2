"""Connected groups from links, by rounds that contract them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoterra.spread import cut, discard


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): the smallest node that can be reached.

    In a round every node goes to its smallest neighbour, if that is smaller, and from there one step
    on; links are rewritten to where their ends went, and those inside one group vanish. At least half
    of the linked nodes vanish in every round, so rounds are few and each is smaller than the one
    before. Minima are combined before the shuffle, so a node with very many links sends one row per
    task. Rounds are written to the shared folder; no task and not the driver holds a whole group.
    """
    steps: list[DataFrame] = []
    links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    while not steps or not links.isEmpty():
        before = links
        both = links.select("a", "b").union(links.select("b", "a")).toDF("node", "other")
        near = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("near"))
        near = cut(near)
        onward = near.select(F.col("node").alias("near"), F.col("near").alias("root"))
        moved = cut(near.join(onward, "near").select("node", "root"))
        steps.append(moved)
        for end in ("a", "b"):
            links = links.join(moved.withColumnsRenamed({"node": end, "root": f"_{end}"}), end)
        ends = links.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        contracted = cut(ends.where("a <> b").distinct())
        discard(near)
        discard(before)
        links = contracted
    # A root of one round is a node of the next one, unless its group was complete.
    labels = steps[0]
    for step in steps[1:]:
        later = step.select(F.col("node").alias("root"), F.col("root").alias("_later"))
        labels = labels.join(later, "root", "left").select("node", F.coalesce("_later", "root").alias("root"))
    return labels
