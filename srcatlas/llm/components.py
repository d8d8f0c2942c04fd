"""Distributed union-find: the smallest id reachable from every node of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.session import cut


def components(links: DataFrame) -> DataFrame:
    """From links (a, b): (id, component) for every node that has a link.

    Each round every node hooks its root to the smallest root seen over its links, and paths are
    halved; the number of rounds is logarithmic in the longest shortest path. All steps are joins
    on a key and minima, which are combined before they are shuffled, so a node with very many
    links is no hot group. Every round is a written table; the driver gets one count per round.
    """
    pairs = cut(links.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parents = cut(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("id"), F.least("a", "p").alias("parent")))
    while True:
        top = parents.select(F.col("id").alias("parent"), F.col("parent").alias("top"))
        known = parents.join(top, "parent").select("id", "parent", "top")  # of each node: parent and grandparent
        seen = both.join(known.select(F.col("id").alias("b"), F.col("top").alias("near")), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        offers = known.join(seen, "id").select("id", "parent", F.least("top", "near").alias("offer"))
        hooked = offers.select("id", "offer").unionByName(offers.select(F.col("parent").alias("id"), "offer")).groupBy("id").agg(F.min("offer").alias("offer"))
        following = cut(parents.join(hooked, "id").select("id", F.least("parent", "offer").alias("parent"), (F.col("offer") < F.col("parent")).alias("moved")))
        moved = following.where("moved").limit(1).count()
        parents = following.drop("moved")
        if not moved:
            return parents.select("id", F.col("parent").alias("component"))
