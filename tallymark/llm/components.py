"""Connected components of an edge table as a Spark job.

Every round, each node hands its smallest known label to its neighbours, and labels are shortened by
looking up the label of the label, so that the number of rounds follows the logarithm of the longest
path. Each round is written below the shared folder: lineage stays short and a lost executor costs
one round. Nothing but one count per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import store


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b; any order, no nulls): the least node reached.

    Edges are relabelled by the labels of their ends in each round and drop out once both are equal;
    a star of any size is aggregated by its leaves' tasks first.
    """
    links = (
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a <> b")
        .distinct()
    )
    links = store(links, "links")
    nodes = None
    while not links.isEmpty():
        # One hop: every larger end points at its least smaller neighbour.
        hop = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        hop = store(_shortened(store(hop, "hop")), "hop")
        nodes = hop if nodes is None else store(_follow(nodes, hop), "nodes")
        # The other edges of a node now link the roots of their ends.
        links = store(
            _relabel(_relabel(links, "a", hop), "b", hop)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .where("a <> b")
            .distinct(),
            "links",
        )
    if nodes is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    roots = nodes.select("up").distinct()
    roots = roots.join(nodes.select(F.col("node").alias("up")), "up", "left_anti")
    return nodes.select("node", F.col("up").alias("label")).unionByName(
        roots.select(F.col("up").alias("node"), F.col("up").alias("label"))
    )


def _shortened(hop: DataFrame) -> DataFrame:
    """Pointers (node, up) followed to their ends by doubling; ``up < node`` excludes cycles."""
    while True:
        above = hop.select(F.col("node").alias("up"), F.col("up").alias("top"))
        longer = store(
            hop.join(above, "up", "left").select(
                "node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")
            ),
            "hop",
        )
        hop = longer.select("node", "up")
        if longer.where("moved").isEmpty():
            return hop


def _follow(nodes: DataFrame, hop: DataFrame) -> DataFrame:
    """Known nodes move on to the new roots; the roots that gained one join them."""
    moved = nodes.join(
        hop.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left"
    ).select("node", F.coalesce("top", "up").alias("up"))
    return moved.unionByName(hop)


def _relabel(links: DataFrame, end: str, hop: DataFrame) -> DataFrame:
    other = "b" if end == "a" else "a"
    return links.join(hop.select(F.col("node").alias(end), "up"), end, "left").select(
        F.coalesce("up", end).alias(end), other
    )
