"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limelight.sources.scratch import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller) neighbours of each node on its smallest neighbour.

    A node's smallest neighbour comes from a partial aggregate; the links of a node are joined with it,
    never gathered, so a hub with most of all links can be split by adaptive execution.
    """
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    lowest = both.groupBy("a").agg(F.min("b").alias("low"))
    lowest = lowest.select("a", F.least("a", "low").alias("low"))
    moved = both.join(lowest, "a")
    if large:
        return moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    hung = moved.filter(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return hung.unionAll(lowest.filter("a <> low").select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b); root is the smallest node of its component.

    Every round is written to the shared folder, so a lost executor costs one round at most. The number
    of rounds grows with the logarithm of the longest chain, not with the data.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, state = materialise(links, "links"), None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        links = materialise(_star(_star(links, large=True), large=False), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
