"""Connected components of a graph held as a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from datalathe.session import cut_lineage


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One half of an alternating round on links (a, b) with a < b.

    Large: every node gives its larger neighbours the smallest label near it. Small: every node
    gives itself and its smaller neighbours the smallest of them. Each keeps the components.
    """
    if small:
        near = links.select(F.col("b").alias("node"), F.col("a").alias("other"))
        moved = F.col("other")
    else:
        near = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(
            links.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        moved = F.when(F.col("other") > F.col("node"), F.col("other"))
    least = near.groupBy("node").agg(F.min("other").alias("low"))
    if not small:
        least = least.withColumn("low", F.least("node", "low"))
    # A plain join, so adaptive execution can split a node with very many links.
    pairs = near.join(least, "node").select("low", moved.alias("other"))
    if small:
        pairs = pairs.unionAll(least.select("low", F.col("node").alias("other")))
    return pairs.where("other > low").select(F.col("low").alias("a"), F.col("other").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of the links (a, b); component is its smallest node.

    Alternating large and small stars (Kiveris et al., 2014) until nothing changes, each round
    written to the shared folder. Rounds grow with the logarithm of the largest component.
    Null ends are ignored; loops and repeated links change nothing.
    """
    links = (
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    links = cut_lineage(links)
    state = _state(links)
    while True:
        after = cut_lineage(_star(_star(links, small=False), small=True))
        now = _state(after)
        links = after
        if now == state:
            break
        state = now
    stars = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return stars.unionAll(roots)


def _state(links: DataFrame) -> tuple:
    """Two sums that tell sets of links apart; in the final stars, each node has one link to its root."""
    hashed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(hashed), F.sum(F.hash("b", "a").cast("long"))).first())
