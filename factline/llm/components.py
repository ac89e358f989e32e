"""Connected components by alternating stars, with one written step per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.session import cut_lineage


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Rows (node, root), one for each node of an edge (a, b): root is the smallest node it reaches.

    A round links the larger neighbours of every node to its smallest neighbour, then the smaller ones; what is left at
    the end are stars around the roots.  Neighbours are only reduced to their minimum, never listed, and the minimum is
    joined back to the edges; in that join the links of one node meet in one task unless Spark splits it.  Null ends are left out.
    Raises if the links have not settled in ``rounds`` rounds (they need about the logarithm of the longest path).
    """
    links = cut_lineage(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    state = _state(links)
    for _ in range(rounds):
        links = cut_lineage(_small_star(_large_star(links)))
        now = _state(links)
        if now == state:
            root = links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
            return root.unionByName(links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        state = now
    raise RuntimeError(f"components not settled after {rounds} rounds")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour, or to the node if that is smaller."""
    low = links.groupBy(F.col("hi").alias("at")).agg(F.min("lo").alias("m"))
    return links.join(low, links["lo"] == low["at"], "left").select("hi", F.coalesce("m", "lo").alias("lo"))


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of a node are linked to the smallest of them."""
    low = links.groupBy(F.col("hi").alias("at")).agg(F.min("lo").alias("m"))
    joined = links.join(low, links["hi"] == low["at"])
    return (
        joined.select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        .select("e.hi", "e.lo").where(F.col("hi") != F.col("lo")).distinct()
    )
