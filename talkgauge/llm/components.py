"""Connected components of a table of links, by rounds of stars, without collecting any link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgauge.session import materialize


def _pointed(links: DataFrame, both_ways: bool) -> DataFrame:
    """One star round: neighbours of a node (all, or the smaller ones) are linked with its least neighbour.

    The least neighbour is a partial aggregate before the shuffle, and the join back has one row per node on one
    side, so a node with very many links is split by the adaptive skew join.
    """
    ends = links
    if both_ways:
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ends.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = ends.join(least, "a")
    if both_ways:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; the root is the least node of the component."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "links")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = state(edges)
    while now[0]:
        edges = materialize(_pointed(_pointed(edges, True), False), "links")
        before, now = now, state(edges)
        if now == before:
            break
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
