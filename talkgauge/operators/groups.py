"""Splits whose parts hold no near copies of each other: components of similar texts are dealt as units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkgauge.functions.hashing import hash_place
from talkgauge.operators import neardup
from talkgauge.operators.scale import HOT_ROWS, PREFIX_DIGITS, keyed_join
from talkgauge.session import materialize


def _least_neighbour(links: DataFrame, upward: bool) -> DataFrame:
    """One star step: neighbours of every node above it (or below) are linked to the least it knows."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if upward else links
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = near.join(least, "a")
    if upward:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        own = least.select("a", F.col("m").alias("b"))
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(id, root)`` of every linked id that is not the least of its component, ``root`` being that least.

    ``links`` has columns ``a`` and ``b``.  Star steps over the links alone, written after each round; they end when
    links stay as they are, after about the logarithm of the longest chain.  Links with a null end or to itself count
    for nothing.
    """
    apart = links.filter(F.col("a") != F.col("b"))
    now = materialize(apart.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        digest = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        seen = now.agg(F.count(F.lit(1)), digest).first()
        if seen == state or seen[0] == 0:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        state = seen
        now = materialize(_least_neighbour(_least_neighbour(now, upward=True), upward=False), "links")


def similar_groups(df: DataFrame, key: str = "id", text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with ``group``: the least key that is reached over copies and near copies.

    Copies hang on their first text, so a group of copies adds a link for each row and none between copies.
    """
    copies, similar = neardup.links(df, key, text, hot_rows)
    ends = [F.col(key).alias("a"), F.col("first").alias("b")]
    roots = components(copies.select(*ends).unionByName(similar.select(*ends)))
    named = roots.select(F.col("id").alias(key), F.col("root").alias("group"))
    return df.join(named, key, "left").withColumn("group", F.coalesce("group", key))


def _cut(share: float) -> Column:
    return F.floor(F.col("n") * F.lit(share) + F.lit(0.5))


def split_groups(df: DataFrame, group: str = "group", label: str = "label", train: float = 0.70, val: float = 0.15,
                 seed: int = 42) -> DataFrame:
    """``df`` with ``split``: whole groups in train, val or test, each class cut near the shares.

    A group counts for the class most of its rows have, ties for the least class.  Groups of a class lie one after
    another in hash order, those with more rows than half the smallest part first; a group goes where its first row
    lies, so the rows of a part miss its share by less than the largest group.  Places come from sums over ``65536``
    hash ranges for each class, and from a window within one range: no class passes through one task.  Null labels are
    a class, null groups a group.
    """
    counted = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("_c"))
    most = F.min(F.struct((-F.col("_c")).alias("c"), F.col(label).alias("l")))
    units = counted.groupBy(group).agg(F.sum("_c").alias("_size"), most["l"].alias("_class"))
    units = materialize(units.withColumn("_place", hash_place(F.coalesce(F.col(group).cast("string"), F.lit("")), seed)), "units")
    totals = units.groupBy("_class").agg(F.sum("_size").alias("n"))
    placed = keyed_join(units, F.broadcast(totals), "_class", null_safe=True)
    least = min(train, val, 1 - train - val)
    large = F.col("_size") > F.col("n") * F.lit(least / 2)
    # Large groups are few (at most 2 / least for each class); they take the first range of their class.
    ranged = placed.withColumn("_range", F.when(large, F.lit("")).otherwise(F.substring("_place", 1, PREFIX_DIGITS)))
    sums = ranged.groupBy("_class", "_range").agg(F.sum("_size").alias("_rows"))
    before = F.sum("_rows").over(W.partitionBy("_class").orderBy("_range")) - F.col("_rows")
    starts = sums.select("_class", "_range", before.alias("_before"))
    inside = F.sum("_size").over(W.partitionBy("_class", "_range").orderBy("_place", group).rowsBetween(W.unboundedPreceding, 0))
    ranked = ranged.withColumn("_inside", inside - F.col("_size"))
    ranked = keyed_join(ranked, starts, ["_class", "_range"], null_safe=True)
    first = F.col("_before") + F.col("_inside")
    name = F.when(first < _cut(train), "train").when(first < _cut(train + val), "val").otherwise("test")
    return keyed_join(df, ranked.select(group, name.alias("split")), group, null_safe=True)
