"""Helpers that keep joins and ranks safe under skew and growth."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkgauge.functions.hashing import hash_place

BROADCAST_ROWS = 100_000
HOT_ROWS = 2_000_000
SPLIT_POINTS = 16_384
PREFIX_DIGITS = 4


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """A small result computed once, or ``df`` itself when it is not small.

    At most ``max_rows + 1`` rows reach the driver, which a broadcast of the
    same rows would need as well.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True


def keyed_join(left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "inner",
               null_safe: bool = False) -> DataFrame:
    """Equi-join on equally named columns; ``null_safe`` lets null keys meet."""
    on = [on] if isinstance(on, str) else list(on)
    if not null_safe:
        return left.join(right, on, how)
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in on})
    meets = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in on])
    return left.join(renamed, meets, how).drop(*[f"_right_{k}" for k in on])


def attach(big: DataFrame, small: DataFrame, on: Sequence[str] | str, how: str = "inner",
           max_rows: int = BROADCAST_ROWS, null_safe: bool = False) -> DataFrame:
    """Join a large side with a usually small one.

    The small side is broadcast only after its rows were counted; beyond the
    bound the join shuffles, and AQE splits skewed partitions.
    """
    side, is_small = bounded(small, max_rows)
    return keyed_join(big, F.broadcast(side) if is_small else side, on, how, null_safe)


def filter_after(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on computed columns without computing them twice.

    A plain filter is pushed below the projections it reads and repeats their
    expressions there, model calls included; a generator stays where it is.
    """
    return df.select("*", F.explode(F.when(condition, F.array(F.lit(True)))).alias("_keep")).drop("_keep")


def split_join(rows: DataFrame, per_key: DataFrame, on: Sequence[str], n: str = "_n", hot_rows: int = HOT_ROWS,
               max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of rows with a written one-row-per-key table that counts them in ``n``.

    Keys with more than ``hot_rows`` rows meet a broadcast of just those keys, so
    their rows stay where they are; there are at most total / ``hot_rows`` of
    them.  All other keys shuffle.  Together that is the plain join.
    """
    hot = per_key.filter(F.col(n) > hot_rows)
    found = hot.limit(max_rows + 1).collect()
    if not found or len(found) > max_rows:
        return rows.join(per_key, on)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, per_key.schema))
    crowded = rows.join(hot, on)
    others = rows.join(hot.select(*on), on, "left_anti").join(per_key.filter(F.col(n) <= hot_rows), on)
    return crowded.unionByName(others)


def order_rank(df: DataFrame, keys: Sequence[str], order: str, tie: str, out: str = "rn", descending: bool = False,
               hot_rows: int = HOT_ROWS, split_points: int = SPLIT_POINTS) -> DataFrame:
    """Exact 1-based rank by ``(order, tie)`` inside each key, from the first or the last.

    A plain window puts a whole key into one task.  When a key exceeds
    ``hot_rows``, its rows are cut into consecutive cells, ranked per cell and
    shifted by the rows of the cells before.  Cell borders are rows picked by a
    hash of ``tie``, so equal times split as well; borders only steer the
    balance, every row is ranked.  About ``split_points`` borders exist in total.
    """
    keys = list(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    top, hot = counts.agg(
        F.coalesce(F.max("_n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("_n") > hot_rows, F.col("_n"))), F.lit(0))
    ).first()
    direction = F.desc if descending else F.asc
    places = [direction(order), direction(tie)]
    if top <= hot_rows:
        return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*places)).cast("bigint"))

    step = max(hot_rows // 4, hot // split_points, 1)
    place = F.struct(F.col(order).alias("o"), F.col(tie).alias("t"))
    hot_keys = counts.filter(F.col("_n") > hot_rows).select(*keys)
    borders, is_small = bounded(
        attach(df.filter(F.pmod(F.xxhash64(tie), F.lit(step)) == 0), hot_keys, keys, "left_semi", null_safe=True)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(place)).alias("_borders"))
    )
    borders = F.broadcast(borders) if is_small else borders
    cell = F.size(F.filter("_borders", lambda b: b <= place))
    # Rows per cell are needed for hot keys only; all other keys are a single cell.
    cells = keyed_join(df, borders, keys, "inner", null_safe=True).groupBy(*keys, cell.alias("_cell")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    before = W.partitionBy(*keys).orderBy(direction("_cell")).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .filter(F.col("_before") > 0)
        .drop("_n")
    )
    celled = (
        keyed_join(df, borders, keys, "left", null_safe=True)
        .withColumn("_cell", F.when(F.col("_borders").isNull(), 0).otherwise(cell))
        .drop("_borders")
    )
    inside = F.row_number().over(W.partitionBy(*keys, "_cell").orderBy(*places))
    return (
        attach(celled, offsets, keys + ["_cell"], "left", null_safe=True)
        .withColumn(out, inside + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_cell", "_before")
    )


def hash_cuts(df: DataFrame, group: str, key: str, seed: int | str, cuts: dict[str, Column]) -> DataFrame:
    """Hash places that cut each group at exact ranks, one row per group.

    ``cuts`` maps a name to the number of rows that come before the cut, given
    the group size ``n``.  The result holds ``group``, ``n`` and one column per
    cut: a row lies before the cut when its place is smaller.  A null cut lies
    behind the last row.

    Ranks are never computed for all rows: counts per hash prefix show which
    prefix holds a cut, and only that prefix is ranked.  Labelling the rows is
    then a plain projection, without a shuffle of the data.
    """
    placed = df.select(F.col(group).alias("_g"), hash_place(key, seed).alias("_h"))
    placed = placed.withColumn("_p", F.substring("_h", 1, PREFIX_DIGITS))
    cells = placed.groupBy("_g", "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(
        "_g", "_p", "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy("_g")).alias("n"),
    )
    # One row per group: where each cut lies and how many rows come before its prefix.
    names = list(cuts)
    ranked_cells = cells.withColumns({f"_rank_{c}": cuts[c].cast("bigint") for c in names})

    def spot(c: str) -> Column:
        rank = F.col(f"_rank_{c}")
        inside = (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_n"))
        return F.min(F.when(inside, F.struct(F.col("_p"), (rank - F.col("_before")).alias("_skip")))).alias(c)

    spots, _ = bounded(ranked_cells.groupBy("_g").agg(F.max("n").alias("n"), *[spot(c) for c in names]))
    wanted = spots.select("_g", F.explode(F.array(*[F.struct(F.lit(c).alias("_cut"), F.col(f"{c}._p"), F.col(f"{c}._skip")) for c in names])).alias("_w"))
    wanted = wanted.select("_g", "_w.*").filter(F.col("_p").isNotNull())
    targets = wanted.groupBy("_g", "_p").agg(F.map_from_entries(F.collect_list(F.struct("_cut", "_skip"))).alias("_skips"))
    inside = attach(placed, targets, ["_g", "_p"], null_safe=True)
    ranked = inside.withColumn("_rank", F.row_number().over(W.partitionBy("_g", "_p").orderBy("_h")) - 1)
    found = ranked.groupBy("_g").agg(
        *[F.min(F.when(F.col("_rank") == F.try_element_at("_skips", F.lit(c)), F.col("_h"))).alias(c) for c in names]
    )
    return keyed_join(spots.select("_g", "n"), found, "_g", "left", null_safe=True).withColumnRenamed("_g", group)


def before_cut(place: Column, cut: str) -> Column:
    return F.col(cut).isNull() | (place < F.col(cut))


def range_splits(df: DataFrame, column: str, parts: int = 256) -> list[float]:
    """At most ``parts - 1`` increasing split points of a numeric column."""
    probabilities = [i / parts for i in range(1, parts)]
    points = df.approxQuantile(column, probabilities, 0.5 / parts)
    return sorted(set(points))


def split_number(column: Column, splits: list[float]) -> Column:
    if not splits:
        return F.lit(0)
    points = F.array(*[F.lit(float(s)) for s in splits])
    return F.size(F.filter(points, lambda s: s <= column))
