"""History condensed to cells of 1, 2, 4, ... days that merge as they age.

Cells are blocks of ``2**k`` days, aligned to multiples of their length.  A day lies in the largest block whose last day is
at least ``2**k`` days old; as time passes a block can only be taken into a larger one, so cells merge and never split, and a
late message finds the cell its day belongs to.  A chat keeps at most four cells for each length: their number grows with
the logarithm of its age.

A cell keeps sums without decay, so any half-life can be asked for later.  Counts and sums of scores stay exact; only the
time of a message within its cell is given up, and its weight lies between those of the earliest and the latest one.
Chats without a qualifying message keep a zero row; rows without a time or a score are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgauge.functions.decay import MICROS_PER_DAY, to_micros, weight
from talkgauge.functions.scoring import MIN_SCORE
from talkgauge.operators.keys import PAIR
from talkgauge.operators.relevance import ratio

# Blocks of up to 2**20 days reach over 2,800 years.
MAX_TIER = 20
CELL = ["first_day", "tier"]


def tier_of(day: Column, today: int) -> Column:
    """The largest ``k`` whose block around ``day`` ended at least ``2**k`` days before ``today``."""
    tier = F.lit(0)
    for k in range(1, MAX_TIER + 1):
        last_day = day - F.pmod(day, F.lit(1 << k)) + ((1 << k) - 1)
        # If a block is old enough so are the smaller ones inside it, so the lengths that fit can be counted.
        tier = tier + (F.lit(today) - last_day >= (1 << k)).cast("int")
    return tier


def _merged(cells: DataFrame, as_of) -> DataFrame:
    today = to_micros(as_of) // MICROS_PER_DAY
    placed = cells.withColumn("tier", tier_of(F.col("first_day"), today))
    first = F.expr("first_day - pmod(first_day, shiftleft(1L, tier))")
    return placed.withColumn("first_day", first).groupBy(*PAIR, *CELL).agg(
        *[F.sum(c).alias(c) for c in ("n_messages", "n_scored", "score_sum", "time_sum")],
        F.min("min_us").alias("min_us"), F.max("max_us").alias("max_us"),
    )


def cells(scored: DataFrame, as_of, min_score: float = MIN_SCORE) -> DataFrame:
    """Cells of scored rows (``mean_us``, ``score``, ``n_messages``) at ``as_of``: one hash aggregate, safe for a huge chat."""
    keep = F.col("score") >= min_score
    us = F.when(keep, F.col("mean_us"))
    rows = scored.filter("mean_us is not null and score is not null").select(
        *PAIR, F.floor(F.col("mean_us") / MICROS_PER_DAY).cast("bigint").alias("first_day"),
        F.col("n_messages").cast("bigint").alias("n_messages"), keep.cast("bigint").alias("n_scored"),
        F.when(keep, F.col("score")).otherwise(0).cast("double").alias("score_sum"),
        F.coalesce(us, F.lit(0)).cast("decimal(18,0)").alias("time_sum"), us.alias("min_us"), us.alias("max_us"),
    )
    return _merged(rows, as_of).withColumn("time_sum", F.col("time_sum").cast("decimal(38,0)"))


def advance(stored: DataFrame, scored: DataFrame, as_of, min_score: float = MIN_SCORE) -> DataFrame:
    """Stored cells carried to ``as_of``, with new or late rows; equal to ``cells`` over all rows."""
    added = cells(scored, as_of, min_score)
    return _merged(stored.unionByName(added), as_of).withColumn("time_sum", F.col("time_sum").cast("decimal(38,0)"))


def chat_scores(stored: DataFrame, as_of, half_life_days: float) -> DataFrame:
    """Score of each chat from its cells, and the bounds ``low`` and ``high`` within which the score of the messages lies."""
    mean_us = F.expr("time_sum div n_scored")
    wt = lambda us: F.when(F.col("n_scored") > 0, weight(us, as_of, half_life_days)).otherwise(0.0)
    mid, least, most = wt(mean_us), wt(F.col("min_us")), wt(F.col("max_us"))
    n, total = F.col("n_scored"), F.col("score_sum")
    sums = stored.groupBy(*PAIR).agg(
        F.sum("n_messages").alias("n_messages"), F.count(F.lit(1)).alias("n_cells"),
        F.sum(total * mid).alias("weighted_sum"), F.sum(n * mid).alias("weight_sum"),
        F.sum(total * least).alias("_a"), F.sum(n * most).alias("_b"), F.sum(total * most).alias("_c"), F.sum(n * least).alias("_d"),
    )
    score = ratio(F.col("weighted_sum"), F.col("weight_sum"), 0.0)
    return sums.select(*PAIR, "n_messages", "n_cells", "weighted_sum", "weight_sum", score.alias("score"),
                       ratio(F.col("_a"), F.col("_b"), 0.0).alias("low"), ratio(F.col("_c"), F.col("_d"), 0.0).alias("high"))
