"""Calibrated probabilities: isotonic regression over counted scores, reliability bins, expected calibration error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 1_000
BINS = 10


def step_of(score: Column, steps: int = STEPS) -> Column:
    """Step 0..steps-1 of a probability; 1 falls into the last step, null stays null."""
    return F.least(F.floor(score * F.lit(steps)), F.lit(steps - 1)).cast("int")


def counted(scored: DataFrame, score: str = "score", positive: str = "positive", steps: int = STEPS) -> DataFrame:
    """Rows and positives for each step: at most ``steps`` rows, whatever the input.  Rows without a score are left out."""
    return scored.filter(F.col(score).isNotNull()).groupBy(step_of(F.col(score), steps).alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(positive).cast("boolean")).alias("pos")
    )


def fit(counts: DataFrame) -> IsotonicRegressionModel:
    """Monotone share of positives by step (pool adjacent violators), steps weighted by their rows.

    No more than the counted steps reach the one task that pools the last of them.
    """
    rows = counts.select(
        F.col("step").cast("double").alias("features"), (F.col("pos") / F.col("n")).alias("label"), F.col("n").cast("double").alias("weight")
    )
    return IsotonicRegression(featuresCol="features", weightCol="weight").fit(rows)


def calibrated(scored: DataFrame, model: IsotonicRegressionModel, score: str = "score", steps: int = STEPS,
               out: str = "calibrated") -> DataFrame:
    """``scored`` with the share of positives expected at its score.

    Between two fitted steps the share lies on the line between theirs, outside it is that of the nearest step.  Without
    a score it is null.
    """
    known = F.col(score).isNotNull()
    place = F.coalesce(step_of(F.col(score), steps).cast("double"), F.lit(0.0))
    rows = scored.withColumn("_place", array_to_vector(F.array(place)))
    moved = model.copy({model.featuresCol: "_place", model.predictionCol: "_share"}).transform(rows)
    return moved.withColumn(out, F.when(known, F.col("_share"))).drop("_place", "_share")


def reliability(scored: DataFrame, score: str = "score", positive: str = "positive", bins: int = BINS,
                by: Sequence[str] = ()) -> DataFrame:
    """Rows, mean probability, share of positives and their gap for each bin of the probability."""
    named = scored.filter(F.col(score).isNotNull()).withColumn("bin", step_of(F.col(score), bins))
    sums = named.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.avg(F.col(positive).cast("int")).alias("share")
    )
    return sums.withColumn("gap", F.abs(F.col("share") - F.col("mean")))


def calibration_error(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error: gaps weighted by rows; and the largest gap."""
    return bins.groupBy(*by).agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("error"), F.max("gap").alias("largest_gap"))
