"""Array arithmetic for logits, probabilities and embeddings."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def argmax(values: Column) -> Column:
    """0-based place of the largest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def _each(values: Column, one: Column) -> Column:
    """One value repeated beside every element; inside a lambda it would be computed per element."""
    return F.array_repeat(one, F.size(values))


def softmax(logits: Column) -> Column:
    """Probabilities; the maximum is taken off first, so large logits stay finite."""
    grown = F.zip_with(logits, _each(logits, F.array_max(logits)), lambda x, top: F.exp(x - top))
    total = F.aggregate(grown, F.lit(0.0), lambda acc, x: acc + x)
    return F.zip_with(grown, _each(logits, total), lambda x, whole: x / whole)


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def class_means(vectors: DataFrame, column: str, label: str) -> DataFrame:
    """Mean vector per class; the ML summarizer adds vectors up without exploding them."""
    as_vector = vectors.select(label, array_to_vector(F.col(column)).alias("_v"))
    return as_vector.groupBy(label).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("mean"))


def mean_logits(vectors: DataFrame, column: str, label: str) -> DataFrame:
    """Logits by class mean: one dot product per class, in label order.

    The means are one row of classes x width, attached as a scalar subquery.
    """
    means = class_means(vectors, column, label)
    table = means.agg(F.array_sort(F.collect_list(F.struct(label, "mean"))).alias("m"))
    return vectors.withColumn("_means", table.scalar()).withColumn(
        "logits", F.transform("_means", lambda c: dot(c["mean"], F.col(column)))
    ).drop("_means")
