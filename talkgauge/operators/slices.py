"""Search for the slices of a dataset on which a model does worst."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slice_search(rows: DataFrame, dimensions: Sequence[str], hit: str = "hit", least_rows: int = 20, least_effect: float = 0.1,
                 depth: int = 2) -> DataFrame:
    """Slices by one to ``depth`` dimensions with accuracy, that of all other rows, and the effect size between them.

    One pass with grouping sets counts all slices at once; the smallest ones are pruned by ``least_rows``.  The effect
    is the difference of accuracies over their pooled deviation; slices on which the model is worse by ``least_effect``
    or more stay.  A slice that holds all rows has nothing to be compared with and is left out, as is one where both
    deviations are zero.  Dimensions that a slice does not cut by are named in ``free``, since a null is a value too.
    """
    names = list(dimensions)
    sets = [list(c) for size in range(min(depth, len(names)) + 1) for c in combinations(names, size)]
    free = F.concat_ws(",", *[F.when(F.grouping(c) == 1, F.lit(c)) for c in names])
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), free.alias("free")
    )
    total = rows.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))).scalar()
    rest = (F.col("_t.n") - F.col("n")).alias("_m")
    inner, outer = F.col("accuracy"), F.col("rest_accuracy")
    spread = F.sqrt((inner * (1 - inner) + outer * (1 - outer)) / 2)
    compared = grouped.filter(F.col("n") >= least_rows).withColumn("_t", total).withColumn("_m", rest).filter(F.col("_m") > 0)
    measured = compared.withColumns({
        "accuracy": F.col("hits") / F.col("n"), "rest_accuracy": (F.col("_t.hits") - F.col("hits")) / F.col("_m"),
    }).withColumn("effect", F.when(spread > 0, (outer - inner) / spread))
    return measured.filter(F.col("effect") >= least_effect).select(*names, "free", "n", "accuracy", "rest_accuracy", "effect")
