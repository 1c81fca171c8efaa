"""Metrics of predicted classes, all derived from one confusion aggregate."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkgauge.functions.hashing import row_seed, unit
from talkgauge.functions.scoring import HIGHEST, LOWEST
from talkgauge.functions.vectors import argmax
from talkgauge.operators.scale import attach, filter_after, range_splits, split_number
from talkgauge.session import materialize


def _div(a: Column, b: Column) -> Column:
    """0 where the metric is undefined."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(predictions: DataFrame, label: str = "label", predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """Rows per (true, predicted) class: at most classes squared rows, whatever the input."""
    return predictions.groupBy(*by, F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def accuracy(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    hit = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0))
    return cells.groupBy(*by).agg((hit / F.sum("n")).alias("accuracy"))


def per_class(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class that occurs as truth or prediction.

    Each cell counts once for its true and once for its predicted class, so one
    aggregate replaces a join of two.
    """
    hit = F.col("label") == F.col("predicted")
    views = F.array(
        F.struct(F.col("label").alias("class"), F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("tp"),
                 F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called")),
    )
    sums = cells.select(*by, F.explode(views).alias("v")).groupBy(*by, F.col("v.class").alias("class")).agg(
        F.sum("v.tp").alias("tp"), F.sum("v.support").alias("support"), F.sum("v.called").alias("called")
    )
    rated = sums.select(
        *by, "class", "support", _div(F.col("tp"), F.col("called")).alias("precision"), _div(F.col("tp"), F.col("support")).alias("recall")
    )
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", _div(2 * p * r, p + r))


def averages(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro and support-weighted averages of precision, recall and F1."""
    rated = per_class(cells, by)
    names = ("precision", "recall", "f1")
    return rated.groupBy(*by).agg(
        *[F.avg(c).alias(f"macro_{c}") for c in names],
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in names],
        F.sum("support").alias("support"),
    )


def full_confusion(cells: DataFrame) -> DataFrame:
    """All cells of the matrix, zeros included.

    The class list is one sorted array from the aggregated cells; exploding it
    twice gives the grid.
    """
    classes = cells.agg(F.array_sort(F.array_distinct(F.concat(F.collect_set("label"), F.collect_set("predicted")))).alias("c"))
    grid = classes.select(F.explode("c").alias("label"), "c").select("label", F.explode("c").alias("predicted"))
    return grid.join(cells, ["label", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def row_shares(cells: DataFrame) -> DataFrame:
    """Cells as share of their true class, and the whole percent; null for a class without true rows."""
    rows = W.partitionBy("label")
    total = F.sum("n").over(rows)
    share = F.when(total > 0, F.col("n") / total)
    return full_confusion(cells).withColumn("share", share).withColumn("percent", F.floor(F.col("share") * 100).cast("int"))


def report(cells: DataFrame) -> DataFrame:
    """Tall report: one row per class, then accuracy, macro and weighted averages."""
    classes = per_class(cells).select(F.concat(F.lit("class "), F.col("class").cast("string")).alias("entry"), "precision", "recall", "f1", "support")
    mean = averages(cells)
    none = F.lit(None).cast("double")
    return (
        classes.unionByName(
            mean.select(F.lit("macro avg").alias("entry"), F.col("macro_precision").alias("precision"),
                        F.col("macro_recall").alias("recall"), F.col("macro_f1").alias("f1"), "support")
        )
        .unionByName(
            mean.select(F.lit("weighted avg").alias("entry"), F.col("weighted_precision").alias("precision"),
                        F.col("weighted_recall").alias("recall"), F.col("weighted_f1").alias("f1"), "support")
        )
        .unionByName(
            cells.agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("_h"))
            .select(F.lit("accuracy").alias("entry"), none.alias("precision"), none.alias("recall"), (F.col("_h") / F.col("support")).alias("f1"), "support")
        )
    )


def metric_rows(cells: DataFrame, run: str, phase: str) -> DataFrame:
    """The run-history form: ``(run, phase, metric, class, value)``."""
    tall = report(cells).select("entry", F.explode(F.create_map(
        F.lit("precision"), "precision", F.lit("recall"), "recall", F.lit("f1"), "f1", F.lit("support"), F.col("support").cast("double")
    )).alias("metric", "value"))
    return tall.filter(F.col("value").isNotNull()).select(
        F.lit(run).alias("run"), F.lit(phase).alias("phase"), "metric", F.col("entry").alias("class"), "value"
    )


# --- combining models --------------------------------------------------------------------


def vote(probabilities: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    """Soft vote of models whose probabilities stand side by side: weighted mean per class."""
    weights = list(weights) if weights is not None else [1.0] * len(probabilities)
    total = float(sum(weights))

    def scaled(column: Column, w: float) -> Column:
        return F.transform(column, lambda p: p * F.lit(w / total))

    mixed = scaled(probabilities[0], weights[0])
    for column, w in zip(probabilities[1:], weights[1:]):
        mixed = F.zip_with(mixed, scaled(column, w), lambda a, b: a + b)
    return mixed


def vote_tall(rows: DataFrame, key: str, probabilities: str = "probabilities", weight: str = "weight") -> DataFrame:
    """The same for one row per (item, model): averaged per class position, then the best class."""
    # Partitioned by item first: both groupings below then need no further shuffle.
    spread = rows.repartition(key).select(key, weight, F.posexplode(probabilities).alias("class", "p"))
    mean = spread.groupBy(key, "class").agg((F.sum(F.col("p") * F.col(weight)) / F.sum(weight)).alias("p"))
    lists = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "p"))), lambda s: s["p"]).alias("probabilities"))
    return lists.withColumn("predicted", argmax(F.col("probabilities")))


# --- ranking quality ---------------------------------------------------------------------


def roc_auc(scored: DataFrame, score: str = "score", positive: str = "positive", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half; one row per group of ``by``, such as a class.

    Scores are first counted, then summed up in two levels: over ranges of the
    score, and inside each range.  No task sees all scores.  The counts are
    written once, as three passes read them.
    """
    wins = F.col(positive).cast("boolean")
    counted = scored.groupBy(*by, F.col(score).alias("_s")).agg(F.count_if(wins).alias("pos"), F.count_if(~wins).alias("neg"))
    counted = materialize(counted, "scores")
    ranged = counted.withColumn("_r", split_number(F.col("_s"), range_splits(counted, "_s")))
    totals = ranged.groupBy(*by, "_r").agg(F.sum("neg").alias("_n"))
    earlier = W.partitionBy(*by).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*by, "_r", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*by, "_r").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0)) + F.col("_before")
    placed = attach(ranged, offsets, [*by, "_r"]).withColumn("below", below)
    won = F.sum(F.col("pos").cast("double") * (F.col("below") + F.col("neg") / 2))
    return placed.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), won.alias("_won")).select(
        *by, "positives", "negatives",
        F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("_won") / F.col("positives") / F.col("negatives")).alias("auc"),
    )


def class_auc(predictions: DataFrame) -> DataFrame:
    """AUC of every class against the rest by its probability, and their mean over the classes that have one."""
    each = predictions.select("label", F.posexplode("probabilities").alias("class", "score"))
    rows = roc_auc(each.select("class", "score", (F.col("label") == F.col("class")).alias("positive")), by=["class"])
    return rows.withColumn("mean_auc", rows.agg(F.avg("auc")).scalar())


def threshold_table(scored: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """True and false positive rate of every score threshold 1..10, with Youden's J.

    Rows are counted per score first: ten rows meet ten thresholds.
    """
    wins = F.col(positive).cast("boolean")
    counted = scored.groupBy(score).agg(F.count_if(wins).alias("pos"), F.count_if(~wins).alias("neg"))
    reached = counted.select(score, "pos", "neg", F.explode(F.sequence(F.lit(LOWEST), F.lit(HIGHEST))).alias("threshold"))
    above = F.col(score) >= F.col("threshold")
    sums = reached.groupBy("threshold").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
    )
    tpr, fpr = _div(F.col("tp"), F.col("_p")), _div(F.col("fp"), F.col("_n"))
    return sums.select("threshold", "tp", "fp", tpr.alias("tpr"), fpr.alias("fpr"), (tpr - fpr).alias("youden"))


# Chance that a Poisson(1) draw is at most 0, 1, 2, ...: beyond these the steps are below double precision.
POISSON_ONE = tuple(accumulate(math.exp(-1) / math.factorial(k) for k in range(18)))


def replicate_cells(predictions: DataFrame, key: str, replicates: int = 100, seed: int = 42) -> DataFrame:
    """Confusion cells of every Poisson bootstrap replicate.

    Each row draws its weight per replicate from a hash of its key, so replicates
    need no shuffle of rows: partial sums per replicate and cell are all that moves.
    """
    seeded = predictions.select(row_seed(key, seed).alias("_start"), "label", "predicted")
    drawn = seeded.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    drawn = drawn.withColumn("_u", unit(F.col("_start"), F.col("replicate")))
    weight = F.lit(len(POISSON_ONE))
    for k, p in reversed(list(enumerate(POISSON_ONE))):
        weight = F.when(F.col("_u") < p, k).otherwise(weight)
    cells = drawn.groupBy("replicate", "label", "predicted").agg(F.sum(weight).alias("n"))
    return cells.filter("n > 0")


def _interval(value: str, level: float) -> list[Column]:
    tail = (1 - level) / 2
    return [F.avg(value).alias("mean"), F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(1 - tail)).alias("high")]


def bootstrap(predictions: DataFrame, key: str, replicates: int = 100, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Confidence interval of accuracy by Poisson bootstrap."""
    cells = replicate_cells(predictions, key, replicates, seed)
    return accuracy(cells, ["replicate"]).agg(*_interval("accuracy", level))


def metric_intervals(predictions: DataFrame, key: str, replicates: int = 100, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Confidence intervals of accuracy and of the averaged metrics, one row per metric.

    The cells, at most classes squared per replicate, are written once.
    """
    cells = materialize(replicate_cells(predictions, key, replicates, seed), "replicates")
    both = accuracy(cells, ["replicate"]).join(averages(cells, ["replicate"]), "replicate")
    names = [c for c in both.columns if c not in ("replicate", "support")]
    tall = both.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names])))
    return tall.groupBy("metric").agg(*_interval("value", level))


# --- looking at errors -------------------------------------------------------------------


def low_confidence(predictions: DataFrame, key: str, n: int = 100, probabilities: str = "probabilities") -> DataFrame:
    """The ``n`` least certain rows, for review."""
    sure = predictions.withColumn("confidence", F.array_max(probabilities))
    return sure.orderBy("confidence", key).limit(n)


def misclassified(predictions: DataFrame) -> DataFrame:
    return filter_after(predictions, F.col("label") != F.col("predicted"))


def label_errors(predictions: DataFrame, label: str = "label", probabilities: str = "probabilities") -> DataFrame:
    """Rows whose out-of-fold probabilities argue for another label (confident learning).

    A class's bar is the mean probability it gets on its own rows.  A row is a
    candidate when some other class clears its bar and is the likeliest of those
    that do.  Labels must be positions in the probability array.
    """
    own = F.get(F.col(probabilities), F.col(label))
    bars = predictions.groupBy(F.col(label).alias("_c")).agg(F.avg(own).alias("_bar"))
    bar_map = bars.agg(F.map_from_entries(F.collect_list(F.struct("_c", "_bar")))).scalar()
    marked = predictions.withColumn("_bars", bar_map)
    cleared = F.transform(
        F.col(probabilities), lambda p, i: F.when(p >= F.try_element_at(F.col("_bars"), i), p).otherwise(F.lit(-1.0))
    )
    marked = marked.withColumn("_cleared", cleared)
    suggested = F.when(F.array_max("_cleared") >= 0, argmax(F.col("_cleared")))
    judged = marked.withColumn("suggested", suggested)
    return filter_after(judged, F.col("suggested") != F.col(label)).drop("_bars", "_cleared")


# --- relevance diagnostics ---------------------------------------------------------------


def recency_shift(weighted_rows: DataFrame) -> DataFrame:
    """Weighted against plain mean of all scores, in one aggregate."""
    sums = weighted_rows.agg(
        (F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("weighted_mean"), F.avg("score").alias("plain_mean")
    )
    return sums.withColumn("shift_percent", 100.0 * (F.col("weighted_mean") - F.col("plain_mean")) / F.col("plain_mean"))


def ablation(weighted_rows: DataFrame, min_score: float) -> DataFrame:
    """Mean score with and without decay and threshold: four variants from one pass."""
    keep, w, s = F.col("score") >= min_score, F.col("weight"), F.col("score")
    sums = weighted_rows.agg(
        (F.sum(F.when(keep, s * w)) / F.sum(F.when(keep, w))).alias("decay+threshold"),
        F.avg(F.when(keep, s)).alias("threshold"),
        (F.sum(s * w) / F.sum(w)).alias("decay"),
        F.avg(s).alias("none"),
    )
    return sums.unpivot([], ["decay+threshold", "threshold", "decay", "none"], "variant", "mean_score")


def signal_to_noise(weighted_rows: DataFrame, signal_from: float, min_score: float) -> DataFrame:
    """Signal weight over noise weight, before and after the threshold; null without noise."""
    signal, keep, w = F.col("score") >= signal_from, F.col("score") >= min_score, F.col("weight")
    sums = weighted_rows.agg(
        F.sum(F.when(signal, w).otherwise(0.0)).alias("_s"), F.sum(F.when(~signal, w).otherwise(0.0)).alias("_n"),
        F.sum(F.when(signal & keep, w).otherwise(0.0)).alias("_sk"), F.sum(F.when(~signal & keep, w).otherwise(0.0)).alias("_nk"),
    )
    return sums.select(
        F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).alias("before"),
        F.when(F.col("_nk") > 0, F.col("_sk") / F.col("_nk")).alias("after"),
    )
