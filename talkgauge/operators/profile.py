"""What a labelled-text table looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgauge.config import IMBALANCE_WARNING, TRUNCATION_WARNING_PERCENT
from talkgauge.functions.scoring import content_key
from talkgauge.functions.textclean import raw_word_count, special_share

QUANTILES = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p95": 0.95}


def size(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows and distinct texts; texts travel as 32-byte digests."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(F.unhex(F.sha2(text, 256))).alias("distinct_texts"))


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / df.agg(F.count(F.lit(1))).scalar())


def imbalance(df: DataFrame, label: str = "label") -> DataFrame:
    """Largest over smallest class, and whether that deserves a warning."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    ratio = F.max("n") / F.min("n")
    return counts.agg(
        F.max("n").alias("largest"), F.min("n").alias("smallest"), ratio.alias("ratio"),
        (ratio > IMBALANCE_WARNING).alias("imbalanced"),
    )


def length_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows per word count: at most one row per length, so exact quantiles stay cheap."""
    return df.select(raw_word_count(F.col(text)).alias("words")).groupBy("words").agg(F.count(F.lit(1)).alias("n"))


def quantile(value: str, weight: str, at: float) -> Column:
    """Exact, linearly interpolated quantile of pre-counted values."""
    return F.percentile(F.col(value), F.lit(at), F.col(weight))


def length_stats(df: DataFrame, text: str = "text", max_length: int = 256) -> DataFrame:
    """Mean, extremes, quantiles and the share above ``max_length``, from one pass over the texts.

    Where more texts would be cut than the profile's limit, ``cut_warning`` is set and ``suggested_length`` is the 95 %
    quantile in whole words; else it is ``max_length``.
    """
    above = 100.0 * F.sum(F.when(F.col("words") > max_length, F.col("n")).otherwise(0)) / F.sum("n")
    warned = above > TRUNCATION_WARNING_PERCENT
    return length_counts(df, text).agg(
        (F.sum(F.col("words") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("words").alias("shortest"),
        F.max("words").alias("longest"),
        *[quantile("words", "n", at).alias(name) for name, at in QUANTILES.items()],
        above.alias("percent_above"), warned.alias("cut_warning"),
        F.when(warned, F.floor(quantile("words", "n", QUANTILES["p95"]))).otherwise(max_length).cast("int").alias("suggested_length"),
    )


def stats_record(df: DataFrame, text: str = "text", label: str = "label", max_length: int = 256) -> DataFrame:
    """One row to store with a dataset; the class distribution is a map."""
    classes = class_distribution(df, label).agg(
        F.count(F.lit(1)).alias("num_classes"),
        F.sum("n").alias("total_samples"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(label).cast("string"), "n")))).alias("class_distribution"),
    )
    lengths = length_stats(df, text, max_length).select(F.struct("mean", "median", "longest"))
    return classes.withColumn("_l", lengths.scalar()).select(
        "total_samples", "num_classes", "class_distribution", F.col("_l.mean").alias("text_length_mean"),
        F.col("_l.median").alias("text_length_median"), F.col("_l.longest").alias("text_length_max"),
    )


def cleaning_report(cleaned: DataFrame, text: str = "text_cleaned") -> DataFrame:
    """Before, emptied, duplicates, after, removed: one pass over cleaned rows."""
    filled = F.length(text) > 0
    counted = cleaned.agg(
        F.count(F.lit(1)).alias("original"),
        F.count_if(~filled).alias("emptied"),
        F.count_distinct(F.when(filled, F.unhex(F.sha2(text, 256)))).alias("cleaned"),
    )
    removed = F.col("original") - F.col("cleaned")
    return counted.select(
        "original", "emptied", (removed - F.col("emptied")).alias("duplicates"), "cleaned", removed.alias("removed"),
        F.when(F.col("original") > 0, 100.0 * removed / F.col("original")).otherwise(0.0).alias("removed_percent"),
    )


def duplicate_count(df: DataFrame, text: str = "text") -> DataFrame:
    return size(df, text).select((F.col("total") - F.col("distinct_texts")).alias("duplicates"))


def outliers(df: DataFrame, key: str, text: str = "text", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows outside the ``low``..``high`` quantiles of length, or above ``high`` in special characters.

    The share is kept to four places, so its distribution has at most 10,001
    values and its exact quantile needs no sketch.
    """
    measured = df.select(key, raw_word_count(F.col(text)).alias("words"), F.round(special_share(F.col(text)), 4).alias("special"))
    words = measured.groupBy("words").agg(F.count(F.lit(1)).alias("n"))
    special = measured.groupBy("special").agg(F.count(F.lit(1)).alias("n"))
    word_limits = words.agg(F.struct(quantile("words", "n", low).alias("low"), quantile("words", "n", high).alias("high")))
    limited = measured.withColumn("_w", word_limits.scalar()).withColumn(
        "_s", special.agg(quantile("special", "n", high)).scalar()
    )
    return limited.select(
        key, "words", "special",
        (F.col("words") < F.col("_w.low")).alias("too_short"),
        (F.col("words") > F.col("_w.high")).alias("too_long"),
        (F.col("special") > F.col("_s")).alias("too_special"),
    )


def conflicting_labels(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Texts that carry more than one label."""
    grouped = df.groupBy(content_key(F.col(text)).alias("text_key")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("labels")
    )
    return grouped.filter(F.col("labels") > 1)


def version_hash(df: DataFrame, *columns: str) -> DataFrame:
    """Fingerprint of a table: independent of row order, sensitive to content and copies."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (columns or df.columns)]
    row = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    total = F.coalesce(F.sum(row), F.lit(0)).cast("string")
    return df.agg(F.count(F.lit(1)).alias("n"), total.alias("_total")).select(
        "n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), "_total"), 256).alias("version")
    )
