"""Bundles: groups of messages of one chat that are scored together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkgauge.functions.decay import day_number, micros
from talkgauge.functions.scoring import content_key
from talkgauge.operators.keys import PAIR
from talkgauge.operators.scale import HOT_ROWS, order_rank

BUNDLE = PAIR + ["bundle_id"]
MODES = ("message", "count", "daily")


def with_bundle_id(messages: DataFrame, mode: str = "count", size: int = 1, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Tag every message with its bundle.

    ``message`` (or ``count`` with size 1): one bundle per message; ``count``:
    runs of ``size`` messages in time order, the last may be short; ``daily``:
    UTC calendar days.  Only ``count`` needs an order, so only it shuffles.
    """
    if mode not in MODES:
        raise ValueError(f"unknown bundle mode: {mode}")
    if size < 1:
        raise ValueError("bundle size must be at least 1")
    if mode == "daily":
        return messages.withColumn("bundle_id", day_number("ts"))
    if mode == "message" or size == 1:
        return messages.withColumn("bundle_id", F.col("msg_id"))
    ranked = order_rank(messages, PAIR, "ts", "msg_id", "_rn", hot_rows=hot_rows)
    return ranked.withColumn("bundle_id", F.floor((F.col("_rn") - 1) / size).cast("bigint")).drop("_rn")


def join_texts(tagged: DataFrame, joiner: str = "\n") -> DataFrame:
    """One row per bundle: text joined in time order, mean time, size.

    Texts are joined in two steps, per hour and then per bundle, so a crowded
    day is first joined in pieces by many tasks.
    """
    hour = F.floor(micros("ts") / F.lit(3_600_000_000)).cast("bigint")
    pieces = (
        tagged.select(*BUNDLE, "msg_id", "text", micros("ts").alias("_us"), hour.alias("_hour"))
        .groupBy(*BUNDLE, "_hour")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("_us", "msg_id", "text"))), lambda m: m["text"]),
                joiner,
            ).alias("_text"),
            F.sum(F.col("_us").cast("decimal(18,0)")).alias("_us"),
            F.count(F.lit(1)).alias("_n"),
        )
    )
    return pieces.groupBy(*BUNDLE).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_hour", "_text"))), lambda m: m["_text"]), joiner
        ).alias("text"),
        F.expr("sum(_us) div sum(_n)").alias("mean_us"),
        F.sum("_n").alias("n_messages"),
    )


def message_bundles(tagged: DataFrame) -> DataFrame:
    """Per-message mode needs no grouping at all."""
    return tagged.select(*BUNDLE, "text", micros("ts").alias("mean_us"), F.lit(1).cast("bigint").alias("n_messages"))


def bundles(messages: DataFrame, mode: str = "count", size: int = 1, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Bundle text and mean time, one row per bundle."""
    tagged = with_bundle_id(messages, mode, size, hot_rows)
    if mode == "message" or (mode == "count" and size == 1):
        return message_bundles(tagged)
    return join_texts(tagged)


def with_key(bundled: DataFrame) -> DataFrame:
    """Bundles with the key of their text; a missing text counts as an empty one, since a null key would never join."""
    filled = bundled.withColumn("text", F.coalesce("text", F.lit("")))
    return filled.withColumn("text_key", content_key(F.col("text")))


def trailing_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of every chat.

    Spark prunes each map task to ``n`` rows per chat before the shuffle.
    """
    latest = W.partitionBy(*PAIR).orderBy(F.desc("ts"), F.desc("msg_id"))
    return messages.withColumn("_back", F.row_number().over(latest)).filter(F.col("_back") <= n).drop("_back")


def trailing_bundle(messages: DataFrame, n: int) -> DataFrame:
    return join_texts(trailing_messages(messages, n).withColumn("bundle_id", F.lit(0).cast("bigint")))


def shorten(bundled: DataFrame, max_chars: int) -> DataFrame:
    """Cut over-long bundle texts before they go to a scorer, and flag them.

    Opt-in: the built-in scorer needs no cut.
    """
    return bundled.withColumn("shortened", F.length("text") > max_chars).withColumn(
        "text", F.substring("text", 1, max_chars)
    )
