"""Decayed, thresholded averages per chat, per user and over all chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgauge.functions.decay import MICROS_PER_DAY, fade, rate, to_micros, weight
from talkgauge.functions.scoring import COMMON_WORDS, MIN_SCORE, display_score, score_from_hits, word_hits
from talkgauge.operators.bundling import BUNDLE, message_bundles, with_bundle_id
from talkgauge.operators.keys import PAIR
from talkgauge.operators.scale import HOT_ROWS, order_rank

SUMS = ["weighted_sum", "weight_sum"]


def weighted(scored: DataFrame, as_of, half_life_days: float, clamp_future: bool = False) -> DataFrame:
    """Add the decay weight of every scored bundle (``score``, ``mean_us``)."""
    return scored.withColumn("weight", weight(F.col("mean_us"), as_of, half_life_days, clamp_future))


def qualifying_sums(score: Column, wt: Column, min_score: float) -> list[Column]:
    """Both sums over qualifying rows; a chat without any keeps its zero row."""
    keep = score >= min_score
    return [
        F.sum(F.when(keep, score * wt).otherwise(0.0)).alias("weighted_sum"),
        F.sum(F.when(keep, wt).otherwise(0.0)).alias("weight_sum"),
    ]


def ratio(weighted_sum: Column, weight_sum: Column, empty: float | None) -> Column:
    return F.when(weight_sum > 0, weighted_sum / weight_sum).otherwise(F.lit(empty).cast("double"))


def with_score(sums: DataFrame, empty: float | None = 0.0) -> DataFrame:
    """Unrounded score and its one-decimal display form."""
    value = ratio(F.col("weighted_sum"), F.col("weight_sum"), empty)
    return sums.withColumn("raw_score", value).withColumn("score", display_score(F.col("raw_score")))


def chat_sums(weighted_rows: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Sums per chat: a hash aggregate with map-side partials, safe for a huge chat."""
    return weighted_rows.groupBy(*PAIR).agg(
        *qualifying_sums(F.col("score"), F.col("weight"), min_score),
        F.sum("n_messages").alias("n_messages"),
    )


def key_weights(weighted_rows: DataFrame) -> DataFrame:
    """Total weight per chat and text, before any score is known.

    The weight does not depend on the score, so a text repeated in a third of
    all rows shrinks to one row per chat before it meets the score table.
    """
    return weighted_rows.groupBy(*PAIR, "text_key").agg(
        F.sum("weight").alias("weight"), F.sum("n_messages").alias("n_messages")
    )


def overall(sums: DataFrame) -> DataFrame:
    """One row over all chats; the score is null when nothing qualifies."""
    return with_score(sums.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in SUMS]), empty=None)


def user_sums(sums: DataFrame, count_self_twice: bool = False) -> DataFrame:
    """Every pair chat counts for both members; a self-chat once unless asked otherwise."""
    members = F.array("u1", "u2")
    if not count_self_twice:
        members = F.array_distinct(members)
    pairs = sums.filter(F.col("u2").isNotNull())
    return (
        pairs.select(F.explode(members).alias("user"), *SUMS)
        .groupBy("user")
        .agg(*[F.sum(c).alias(c) for c in SUMS])
    )


def levels(sums: DataFrame) -> DataFrame:
    """Chat and overall rows from one grouping pass; ``level`` tells them apart."""
    grouped = sums.groupingSets([["u1", "u2"], []], "u1", "u2").agg(
        F.grouping_id().alias("_gid"), *[F.sum(c).alias(c) for c in SUMS]
    )
    return grouped.select(
        F.when(F.col("_gid") == 0, "chat").otherwise("overall").alias("level"), "u1", "u2", *SUMS
    )


def additive_bundle_scores(
    messages: DataFrame,
    mode: str = "count",
    size: int = 1,
    words: tuple[str, ...] = COMMON_WORDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Bundle scores of the word-list scorer without joining texts.

    Hits add up over the messages of a bundle, so each text is reduced to a
    number in the scan and never shuffled.
    """
    hits = messages.withColumn("hits", word_hits(F.col("text"), words).cast("bigint")).drop("text")
    if mode == "message" or (mode == "count" and size == 1):
        single = message_bundles(with_bundle_id(hits.withColumnRenamed("hits", "text"), "message"))
        return single.withColumn("score", score_from_hits(F.col("text"))).drop("text")
    tagged = with_bundle_id(hits, mode, size, hot_rows)
    us = F.unix_micros("ts").cast("decimal(18,0)")
    grouped = tagged.groupBy(*BUNDLE).agg(
        F.sum("hits").alias("hits"), F.sum(us).alias("_us"), F.count(F.lit(1)).alias("n_messages")
    )
    return grouped.select(
        *BUNDLE,
        F.expr("_us div n_messages").alias("mean_us"),
        "n_messages",
        score_from_hits(F.col("hits")).alias("score"),
    )


def as_state(sums: DataFrame, as_of) -> DataFrame:
    return sums.withColumn("as_of_us", F.lit(to_micros(as_of)))


def state_at(state: DataFrame, as_of, half_life_days: float) -> DataFrame:
    """All stored sums carried to one common moment."""
    faded = [fade(F.col(c), F.col("as_of_us"), as_of, half_life_days).alias(c) for c in SUMS]
    return state.select(*PAIR, *faded, "n_messages", F.lit(to_micros(as_of)).alias("as_of_us"))


def position_weighted(scored: DataFrame, half_life: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Decay by place when times are missing: the last message of a chat has age 0.

    Needs ``msg_id`` as the order; ``half_life`` counts messages.
    """
    ranked = order_rank(scored, PAIR, "msg_id", "msg_id", "_back", descending=True, hot_rows=hot_rows)
    aged = ranked.withColumn("position_age", F.col("_back") - 1).drop("_back")
    return aged.withColumn("weight", F.exp(F.lit(-rate(half_life)) * F.col("position_age")))


def condense(weighted_rows: DataFrame, as_of, keep_days: float = 30.0, min_score: float = MIN_SCORE) -> DataFrame:
    """Replace everything older than ``keep_days`` by one averaged row per chat.

    The averaged row carries the weighted mean score, the mean time and the
    total weight, so chat sums stay what they were.
    """
    border = to_micros(as_of) - int(keep_days * MICROS_PER_DAY)
    rows = weighted_rows.select(*PAIR, "mean_us", "score", "weight", "n_messages")
    recent = rows.filter(F.col("mean_us") >= border).select(
        *PAIR, "mean_us", F.col("score").cast("double").alias("score"), "weight", "n_messages", F.lit(False).alias("condensed")
    )
    old = rows.filter(F.col("mean_us") < border)
    sums = old.groupBy(*PAIR).agg(
        *qualifying_sums(F.col("score"), F.col("weight"), min_score),
        F.sum("n_messages").alias("n_messages"),
        F.expr("sum(cast(mean_us as decimal(18,0))) div count(1)").alias("mean_us"),
    )
    folded = sums.select(
        *PAIR, "mean_us", ratio(F.col("weighted_sum"), F.col("weight_sum"), 0.0).alias("score"),
        F.col("weight_sum").alias("weight"), "n_messages", F.lit(True).alias("condensed"),
    )
    return recent.unionByName(folded)
