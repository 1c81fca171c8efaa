"""Keeping chat sums current as new messages arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgauge.functions.decay import fade, to_micros
from talkgauge.functions.scoring import MIN_SCORE
from talkgauge.operators.keys import PAIR, affected_chats, messages_of
from talkgauge.operators.relevance import SUMS, as_state, chat_sums, overall, state_at, weighted
from talkgauge.operators.scale import attach


def add_scored(state: DataFrame, new_scored: DataFrame, as_of, half_life_days: float,
               min_score: float = MIN_SCORE) -> DataFrame:
    """New scored messages on top of stored sums; history is not read.

    Old sums fade to ``as_of``, new rows get their own weight, and both are
    added up by one aggregate.  A chat seen first simply starts from zero.
    """
    fresh = chat_sums(weighted(new_scored, as_of, half_life_days), min_score)
    faded = state_at(state, as_of, half_life_days).drop("as_of_us")
    total = faded.unionByName(fresh.select(faded.columns)).groupBy(*PAIR).agg(
        *[F.sum(c).alias(c) for c in SUMS], F.sum("n_messages").alias("n_messages")
    )
    return as_state(total, as_of)


def replace_chats(state: DataFrame, recomputed: DataFrame, touched: DataFrame, as_of, half_life_days: float) -> DataFrame:
    """Fresh sums for the touched chats, faded sums for all others, one common moment."""
    kept = attach(state, touched, PAIR, "left_anti", null_safe=True)
    faded = state_at(kept, as_of, half_life_days)
    return faded.unionByName(as_state(recomputed, as_of).select(faded.columns))


def recomputed_chats(touched: DataFrame, score_rows, as_of, half_life_days: float, min_score: float = MIN_SCORE) -> DataFrame:
    """State rows of chats from all their messages, old and new.

    ``score_rows`` turns messages into scored bundles (``score``, ``mean_us``,
    ``n_messages``).
    """
    return as_state(chat_sums(weighted(score_rows(touched), as_of, half_life_days), min_score), as_of)


def recompute_affected(history: DataFrame, new: DataFrame, state: DataFrame, score_rows, as_of,
                       half_life_days: float, min_score: float = MIN_SCORE) -> DataFrame:
    """Batch update for any bundle mode: only chats with new messages are recomputed.

    ``history`` already holds the new messages.  ``score_rows`` turns messages
    into scored bundles (``score``, ``mean_us``, ``n_messages``).
    """
    touched = affected_chats(new)
    rows = score_rows(messages_of(history, touched))
    sums = chat_sums(weighted(rows, as_of, half_life_days), min_score)
    return replace_chats(state, sums, touched, as_of, half_life_days)


def overall_delta(old_overall: DataFrame, old_state: DataFrame, new_state: DataFrame) -> DataFrame:
    """Overall sums moved by the difference of the touched chats.

    Right only when both states stand at the same ``as_of``; ``state_at`` first.
    """
    moved = new_state.select(*SUMS).unionByName(
        old_state.select(*[(-F.col(c)).alias(c) for c in SUMS])
    ).unionByName(old_overall.select(*SUMS))
    return overall(moved)


def overall_at(state: DataFrame, as_of, half_life_days: float) -> DataFrame:
    """Overall score at a moment, from stored sums of any age."""
    return overall(state_at(state, as_of, half_life_days))


def faded_column(column: str, as_of, half_life_days: float):
    return fade(F.col(column), F.col("as_of_us"), to_micros(as_of), half_life_days)
