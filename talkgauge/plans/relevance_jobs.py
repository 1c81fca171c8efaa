"""The conversation jobs: first run, daily run, and the pass they share."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from talkgauge.functions.scoring import MIN_SCORE
from talkgauge.operators.bundling import bundles, with_key
from talkgauge.operators.incremental import recomputed_chats
from talkgauge.operators.keys import affected_chats, merge_messages, messages_of, with_pair
from talkgauge.operators.relevance import (
    additive_bundle_scores,
    as_state,
    chat_sums,
    key_weights,
    overall,
    state_at,
    user_sums,
    weighted,
    with_score,
)
from talkgauge.operators.scorer import WordListScorer, score_bundles, score_missing
from talkgauge.session import materialize
from talkgauge.sources.store import append_messages, chat_states, stored_messages


@dataclass(frozen=True)
class ScoringSettings:
    """What a relevance run needs to know."""

    topic: str = "Formula 1"
    half_life_days: float = 7.0
    min_score: float = MIN_SCORE
    mode: str = "count"
    bundle_size: int = 1
    with_overall: bool = True
    scorer: object = field(default_factory=WordListScorer)

    @property
    def grouped(self) -> bool:
        return self.mode == "daily" or (self.mode == "count" and self.bundle_size > 1)


@dataclass(frozen=True)
class Scores:
    """Result frames of a run; ``overall`` is None when switched off."""

    chats: DataFrame
    users: DataFrame
    overall: DataFrame | None
    state: DataFrame


def scored_rows(pairs: DataFrame, settings: ScoringSettings, cache_path: str | None) -> DataFrame:
    """Scored bundles of keyed messages.

    The word-list scorer needs neither joined texts nor a cache; any other
    scorer goes through the memo table at ``cache_path``.
    """
    scorer = settings.scorer
    if isinstance(scorer, WordListScorer):
        return additive_bundle_scores(pairs, settings.mode, settings.bundle_size, scorer.words)
    bundled = with_key(bundles(pairs, settings.mode, settings.bundle_size))
    return score_bundles(bundled, scorer, settings.topic, cache_path, settle=settings.grouped)


def process_history(pairs: DataFrame, settings: ScoringSettings, as_of, cache_path: str | None = None) -> DataFrame:
    """Chat sums of a whole history at ``as_of``."""
    scorer = settings.scorer
    if isinstance(scorer, WordListScorer):
        rows = weighted(scored_rows(pairs, settings, cache_path), as_of, settings.half_life_days)
        return chat_sums(rows, settings.min_score)
    bundled = with_key(bundles(pairs, settings.mode, settings.bundle_size))
    source = materialize(bundled, "bundles") if settings.grouped else bundled
    scores = score_missing(source, scorer, settings.topic, cache_path)
    slim = weighted(source.drop("text"), as_of, settings.half_life_days)
    return chat_sums(key_weights(slim).join(scores, "text_key"), settings.min_score)


def roll_up(state: DataFrame, settings: ScoringSettings) -> Scores:
    """Chat, user and overall scores from sums that share one as-of."""
    return Scores(
        chats=with_score(state),
        users=with_score(user_sums(state)),
        overall=overall(state) if settings.with_overall else None,
        state=state,
    )


def _stored_scores(spark: SparkSession, settings: ScoringSettings, as_of, state_root: str) -> Scores:
    """Scores of all stored chats at one moment; sums of earlier runs fade as they are read."""
    return roll_up(state_at(chat_states(spark, state_root).load(), as_of, settings.half_life_days), settings)


def first_run(messages: DataFrame, settings: ScoringSettings, as_of, state_root: str,
              cache_path: str | None = None) -> Scores:
    """Score a history and store its state in the place of what is there."""
    spark = messages.sparkSession
    sums = process_history(with_pair(messages), settings, as_of, cache_path)
    chat_states(spark, state_root).write(as_state(sums, as_of), replace=True)
    return _stored_scores(spark, settings, as_of, state_root)


def _store_touched(touched: DataFrame, settings: ScoringSettings, as_of, state_root: str, cache_path: str | None) -> None:
    """Compute chats from all their messages, and store them alone."""
    sums = recomputed_chats(touched, lambda rows: scored_rows(rows, settings, cache_path), as_of, settings.half_life_days, settings.min_score)
    chat_states(touched.sparkSession, state_root).write(sums)


def daily_run(history: DataFrame, new_messages: DataFrame, settings: ScoringSettings, as_of, state_root: str,
              cache_path: str | None = None) -> Scores:
    """Merge new messages, recompute and store the chats they touch; all others keep their stored sums."""
    merged = with_pair(merge_messages(history, new_messages))
    _store_touched(messages_of(merged, affected_chats(with_pair(new_messages))), settings, as_of, state_root, cache_path)
    return _stored_scores(history.sparkSession, settings, as_of, state_root)


def stored_first_run(messages: DataFrame, settings: ScoringSettings, as_of, store: str, state_root: str,
                     cache_path: str | None = None) -> Scores:
    """A first run that also keeps the messages, by chat bucket, for ``stored_daily_run``."""
    append_messages(with_pair(messages), store)
    return first_run(messages, settings, as_of, state_root, cache_path)


def stored_daily_run(new_messages: DataFrame, settings: ScoringSettings, as_of, store: str, state_root: str,
                     cache_path: str | None = None) -> Scores:
    """A daily run that reads and writes only the buckets of the touched chats.

    Touched chats are computed from all their messages, so a run repeated after a failure gives the same state;
    messages that the store already holds are not added again.
    """
    spark: SparkSession = new_messages.sparkSession
    new = materialize(with_pair(new_messages), "new-messages")
    known = stored_messages(spark, store, new)
    _store_touched(merge_messages(messages_of(known, affected_chats(new)), new), settings, as_of, state_root, cache_path)
    fresh = new.dropDuplicates(["msg_id"]).join(known.select("msg_id"), "msg_id", "left_anti")
    append_messages(fresh.select(new.columns), store)
    return _stored_scores(spark, settings, as_of, state_root)
