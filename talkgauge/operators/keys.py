"""Pair keys, merging of new messages, and lookups into stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgauge.functions.decay import micros
from talkgauge.operators.scale import attach, keyed_join

PAIR = ["u1", "u2"]


def with_pair(messages: DataFrame) -> DataFrame:
    """Undirected chat key: both directions of a chat share ``(u1, u2)``; without a sender or receiver ``u2`` is null."""
    both = F.col("sender").isNotNull() & F.col("receiver").isNotNull()
    return messages.select(
        "msg_id",
        F.least("sender", "receiver").alias("u1"),
        F.when(both, F.greatest("sender", "receiver")).alias("u2"),
        "text",
        "ts",
    )


def merge_messages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new messages as one history; replayed ``msg_id``s are kept once.

    A replay is recognised by id, so only the new batch is checked against the
    stored ids; the history itself is not shuffled when the batch is small.
    """
    fresh = new.dropDuplicates(["msg_id"])
    seen = attach(old.select("msg_id"), fresh.select("msg_id"), "msg_id", "left_semi")
    return old.unionByName(fresh.join(seen, "msg_id", "left_anti"))


def append_message(history: DataFrame, message: DataFrame) -> DataFrame:
    """Add one (or a few) messages as they come."""
    return history.unionByName(message)


def affected_chats(new: DataFrame) -> DataFrame:
    return new.select(*PAIR).distinct()


def messages_of(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """Rows of the given chats only."""
    return attach(messages, chats, PAIR, "left_semi", null_safe=True)


def late_appends(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per chat in ``new``: does its earliest message predate the stored latest?

    Chats without history are simply in order.
    """
    first_new = new.groupBy(*PAIR).agg(F.min(micros("ts")).alias("first_new"), F.count(F.lit(1)).alias("n_new"))
    last_old = messages_of(old.select(*PAIR, "ts"), affected_chats(new))
    last_old = last_old.groupBy(*PAIR).agg(F.max(micros("ts")).alias("last_old"))
    return keyed_join(first_new, last_old, PAIR, "left", null_safe=True).withColumn(
        "out_of_order", F.coalesce(F.col("first_new") < F.col("last_old"), F.lit(False))
    )


def lookup_state(chats: DataFrame, state: DataFrame, as_of) -> DataFrame:
    """Stored sums per chat, or zeros as of now for a chat never seen."""
    return keyed_join(chats, state, PAIR, "left", null_safe=True).select(
        *PAIR,
        F.coalesce("weighted_sum", F.lit(0.0)).alias("weighted_sum"),
        F.coalesce("weight_sum", F.lit(0.0)).alias("weight_sum"),
        F.coalesce("as_of", as_of).alias("as_of"),
    )
