"""Message sources: flat rows, nested histories, and the conversation view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.functions.decay import to_micros

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("msg_id", T.LongType()),
        T.StructField("sender", T.StringType()),
        T.StructField("receiver", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)
HISTORY_SCHEMA = T.StructType(
    [
        T.StructField(
            "history",
            T.MapType(
                T.StringType(),
                T.ArrayType(
                    T.StructType(
                        [T.StructField("text", T.StringType()), T.StructField("ts", T.TimestampType())]
                    )
                ),
            ),
        )
    ]
)

VIEW_START = to_micros("2024-01-01T00:00:00")
VIEW_USERS = 23


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Flat messages with the declared schema; no inference."""
    return spark.read.schema(MESSAGE_SCHEMA).format(fmt).load(path)


def read_history(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Nested contact -> messages map, one or more maps per file."""
    return spark.read.schema(HISTORY_SCHEMA).format(fmt).load(path)


def flatten_history(nested: DataFrame) -> DataFrame:
    """``history`` map rows to one row per message, keyed by contact.

    ``position`` is the place in the contact's list, the tie-break for equal times.
    Contacts without messages yield no rows.
    """
    contacts = nested.select(F.explode("history").alias("contact", "messages"))
    return contacts.select("contact", F.posexplode("messages").alias("position", "m")).select(
        "contact", F.col("position").cast("bigint").alias("position"), "m.text", "m.ts"
    )


def nest_history(messages: DataFrame, contact: str = "contact", order: str = "position") -> DataFrame:
    """One ``(contact, messages)`` row per chat, the nested form for export.

    Rows stay one per contact: the whole-history map of one row would have to
    fit a single task.
    """
    return messages.groupBy(contact).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ts", order, "text"))),
            lambda m: F.struct(m["text"].alias("text"), m["ts"].alias("ts")),
        ).alias("messages")
    )


def contact_messages(flat: DataFrame) -> DataFrame:
    """Older single-contact chats in pair form: ``u2`` is null, so they have no user roll-up."""
    return flat.select(
        F.col("position").alias("msg_id"),
        F.col("contact").alias("u1"),
        F.lit(None).cast("string").alias("u2"),
        "text",
        "ts",
    )


def user_name(number: Column) -> Column:
    return number.cast("string")


def conversation_messages(conversations: DataFrame, as_names: bool = False) -> DataFrame:
    """Message view over ``conversations``: turns become messages between two users.

    All turns but the first user's are spoken to that user, those of the system
    too.  Users, direction and time follow from the conversation number and the turn.
    """
    first = F.col("conv_id") % VIEW_USERS
    second = (F.col("conv_id") * 5 + 1) % VIEW_USERS
    spoken = F.col("role") == "user"
    offset = (F.col("conv_id") % 60) * F.lit(12 * 3_600_000_000) + F.col("turn") * F.lit(5 * 60_000_000)
    sender, receiver = F.when(spoken, first).otherwise(second), F.when(spoken, second).otherwise(first)
    if as_names:
        sender, receiver = user_name(sender), user_name(receiver)
    return conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"),
        sender.alias("sender"),
        receiver.alias("receiver"),
        "text",
        F.timestamp_micros(F.lit(VIEW_START) + offset).alias("ts"),
    )
