"""The given tables, with only the declared columns read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge.functions.decay import to_micros
from talkgauge.operators.keys import with_pair
from talkgauge.sources.messages import conversation_messages

AS_OF = to_micros("2024-03-01T00:00:00")
EVENTS_AS_OF = to_micros("2024-02-01T00:00:00")
HALF_LIFE = 7.0
# Old and new part of the message view for the incremental queries.
NEW_FROM = to_micros("2024-01-25T00:00:00")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose texts are expensive to process.

    A single small file is one split, so one core would do all the work: such
    an input is spread first.  With as many splits as cores nothing happens.
    """
    rows = table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def messages(spark: SparkSession, folder: str, as_names: bool = False) -> DataFrame:
    return conversation_messages(table(spark, folder, "conversations"), as_names)


def pairs(spark: SparkSession, folder: str, as_names: bool = False) -> DataFrame:
    return with_pair(messages(spark, folder, as_names))


def old_part(rows: DataFrame) -> DataFrame:
    return rows.filter(F.unix_micros("ts") < NEW_FROM)


def new_part(rows: DataFrame) -> DataFrame:
    return rows.filter(F.unix_micros("ts") >= NEW_FROM)


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, one file or a folder of them, as a file stream of the same schema."""
    reader = spark.readStream.schema(table(spark, folder, name).schema)
    return reader.parquet(f"{folder}/{name}.parque[t]")


def message_stream(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_messages(stream(spark, folder, "conversations"), as_names=True)


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return scored_events(stream(spark, folder, "events"))


def event_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scored_events(table(spark, folder, "events"))


def scored_events(events: DataFrame) -> DataFrame:
    """Events as scored items: ``value`` clamped to a whole score of 1..10; a missing one scores lowest."""
    score = F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(F.floor("value"), F.lit(0)))).cast("int")
    return events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), score.alias("score"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that have a quality label."""
    docs = texts(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return docs.join(table(spark, folder, "labels"), "doc_id")
