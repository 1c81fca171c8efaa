"""Tables that live between runs: score cache, chat state, trend log."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.operators.keys import PAIR
from talkgauge.sources.folders import folder, list_folders, path_exists
from talkgauge.sources.keyed_store import KeyedStore

SCORES_SCHEMA = T.StructType(
    [
        T.StructField("text_key", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("scorer", T.StringType()),
        T.StructField("topic", T.StringType()),
    ]
)
STATE_SCHEMA = T.StructType(
    [
        T.StructField("u1", T.StringType()),
        T.StructField("u2", T.StringType()),
        T.StructField("weighted_sum", T.DoubleType()),
        T.StructField("weight_sum", T.DoubleType()),
        T.StructField("n_messages", T.LongType()),
        T.StructField("as_of_us", T.LongType()),
    ]
)
LOG_SCHEMA = T.StructType(
    [
        T.StructField("as_of_us", T.LongType()),
        T.StructField("composite", T.DoubleType()),
        T.StructField("user_avg", T.DoubleType()),
        T.StructField("chat_avg", T.DoubleType()),
        T.StructField("active_chats", T.LongType()),
        T.StructField("active_users", T.LongType()),
        T.StructField("snapshot_date", T.DateType()),
    ]
)
_VERSION = re.compile(r"v=(\d{10})$")


# Folders of a message store; a daily run reads those its messages fall into.
CHAT_BUCKETS = 512
STATE_BUCKETS = 64


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet table, or an empty frame of its schema when nothing was written yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _chat_bucket() -> Column:
    return F.pmod(F.xxhash64("u1", "u2"), F.lit(CHAT_BUCKETS)).cast("int")


def append_messages(pairs: DataFrame, path: str) -> None:
    """Add keyed messages to a store with one folder per chat bucket.

    The rebalance hint gives a bucket one file unless it is large: a hot chat is spread over several tasks.
    """
    bucketed = pairs.withColumn("chat_bucket", _chat_bucket())
    bucketed.hint("rebalance", "chat_bucket").write.mode("append").partitionBy("chat_bucket").parquet(path)


def stored_messages(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Stored messages in the buckets that the keyed messages ``like`` touch; no other folder is read.

    At most ``CHAT_BUCKETS`` numbers come to the driver.
    """
    touched = [r[0] for r in like.select(_chat_bucket()).distinct().collect()]
    schema = T.StructType([*like.schema.fields, T.StructField("chat_bucket", T.IntegerType())])
    return read_or_empty(spark, path, schema).filter(F.col("chat_bucket").isin(touched)).drop("chat_bucket")


def score_cache(spark: SparkSession, path: str, scorer: str, topic: str) -> KeyedStore:
    """Scores of one scorer and topic, in a folder of their own; filters tell which parts can hold a key."""
    schema = T.StructType([SCORES_SCHEMA["text_key"], SCORES_SCHEMA["score"]])
    root = f"{path.rstrip('/')}/scorer={quote(scorer, safe='')}/topic={quote(topic, safe='')}"
    return KeyedStore(spark, root, schema, ["text_key"], filtered=True)


def load_scores(spark: SparkSession, path: str, scorer: str | None = None, topic: str | None = None) -> DataFrame:
    """One cached score per key; scorer and topic are folders, so others are not read."""
    out = spark.createDataFrame([], SCORES_SCHEMA)
    for first in list_folders(spark, path):
        for second in list_folders(spark, f"{path.rstrip('/')}/{first}"):
            named, about = (unquote(x.split("=", 1)[1]) for x in (first, second))
            if scorer in (None, named) and topic in (None, about):
                scores = score_cache(spark, path, named, about).load()
                out = out.unionByName(scores.withColumns({"scorer": F.lit(named), "topic": F.lit(about)}))
    return out


def chat_states(spark: SparkSession, root: str) -> KeyedStore:
    """Sums of all chats; a run writes the chats that it computed, each with its own time."""
    return KeyedStore(spark, root, STATE_SCHEMA, PAIR, buckets=STATE_BUCKETS)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Completed versions, oldest first; a version without its success marker is ignored."""
    fs, hadoop = folder(spark, root)
    if not fs.exists(hadoop):
        return []
    found = []
    for status in fs.listStatus(hadoop):
        match = _VERSION.search(status.getPath().toString())
        marker = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if match and fs.exists(marker):
            found.append(int(match.group(1)))
    return sorted(found)


def save_version(df: DataFrame, root: str) -> int:
    """Write a new version next to the old ones.

    Readers switch only when the write has committed, so a failed run leaves the
    previous version in place.  Numbers of failed attempts are not reused.
    """
    spark = df.sparkSession
    number = (versions(spark, root) or [0])[-1] + 1
    while path_exists(spark, f"{root}/v={number:010d}"):
        number += 1
    df.write.mode("errorifexists").parquet(f"{root}/v={number:010d}")
    return number


def load_version(spark: SparkSession, root: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    known = versions(spark, root)
    if not known:
        return spark.createDataFrame([], schema)
    if version is not None and version not in known:
        raise ValueError(f"no version {version} under {root}")
    number = known[-1] if version is None else version
    return spark.read.schema(schema).parquet(f"{root}/v={number:010d}")


def save_state(state: DataFrame, root: str) -> int:
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in STATE_SCHEMA]
    return save_version(state.select(*columns), root)


def load_state(spark: SparkSession, root: str) -> DataFrame:
    return load_version(spark, root, STATE_SCHEMA)


def append_log(snapshot: DataFrame, path: str) -> None:
    """Add a snapshot row to the trend log, one folder per day."""
    dated = snapshot.withColumn("snapshot_date", F.date_from_unix_date(F.floor(F.col("as_of_us") / F.lit(86_400_000_000)).cast("int")))
    dated.select(*LOG_SCHEMA.fieldNames()).write.mode("append").partitionBy("snapshot_date").parquet(path)


def load_log(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, LOG_SCHEMA)


def iso_time(ts: Column) -> Column:
    """ISO text of a timestamp, in the session time zone."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def parse_iso(text: Column) -> Column:
    return F.to_timestamp(text)
