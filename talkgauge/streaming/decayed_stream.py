"""Streaming forms: decayed sums per key, day bundles, replay-safe input.

Forward decay keeps ``sum(score * exp(rate * (ts - landmark)))``: a plain sum,
independent of arrival order, so a late row needs no re-sort and batch and
stream run the same aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.functions.decay import day_number, forward_scale, forward_weight, micros, to_micros
from talkgauge.functions.scoring import MIN_SCORE
from talkgauge.operators.incremental import add_scored
from talkgauge.operators.keys import with_pair
from talkgauge.operators.relevance import additive_bundle_scores
from talkgauge.sources.store import STATE_SCHEMA, load_version

LANDMARK = to_micros("2024-01-01T00:00:00")
# exp() leaves the double range beyond about 1,000 half lives; re-base well before.
SAFE_HALF_LIVES = 500


def forward_sums(scored: DataFrame, key: str, half_life_days: float, landmark: int = LANDMARK,
                 min_score: float = MIN_SCORE) -> DataFrame:
    """Mergeable sums per key, valid for batch and streaming input alike."""
    wt = forward_weight(micros("ts"), landmark, half_life_days)
    keep = F.col("score") >= min_score
    return scored.groupBy(key).agg(
        F.sum(F.when(keep, F.col("score") * wt).otherwise(0.0)).alias("forward_weighted"),
        F.sum(F.when(keep, wt).otherwise(0.0)).alias("forward_weight"),
        F.count(F.lit(1)).alias("n"),
    )


def read_at(sums: DataFrame, key: str, as_of: int, half_life_days: float, landmark: int = LANDMARK) -> DataFrame:
    """Backward-decayed sums at ``as_of``."""
    scale = forward_scale(landmark, as_of, half_life_days)
    return sums.select(
        key, (F.col("forward_weighted") * scale).alias("weighted_sum"), (F.col("forward_weight") * scale).alias("weight_sum"), "n"
    )


def rebase(sums: DataFrame, old: int, new: int, half_life_days: float) -> DataFrame:
    """Move the landmark forward so that the growing weights stay finite."""
    scale = forward_scale(old, new, half_life_days)
    return sums.withColumns(
        {"forward_weighted": F.col("forward_weighted") * scale, "forward_weight": F.col("forward_weight") * scale}
    )


def needs_rebase(landmark: int, now: int, half_life_days: float) -> bool:
    return (now - landmark) / 86_400_000_000 / half_life_days > SAFE_HALF_LIVES


def once_per_id(stream: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Drop replays that arrive within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_sums(scored: DataFrame, key: str, half_life_days: float, root: str) -> DataFrame:
    """Drain a stream of scored rows and return the newest sums of every key.

    Update mode emits only the keys a batch touched.  A batch writes its own
    folder, so a repeated batch overwrites itself and nothing else.
    """
    spark = scored.sparkSession
    sums = forward_sums(scored, key, half_life_days)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/sums/batch={number}")

    query = (
        sums.writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    written = spark.read.schema(T.StructType(sums.schema.fields + [T.StructField("batch", T.LongType())])).parquet(f"{root}/sums")
    newest = written.groupBy(key).agg(F.max_by(F.struct("forward_weighted", "forward_weight", "n"), "batch").alias("s"))
    return newest.select(key, "s.*")


def run_days(scored: DataFrame, key: str, root: str, late: str = "1 day") -> DataFrame:
    """Day bundles per key, the newest of each day.

    Open days come out as they are so far; the watermark only frees the state of days it has passed, whose bundles
    change no more.  A batch writes the days it touched to its own folder, so a repeated batch overwrites itself.
    """
    spark = scored.sparkSession
    days = scored.withWatermark("ts", late).groupBy(key, F.window("ts", "1 day")).agg(
        F.sum("score").alias("score_sum"), F.count(F.lit(1)).alias("n")
    )
    rows = days.select(key, day_number(F.col("window.start")).alias("day"), "score_sum", "n")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/days/batch={number}")

    query = (
        rows.writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    written = spark.read.schema(T.StructType(rows.schema.fields + [T.StructField("batch", T.LongType())])).parquet(f"{root}/days")
    newest = written.groupBy(key, "day").agg(F.max_by(F.struct("score_sum", "n"), "batch").alias("s"))
    return newest.select(key, "day", "s.*")


def update_state(batches: DataFrame, apply, initial: DataFrame, root: str) -> DataFrame:
    """Daily updates as micro-batches: ``apply(state, batch)`` returns the next state.

    For steps without an order-free form, such as count bundles.  Batch ``n``
    reads version ``n`` and writes version ``n + 1``, so a batch that is run
    again after a failure overwrites its own result and is never added twice.
    """
    spark = batches.sparkSession

    def version(number: int) -> str:
        return f"{root}/state/v={number:010d}"

    def step(batch: DataFrame, number: int) -> None:
        before = initial if number == 0 else spark.read.schema(initial.schema).parquet(version(number))
        apply(before, batch).select(initial.columns).write.mode("overwrite").parquet(version(number + 1))

    query = (
        batches.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return load_version(spark, f"{root}/state", initial.schema)


def run_chats(messages: DataFrame, as_of: int, half_life_days: float, root: str) -> DataFrame:
    """Chat sums kept by a stream of messages: stored sums fade, each batch is added."""
    empty = messages.sparkSession.createDataFrame([], STATE_SCHEMA)

    def add(state: DataFrame, batch: DataFrame) -> DataFrame:
        scored = additive_bundle_scores(with_pair(batch), "message")
        return add_scored(state, scored, as_of, half_life_days)

    return update_state(messages, add, empty, root)
