from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from talkgauge.functions import decay
from talkgauge.session import scratch_path
from talkgauge.streaming import decayed_stream as ds

START = datetime(2024, 1, 1)


def rows(n, skip=0):
    return [(i, START + timedelta(hours=i), i % 3, "x", float(1 + i % 12), "") for i in range(skip, n)]


SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def write(spark, data, folder):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def scored(df):
    score = F.greatest(F.lit(1), F.least(F.lit(10), F.floor("value"))).cast("int")
    return df.withColumn("score", score)


def test_rebasing_keeps_the_sums(spark):
    data = scored(spark.createDataFrame(rows(100), SCHEMA))
    later = decay.to_micros("2024-06-01T00:00:00")
    now = decay.to_micros("2024-07-01T00:00:00")
    sums = ds.forward_sums(data, "user_id", 7)
    moved = ds.rebase(sums, ds.LANDMARK, later, 7)
    a = {r.user_id: r.weighted_sum for r in ds.read_at(sums, "user_id", now, 7).collect()}
    b = {r.user_id: r.weighted_sum for r in ds.read_at(moved, "user_id", now, 7, later).collect()}
    assert a.keys() == b.keys() and all(b[k] == pytest.approx(a[k]) for k in a)
    assert ds.needs_rebase(0, 4000 * decay.MICROS_PER_DAY, 7) and not ds.needs_rebase(0, 30 * decay.MICROS_PER_DAY, 7)


def test_arrival_order_does_not_matter_and_late_rows_count(spark):
    data = scored(spark.createDataFrame(rows(60), SCHEMA))
    whole = {r.user_id: r.forward_weight for r in ds.forward_sums(data, "user_id", 7).collect()}
    parts = ds.forward_sums(data.filter("event_id >= 20"), "user_id", 7).unionByName(ds.forward_sums(data.filter("event_id < 20"), "user_id", 7))
    added = {r.user_id: r.w for r in parts.groupBy("user_id").agg(F.sum("forward_weight").alias("w")).collect()}
    assert all(added[k] == pytest.approx(whole[k]) for k in whole)


def test_state_batches_build_on_each_other_and_replay_once(spark, tmp_path):
    folder, root = str(tmp_path / "in"), scratch_path(spark, "state")
    empty = spark.createDataFrame([], "user_id bigint, n bigint")

    def add(state, batch):
        return state.unionByName(batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))).groupBy("user_id").agg(F.sum("n").alias("n"))

    def drain(progress=root):
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        return {r.user_id: r.n for r in ds.update_state(stream, add, empty, progress).collect()}

    spark.createDataFrame(rows(10), SCHEMA).coalesce(1).write.parquet(folder)
    assert drain() == {0: 4, 1: 3, 2: 3}
    spark.createDataFrame(rows(16, 10), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    assert drain() == {0: 6, 1: 5, 2: 5}
    # A lost commit marker makes the stream run its last batch again.
    for name in (".1.crc", "1"):
        (Path(root) / "progress" / "commits" / name).unlink()
    assert drain() == {0: 6, 1: 5, 2: 5}


def test_replays_are_dropped_within_the_watermark(spark, tmp_path):
    folder = str(tmp_path / "in")
    for _ in range(2):
        spark.createDataFrame(rows(20), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = ds.once_per_id(spark.readStream.schema(SCHEMA).parquet(folder))
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(
        availableNow=True
    ).start().awaitTermination()
    assert spark.read.parquet(out).count() == 20
