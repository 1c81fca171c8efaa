"""Count bundles and trailing bundles kept by a stream of messages.

The state of a chat is its open bundle, at most ``size - 1`` messages, and its last ``last`` messages.  A batch adds its
messages in time order after all earlier ones; a bundle is closed when it is full, or with ``idle_seconds`` when the
watermark has passed its last message by as much.  Open bundles come out as they are so far, so a reader always has every
message.  The rows that one batch brings for one chat are sorted in memory: bound batches by files, not by trust.

A null text is empty; equal times are ordered by ``msg_id``; a restart with the same folder goes on where it stopped, and
a batch that is run again overwrites its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talkgauge.functions.decay import micros
from talkgauge.operators.keys import PAIR

LATE = "1 hour"
_MESSAGE = T.StructType([T.StructField("msg_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("us", T.LongType())])
_COUNT = T.StructType([T.StructField("bundles", T.LongType())])
_OUT = T.StructType([
    T.StructField("u1", T.StringType()), T.StructField("u2", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("bundle_id", T.LongType()), T.StructField("closed", T.BooleanType()), T.StructField("text", T.StringType()),
    T.StructField("n_messages", T.LongType()), T.StructField("mean_us", T.LongType()),
])
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BundleKeeper(StatefulProcessor):
    def __init__(self, size: int, last: int, idle_seconds: int | None = None):
        self.size, self.last, self.idle_seconds = size, last, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _MESSAGE)
        self.tail = handle.getListState("tail", _MESSAGE)
        self.done = handle.getValueState("done", _COUNT)

    def _finished(self) -> int:
        return self.done.get()[0] if self.done.exists() else 0

    def _row(self, key: tuple, kind: str, number: int, closed: bool, messages: list[tuple]) -> tuple:
        times = [m[2] for m in messages]
        return (*key, kind, number, closed, "\n".join(m[1] for m in messages), len(messages), sum(times) // len(times))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_OUT.fieldNames())

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = sorted((m for part in rows for m in zip(part["msg_id"].tolist(), part["text"].tolist(), part["us"].tolist(), strict=True)),
                     key=lambda m: (m[2], m[0]))
        number, waiting = self._finished(), [tuple(m) for m in self.open.get()] if self.open.exists() else []
        tail = ([tuple(m) for m in self.tail.get()] if self.tail.exists() else []) + new
        waiting, out = waiting + new, []
        while len(waiting) >= self.size:
            out.append(self._row(key, "count", number, True, waiting[: self.size]))
            waiting, number = waiting[self.size :], number + 1
        if waiting:
            out.append(self._row(key, "count", number, False, waiting))
        out.append(self._row(key, "trailing", 0, False, tail[-self.last :]))
        self.done.update((number,))
        # A list state may not be empty.
        if waiting:
            self.open.put(waiting)
        else:
            self.open.clear()
        self.tail.put(tail[-self.last :])
        self._watch(waiting)
        yield self._frame(out)

    def _watch(self, waiting: list[tuple]) -> None:
        """One timer for the open bundle."""
        if self.idle_seconds is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if waiting:
            self.handle.registerTimer(waiting[-1][2] // 1000 + self.idle_seconds * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting, number = [tuple(m) for m in self.open.get()] if self.open.exists() else [], self._finished()
        if waiting:
            self.open.clear()
            self.done.update((number + 1,))
            yield self._frame([self._row(key, "count", number, True, waiting)])

    def close(self) -> None:
        pass


def bundle_stream(pairs: DataFrame, size: int, last: int, idle_seconds: int | None = None, late: str = LATE) -> DataFrame:
    """A stream of keyed messages as a stream of bundle rows, for update mode."""
    timed = pairs.withWatermark("ts", late) if idle_seconds is not None else pairs
    rows = timed.select(*[F.col(c).cast("string").alias(c) for c in PAIR], "msg_id", F.coalesce("text", F.lit("")).alias("text"), micros("ts").alias("us"),
                        *(["ts"] if idle_seconds is not None else []))
    return rows.groupBy(*PAIR).transformWithStateInPandas(
        statefulProcessor=BundleKeeper(size, last, idle_seconds), outputStructType=_OUT, outputMode="update",
        timeMode="None" if idle_seconds is None else "EventTime")


def run_bundles(pairs: DataFrame, size: int, last: int, root: str, idle_seconds: int | None = None, late: str = LATE) -> DataFrame:
    """Drain what the stream holds and return the newest row of every bundle, from this run and earlier ones."""
    spark: SparkSession = pairs.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/bundles/batch={number}")

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        query = (
            bundle_stream(pairs, size, last, idle_seconds, late).writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    written = spark.read.schema(T.StructType([*_OUT, T.StructField("batch", T.LongType())])).parquet(f"{root}/bundles")
    names = ["closed", "text", "n_messages", "mean_us"]
    newest = written.groupBy(*PAIR, "kind", "bundle_id").agg(F.max_by(F.struct(*names), "batch").alias("b"))
    return newest.select(*PAIR, "kind", "bundle_id", "b.*")
