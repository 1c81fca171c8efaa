"""Bundles kept by a stream: over deliveries and restarts, with time-outs."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from talkgauge.operators import bundling
from talkgauge.session import scratch_path
from talkgauge.streaming import bundle_stream

SCHEMA = "msg_id bigint, u1 string, u2 string, text string, ts timestamp"
START = datetime(2025, 12, 1, tzinfo=UTC)


def delivered(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/messages")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/messages")


def held(found, kind):
    return {(r.u1, r.u2, r.bundle_id): (r.text, r.n_messages, r.mean_us) for r in found.filter(f"kind = '{kind}'").collect()}


@pytest.mark.parametrize("size,last", [(1, 1), (3, 4)])
def test_deliveries_and_restarts_give_the_bundles_of_the_whole(spark, size, last):
    rng, folder = random.Random(size), scratch_path(spark, "stream")
    rows = [(i, f"u{rng.randrange(3)}", None if rng.random() < 0.1 else "z", rng.choice(["a", "", None, "é\nb"]), START + timedelta(minutes=i // 2)) for i in range(60)]
    for part in (rows[:25], rows[25:26], rows[26:]):
        found = bundle_stream.run_bundles(delivered(spark, folder, part), size, last, folder)
    again = bundle_stream.run_bundles(spark.readStream.schema(SCHEMA).parquet(f"{folder}/messages"), size, last, folder)
    whole = spark.createDataFrame(rows, SCHEMA).na.fill("", ["text"])

    def plain(bundled):
        return {(r.u1, r.u2, r.bundle_id): (r.text, r.n_messages, r.mean_us) for r in bundled.collect()}

    tagged = bundling.with_bundle_id(whole, "count", max(size, 2)) if size > 1 else None
    for got in (found, again):
        assert held(got, "trailing") == plain(bundling.trailing_bundle(whole, last))
        if tagged is not None:
            assert held(got, "count") == plain(bundling.join_texts(tagged))
        else:
            assert sum(v[1] for v in held(got, "count").values()) == len(rows) == len(held(got, "count"))


def test_an_idle_bundle_is_closed_and_the_next_message_opens_another(spark):
    folder = scratch_path(spark, "stream")

    def at(minutes):
        return START + timedelta(minutes=minutes)

    parts = [[(1, "a", "b", "one", at(0)), (2, "a", "b", "two", at(1))], [(3, "c", "d", "far on", at(300))], [(4, "a", "b", "three", at(301))]]
    for part in parts:
        found = bundle_stream.run_bundles(delivered(spark, folder, part), 10, 5, folder, idle_seconds=600, late="1 minute")
    got = {(r.u1, r.bundle_id): (r.closed, r.text) for r in found.filter("kind = 'count'").collect()}
    assert got == {("a", 0): (True, "one\ntwo"), ("c", 0): (False, "far on"), ("a", 1): (False, "three")}
