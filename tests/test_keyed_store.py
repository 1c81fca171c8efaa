"""The keyed store: changed buckets only, overlapping commits, compaction, filters, broken-off commits."""

import random
from pathlib import Path

import pytest
from pyspark.sql import types as T

from talkgauge.sources.keyed_store import KeyedStore
from talkgauge.sources.store import load_scores, score_cache

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(store, keys=None):
    rows = store.load(keys).collect()
    out = {r.k: r.n for r in rows}
    assert len(out) == len(rows)
    return out


def files(root):
    return {p: p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def opened(df):
    return {Path(f).parent for f in df.inputFiles()}


def test_runs_write_touched_buckets_and_the_newest_row_counts(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", SCHEMA, ["k"], buckets=16, most_parts=3)
    assert content(store) == {} and store.commits() == []
    rng, want = random.Random(2), {}
    for run in range(7):
        rows = {None if rng.random() < 0.02 else f"k{rng.randrange(200)}": run * 1_000 + i for i in range(150 if run == 0 else 6)}
        before, parts = files(tmp_path), store.parts()
        store.write(frame(spark, list(rows.items())))
        want |= rows
        assert content(store) == want
        # No file changes; the parts of buckets that no row of this run falls into stay as they are.
        assert before.items() <= files(tmp_path).items()
        touched = {b for b, commits in store.parts().items() if commits != parts.get(b)}
        assert len(touched) <= len(rows) and all(len(c) <= 3 for c in store.parts().values())
    assert len(opened(store.load())) == sum(map(len, store.parts().values()))


def test_replacing_and_empty_commits(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", SCHEMA, ["k"])
    store.write(frame(spark, [(f"k{i}", i) for i in range(50)]))
    store.write(frame(spark, []))
    assert len(content(store)) == 50
    store.write(frame(spark, [("a", 1)]), replace=True)
    assert content(store) == {"a": 1}
    store.write(frame(spark, []), replace=True)
    assert content(store) == {}


def test_a_commit_that_broke_off_is_not_read(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", SCHEMA, ["k"], buckets=2)
    store.write(frame(spark, [("a", 1), ("b", 2)]))
    store.write(frame(spark, [("a", 5)]))
    (tmp_path / "s" / "commits" / f"{store.commits()[-1]}.json").unlink()
    assert content(store) == {"a": 1, "b": 2}
    store.write(frame(spark, [("b", 3)]))
    assert content(store) == {"a": 1, "b": 3}


def test_overlapping_commits_lose_nothing_and_agree(spark, tmp_path):
    first, second = (KeyedStore(spark, f"{tmp_path}/s", SCHEMA, ["k"], buckets=4) for _ in range(2))
    # Both take the same number, as if neither had seen the other.
    second.commits = lambda: []
    first.write(frame(spark, [("a", 1), ("b", 1)]))
    second.write(frame(spark, [("b", 2), ("c", 2)]))
    del second.commits
    got = content(first)
    assert got == content(second) and got["a"] == 1 and got["c"] == 2 and got["b"] in (1, 2)
    assert len({c.split("-")[0] for c in first.commits()}) == 1


@pytest.mark.parametrize("n", [30, 9_000])
def test_filters_open_only_parts_that_can_hold_a_key(spark, tmp_path, n):
    store = KeyedStore(spark, f"{tmp_path}/s", SCHEMA, ["k"], buckets=8, filtered=True)
    for run in range(3):
        store.write(frame(spark, [(f"{run}-{i}", i) for i in range(n)]))
    asked = frame(spark, [(f"1-{i}", 0) for i in range(5)] + [("missing", 0)]).select("k")
    found = store.load(asked)
    assert {k for k in content(store, asked)} >= {f"1-{i}" for i in range(5)}
    # Five keys lie in at most five parts; a filter lets few others through.
    assert len(opened(found)) <= 8 < len(opened(store.load())) == 24
    everything = frame(spark, [(f"{run}-{i}", 0) for run in range(3) for i in range(n)]).select("k")
    assert len(content(store, everything)) == 3 * n
    assert store.load(frame(spark, [("none of these", 0)]).select("k")).count() <= n


def test_scores_of_scorers_and_topics_are_apart(spark, tmp_path):
    path = f"{tmp_path}/cache"
    for scorer, topic, n in (("a/b", "x y", 1), ("a/b", "ü=1", 2), ("c", "x y", 3)):
        score_cache(spark, path, scorer, topic).write(spark.createDataFrame([("key", n)], "text_key string, score int"))
    assert sorted(tuple(r) for r in load_scores(spark, path).collect()) == [("key", 1, "a/b", "x y"), ("key", 2, "a/b", "ü=1"), ("key", 3, "c", "x y")]
    assert [r.score for r in load_scores(spark, path, "a/b", "ü=1").collect()] == [2]
    assert load_scores(spark, f"{tmp_path}/none").count() == 0
