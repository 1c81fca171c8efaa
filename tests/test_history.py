"""Condensed cells and table versions against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from talkgauge.operators import tiers
from talkgauge.operators.keys import PAIR
from talkgauge.sources import versions

DAY = 86_400_000_000
SCORED = "u1 string, u2 string, mean_us bigint, score int, n_messages bigint"


def scored(spark, n, days, seed=1):
    rng = random.Random(seed)
    rows = [("a", "b", rng.randrange(days * DAY), rng.randint(1, 10), 1) for _ in range(n)]
    rows += [("a", "c", 5 * DAY + 7, 2, 1), ("a", "c", None, 9, 1), ("a", "d", 3 * DAY, None, 1)]
    return spark.createDataFrame(rows, SCORED), rows


def by_cell(df):
    return {(r.u1, r.u2, r.first_day, r.tier): tuple(r)[4:] for r in df.collect()}


def plain_tier(day, today):
    k = 0
    while today - (((day >> (k + 1)) + 1 << (k + 1)) - 1) >= 1 << (k + 1):
        k += 1
    return k


def test_tier_is_the_largest_block_that_is_old_enough(spark):
    days = spark.range(-40, 1200).withColumnRenamed("id", "day")
    for today in (0, 1000, 1150):
        got = days.select("day", tiers.tier_of(F.col("day"), today).alias("tier")).collect()
        assert all(r.tier == plain_tier(r.day, today) for r in got)


def test_cells_that_age_equal_cells_made_anew(spark):
    df, _ = scored(spark, 3000, 400)
    late = df.filter("mean_us % 7 = 0")
    early = df.filter("mean_us % 7 <> 0 or mean_us is null")
    step = tiers.cells(early.filter(F.col("mean_us") < 200 * DAY), 200 * DAY)
    step = tiers.advance(step, early.filter(F.col("mean_us") >= 200 * DAY), 400 * DAY)
    step = tiers.advance(step, late, 433 * DAY)
    assert by_cell(step) == by_cell(tiers.cells(df, 433 * DAY))
    assert step.schema == tiers.advance(step, df.limit(0), 500 * DAY).schema


def test_cells_grow_with_the_logarithm_of_age_and_keep_sums(spark):
    df, rows = scored(spark, 6000, 2000)
    for at in (2000, 2500, 9000):
        cells = tiers.cells(df, at * DAY)
        one = cells.filter("u2 = 'b'")
        assert one.count() <= 4 * (math.log2(at) + 1)
        assert max(r[0] for r in one.groupBy("tier").count().select("count").collect()) <= 4
        assert one.agg(F.sum("n_messages"), F.sum("score_sum")).first() == (6000, sum(r[3] for r in rows[:6000] if r[3] >= 3))


@pytest.mark.parametrize("half_life", [0.5, 7, 90])
def test_scores_lie_between_their_bounds(spark, half_life):
    df, rows = scored(spark, 800, 120)
    for at in (120 * DAY, 150 * DAY):
        got = {r.u2: r for r in tiers.chat_scores(tiers.cells(df, at), at, half_life).collect()}
        kept = [(0.5 ** ((at - r[2]) / DAY / half_life), r[3]) for r in rows[:800] if r[3] >= 3]
        exact = sum(w * s for w, s in kept) / sum(w for w, _ in kept)
        assert got["b"].low - 1e-9 <= exact <= got["b"].high + 1e-9
        assert got["b"].low <= got["b"].score <= got["b"].high
        assert (got["c"].score, got["c"].n_messages) == (0.0, 1) and "d" not in got


def test_empty_history(spark):
    none = tiers.cells(spark.createDataFrame([], SCORED), DAY)
    assert none.count() == tiers.chat_scores(none, DAY, 7).count() == 0
    assert set(PAIR) <= set(none.columns)


TABLE = "id bigint, text string, `key` string, n int, digest string"


def rows_of(n):
    return [(i, f"text {i}", None if i % 5 else "k", i, "d") for i in range(n)]


def write(spark, tmp_path, name, rows, **options):
    path = f"file://{tmp_path}/{name}"
    df = rows if hasattr(rows, "schema") else spark.createDataFrame(rows, TABLE)
    return path, versions.write_version(df, path, "id", **options)


def changes(spark, old, new):
    return {(r.key, r.change, r.n_old, r.n_new) for r in versions.difference(spark, old[0], new[0]).collect()}


def test_differences_of_versions(spark, tmp_path):
    old = rows_of(300) + [(7, "copy", None, 1, None)] * 2 + [(None, "lost", None, None, None)]
    new = [r for r in old if r[0] not in (3, 4)] + [(900, "", None, None, None), (None, "more", None, None, None)]
    new = [(r[0], None, *r[2:]) if r[0] == 20 else r for r in new]
    new.remove((7, "copy", None, 1, None))
    random.Random(2).shuffle(new)
    a, b = write(spark, tmp_path, "a", old), write(spark, tmp_path, "b", new)
    want = {(3, "removed", 1, 0), (4, "removed", 1, 0), (900, "added", 0, 1), (20, "changed", 1, 1), (7, "changed", 3, 2), (None, "changed", 1, 2)}
    assert changes(spark, a, b) == want
    assert len(versions.changed_buckets(spark, a[0], b[0])) <= 6


def test_same_rows_make_the_same_root(spark, tmp_path):
    rows = rows_of(80)
    df = spark.createDataFrame(rows[::-1], TABLE).repartition(5).select("n", "digest", "id", "key", "text")
    a, b = write(spark, tmp_path, "a", rows), write(spark, tmp_path, "b", df)
    assert a[1] == b[1] and changes(spark, a, b) == set()
    assert write(spark, tmp_path, "c", df.withColumn("digest", F.lit("e")))[1] != a[1]
    # A null is neither an empty text nor the word.
    odd = [write(spark, tmp_path, f"odd{i}", [(1, t, None, None, None)])[1] for i, t in enumerate((None, "", "null", "-"))]
    assert len(set(odd)) == 4


def test_equal_buckets_are_not_read(spark, tmp_path):
    rows = rows_of(500)
    a = write(spark, tmp_path, "a", rows, buckets=64)
    b = write(spark, tmp_path, "b", [(r[0], "other", *r[2:]) if r[0] == 77 else r for r in rows], buckets=64)
    buckets = versions.changed_buckets(spark, a[0], b[0])
    assert len(buckets) == 1
    diff = versions.difference(spark, a[0], b[0])
    assert {f.rsplit("bucket=", 1)[1].split("/")[0] for f in diff.inputFiles()} >= {str(buckets[0])}
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"PartitionFilters: [isnotnull(bucket") + plan.count("PartitionFilters: [(bucket") == 2
    assert changes(spark, a, b) == {(77, "changed", 1, 1)}


def test_odd_versions(spark, tmp_path):
    none, some = write(spark, tmp_path, "none", []), write(spark, tmp_path, "some", rows_of(3))
    assert changes(spark, none, some) == {(i, "added", 0, 1) for i in range(3)}
    assert changes(spark, none, write(spark, tmp_path, "none2", [])) == set()
    with pytest.raises(FileExistsError):
        write(spark, tmp_path, "some", rows_of(2))
    with pytest.raises(FileNotFoundError):
        versions.difference(spark, none[0], f"file://{tmp_path}/absent")
    with pytest.raises(ValueError):
        versions.difference(spark, none[0], write(spark, tmp_path, "few", rows_of(2), buckets=8)[0])
