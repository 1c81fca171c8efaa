import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from talkgauge.functions import decay
from talkgauge.operators import bundling, incremental, keys, relevance, reports, scorer
from talkgauge.operators.scale import order_rank
from talkgauge.plans import relevance_jobs as jobs
from talkgauge.session import scratch_path
from talkgauge.sources import messages as sources
from talkgauge.sources import store

AS_OF = "2025-12-17T00:00:00"


def scored(spark, rows):
    """(u1, u2, day, score) rows as scored one-message bundles."""
    data = [(a, b, decay.to_micros(datetime(2025, 12, d)), s, 1) for a, b, d, s in rows]
    return spark.createDataFrame(data, "u1 string, u2 string, mean_us bigint, score int, n_messages bigint")


def sums(spark, rows, as_of=AS_OF):
    return relevance.chat_sums(relevance.weighted(scored(spark, rows), as_of, 7))


def by_key(df, *names):
    return {tuple(r[n] for n in names): r for r in df.collect()}


TWO = [("me", "FriendA", 1, 1), ("me", "FriendA", 16, 10), ("me", "FriendB", 10, 1), ("me", "FriendB", 15, 1)]


def test_two_contacts(spark):
    got = by_key(relevance.with_score(sums(spark, TWO)), "u2")
    assert got[("FriendA",)].score == 10.0
    assert got[("FriendA",)].weight_sum == pytest.approx(math.exp(-math.log(2) / 7), abs=1e-9)
    assert (got[("FriendB",)].score, got[("FriendB",)].weight_sum) == (0.0, 0.0)
    assert relevance.overall(sums(spark, TWO)).first().score == 10.0


def test_weighted_mean_of_four(spark):
    rows = [("a", "b", 17, 10), ("a", "b", 15, 9), ("a", "b", 12, 8), ("a", "b", 7, 7)]
    assert relevance.with_score(sums(spark, rows)).first().raw_score == pytest.approx(8.874166, abs=1e-6)


def test_threshold_is_inclusive(spark):
    assert relevance.with_score(sums(spark, [("a", "b", 1, 3), ("a", "b", 2, 2)])).first().score == 3.0


def test_overall_is_null_when_nothing_qualifies(spark):
    assert relevance.overall(sums(spark, [("a", "b", 1, 1)])).first().score is None


def test_ageing_all_messages_keeps_scores(spark):
    early = by_key(relevance.with_score(sums(spark, TWO)), "u2")
    late = by_key(relevance.with_score(sums(spark, TWO, "2026-01-30T00:00:00")), "u2")
    for k in early:
        assert late[k].raw_score == pytest.approx(early[k].raw_score, abs=1e-9)
        assert late[k].weight_sum <= early[k].weight_sum


def test_self_chat_counts_once(spark):
    state = sums(spark, [("a", "a", 16, 10), ("a", "b", 16, 4)])
    once = by_key(relevance.user_sums(state), "user")
    twice = by_key(relevance.user_sums(state, count_self_twice=True), "user")
    w = math.exp(-math.log(2) / 7)
    assert once[("a",)].weighted_sum == pytest.approx(14 * w)
    assert twice[("a",)].weighted_sum == pytest.approx(24 * w)


def test_contact_chats_have_no_user(spark):
    state = sums(spark, [("a", None, 16, 10), ("a", "b", 16, 4)])
    assert {r.user for r in relevance.user_sums(state).collect()} == {"a", "b"}
    assert by_key(relevance.with_score(state), "u1", "u2")[("a", None)].score == 10.0


def test_direction_does_not_matter(spark, trio):
    swapped = trio.select("msg_id", F.col("receiver").alias("sender"), F.col("sender").alias("receiver"), "text", "ts")
    rows = lambda m: sorted(map(tuple, keys.with_pair(m).collect()))
    assert rows(trio) == rows(swapped)
    assert {r[1:3] for r in rows(trio)} == {("Alice", "Bob"), ("Alice", "Charlie")}


def test_day_bundles_keep_input_order_on_ties(spark, trio):
    got = bundling.bundles(keys.with_pair(trio), "daily").orderBy("mean_us").collect()
    assert [r.text for r in got] == [
        "Hey Bob, how is it going?\nGood, you?", "Did you see the race?\nYes, amazing!", "Nice weather today.\nCoffee?"
    ]
    assert [r.n_messages for r in got] == [2, 2, 2]


def test_bundle_size_one_is_message_mode(spark, trio):
    pairs = keys.with_pair(trio)
    rows = lambda m, s: sorted(map(tuple, bundling.bundles(pairs, m, s).collect()))
    assert rows("count", 1) == rows("message", 1)


def test_bundle_modes_are_checked(spark, trio):
    with pytest.raises(ValueError):
        bundling.with_bundle_id(trio, "weekly")
    with pytest.raises(ValueError):
        bundling.with_bundle_id(trio, "count", 0)


@pytest.mark.parametrize("hot_rows", [10_000, 7, 60])
def test_order_rank_with_one_hot_chat_and_equal_times(spark, hot_rows):
    rng = random.Random(5)
    rows = [(i, "a", "b" if i % 3 else f"c{i % 40}", datetime(2024, 1, 1) + timedelta(seconds=rng.choice([0, 0, 0, i % 50]))) for i in range(600)]
    rows += [(1000 + i, "solo", None, datetime(2024, 1, 1)) for i in range(90)]
    df = spark.createDataFrame(rows, "msg_id bigint, u1 string, u2 string, ts timestamp")
    got = {r.msg_id: r.rn for r in order_rank(df, ["u1", "u2"], "ts", "msg_id", hot_rows=hot_rows).collect()}
    back = {r.msg_id: r.rn for r in order_rank(df, ["u1", "u2"], "ts", "msg_id", descending=True, hot_rows=hot_rows).collect()}
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault((r[1], r[2]), []).append((r[3], r[0]))
    for members in groups.values():
        for place, (_, msg) in enumerate(sorted(members), 1):
            assert got[msg] == place and back[msg] == len(members) + 1 - place


def test_trailing_messages(spark, trio):
    got = bundling.trailing_bundle(keys.with_pair(trio), 3).collect()
    assert sorted(r.text.split("\n")[0] for r in got) == ["Good, you?", "Nice weather today."]


def test_merge_keeps_replays_once_and_flags_late(spark, trio):
    pairs = keys.with_pair(trio)
    new = spark.createDataFrame(
        [(6, "Alice", "Charlie", "Coffee?", datetime(2025, 12, 3)), (7, "Alice", "Bob", "late", datetime(2025, 11, 1)),
         (8, "Dora", "Eve", "hello", datetime(2025, 12, 4)), (8, "Dora", "Eve", "hello", datetime(2025, 12, 4))],
        pairs.schema,
    )
    merged = keys.merge_messages(pairs, new)
    assert sorted(r.msg_id for r in merged.collect()) == [1, 2, 3, 4, 5, 6, 7, 8]
    flags = by_key(keys.late_appends(pairs, new), "u1", "u2")
    assert flags[("Alice", "Bob")].out_of_order and not flags[("Dora", "Eve")].out_of_order
    assert flags[("Dora", "Eve")].last_old is None


def test_state_lookup_defaults(spark):
    chats = spark.createDataFrame([("a", "b"), ("x", None), ("n", "m")], "u1 string, u2 string")
    state = spark.createDataFrame([("a", "b", 2.0, 1.0, 5), ("x", None, 3.0, 1.0, 6)],
                                  "u1 string, u2 string, weighted_sum double, weight_sum double, as_of bigint")
    got = by_key(keys.lookup_state(chats, state, F.lit(9)), "u1")
    assert (got[("a",)].weighted_sum, got[("x",)].weighted_sum, got[("n",)].weighted_sum, got[("n",)].as_of) == (2.0, 3.0, 0.0, 9)


def test_addition_equals_full_run_for_new_and_old_chats(spark):
    old, new = TWO, [("me", "FriendB", 17, 9), ("new", "pair", 16, 8), ("solo", None, 16, 7)]
    state = relevance.as_state(sums(spark, old, "2025-12-16T00:00:00"), "2025-12-16T00:00:00")
    updated = by_key(incremental.add_scored(state, scored(spark, new), "2025-12-18T00:00:00", 7), "u1", "u2")
    full = by_key(sums(spark, old + new, "2025-12-18T00:00:00"), "u1", "u2")
    assert updated.keys() == full.keys()
    for k in full:
        assert updated[k].weighted_sum == pytest.approx(full[k].weighted_sum, abs=1e-12)
        assert updated[k].n_messages == full[k].n_messages


def test_replace_chats_fades_the_others(spark):
    state = relevance.as_state(sums(spark, TWO), AS_OF)
    fresh = sums(spark, [("me", "FriendB", 16, 10)], "2025-12-24T00:00:00")
    got = by_key(incremental.replace_chats(state, fresh, fresh.select("u1", "u2"), "2025-12-24T00:00:00", 7), "u2")
    before = by_key(state, "u2")
    assert got[("FriendA",)].weighted_sum == pytest.approx(before[("FriendA",)].weighted_sum / 2)
    assert got[("FriendB",)].weighted_sum == pytest.approx(10 * math.exp(-math.log(2) / 7 * 8))


def test_condensing_keeps_chat_sums(spark):
    rows = relevance.weighted(scored(spark, TWO + [("me", "FriendA", 2, 8), ("me", "FriendA", 3, 4)]), AS_OF, 7)
    slim = relevance.condense(rows, AS_OF, 10)
    before, after = by_key(relevance.chat_sums(rows), "u2"), by_key(relevance.chat_sums(slim), "u2")
    assert slim.filter("condensed").count() == 1
    for k in before:
        assert after[k].weighted_sum == pytest.approx(before[k].weighted_sum)
        assert after[k].n_messages == before[k].n_messages


class CountingScorer(scorer.PromptScorer):
    """Counts the prompts that reach the answerer."""

    def __init__(self, spark):
        self.asked = asked = spark.sparkContext.accumulator(0)

        def make():
            def answer(batch):
                asked.add(len(batch))
                return [f" {min(10, p.count('race') * 9 + 2)} " for p in batch]

            return answer

        super().__init__(make, "counting")


def test_each_distinct_text_is_asked_once_per_topic(spark, trio):
    cache, rater = scratch_path(spark, "cache"), CountingScorer(spark)
    pairs = keys.with_pair(trio)
    twice = pairs.unionByName(pairs.withColumn("msg_id", F.col("msg_id") + 100))
    bundled = bundling.with_key(bundling.bundles(twice, "message"))
    rows = scorer.score_bundles(bundled, rater, "racing", cache).collect()
    assert len(rows) == 12 and rater.asked.value == 6
    scorer.score_bundles(bundled, rater, "racing", cache).collect()
    assert rater.asked.value == 6
    scorer.score_bundles(bundled, rater, "cooking", cache).collect()
    assert rater.asked.value == 12
    assert store.load_scores(spark, cache, "counting", "racing").count() == 6


def test_only_unseen_texts_are_asked(spark, trio):
    cache, rater = scratch_path(spark, "cache"), CountingScorer(spark)
    pairs = keys.with_pair(trio)
    twice = bundling.with_key(bundling.bundles(pairs.unionByName(pairs), "message"))
    assert scorer.score_missing(twice.filter("bundle_id <= 2"), rater, "racing", cache).count() == 2 == rater.asked.value
    assert scorer.score_missing(twice, rater, "racing", cache).count() == 6 == rater.asked.value


def test_yes_no_answers_are_kept(spark, trio):
    cache, asked = scratch_path(spark, "cache"), spark.sparkContext.accumulator(0)

    def make():
        def answer(batch):
            asked.add(len(batch))
            return ["Yes" if "race" in p.split("'No': ", 1)[1] else "no" for p in batch]

        return answer

    for rows in (trio.filter("msg_id <= 4"), trio, trio):
        got = scorer.on_topic(rows, make, "racing", cache)
        assert [r.msg_id for r in got.collect()] == [3]
    assert asked.value == 6


def test_prompted_history_weighs_before_joining(spark, trio):
    settings = jobs.ScoringSettings(topic="racing", scorer=CountingScorer(spark))
    got = by_key(relevance.with_score(jobs.process_history(keys.with_pair(trio), settings, AS_OF, scratch_path(spark, "c"))), "u2")
    assert got[("Bob",)].score == 10.0 and got[("Charlie",)].score == 0.0 and got[("Bob",)].n_messages == 4


@pytest.mark.parametrize("mode,size", [("count", 1), ("count", 3), ("daily", 1)])
def test_daily_run_equals_first_run_on_everything(spark, trio, mode, size):
    settings = jobs.ScoringSettings(mode=mode, bundle_size=size, scorer=scorer.WordListScorer(("you", "the", "yes,", "race?", "nice", "bob,")), min_score=2)
    old, new = trio.filter("msg_id <= 3"), trio.filter("msg_id > 3")
    root = scratch_path(spark, "state")
    jobs.first_run(old, settings, "2025-12-02T12:00:00", root)
    updated = jobs.daily_run(old, new, settings, AS_OF, root)
    full = jobs.first_run(trio, settings, AS_OF, scratch_path(spark, "state"))
    assert len(store.chat_states(spark, root).commits()) == 2
    for a, b in ((updated.chats, full.chats), (updated.users, full.users)):
        names = [c for c in a.columns if c in ("u1", "u2", "user")]
        left, right = by_key(a, *names), by_key(b, *names)
        assert left.keys() == right.keys()
        for k in left:
            assert left[k].raw_score == pytest.approx(right[k].raw_score, abs=1e-9)
    assert updated.overall.first().raw_score == pytest.approx(full.overall.first().raw_score, abs=1e-9)


def test_overall_can_be_off(spark, trio):
    settings = jobs.ScoringSettings(with_overall=False)
    assert jobs.first_run(trio, settings, AS_OF, scratch_path(spark, "state")).overall is None


def test_state_versions_ignore_unfinished_writes(spark, tmp_path):
    root = f"{tmp_path}/state"
    assert store.load_state(spark, root).count() == 0
    state = relevance.as_state(sums(spark, TWO), AS_OF)
    assert store.save_state(state, root) == 1
    (tmp_path / "state" / "v=0000000002").mkdir()
    assert store.versions(spark, root) == [1]
    assert store.save_state(state, root) == 3
    assert store.load_state(spark, root).count() == 2
    with pytest.raises(ValueError):
        store.load_version(spark, root, store.STATE_SCHEMA, 2)


def test_iso_round_trip(spark):
    row = spark.createDataFrame([(datetime(2025, 12, 1, 3, 4, 5, 678901),)], "ts timestamp")
    text = row.select(store.iso_time(F.col("ts")).alias("t"), "ts").withColumn("back", store.parse_iso(F.col("t"))).first()
    assert text.t == "2025-12-01T03:04:05.678901" and text.back == text.ts


def test_nested_history(spark):
    data = [({"FriendA": [("hi", datetime(2025, 12, 1)), ("race", datetime(2025, 12, 16))], "Nobody": []},)]
    nested = spark.createDataFrame(data, sources.HISTORY_SCHEMA)
    flat = sources.flatten_history(nested)
    assert sorted((r.contact, r.position, r.text) for r in flat.collect()) == [("FriendA", 0, "hi"), ("FriendA", 1, "race")]
    chats = sources.contact_messages(flat)
    assert {(r.u1, r.u2) for r in chats.collect()} == {("FriendA", None)}


def test_reports(spark):
    state = sums(spark, [("a", "b", 16, 9), ("a", "c", 16, 4), ("b", "c", 16, 2), ("d", "d", 16, 6)])
    chats, users = relevance.with_score(state), relevance.with_score(relevance.user_sums(state))
    assert [r.label for r in reports.top_chats(chats, 2).collect()] == ["a-b", "d-d"]
    assert [r.user for r in reports.top_users(users, 2).collect()] == ["b", "a"]
    edges = reports.network_edges(chats)
    assert edges.count() == 3
    nodes = by_key(reports.network_nodes(edges, users), "user")
    assert nodes[("d",)].node_size == 600.0 and len(nodes) == 4
    cells = by_key(reports.matrix_cells(chats), "user", "other")
    assert len(cells) == 7 and cells[("b", "a")].score == 9.0
    wide = by_key(reports.matrix_wide(chats), "user")
    assert wide[("a",)]["d"] == 0.0 and wide[("c",)]["a"] == 4.0
    with pytest.raises(ValueError):
        reports.matrix_wide(chats, 2)
    index = {r.user: r.idx for r in reports.node_index(users.select("user")).collect()}
    assert index == {"a": 0, "b": 1, "c": 2, "d": 3}
    row = reports.snapshot(chats, users, relevance.overall(state), AS_OF).first()
    assert (row.active_chats, row.active_users) == (3, 4)


def test_reports_on_nothing(spark):
    state = sums(spark, [("a", "b", 16, 1)])
    chats, users = relevance.with_score(state), relevance.with_score(relevance.user_sums(state))
    row = reports.snapshot(chats, users, relevance.overall(state), AS_OF).first()
    assert (row.composite, row.chat_avg, row.active_chats) == (0.0, 0.0, 0)
    none = spark.createDataFrame([], "score int")
    assert reports.summary(chats, users, relevance.overall(state), none).first().relevance_rate == 0.0


def test_decay_curve_and_double_count(spark):
    curve = {r.day: r.weight for r in reports.decay_curve(spark).collect()}
    assert len(curve) == 31 and curve[7] == pytest.approx(0.5) and curve[30] < 0.1
    state = sums(spark, [("a", "b", 16, 9)])
    row = reports.double_count(relevance.with_score(relevance.user_sums(state)), relevance.overall(state)).first()
    assert (row.sum_of_users, row.overall_score) == (18.0, 9.0)


def test_cosine_scores(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [-1.0, 0.0]), (4, [1.0, 1.0])], "id int, embedding array<double>")
    topic = spark.createDataFrame([([3.0, 0.0],)], "t array<double>")
    got = {r.id: r.score for r in scorer.cosine_scores(rows, topic).collect()}
    assert got[1] == pytest.approx(10.0) and got[2] == got[3] == 1.0 and got[4] == pytest.approx(1 + 9 / math.sqrt(2))


def test_stored_daily_run_reads_touched_buckets_and_can_be_repeated(spark, trio):
    settings, root, messages = jobs.ScoringSettings(), scratch_path(spark, "state"), scratch_path(spark, "messages")
    old, new = trio.filter("msg_id < 6"), trio.filter("msg_id >= 5")
    jobs.stored_first_run(old, settings, datetime(2025, 12, 3), messages, root)
    pairs = keys.with_pair(new)
    known = store.stored_messages(spark, messages, pairs)
    assert "PartitionFilters: [isnotnull(chat_bucket" in known._jdf.queryExecution().toString()
    assert {r.msg_id for r in known.collect()} == {5}
    want = {(r.u1, r.u2): (r.n_messages, round(r.raw_score, 9)) for r in jobs.first_run(trio, settings, AS_OF, scratch_path(spark, "state")).chats.collect()}
    for _ in range(2):
        got = jobs.stored_daily_run(new, settings, AS_OF, messages, root).chats
        assert {(r.u1, r.u2): (r.n_messages, round(r.raw_score, 9)) for r in got.collect()} == want
    assert spark.read.parquet(messages).count() == 6
    # A day without messages changes no chat.
    assert jobs.stored_daily_run(new.limit(0), settings, AS_OF, messages, root).chats.count() == len(want)
