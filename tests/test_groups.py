"""Splits by group, calibration, slices and sketches against plain Python."""

import random

from pyspark.sql import functions as F

from talkgauge.functions.hashing import hash_place
from talkgauge.operators import calibrate, groups, sketches, slices

DOCS = "id bigint, text string, label string"


def plain_components(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root if find(x) != x}


def test_components_of_chains_stars_and_random_links(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, 500 + i) for i in range(1, 60)]
    links += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    links += [(7, 7), (9, 8), (8, 9), (9, 8)]
    df = spark.createDataFrame(links + [(None, 3), (4, None)], "a bigint, b bigint")
    got = groups.components(df).collect()
    assert len({r.id for r in got}) == len(got)
    assert {r.id: r.root for r in got} == plain_components([p for p in links if p[0] != p[1]])
    assert groups.components(df.limit(0)).count() == 0


def test_chains_of_near_copies_are_one_group(spark):
    words = [f"w{i}" for i in range(400)]
    chain = []
    for step in range(5):
        chain.append(" ".join(words[step * 4:] + [f"x{step}_{i}" for i in range(step)]))
    other = " ".join(f"v{i}" for i in range(90))
    rows = [(i, t, "a") for i, t in enumerate(chain)] + [(10, other, "a"), (11, other, "b"), (12, None, "b"), (13, "", None)]
    got = {r.id: r.group for r in groups.similar_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 10: 10, 11: 10, 12: 12, 13: 12}


def test_split_groups_deals_whole_groups_near_the_shares(spark):
    rng = random.Random(5)
    rows, key = [], 0
    for group in range(600):
        label = rng.choice(["a", "a", "b", None])
        for _ in range(1500 if group == 17 else rng.choice([1, 1, 1, 2, 5, 30])):
            rows.append((key, group, label if rng.random() < 0.9 else "a"))
            key += 1
    df = spark.createDataFrame(rows, "id bigint, group bigint, label string")
    got = groups.split_groups(df).collect()
    assert len(got) == len(rows)
    # Plainly: each class in hash order, large groups first, a group goes where its first row lies.
    place = {r.group: r.p for r in df.select("group").distinct().select("group", hash_place("group", 42).alias("p")).collect()}
    members, classes = {}, {}
    for _, g, label in rows:
        members.setdefault(g, []).append(label)
    for g, labels in members.items():
        top = max(labels.count(x) for x in set(labels))
        # A null sorts before all other classes.
        classes.setdefault(min((x for x in set(labels) if labels.count(x) == top), key=lambda x: (x is not None, x or "")), []).append(g)
    want = {}
    for of in classes.values():
        n, before = sum(len(members[g]) for g in of), 0
        for g in sorted(of, key=lambda g: (len(members[g]) <= n * 0.075, place[g])):
            want[g] = "train" if before < int(n * 0.7 + 0.5) else "val" if before < int(n * 0.85 + 0.5) else "test"
            before += len(members[g])
    assert {r.group: r.split for r in got} == want and set(want.values()) == {"train", "val", "test"}
    assert all(r.split == want[r.group] for r in got)
    assert groups.split_groups(df.limit(0)).count() == 0


def test_isotonic_shares_against_pooling(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(800):
        s = rng.random()
        rows.append((s, rng.random() < s * s))
    df = spark.createDataFrame(rows + [(None, True)], "score double, positive boolean")
    model = calibrate.fit(calibrate.counted(df, steps=50))
    got = {calibrated.step: calibrated.c for calibrated in calibrate.calibrated(df.filter("score is not null"), model, steps=50, out="c")
           .select(calibrate.step_of(F.col("score"), 50).alias("step"), "c").distinct().collect()}
    counts = {}
    for s, y in rows:
        n, p = counts.get(min(int(s * 50), 49), (0, 0))
        counts[min(int(s * 50), 49)] = (n + 1, p + y)
    blocks = []
    for step in sorted(counts):
        blocks.append([*counts[step], [step]])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            n, p, steps = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + p, blocks[-1][2] + steps]
    want = {s: p / n for n, p, steps in blocks for s in steps}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)
    missing = calibrate.calibrated(spark.createDataFrame([(None,)], "score double"), model, steps=50).first()
    assert missing.calibrated is None
    # On the rows it was fitted on, calibration leaves no gap between mean and share of a block.
    both = calibrate.calibrated(df, model, steps=50)
    error = calibrate.calibration_error(calibrate.reliability(both, "calibrated")).first().error
    assert error < 1e-9 < calibrate.calibration_error(calibrate.reliability(both, "score")).first().error


def test_slices_with_nulls_and_support(spark):
    rows = [("en", None, False)] * 30 + [("en", "web", True)] * 50 + [("de", "web", True)] * 50 + [(None, "web", False)] * 10 + [("fr", "x", False)] * 2
    df = spark.createDataFrame(rows, "lang string, source string, hit boolean")
    got = {(r.lang, r.source, r.free): (r.n, r.accuracy) for r in slices.slice_search(df, ["lang", "source"], least_rows=5).collect()}
    # Where neither side varies there is no deviation to measure by.
    assert got == {("en", None, "source"): (80, 50 / 80), (None, None, "lang"): (30, 0.0), ("en", None, ""): (30, 0.0),
                   (None, None, "source"): (10, 0.0), (None, "web", ""): (10, 0.0)}
    assert slices.slice_search(df.limit(0), ["lang", "source"]).count() == 0


def test_sketches_of_parts_merge_to_those_of_the_whole(spark):
    rng = random.Random(9)
    rows = [("abc"[i % 3], " ".join(["w"] * rng.randrange(1, 3000) + [str(i // 2)])) for i in range(3000)] + [("a", None), ("a", "")]
    df = spark.createDataFrame(rows, "source string, text string")
    parts = sketches.part_sketches(df, ["source"])
    got = sketches.profile(parts).first()
    lengths = sorted(len((t or "").split()) for _, t in rows)
    assert got.n == len(rows) and (got.shortest, got.longest) == (lengths[0], lengths[-1])
    assert abs(got.mean - sum(lengths) / len(rows)) < 1e-9
    for estimate, share in ((got.p50, 0.5), (got.p95, 0.95)):
        below, upto = sum(x < estimate for x in lengths), sum(x <= estimate for x in lengths)
        assert below / len(rows) - sketches.RANK_BOUND <= share <= upto / len(rows) + sketches.RANK_BOUND
    distinct = len({t or "" for _, t in rows})
    assert abs(got.distinct_texts - distinct) <= sketches.DISTINCT_BOUND * distinct
