import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from talkgauge.config import DatasetSettings
from talkgauge.operators import neardup, prepare, profile
from talkgauge.functions.hashing import hash_place, row_seed, unit
from talkgauge.operators.scale import attach, bounded, hash_cuts, split_join
from talkgauge.plans import dataset_jobs
from talkgauge.session import materialize
from talkgauge.sources import datasets

SCHEMA = "text string, label string"
ROWS = [('plain, with "quotes"', "b"), ("line\nbreak", "a"), ("ünï", "c"), ("back\\slash", "a")]


def test_csv_json_and_jsonl_read_alike(spark, tmp_path):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    import pandas as pd

    local = pd.DataFrame(ROWS, columns=["text", "label"])
    local.to_csv(tmp_path / "d.csv", index=False)
    local.to_json(tmp_path / "d.json", orient="records")
    local.to_json(tmp_path / "d.jsonl", orient="records", lines=True)
    for name in ("d.csv", "d.json", "d.jsonl"):
        got = datasets.read_dataset(spark, str(tmp_path / name), frame.schema)
        assert sorted(map(tuple, got.collect())) == sorted(ROWS), name
        inferred = datasets.read_dataset(spark, str(tmp_path / name))
        assert set(inferred.columns) == {"text", "label"} and inferred.count() == 4


def test_reader_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        datasets.read_dataset(spark, str(tmp_path / "none.csv"))
    (tmp_path / "d.xml").write_text("<x/>")
    with pytest.raises(ValueError):
        datasets.read_dataset(spark, str(tmp_path / "d.xml"))
    with pytest.raises(ValueError, match="label"):
        datasets.require_columns(spark.createDataFrame([("x",)], "text string"), "text", "label")


def test_settings():
    s = DatasetSettings(seed=7)
    assert DatasetSettings.from_json(s.to_json()) == s
    with pytest.raises(ValueError):
        DatasetSettings(train_ratio=0.9)
    with pytest.raises(ValueError):
        DatasetSettings(max_length=100)


def test_label_ids(spark):
    rows = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, "a"), (5, None)], "id int, label string")
    assert {r.label: r.label_id for r in prepare.label_map(rows).collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.label: r.label_id for r in prepare.label_map_by_appearance(rows, "label", "id").collect()} == {"b": 0, "a": 1, "c": 2}
    encoded = {r.id: r.label_id for r in prepare.encode_labels(rows, prepare.label_map(rows)).collect()}
    assert encoded == {1: 1, 2: 0, 3: 2, 4: 0, 5: None}


def expected_places(ids, seed):
    import hashlib

    return sorted(ids, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())


@pytest.mark.parametrize("sizes", [{"a": 997, "b": 20, "c": 1}, {"a": 3}, {"a": 5000, None: 40}])
def test_split_cuts_every_class_at_rounded_shares(spark, sizes):
    rows, members = [], {}
    for label, n in sizes.items():
        for _ in range(n):
            members.setdefault(label, []).append(len(rows))
            rows.append((len(rows), label))
    df = spark.createDataFrame(rows, "id bigint, label string")
    got = {r.id: r.split for r in prepare.split(df, seed=3).collect()}
    assert len(got) == len(rows)
    for label, ids in members.items():
        n = len(ids)
        ends = math.floor(n * 0.70 + 0.5), math.floor(n * 0.85 + 0.5)
        for place, i in enumerate(expected_places(ids, 3)):
            assert got[i] == ("train" if place < ends[0] else "val" if place < ends[1] else "test")


def test_split_is_independent_of_row_order_and_partitions(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).cast("string").alias("label"))
    a = {tuple(r) for r in prepare.split(df).collect()}
    assert a == {tuple(r) for r in prepare.split(df.orderBy(F.rand(1)).repartition(7)).collect()}


def test_row_sequences_look_uniform_and_unrelated(spark):
    drawn = spark.range(4000).select(row_seed("id", 1).alias("s")).select(
        *[unit(F.col("s"), F.lit(i)).alias(f"u{i}") for i in range(4)]
    )
    row = drawn.agg(
        *[F.avg(f"u{i}").alias(f"m{i}") for i in range(4)], *[F.corr("u0", f"u{i}").alias(f"c{i}") for i in range(1, 4)],
        *[F.avg((F.floor(F.col("u0") * 10) == d).cast("int")).alias(f"d{d}") for d in range(10)],
        F.min("u0").alias("low"), F.max("u0").alias("high"),
    ).first().asDict()
    assert all(abs(row[f"m{i}"] - 0.5) < 0.02 for i in range(4)) and all(abs(row[f"c{i}"]) < 0.05 for i in range(1, 4))
    assert all(abs(row[f"d{d}"] - 0.1) < 0.02 for d in range(10)) and row["low"] >= 0 and row["high"] < 1


def test_folds_are_balanced(spark):
    df = spark.range(103).select("id", F.when(F.col("id") < 11, "rare").otherwise("common").alias("label"))
    counts = prepare.folds(df, 5).groupBy("label", "fold").count().collect()
    for label in ("rare", "common"):
        sizes = [r["count"] for r in counts if r.label == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_hash_cut_at_the_ends(spark):
    df = spark.range(10).select("id", F.lit("x").alias("label"))
    cuts = hash_cuts(df, "label", "id", 1, {"none": F.lit(0), "some": F.lit(4), "all": F.lit(10)}).first()
    places = sorted(r.p for r in df.select(hash_place("id", 1).alias("p")).collect())
    assert cuts.none == places[0] and cuts.some == places[4] and cuts["all"] is None and cuts.n == 10


def test_balance(spark):
    df = spark.range(47).select("id", F.when(F.col("id") < 7, "rare").otherwise("common").alias("label"))
    under = {r.label: r["count"] for r in prepare.undersample(df).groupBy("label").count().collect()}
    over = {r.label: r["count"] for r in prepare.oversample(df).groupBy("label").count().collect()}
    assert under == {"rare": 7, "common": 7} and over == {"rare": 40, "common": 40}
    assert prepare.oversample(df).select("id").distinct().count() == 47
    weights = {r.label: r.class_weight for r in prepare.class_weights(df).collect()}
    assert weights["rare"] == pytest.approx(47 / 14) and weights["common"] == pytest.approx(47 / 80)


def test_first_copies_keep_the_lowest_key(spark):
    rows = spark.createDataFrame([(5, "x"), (2, "x"), (9, "y"), (1, "z"), (3, "x")], "id int, text_cleaned string")
    assert sorted(r.id for r in prepare.first_copies(rows, "id").collect()) == [1, 2, 9]


def test_cleaning_report_adds_up(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, ""), (4, "d e f")], "id int, text_cleaned string")
    r = profile.cleaning_report(rows).first()
    assert (r.original, r.emptied, r.duplicates, r.cleaned, r.removed, r.removed_percent) == (4, 1, 1, 2, 2, 50.0)


def test_profile_numbers(spark):
    rows = spark.createDataFrame([("a b", "x"), ("a  b\nc", "x"), (None, "y"), ("d", "x")], SCHEMA)
    s = profile.length_stats(rows, max_length=2).first()
    assert (s.mean, s.shortest, s.longest, s.median, s.percent_above) == (1.5, 0, 3, 1.5, 25.0)
    assert profile.imbalance(rows).first().imbalanced
    record = profile.stats_record(rows).first()
    assert record.class_distribution == {"x": 3, "y": 1} and record.num_classes == 2


def test_version_hash_ignores_order_but_not_content(spark):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("t"))
    v = profile.version_hash(df).first().version
    assert profile.version_hash(df.repartition(5).orderBy(F.rand(3))).first().version == v
    assert profile.version_hash(df.union(df.limit(1))).first().version != v
    assert profile.version_hash(df.withColumn("t", F.when(F.col("id") == 4, "x").otherwise(F.col("t")))).first().version != v


def test_tokens_are_padded_and_cut(spark):
    rows = spark.createDataFrame([(1, "one two three"), (2, ""), (3, None), (4, "w " * 300)], "id int, text string")
    got = {r.id: r for r in prepare.tokenized(rows, 128).collect()}
    assert all(len(r.input_ids) == len(r.attention_mask) == 128 for r in got.values())
    assert [sum(got[i].attention_mask) for i in (1, 2, 3, 4)] == [3, 0, 0, 128]
    assert got[1].input_ids[3:] == [0] * 125 and min(got[1].input_ids[:3]) >= 2

    def make():
        return lambda texts: [list(range(2, 2 + len(t))) for t in texts]

    plugged = {r.id: r for r in prepare.tokenized(rows, 128, make_tokenizer=make).collect()}
    assert plugged[1].input_ids[:14] == list(range(2, 15)) + [0] and sum(plugged[3].attention_mask) == 0


def test_augmentation_touches_training_rows_only(spark):
    rows = spark.createDataFrame(
        [(i, "the quick brown fox jumps over the lazy dog again", "x", s) for i, s in enumerate(["train"] * 30 + ["val", "test"])],
        "id bigint, text string, label string, split string",
    )
    out = prepare.augmented(rows, lambda w, k: prepare.delete_words(w, k, 0.3), "deletion")
    changed = out.filter("variant = 'deletion'").collect()
    assert len(changed) == 30 and {r.split for r in changed} == {"train"}
    assert any(len(r.text.split()) < 10 for r in changed) and all(r.text for r in changed)
    assert sorted(out.filter("variant = 'original'").drop("variant").collect()) == sorted(rows.collect())
    again = prepare.augmented(rows.repartition(5), lambda w, k: prepare.delete_words(w, k, 0.3), "deletion")
    assert sorted(again.collect()) == sorted(out.collect())
    grown = prepare.augmented(rows, lambda w, k: prepare.insert_words(w, k, 0.5), "insertion").filter("variant <> 'original'").collect()
    assert any(len(r.text.split()) > 10 for r in grown) and all(set(r.text.split()) <= set(rows.first().text.split()) for r in grown)
    gone = prepare.augmented(rows, lambda w, k: prepare.delete_words(w, k, 1.1), "deletion").filter("variant <> 'original'")
    assert {r.text for r in gone.collect()} == {"the"}


def test_synonym_paths_agree(spark):
    rows = spark.createDataFrame([(i, "the cat sat on the mat", "train") for i in range(20)], "id bigint, text string, split string")
    synonyms = spark.createDataFrame([("cat", "dog"), ("mat", "rug")], "word string, synonym string")
    a = prepare.augmented_by_synonyms(rows, synonyms, 0.5)
    b = prepare.augmented_by_synonyms(rows, synonyms, 0.5, max_rows=1)
    assert a.columns == b.columns and sorted(a.collect()) == sorted(b.collect())
    assert {w for r in a.collect() for w in r.text.split()} == {"the", "cat", "sat", "on", "mat", "dog", "rug"}


def test_bounded_and_attach_agree_on_both_paths(spark):
    big = spark.range(100).select((F.col("id") % 5).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (None, "n")], "k bigint, v string")
    assert bounded(small, 3)[1] and not bounded(small, 2)[1]
    assert sorted(attach(big, small, "k").collect()) == sorted(attach(big, small, "k", max_rows=1).collect())
    nulls = spark.createDataFrame([(None, 1)], "k bigint, id bigint")
    assert attach(nulls, small, "k", null_safe=True).first().v == "n"


def test_contained_passages_against_brute_force(spark):
    rng = random.Random(2)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (2, 5, 12)] + ["", "a  b\nc a"]
    docs = [" ".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(40)] + ["", "a", passages[2] + " x", "xa b c ay"]
    rows = spark.createDataFrame(list(enumerate(docs)), "doc bigint, text string")
    held = spark.createDataFrame(list(enumerate(passages)), "item bigint, text string")
    got = {tuple(r) for r in prepare.contained_passages(rows, held, "doc", "item").collect()}
    flat = lambda t: " " + " ".join(t.split()) + " "
    assert got == {(i, j) for i, d in enumerate(docs) for j, p in enumerate(passages) if p and flat(p) in flat(d)}
    assert prepare.contained_passages(rows, held.filter("item = 3"), "doc", "item").count() == 0


def test_split_join_equals_plain_join(spark):
    rows = spark.range(300).select(F.when(F.col("id") < 100, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    per_key = rows.filter("k < 40").groupBy("k").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("first"))
    want = sorted(rows.join(per_key, "k").collect())
    for hot in (1000, 20, 3, 0):
        assert sorted(split_join(rows, per_key, ["k"], hot_rows=hot).select("k", "id", "_n", "first").collect()) == want
    assert sorted(split_join(rows, per_key, ["k"], hot_rows=0, max_rows=3).collect()) == want


def jaccard(a, b):
    return len(a & b) / len(a | b)


def shingles(text):
    words = " ".join(text.split()).split(" ")
    return {tuple(words[i : i + 3]) for i in range(max(len(words) - 2, 1))}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([40, 150, 400]))]
        texts.append(" ".join(base))
        for changes in (0, 1, 2, 6):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += ["", "a", "a b", "a  b", " ".join(words[:3])]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    sets = [shingles(t) for t in texts]
    want = {
        i: j for i in range(len(texts)) for j in reversed(range(i)) if jaccard(sets[i], sets[j]) > 0.95
    }
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert r.similarity == pytest.approx(jaccard(sets[i], sets[r.first])) and r.first == want[i]


def test_near_duplicates_of_one_template(spark):
    """Many texts about 95 % alike: every pair beyond the threshold is found, with the earliest text."""
    rng = random.Random(5)
    base = [f"t{i}" for i in range(400)]
    texts = []
    for i in range(300):
        copy = list(base)
        for place in rng.sample(range(400), rng.randrange(1, 7)):
            copy[place] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    # A copy of a text that itself repeats an earlier one.
    texts.append(texts[150])
    sets = [shingles(t) for t in texts]
    want = {i: next((j for j in range(i) if jaccard(sets[i], sets[j]) > 0.95), None) for i in range(len(texts))}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.first for r in neardup.near_duplicates(df, earliest=True).collect()}
    assert got == {i: j for i, j in want.items() if j is not None}


@pytest.mark.parametrize("hot_rows", [2_000_000, 20])
def test_near_duplicates_with_a_third_of_all_rows_in_one_group(spark, hot_rows):
    """Slight variants of one text: every variant is compared once, not with every other."""
    base = [f"b{i}" for i in range(300)]
    texts = []
    for i in range(200):
        copy = list(base)
        copy[i] = f"x{i}"
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 100 + [" ".join(f"o{i}-{j}" for j in range(50)) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.first for r in neardup.near_duplicates(df, hot_rows=hot_rows).collect()}
    assert set(got) == set(range(1, 300))
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[i] == 200 for i in range(201, 300))


def test_dataset_job_from_file(spark, tmp_path):
    lines = [{"text": f"some words number {i} <b>and</b> more text {i % 7} http://x.y", "label": "ham" if i % 3 else "spam"} for i in range(90)]
    lines += [{"text": "too short", "label": "ham"}, {"text": lines[0]["text"], "label": lines[0]["label"]}]
    path = tmp_path / "labelled.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in lines))
    settings = DatasetSettings(data_path=str(path), output_dir=str(tmp_path / "out"), max_length=128)
    prepared = dataset_jobs.prepare_file(spark, settings)
    report = prepared.report.first()
    assert (report.original, report.emptied, report.duplicates, report.cleaned) == (92, 1, 1, 90)
    assert {r.label: r.label_id for r in prepared.labels.collect()} == {"ham": 0, "spam": 1}
    assert prepare.shared_texts(prepared.splits).count() == 0
    train = datasets.read_split(spark, f"{tmp_path}/out/splits", "train", prepared.splits.drop("split").schema)
    assert train.count() == 63 and "[URL]" in train.first().text
    tokens = dataset_jobs.tokenize_splits(prepared, settings)
    assert tokens.columns == ["split", "input_ids", "attention_mask", "label"] and tokens.count() == 90
    _, history = dataset_jobs.train_and_judge(prepared, settings, "r1", regParam=0.01)
    phases = {r.phase for r in history.select("phase").distinct().collect()}
    assert phases == {"train", "val", "test"}


def test_length_warning_suggests_the_upper_quantile(spark):
    rows = spark.createDataFrame([("a b",)] * 8 + [("a b c d e f",)] * 2, "text string")
    warned = profile.length_stats(rows, max_length=4).first()
    assert warned.cut_warning and warned.suggested_length == 6
    fine = profile.length_stats(rows, max_length=6).first()
    assert not fine.cut_warning and fine.suggested_length == 6


def test_first_shingles_are_few_and_seldom_common(spark):
    """Of each text about 5 % of its shingles meet others; a passage in all texts brings nobody together."""
    common = " ".join(f"c{i}" for i in range(150))
    df = spark.createDataFrame([(i, common + " " + " ".join(f"w{i}-{j}" for j in range(150))) for i in range(400)], "doc_id bigint, text string")
    signed = materialize(neardup.with_shingles(df, "doc_id", "text").withColumn("size", F.size("shingles")), "signed")
    none = spark.createDataFrame([], "doc_id bigint, first bigint")
    rare = neardup.rare_tokens(signed, none, "doc_id").collect()
    assert len(rare) == 400 * (298 - 284 + 3)
    assert sum(n * n for n in Counter(r.token for r in rare).values()) < 2 * len(rare)


def test_long_synonym_table_takes_rows_one_by_one(spark):
    """Keys that repeat or are null: the path by join gives one altered copy for every row, as the path by map does."""
    rows = [(i // 2, f"the cat {i} sat on the mat", "train") for i in range(20)] + [(None, "the cat", "train"), (50, "the the", "test"), (51, "", "train")]
    df = spark.createDataFrame(rows, "id bigint, text string, split string")
    synonyms = spark.createDataFrame([("cat", "dog"), ("mat", "rug"), ("the", "that"), ("sat", None)], "word string, synonym string")
    a, b = (prepare.augmented_by_synonyms(df, synonyms, 0.5, max_rows=n).collect() for n in (1_000, 1))
    assert Counter(a) == Counter(b) and len(b) == 45


def test_plugged_in_tokenizer_gets_few_texts_at_a_time(spark):
    df = spark.range(700).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), "id")).alias("text")).coalesce(1)
    made = prepare.tokenized(df, 4, make_tokenizer=lambda: lambda texts: [[len(texts), len(t), 7, 8, 9] for t in texts])
    got = made.collect()
    assert max(r.input_ids[0] for r in got) == prepare.TOKENIZER_TEXTS and len(got) == 700
    assert all(r.input_ids[1:] == [len(r.text or ""), 7, 8] and r.attention_mask == [1] * 4 for r in got)
