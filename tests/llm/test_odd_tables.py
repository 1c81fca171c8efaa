"""Operators on tables without labels, without ids, and with columns that carry the names used inside."""

import random

import corpus_pipeline
from talkgauge.llm import decontaminate, mixing, pii, quality, simhash
from talkgauge.llm.queries import PSEUDONYM_KEY

NAMES = ["_apart", "_again", "apart", "again", "_leaked", "_digest", "leaked", "leaked_digest", "digest", "row", "id", "body", "root", "print", "salt",
         "draw", "copies", "target", "_found", "_new", "_pieces", "found", "new", "pieces", "n_replaced", "_mix_source"]
ITEM = "which river crosses the old town of zurvath before it reaches the sea and the answer is the green kelvar stream"


def documents(spark):
    rng = random.Random(1)
    texts = [None, "", "call +1 (555) 123-4567 now", f"well {ITEM} indeed", *[" ".join(rng.choices("abcdefghijkl", k=40)) for _ in range(30)]]
    texts += texts[4:8]
    rows = [(i if i % 7 else None, t, "en", ["a", "b", None][i % 3], 1, *NAMES) for i, t in enumerate(texts)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in NAMES)
    return spark.createDataFrame(rows, schema)


def test_clashing_names_come_through(spark):
    docs = documents(spark)
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    for kept in (simhash.keep_first(docs), decontaminate.keep_clean(docs, benchmark), mixing.mix(docs)):
        assert kept.columns == docs.columns
        assert all(r[n] == n for r in kept.collect() for n in NAMES)
    assert decontaminate.keep_clean(docs, benchmark).count() == docs.count() - 1
    masked = pii.pseudonymised(docs, PSEUDONYM_KEY, found="n_values")
    assert masked.columns == [*docs.columns, "n_values"]
    got = masked.collect()
    assert all(r[n] == n for r in got for n in NAMES) and sum(r.n_values for r in got) == 1
    counted = pii.pseudonymised(docs, PSEUDONYM_KEY)
    assert sorted(counted.columns) == sorted(docs.columns) and sum(r.n_replaced for r in counted.collect()) == 1


def test_quality_without_usable_labels(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    unusable = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 7, 0)], none.schema)
    for labels in (none, unusable):
        model = quality.train(docs, labels)
        assert {round(r.score, 3) for r in quality.score(docs, model).collect()} == {0.5}
    empty = docs.limit(0)
    assert quality.score(empty, quality.train(empty, none)).count() == 0


def test_mix_of_rows_without_ids_meets_its_targets(spark):
    rng = random.Random(5)
    rows = [(None, " ".join(rng.choices("abcdef", k=rng.randrange(5, 30))) + f" {i}", ["a", "b", "c"][i % 3]) for i in range(3_000)]
    got = mixing.mix_counts(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    for size in {r.source_size for r in got}:
        part = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in part) / part[0].target - 1) < 0.1


def test_pipeline_stages_keep_the_columns(spark):
    docs = documents(spark)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "source_mix", "token_files"]
    assert corpus_pipeline.drop_near_duplicates(spark, docs, "").columns == docs.columns
