import hashlib
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talkgauge.functions import decay, scoring


def test_parse_score(spark):
    cases = {"7": 7, " 8 ": 8, "+8": 8, "0": 1, "-3": 1, "42": 10, "8.5": 5, "8/10": 5, "": 5, None: 5, "1_0": 10,
             "9" * 60: 10, "-" + "9" * 60: 1, "\n6\n": 6, "seven": 5, "1__0": 5, "\x1c4": 4}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want int")
    got = rows.withColumn("got", scoring.parse_score(F.col("raw"))).collect()
    assert [(r.raw, r.got) for r in got] == [(r.raw, r.want) for r in got]


def test_parse_yes(spark):
    cases = {"Yes": True, " YES ": True, "Yes.": False, "No": False, None: False, "": False}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want boolean")
    assert all(r.got == r.want for r in rows.withColumn("got", scoring.parse_yes(F.col("raw"))).collect())


def test_prompt_places_message_untouched(spark):
    row = spark.createDataFrame([("a {topic} $1 \\1",)], "t string").select(
        scoring.render_prompt(F.col("t"), "Formula 1").alias("p")
    ).first()
    assert row.p == scoring.BUNDLE_PROMPT.replace("{topic}", "Formula 1").replace("{message}", "a {topic} $1 \\1")


@pytest.mark.parametrize("template", [scoring.MESSAGE_PROMPT, scoring.SHORT_PROMPT, scoring.YES_NO_PROMPT])
def test_other_prompts(spark, template):
    got = spark.createDataFrame([("hi",)], "t string").select(scoring.render_prompt(F.col("t"), "F1", template)).first()[0]
    assert got == template.format(topic="F1", message="hi")


def test_content_key_is_sha256(spark):
    text = "é\n日本 🙂"
    got = spark.createDataFrame([(text,)], "t string").select(scoring.content_key(F.col("t"))).first()[0]
    assert got == hashlib.sha256(text.encode()).hexdigest()


def test_word_hits_add_up_over_joined_messages(spark):
    parts = ["The end of the day", "", "of", " the\tand  la", "other theory"]
    rows = spark.createDataFrame([(p,) for p in parts], "t string")
    single = rows.agg(F.sum(scoring.word_hits(F.col("t")))).first()[0]
    joined = spark.createDataFrame([("\n".join(parts),)], "t string").select(scoring.word_hits(F.col("t"))).first()[0]
    want = sum(w.lower() in scoring.COMMON_WORDS for p in parts for w in p.split())
    assert single == joined == want


def test_weights_by_age(spark):
    now = decay.to_micros("2025-12-17T00:00:00")
    ages = {0: 1.0, 3: 0.742997, 7: 0.5, 14: 0.25, 30: 0.051271, -1: 1.104090}
    rows = spark.createDataFrame([(now - a * decay.MICROS_PER_DAY, w) for a, w in ages.items()], "us bigint, want double")
    got = rows.select(F.round(decay.weight(F.col("us"), now, 7), 6).alias("got"), "want").collect()
    assert all(r.got == pytest.approx(r.want, abs=1e-6) for r in got)
    clamped = rows.select(decay.weight(F.col("us"), now, 7, clamp_future=True).alias("w")).agg(F.max("w")).first()[0]
    assert clamped == 1.0


def test_forward_decay_equals_backward(spark):
    landmark, now = decay.to_micros("2024-01-01T00:00:00"), decay.to_micros("2024-03-01T00:00:00")
    rows = spark.range(50).select((F.col("id") * 86_400_000_000 + landmark).alias("us"))
    back = rows.agg(F.sum(decay.weight(F.col("us"), now, 7))).first()[0]
    ahead = rows.agg(F.sum(decay.forward_weight(F.col("us"), landmark, 7)).alias("s")).select(
        F.col("s") * decay.forward_scale(landmark, now, 7)
    ).first()[0]
    assert ahead == pytest.approx(back, rel=1e-12)


def test_half_life_must_be_positive():
    with pytest.raises(ValueError):
        decay.rate(0)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(0, 10, allow_nan=False), st.integers(0, 200).map(lambda i: i / 20),
                          st.integers(0, 2000).map(lambda i: i * 0.05)), min_size=1, max_size=60))
def test_display_score_rounds_like_exact_binary(spark, values):
    rows = spark.createDataFrame([(float(v),) for v in values], "x double")
    for r in rows.select("x", scoring.display_score(F.col("x")).alias("y")).collect():
        assert r.y == round(r.x, 1), (r.x, r.y)


def test_bands_and_bins(spark):
    rows = spark.createDataFrame([(0.0,), (2.4,), (3.4,), (3.5,), (6.4,), (7.0,), (10.0,)], "s double")
    got = [tuple(r) for r in rows.select(scoring.score_band(F.col("s")), scoring.histogram_bin(F.col("s"))).collect()]
    assert got == [("not relevant", "0-2"), ("not relevant", "0-2"), ("not relevant", "3-4"), ("moderate", "3-4"),
                   ("moderate", "5-6"), ("high", "7-8"), ("high", "9-10")]


def test_micros_reads_naive_as_utc():
    assert decay.to_micros("1970-01-02T00:00:00") == decay.MICROS_PER_DAY
    assert decay.to_micros("1970-01-01T01:00:00+01:00") == 0
    assert math.isclose(decay.rate(7) * 7, math.log(2))
