"""Scoring of texts: each distinct text once, answers kept in a table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgauge.functions.scoring import (
    BUNDLE_PROMPT,
    COMMON_WORDS,
    LOWEST,
    YES_NO_PROMPT,
    content_key,
    parse_score,
    parse_yes,
    render_prompt,
    word_score,
)
from talkgauge.session import materialize, scratch_path
from talkgauge.sources.store import score_cache

Answerer = Callable[[Sequence[str]], Sequence[str]]


class WordListScorer:
    """Offline scorer: 1 plus the listed words in the text, at most 10.  Runs in the JVM."""

    def __init__(self, words: Sequence[str] = COMMON_WORDS, name: str = "word-list"):
        self.words, self.name = tuple(words), name

    def score(self, keyed: DataFrame, topic: str) -> DataFrame:
        return keyed.select("text_key", word_score(F.col("text"), self.words).alias("score"))


class PromptScorer:
    """Scorer behind a prompt: ``make_answerer()`` is called once per task.

    The answerer maps a batch of prompts to raw answers, so it can batch or pool
    its calls; only keys that were never scored reach it.  A template of one's own
    is part of the name, so that scores of two templates are kept apart.
    """

    def __init__(self, make_answerer: Callable[[], Answerer], name: str, template: str = BUNDLE_PROMPT):
        self.make_answerer, self.template = make_answerer, template
        self.name = name if template == BUNDLE_PROMPT else f"{name}-{hashlib.sha256(template.encode()).hexdigest()[:12]}"

    def answers(self, keyed: DataFrame, topic: str) -> DataFrame:
        make_answerer = self.make_answerer

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            answerer = make_answerer()
            for batch in batches:
                yield pd.DataFrame({"text_key": batch["text_key"], "answer": list(answerer(batch["prompt"].tolist()))})

        prompts = keyed.select("text_key", render_prompt(F.col("text"), topic, self.template).alias("prompt"))
        return prompts.mapInPandas(ask, "text_key string, answer string")

    def score(self, keyed: DataFrame, topic: str) -> DataFrame:
        return self.answers(keyed, topic).select("text_key", parse_score(F.col("answer")).alias("score"))


def distinct_texts(bundled: DataFrame) -> DataFrame:
    """Each text once; copies collapse before the shuffle."""
    return bundled.select("text_key", "text").dropDuplicates(["text_key"])


def score_missing(bundled: DataFrame, scorer, topic: str, cache_path: str) -> DataFrame:
    """Score what the cache does not hold, store it, and return ``text_key, score`` of ``bundled``.

    Only parts of the cache that can hold a key of the batch are opened.  The keys that miss are a written table, so
    the planner knows its size: few of them are broadcast into the scan of the texts, many meet the folded texts in a
    shuffle.  New scores are written before anything joins them: a retried task reads the stored answer instead of
    asking again.
    """
    if cache_path is None:
        raise ValueError("a scorer that is asked once per text needs a cache_path")
    cache = score_cache(bundled.sparkSession, cache_path, scorer.name, topic)
    if not cache.commits():
        cache.write(scorer.score(distinct_texts(bundled), topic))
        return cache.load()
    keys = materialize(bundled.select("text_key").distinct(), "keys")
    missing = materialize(keys.join(cache.load(keys), "text_key", "left_anti"), "missing-keys")
    if not missing.isEmpty():
        cache.write(scorer.score(distinct_texts(bundled.join(missing, "text_key", "left_semi")), topic))
    return cache.load(keys).join(keys, "text_key", "left_semi")


def score_bundles(bundled: DataFrame, scorer, topic: str, cache_path: str, settle: bool = True) -> DataFrame:
    """Bundles with their memoised score.  ``bundled`` needs a ``text_key``.

    ``settle`` writes grouped bundles once, since scoring and joining both read
    them; plain messages are cheaper to read again.  The text is not carried
    through the join, and AQE splits a text that many bundles have in common.
    """
    source = materialize(bundled, "bundles") if settle else bundled
    scores = score_missing(source, scorer, topic, cache_path)
    return source.drop("text").join(scores, "text_key")


def cache_report(bundled: DataFrame, cached: DataFrame) -> DataFrame:
    """Hits, misses and calls saved, in one pass over the distinct keys."""
    per_key = bundled.groupBy("text_key").agg(F.count(F.lit(1)).alias("n"))
    known = cached.select("text_key").distinct().withColumn("known", F.lit(True))
    marked = per_key.join(known, "text_key", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return marked.agg(
        F.sum("n").alias("bundles"),
        F.count(F.lit(1)).alias("distinct_texts"),
        F.count_if("known").alias("hits"),
        F.count_if(~F.col("known")).alias("misses"),
        (F.sum("n") - F.count_if(~F.col("known"))).alias("calls_saved"),
    )


class YesNoScorer(PromptScorer):
    """Scores a text 1 if it is on topic and 0 if not."""

    def __init__(self, make_answerer: Callable[[], Answerer], name: str = "yes-no"):
        super().__init__(make_answerer, name, YES_NO_PROMPT)

    def score(self, keyed: DataFrame, topic: str) -> DataFrame:
        return self.answers(keyed, topic).select("text_key", parse_yes(F.col("answer")).cast("int").alias("score"))


def on_topic(messages: DataFrame, make_answerer: Callable[[], Answerer], topic: str, cache_path: str | None = None) -> DataFrame:
    """Messages whose yes/no answer is yes; each distinct text is asked once, over all runs that share a ``cache_path``."""
    keyed = messages.withColumn("text_key", content_key(F.col("text")))
    path = cache_path or scratch_path(messages.sparkSession, "answers")
    scores = score_missing(keyed, YesNoScorer(make_answerer), topic, path)
    return keyed.join(scores.filter("score = 1").select("text_key"), "text_key", "left_semi").drop("text_key")


def cosine(left: Column, right: Column) -> Column:
    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)

    # A zero vector resembles nothing: its similarity is null.
    return F.try_divide(dot(left, right), F.sqrt(dot(left, left) * dot(right, right)))


def cosine_scores(vectors: DataFrame, topic_vector: DataFrame, column: str = "embedding") -> DataFrame:
    """Cheap scorer: cosine to one topic vector, mapped linearly onto 1..10.

    ``topic_vector`` is a one-row, one-column frame; it enters as a scalar
    subquery, so no join is planned.
    """
    similar = vectors.withColumn("_topic", topic_vector.scalar())
    similar = similar.withColumn("similarity", cosine(F.col(column), F.col("_topic"))).drop("_topic")
    top = F.lit(10.0 - LOWEST)
    return similar.withColumn("score", F.lit(float(LOWEST)) + top * F.greatest(F.lit(0.0), F.col("similarity")))
