"""Prompts, answers, keys and the offline word-list scorer as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds, threshold, fallback and prompt wording that results depend on.
LOWEST, HIGHEST = 1, 10
MIN_SCORE = 3
FLOW_MIN_SCORE = 5
FALLBACK = 5
BUNDLE_PROMPT = (
    "\nOn a scale of 1 to 10, rate how closely this message bundle relates to the topic of "
    "{topic} (1 = completely unrelated, 10 = directly about it). Respond with only the integer score.\n"
    "Message bundle: {message}\n"
)
MESSAGE_PROMPT = (
    "\nOn a scale of 1 to 10, rate how closely this message relates to the topic of {topic} "
    "(1 = completely unrelated, 10 = directly about it). Respond with only the integer score.\nMessage: {message}\n"
)
SHORT_PROMPT = "Rate 1-10: {message} relevance to {topic}"
YES_NO_PROMPT = "Is this message about {topic}? Answer only 'Yes' or 'No': {message}"
SCORE_BANDS = ((3, "not relevant"), (6, "moderate"), (10, "high"))
HISTOGRAM_BINS = ((2, "0-2"), (4, "3-4"), (6, "5-6"), (8, "7-8"), (10, "9-10"))

# Default vocabulary of the offline scorer (ours).
COMMON_WORDS = ("the", "and", "of", "en", "de", "der", "la", "que")


def render_prompt(text: Column, topic: Column | str, template: str = BUNDLE_PROMPT) -> Column:
    """Fill ``{topic}`` and ``{message}``; the message is placed, never parsed."""
    values = {"{topic}": F.lit(topic) if isinstance(topic, str) else topic, "{message}": text}
    pieces = re.split(r"(\{topic\}|\{message\})", template)
    return F.concat(*[values.get(piece, F.lit(piece)) for piece in pieces])


def parse_score(answer: Column) -> Column:
    """Whole-number answer clamped to 1..10; anything else counts as neutral."""
    bare = F.regexp_replace(answer, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    digits = F.regexp_replace(bare, "_", "")
    number = digits.try_cast("decimal(38,0)")
    huge = F.when(digits.startswith("-"), F.lit(LOWEST)).otherwise(F.lit(HIGHEST))
    clamped = F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), number)).cast("int")
    whole = bare.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$")
    # least() skips nulls, so a number too long for a decimal needs its own branch.
    return F.when(whole & number.isNull(), huge).when(whole, clamped).otherwise(F.lit(FALLBACK)).cast("int")


def parse_yes(answer: Column) -> Column:
    """True only for a bare yes, in any case, with outer blanks ignored."""
    bare = F.regexp_replace(answer, r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.lower(bare) == F.lit("yes"), F.lit(False))


def content_key(text: Column) -> Column:
    return F.sha2(text, 256)


def word_hits(text: Column, words: tuple[str, ...] = COMMON_WORDS) -> Column:
    """How many blank-separated words are in the list.

    The count of a newline-joined bundle is the sum of the counts of its
    messages, so a bundle can be scored without ever joining its text.
    """
    listed = "|".join(re.escape(w) for w in words)
    return F.regexp_count(F.lower(text), F.lit(rf"(?<!\S)(?:{listed})(?!\S)"))


def score_from_hits(hits: Column) -> Column:
    """A missing text has no hits; ``least`` alone would skip the null and give the highest score."""
    hits = F.coalesce(hits.cast("bigint"), F.lit(0))
    return F.least(F.lit(HIGHEST).cast("bigint"), F.lit(LOWEST) + hits).cast("int")


def word_score(text: Column, words: tuple[str, ...] = COMMON_WORDS) -> Column:
    return score_from_hits(word_hits(text, words))


def _steps(value: Column, steps) -> Column:
    out = None
    for top, name in steps:
        out = F.when(value <= top, name) if out is None else out.when(value <= top, name)
    return out


def score_band(score: Column) -> Column:
    """Reader-guide bands 0-3, 4-6, 7-10, cut on the nearest whole score."""
    return _steps(F.floor(score + 0.5), SCORE_BANDS)


def histogram_bin(score: Column) -> Column:
    return _steps(F.floor(score + 0.5), HISTOGRAM_BINS)


def display_score(x: Column) -> Column:
    """One decimal place, rounded on the exact binary value with ties to even.

    ``x * 10`` is split into its rounded value and the rounding error (Dekker's
    product), so a value such as 0.15, stored slightly below the tie, goes down.
    """
    scaled = x * F.lit(10.0)
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    error = (high * F.lit(10.0) - scaled) + (x - high) * F.lit(10.0)
    whole = F.floor(scaled)
    # Exact: both operands are close, so the subtraction loses nothing.
    over_half = (scaled - whole - F.lit(0.5)) + error
    up = (over_half > 0) | ((over_half == 0) & (whole % 2 != 0))
    return (whole + up.cast("int")) / F.lit(10.0)
