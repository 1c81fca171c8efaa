"""Mixing sources to target weights.

Word counts are summed per source, targets follow from the weights, and each document of a source is emitted
``floor(rate)`` times plus once more with the probability of the fraction, drawn from a hash of its id and text.  Only the
one-row-per-source table is joined, so no text and no hot source is shuffled.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a source without
words has target and rate 0; rows with equal id and text are drawn alike; a null id draws like an empty one; an
empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkgauge.llm.common import no_null
from talkgauge.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix-1"
_DRAW_DIGITS = 13


def word_count(text: str | Column) -> Column:
    return F.regexp_count(no_null(text), F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    Sources share all sizes by weight, none above ``most_repeats`` times its own size.  With sources ordered by
    size for their weight, a source is at its limit exactly if the share left for it after all before it reaches
    that limit; the comparisons are between integers.  The windows hold one row per source, not per document.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = per_source.select(
        "*", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), place + 1).cast("bigint").alias("weight"),
        (F.col("source_size") * most_repeats).alias("cap"),
    )
    by_need = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    shares = weighed.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left_words"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    ).withColumn("full", F.col("cap") * F.col("left_weight") <= F.col("weight") * F.col("left_words"))
    # The first source that is not full fixes the share of a unit of weight for all that follow.
    first = F.max(F.when(~F.col("full"), F.struct("left_weight", "left_words"))).over(everything)
    share = (F.col("weight") * first["left_words"]).cast("double") / first["left_weight"].cast("double")
    return shares.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def draw(key: str, text: str, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id, the text and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), no_null(F.col(key).cast("string")), F.lit(":"), F.md5(no_null(text))))
    return F.conv(F.substring(digest, 1, _DRAW_DIGITS), 16, 10).cast("bigint").cast("double") / F.lit(float(16**_DRAW_DIGITS))


def copies() -> Column:
    """How often a row with columns ``source_size``, ``target`` and ``draw`` is emitted."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = F.when(F.col("draw") < rate - F.floor(rate), 1).otherwise(0)
    return (F.floor(rate) + extra).cast("bigint")


def with_copies(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of ``source, draw`` and more with ``source_size``, ``target`` and ``copies``; ``targets`` is a written table of one row per source."""
    named = targets.select(F.col("source").alias("_mix_source"), "source_size", "target")
    joined = rows.join(named, F.col("source").eqNullSafe(F.col("_mix_source")))
    return joined.withColumn("copies", copies()).drop("_mix_source")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS,
        most_repeats: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as its source's rate asks, with the columns of ``docs``."""
    sizes = docs.select(F.col(source).alias("source"), word_count(text).alias("size"))
    targets = materialize(source_targets(sizes, weights, most_repeats), "targets")
    packed = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), draw(key, text, seed).alias("draw"))
    mixed = with_copies(packed, targets)
    repeated = mixed.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return repeated.select("row.*")


def mix_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS,
               most_repeats: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """Per document its size, its source's size and target, and the words the mix takes of it."""
    sized = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"), draw(key, text, seed).alias("draw"))
    sized = materialize(sized, "sizes")
    targets = materialize(source_targets(sized, weights, most_repeats), "targets")
    return with_copies(sized, targets).select(
        F.col("id").alias(key), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )
