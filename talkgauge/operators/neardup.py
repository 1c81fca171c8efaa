"""Near-duplicate texts: a prefix filter finds candidates, exact Jaccard decides.

A text is flagged when its word 3-shingles agree by more than 95 % with those
of an earlier text.  Copies are folded before.  In any one order of all
shingles, two such texts share ``SHARED`` shingles among the first few of each,
about 5 % of its shingles; texts meet on these only, and nothing else of a text
is shuffled before.  The order is that of their hashes, but shingles which
crowd these first places come later, the most frequent last, so common passages
bring nobody together.  Which ones do is counted over the first places of all
texts and kept for ``BUCKETS`` buckets of shingles: a rare shingle in the bucket
of a frequent one comes later too, which changes the work, not the result.  The
result equals comparing all pairs; work grows with the texts that share rare
shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgauge.functions.textclean import collapse_blanks
from talkgauge.operators.scale import HOT_ROWS, attach, filter_after, split_join
from talkgauge.session import materialize

SHINGLE_WORDS = 3
LEAST_SIMILARITY = 0.95
SHARED = 3
# Shingles that more texts than CROWD have among their first ones come later; the first ones are chosen TURNS times at most.
CROWD = 16
TURNS = 4
HASH_BITS = 58
BUCKETS = 1 << 20


def shingle_hashes(words: str) -> Column:
    """Distinct hashed runs of three words; a shorter text is one shingle.

    ``words`` names a column: each shingle reads three of its elements.
    """
    last = F.greatest(F.size(words) - SHINGLE_WORDS, F.lit(0))

    def at(i: Column, step: int) -> Column:
        return F.coalesce(F.get(F.col(words), i + step), F.lit(""))

    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2))))


def with_shingles(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key, text digest and shingle set of every row."""
    present = F.coalesce(F.col(text), F.lit(""))
    worded = df.select(key, F.unhex(F.sha2(present, 256)).alias("digest"), F.split(collapse_blanks(present), " ").alias("_words"))
    return worded.select(key, "digest", shingle_hashes("_words").alias("shingles"))


def copies_of(signed: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every later copy of a text with the lowest key that holds it."""
    digests = signed.select(key, "digest")
    firsts = digests.groupBy("digest").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("_n"))
    firsts = materialize(firsts.filter(F.col("_n") > 1), "firsts")
    return split_join(digests, firsts, ["digest"], hot_rows=hot_rows).filter(F.col(key) != F.col("first")).select(key, "first")


def least_shared(size: str) -> Column:
    """Shingles that a text shares at least with any similar one."""
    return F.floor(F.lit(LEAST_SIMILARITY) * F.col(size)) + 1


def prefixes(signed: DataFrame, key: str, levels: bytearray) -> DataFrame:
    """The first shingles of every text, so many that two similar texts share ``SHARED`` of them (or all they share).

    A token is a shingle's hash behind the level of its bucket.
    """
    packed = signed.sparkSession.createDataFrame([(levels,)], "levels binary").scalar()
    hashed = signed.select(key, "size", F.transform("shingles", lambda x: F.shiftrightunsigned(x, 64 - HASH_BITS)).alias("_t"))
    if any(levels):
        byte = lambda t: F.substring(F.col("_levels"), (t.bitwiseAND(BUCKETS - 1) + 1).cast("int"), F.lit(1))
        level = lambda t: F.ascii(byte(t).cast("string")).cast("bigint")
        hashed = hashed.withColumn("_levels", packed).select(
            key, "size", F.transform("_t", lambda t: F.shiftleft(level(t), HASH_BITS).bitwiseOR(t)).alias("_t"))
    length = F.col("size") - least_shared("size") + F.least(F.lit(SHARED), least_shared("size"))
    return hashed.select(key, "size", F.slice(F.sort_array("_t"), F.lit(1), length.cast("int")).alias("tokens"))


def rare_tokens(signed: DataFrame, copies: DataFrame, key: str) -> DataFrame:
    """``key, size, token``: the first shingles of the texts that are no copies, in an order in which few texts share them."""
    levels = bytearray(BUCKETS)
    for turn in range(TURNS):
        # Written before copies are taken out: only first shingles meet them.
        firsts = materialize(prefixes(signed, key, levels), "prefixes")
        rare = attach(firsts, copies.select(key), key, "left_anti").select(key, "size", F.explode("tokens").alias("token"))
        if turn == TURNS - 1:
            break
        crowds = rare.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD)
        bucket = F.col("token").bitwiseAND(BUCKETS - 1).cast("int").alias("bucket")
        level = F.least(F.floor(F.log2(F.max("n"))), F.lit(2 ** (63 - HASH_BITS) - 1)).cast("int").alias("level")
        # At most BUCKETS small rows, whatever the input.
        found = [r for r in crowds.groupBy(bucket).agg(level).toArrow().to_pylist() if r["level"] > levels[r["bucket"]]]
        if not found:
            break
        for r in found:
            levels[r["bucket"]] = r["level"]
    return rare


def candidates(rare: DataFrame, key: str) -> DataFrame:
    """``(key, first)`` pairs of texts that may be similar, the second one earlier."""
    other = rare.select(F.col(key).alias("first"), F.col("size").alias("_size"), "token")
    close = F.least("size", "_size") > F.lit(LEAST_SIMILARITY) * F.greatest("size", "_size")
    met = rare.join(other, "token").filter((F.col(key) > F.col("first")) & close)
    counted = met.groupBy(key, "first", "size", "_size").agg(F.count(F.lit(1)).alias("_met"))
    enough = F.col("_met") >= F.least(F.lit(SHARED), least_shared("size"), least_shared("_size"))
    return counted.filter(enough).select(key, "first").distinct()


def links(df: DataFrame, key: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Exact copies as ``(key, first)``, and all similar pairs ``(key, first, similarity)`` of different texts, both written."""
    signed = materialize(with_shingles(df, key, text).withColumn("size", F.size("shingles")), "shingles")
    copies = materialize(copies_of(signed, key, hot_rows), "copies")
    pairs = materialize(candidates(rare_tokens(signed, copies, key), key), "pairs")
    # Only texts of a pair are compared; copies are in none.
    paired = materialize(pairs.select(F.explode(F.array(key, "first")).alias(key)).distinct(), "paired")
    sets = materialize(signed.select(key, "shingles").join(paired, key, "left_semi"), "sets")
    both = pairs.join(sets, key).join(sets.select(F.col(key).alias("first"), F.col("shingles").alias("_other")), "first")
    shared = F.size(F.array_intersect("shingles", "_other"))
    compared = both.select(key, "first", F.size("shingles").alias("_a"), F.size("_other").alias("_b"), shared.alias("_s"))
    similar = compared.withColumn("similarity", F.col("_s") / (F.col("_a") + F.col("_b") - F.col("_s")))
    close = filter_after(similar, F.col("similarity") > LEAST_SIMILARITY).select(key, "first", "similarity")
    return copies, materialize(close, "similar")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS,
                    earliest: bool = False) -> DataFrame:
    """Flagged texts with the earlier text they repeat and their Jaccard similarity.

    An exact copy names the first text it equals; with ``earliest`` it names what that text repeats, if anything.
    """
    copies, similar = links(df, key, text, hot_rows)
    best = similar.groupBy(key).agg(F.min(F.struct("first", "similarity")).alias("_m"))
    flagged = best.select(key, F.col("_m.first").alias("first"), F.col("_m.similarity").alias("similarity"))
    if not earliest:
        return flagged.unionByName(copies.select(key, "first", F.lit(1.0).alias("similarity")))
    of_first = flagged.select(F.col(key).alias("first"), F.col("first").alias("_first"), "similarity")
    copied = copies.join(of_first, "first", "left").select(
        key, F.coalesce("_first", "first").alias("first"), F.coalesce("similarity", F.lit(1.0)).alias("similarity")
    )
    return flagged.unionByName(copied)
