"""Exact duplicates: group by a 128-bit content hash, then compare bytes inside the groups.

One scan hashes every text.  Only texts whose hash occurs more than once are read again and grouped by their
bytes, with partial counts before the shuffle, so a text that a third of all rows hold is one row per task.
Texts that merely share a hash fall into different groups there.

Defined results: a null text counts as empty; a row without an id forms groups like any other and is kept only
where no row of its group has an id; repeated rows with the kept id are all marked as kept; an empty table
gives an empty result; columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgauge.llm.common import no_null
from talkgauge.session import materialize


def md5_bytes(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest",
                 content_hash: Callable[[Column], Column] = md5_bytes) -> DataFrame:
    """One row per row of ``docs``: key, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    ``keep`` names which id of a group stays: ``smallest`` or ``largest``.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep}")
    chosen = F.min if keep == "smallest" else F.max
    texts = docs.select(F.col(key).alias("id"), no_null(text).alias("body"))
    hashed = materialize(
        texts.select("id", content_hash(F.col("body")).alias("hash"), F.unhex(F.sha2("body", 256)).alias("digest")), "hashes"
    )
    shared = materialize(hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "shared")
    members = texts.withColumn("hash", content_hash(F.col("body"))).join(shared, "hash", "left_semi")
    same = members.groupBy("hash", "body").agg(F.count(F.lit(1)).alias("n"), chosen("id").alias("keep_id"))
    # Rows find their group by both digests; two texts that shared even these must not be mixed up.
    found = same.groupBy("hash", F.unhex(F.sha2("body", 256)).alias("digest")).agg(
        F.max("n").alias("n"), chosen("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("texts")
    )
    found = materialize(
        found.filter(F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share MD5 and SHA-256"))).otherwise(F.lit(True))),
        "groups",
    )
    labelled = hashed.join(found, ["hash", "digest"], "left")
    alone = F.col("n").isNull()
    keep_id = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return labelled.select(
        F.col("id").alias(key),
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
