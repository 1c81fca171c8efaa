"""Versions of a table as hash trees, and the difference of two of them.

A version keeps, for each key, the number of its rows and a digest of them; keys lie in buckets by their hash, each with a
digest; the root is made of the bucket digests.  The difference of two versions reads the small table of bucket digests and
then only buckets whose digests differ.  Rows themselves are not stored.  A changed row costs the reading of its bucket, so
give a large table more buckets; their files are split by size, whatever their number.

Digests of keys and buckets are sums of row digests, so they depend neither on order nor on partitions, and a key that
holds a third of all rows is added up before the shuffle.  They reveal changes; they are no guard against forgery.  A null
key is a key of its own, repeated keys count with their copies, and an empty table has a root too.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge.sources.folders import path_exists, read_text, write_text

BUCKETS = 128
DESCRIPTION = "version.json"
_PARTS = [f"_p{i}" for i in range(4)]


def _sums(digest: Column) -> list[Column]:
    """Four numbers of 60 bits from a digest, as they are added up."""
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)").alias(p) for i, p in enumerate(_PARTS)]


def _total(n: Column) -> Column:
    return F.sha2(F.concat_ws(":", n.cast("string"), *[F.sum(p).cast("string") for p in _PARTS]), 256)


def write_version(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> str:
    """Write the hash tree of ``rows`` to ``path`` and return its root; all columns count, whatever their order.

    The description is written last: a version without it is not there and may be written anew, one with it never changes.
    """
    spark, columns = rows.sparkSession, sorted(rows.columns)
    if path_exists(spark, f"{path}/{DESCRIPTION}"):
        raise FileExistsError(f"{path} holds a version")
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])), 256)
    hashed = rows.select(F.col(f"`{key}`").alias("key"), digest.alias("_digest")).select("key", *_sums(F.col("_digest")))
    keys = hashed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), _total(F.count(F.lit(1))).alias("digest"))
    keys = keys.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    keys.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/keys")
    stored = spark.read.schema(keys.schema).parquet(f"{path}/keys")
    each = stored.select("bucket", "n", *_sums(F.col("digest")))
    digests = each.groupBy("bucket").agg(F.sum("n").alias("n"), _total(F.sum("n")).alias("digest"))
    digests.coalesce(1).write.mode("overwrite").parquet(f"{path}/buckets")
    # At most as many rows as there are buckets.
    leaves = spark.read.parquet(f"{path}/buckets").orderBy("bucket").collect()
    layout = {"key": key, "columns": columns, "buckets": buckets, "type": keys.schema["key"].dataType.simpleString()}
    tree = "\n".join([json.dumps(layout), *[f"{r.bucket}:{r.n}:{r.digest}" for r in leaves]])
    root = hashlib.sha256(tree.encode()).hexdigest()
    write_text(spark, f"{path}/{DESCRIPTION}", json.dumps({**layout, "root": root}))
    return root


def describe_version(spark: SparkSession, path: str) -> dict:
    """``root, key, columns, buckets`` and key ``type`` of a version; an error if it is not complete."""
    if not path_exists(spark, f"{path}/{DESCRIPTION}"):
        raise FileNotFoundError(f"no complete version in {path}")
    return json.loads(read_text(spark, f"{path}/{DESCRIPTION}"))


def changed_buckets(spark: SparkSession, old: str, new: str) -> list[int]:
    """Numbers of the buckets in which two versions differ."""
    a, b = (spark.read.parquet(f"{p}/buckets").select("bucket", F.col("digest").alias(name)) for p, name in ((old, "a"), (new, "b")))
    differs = a.join(b, "bucket", "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    return sorted(r.bucket for r in differs.select("bucket").collect())


def difference(spark: SparkSession, old: str, new: str) -> DataFrame:
    """``key, change, n_old, n_new`` of the versions in two folders; ``change`` is added, removed or changed.

    Only the files of buckets that differ are read.
    """
    first, second = describe_version(spark, old), describe_version(spark, new)
    for part in ("key", "type", "buckets"):
        if first[part] != second[part]:
            raise ValueError(f"versions differ in their {part}: {first[part]} and {second[part]}")
    schema = f"key {first['type']}, n bigint, digest string, bucket int"
    # Equal roots stand for equal tables; other columns change every row digest, so all buckets differ then.
    numbers = [] if first["root"] == second["root"] else changed_buckets(spark, old, new)
    inside = F.col("bucket").isin(numbers) if numbers else F.lit(False)
    a, b = (spark.read.schema(schema).parquet(f"{p}/keys").filter(inside) for p in (old, new))
    a, b = a.alias("a"), b.alias("b")
    met = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & F.col("a.key").eqNullSafe(F.col("b.key")), "full")
    change = F.when(F.col("a.n").isNull(), "added").when(F.col("b.n").isNull(), "removed").when(F.col("a.digest") != F.col("b.digest"), "changed")
    rows = met.select(
        F.when(F.col("a.n").isNull(), F.col("b.key")).otherwise(F.col("a.key")).alias("key"), change.alias("change"),
        F.coalesce("a.n", F.lit(0)).alias("n_old"), F.coalesce("b.n", F.lit(0)).alias("n_new"),
    )
    return rows.filter("change is not null")
