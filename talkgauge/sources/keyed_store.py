"""A table under a key that many small runs add to.

Rows lie in hash buckets of their key.  A commit writes one part for each bucket that its rows fall into and leaves all
other files as they are; for each key the newest part counts.  A bucket with more than ``most_parts`` parts is merged into
one by the commit that made it so.  A commit counts once its small file under ``commits`` is there, so a run that broke off
leaves nothing behind that is read; the file names the parts that its parts replace, so commits that overlap lose nothing
and every reader sees the same winner: the greater commit name.

With ``filtered``, each part has a Bloom filter, and a reader that knows its keys opens only the parts that can hold one of
them.

A commit has one row for each key; keys may be null; a store without commits has no rows; a commit without rows changes
nothing.  Replaced parts are kept, for readers that still hold them.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.sources.folders import list_folders, list_names, read_text, write_text

BUCKETS = 16
MOST_PARTS = 8
# Bloom filters: hashes and bits for each key, and how many bitmaps a part may have at most.
HASHES = 3
BITS_PER_KEY = 16
BITMAP_BITS = 32_768
MOST_BITMAPS = 64
_FILTERS = "bucket int, bitmaps int, bits map<bigint,binary>"


class KeyedStore:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: Sequence[str], buckets: int = BUCKETS,
                 most_parts: int = MOST_PARTS, filtered: bool = False):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, list(key)
        self.buckets, self.most_parts, self.filtered = buckets, most_parts, filtered

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def commits(self) -> list[str]:
        """Names of complete commits, oldest first."""
        names = list_names(self.spark, f"{self.root}/commits")
        return sorted(n.removesuffix(".json") for n in names if n.endswith(".json"))

    def parts(self) -> dict[int, list[str]]:
        """Commits whose part of a bucket counts, oldest first: from the commit files, at most buckets x parts names each."""
        live, gone = defaultdict(list), set()
        for commit in self.commits():
            told = json.loads(read_text(self.spark, f"{self.root}/commits/{commit}.json"))
            for bucket in told["buckets"]:
                live[bucket].append(commit)
            gone |= {(int(b), c) for b, commits in told["replaces"].items() for c in commits}
        kept = {b: [c for c in commits if (b, c) not in gone] for b, commits in live.items()}
        return {b: commits for b, commits in kept.items() if commits}

    def _positions(self, bitmaps: Column) -> Column:
        hashes = F.array(*[F.xxhash64(F.lit(i), *self.key) for i in range(HASHES)])
        return F.transform(hashes, lambda h: F.pmod(h, bitmaps.cast("bigint") * BITMAP_BITS))

    def _holding(self, live: dict[int, list[str]], keys: DataFrame) -> dict[int, list[str]]:
        """Parts whose filter lets one of the keys through."""
        paths = [f"{self.root}/filters/commit={c}" for c in sorted({c for commits in live.values() for c in commits})]
        schema = T.StructType([*T.StructType.fromDDL(_FILTERS), T.StructField("commit", T.StringType())])
        filters = self.spark.read.schema(schema).option("basePath", f"{self.root}/filters").parquet(*paths)
        asked = keys.select(*self.key, self._bucket().alias("_bucket"))
        # Bounded by buckets x parts x MOST_BITMAPS bitmaps of 4 KB.
        met = asked.join(F.broadcast(filters), F.col("_bucket") == F.col("bucket"))

        def is_set(spot: Column) -> Column:
            bitmap, bit = F.try_element_at("bits", F.floor(spot / BITMAP_BITS)), F.pmod(spot, F.lit(BITMAP_BITS)).cast("int")
            byte = F.conv(F.hex(F.substr(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))

        passed = met.filter(F.forall(self._positions(F.col("bitmaps")), is_set)).select("bucket", "commit").distinct()
        found = {tuple(r) for r in passed.collect()}
        held = {b: [c for c in commits if (b, c) in found] for b, commits in live.items()}
        return {b: commits for b, commits in held.items() if commits}

    def load(self, keys: DataFrame | None = None) -> DataFrame:
        """The newest row of each key; with ``keys`` (in a filtered store) of the parts that can hold one of them."""
        live = self.parts()
        if keys is not None and self.filtered and live:
            live = self._holding(live, keys)
        return self._merged(live)

    def _merged(self, live: dict[int, list[str]]) -> DataFrame:
        names = self.schema.fieldNames()
        whole = T.StructType([*self.schema, T.StructField("commit", T.StringType()), T.StructField("bucket", T.IntegerType())])

        def read(buckets: list[int]) -> DataFrame:
            paths = [f"{self.root}/data/commit={c}/bucket={b}" for b in buckets for c in live[b]]
            if not paths:
                return self.spark.createDataFrame([], whole)
            return self.spark.read.schema(whole).option("basePath", f"{self.root}/data").parquet(*paths)

        single, several = [b for b in live if len(live[b]) == 1], [b for b in live if len(live[b]) > 1]
        if not several:
            return read(single).select(*names)
        newest = read(several).groupBy(*self.key).agg(F.max_by(F.struct(*names), "commit").alias("row")).select("row.*")
        return newest.unionByName(read(single).select(*names)) if single else newest

    def write(self, rows: DataFrame, replace: bool = False) -> None:
        """Add rows, one for each key, or with ``replace`` put them in the place of all that is there."""
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        before = self.parts()
        written = self._commit(rows.select(*columns), before if replace else {})
        crowded = {b: before[b] for b in written if not replace and len(before.get(b, ())) >= self.most_parts}
        if crowded:
            now = self.parts()
            self._commit(self._merged({b: now[b] for b in crowded}), {b: now[b] for b in crowded})

    def _commit(self, rows: DataFrame, replaced: dict[int, list[str]]) -> list[int]:
        last = (self.commits() or ["0"])[-1].split("-")[0]
        commit = f"{int(last) + 1:010d}-{uuid.uuid4().hex[:12]}"
        data = f"{self.root}/data/commit={commit}"
        # One file for each bucket, unless it is large.
        bucketed = rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
        bucketed.write.mode("errorifexists").partitionBy("bucket").parquet(data)
        buckets = [int(name.split("=")[1]) for name in list_folders(self.spark, data) if name.startswith("bucket=")]
        if self.filtered:
            self._filters(data).write.mode("errorifexists").parquet(f"{self.root}/filters/commit={commit}")
        told = {"buckets": buckets, "replaces": {str(b): commits for b, commits in replaced.items()}}
        if buckets or replaced:
            write_text(self.spark, f"{self.root}/commits/{commit}.json", json.dumps(told))
        return buckets

    def _filters(self, data: str) -> DataFrame:
        """``bucket, bitmaps, bits`` of a written commit."""
        schema = T.StructType([*[self.schema[k] for k in self.key], T.StructField("bucket", T.IntegerType())])
        rows = self.spark.read.schema(schema).parquet(data)
        needed = F.ceil(F.count(F.lit(1)) * BITS_PER_KEY / BITMAP_BITS)
        sizes = rows.groupBy("bucket").agg(F.least(needed, F.lit(MOST_BITMAPS)).cast("int").alias("bitmaps"))
        spots = rows.join(F.broadcast(sizes), "bucket").select("bucket", "bitmaps", F.explode(self._positions(F.col("bitmaps"))).alias("spot"))
        maps = spots.groupBy("bucket", "bitmaps", F.floor(F.col("spot") / BITMAP_BITS).alias("no")).agg(
            F.bitmap_construct_agg(F.pmod("spot", F.lit(BITMAP_BITS))).alias("bits"))
        return maps.groupBy("bucket", "bitmaps").agg(F.map_from_entries(F.collect_list(F.struct("no", "bits"))).alias("bits"))
