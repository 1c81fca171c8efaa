"""SimHash near-duplicates found by deletion variants.

A 64-bit fingerprint is cut into three segments.  Of two fingerprints that differ in at most four bits, one segment
differs in at most one bit, since three segments with two each would make six.  Every segment is indexed with each of
its bits left out in turn: two segments that differ in at most one bit then share a variant.  Fingerprints that share
a variant are compared in blocks inside the tasks, and of a bucket only links that join what is not yet joined come
out, at most one per member.  A bucket beyond ``BLOCK`` members is cut into blocks, and every two blocks meet.

Defined results: a null or blank text has fingerprint zero and is linked like any other; copies share a fingerprint
and meet the index once; repeated rows come out as often as they come in; a row without an id takes part and never
names a component while another id is there; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from talkgauge.llm.common import no_null, slices
from talkgauge.llm.components import components
from talkgauge.session import materialize

BITS = 64
MOST_DIFFERENT = 4
SHINGLE_WORDS = 4
HASH_SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
BLOCK = 4096
_CHUNK = 1 << 15
_ROWS = 1 << 18
_SALTS = 32


def _votes(hashes: Iterator[int]) -> tuple[int, np.ndarray]:
    """Number of hashes and, for each bit, in how many it is set; a bounded chunk at a time."""
    count, set_bits = 0, np.zeros(BITS, dtype=np.int64)
    while len(chunk := np.fromiter(islice(hashes, _CHUNK), dtype="<u8")):
        bits = np.unpackbits(chunk.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
        count += len(chunk)
    return count, set_bits


def fingerprint(text: str | None, words_each: int = SHINGLE_WORDS) -> int:
    """SimHash over the word shingles of one text, as an unsigned number.

    ``bytes.lower`` changes A to Z alone, and ``bytes.split`` cuts at 0x20 and 0x09 to 0x0D.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < words_each:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(words_each)], strict=False))
    count, set_bits = _votes(xxh64_intdigest(s, HASH_SEED) for s in shingles)
    return int(np.packbits(set_bits * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, print`` of every row, the fingerprint as a signed 64-bit number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column("body")), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints.view(np.int64))], ["id", "print"])

    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("body"))
    return rows.mapInArrow(work, "id bigint, print bigint")


def fingerprints_by_text(texts: DataFrame) -> DataFrame:
    """``digest, print`` of each distinct text in column ``body``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column("body")), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(prints.view(np.int64))], ["digest", "print"])

    rows = texts.select(F.sha2(no_null("body"), 256).alias("digest"), no_null("body").alias("body"))
    return rows.dropDuplicates(["digest"]).mapInArrow(work, "digest string, print bigint")


def variants(prints: DataFrame) -> DataFrame:
    """One row per print and left-out bit: the bucket ``key`` names the bit and the rest of its segment."""
    with_bit = prints.select("print", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit"))

    def per_segment(value) -> Column:
        out = F.lit(value(*SEGMENTS[-1]))
        for first, width in reversed(SEGMENTS[:-1]):
            out = F.when(F.col("bit") < first + width, F.lit(value(first, width))).otherwise(out)
        return out

    cut = with_bit.select("print", "bit", per_segment(lambda f, w: f).alias("first"), per_segment(lambda f, w: (1 << w) - 1).alias("mask"))
    rest = F.expr("(shiftrightunsigned(print, first) & mask) & ~shiftleft(1L, bit - first)")
    return cut.select("print", (F.col("bit").cast("bigint") * (1 << 22) + rest).cast("int").alias("key"))


def joining_links(group: np.ndarray, prints: np.ndarray, most: int = MOST_DIFFERENT) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, inside each run of equal ``group``, all prints within ``most`` bits of each other.

    Row ``i`` meets row ``i + step`` for growing steps as long as both are in one run; pairs already joined are not
    joined again, so at most one link per row comes out.
    """
    label = np.arange(len(group))
    live = np.flatnonzero(group[1:] == group[:-1])
    step = 1
    while len(live):
        near = live[np.bitwise_count(prints[live] ^ prints[live + step]) <= most]
        a, b = label[near], label[near + step]
        while (open_ := a != b).any():
            a, b = a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (next_ := label[label]).tobytes() != label.tobytes():
                label = next_
            a, b = label[a], label[b]
        step += 1
        live = live[live + step < len(group)]
        live = live[group[live + step] == group[live]]
    joined = np.flatnonzero(label != np.arange(len(group)))
    return prints[joined], prints[label[joined]]


def _links_in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by group; a group cut by a batch border waits for the next batch."""
    group, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def out(upto: int) -> pa.RecordBatch:
        a, b = joining_links(group[:upto], prints[:upto])
        pairs = np.unique(np.stack([a, b], axis=1), axis=0).view(np.int64) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        group = np.concatenate([group, batch.column("group").to_numpy(zero_copy_only=False)])
        prints = np.concatenate([prints, batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)])
        if len(group) >= _ROWS:
            upto = int(np.searchsorted(group == group[-1], True))
            yield out(upto)
            group, prints = group[upto:], prints[upto:]
    yield out(len(group))


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a, b``: links that connect all distinct ``prints`` within ``MOST_DIFFERENT`` bits, directly or in turn."""
    index = variants(prints)
    crowded = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    crowded = materialize(crowded, "crowded")
    usual = index.join(crowded, "key", "left_anti").select(F.col("key").cast("bigint").alias("group"), "print")
    # Every row of a crowded bucket goes to one group for each block its own block meets.
    blocks = F.ceil(F.col("n") / block)
    own = F.pmod(F.xxhash64("print"), F.col("blocks"))
    split = index.join(crowded, "key").withColumn("blocks", blocks).withColumn("own", own)
    split = split.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    # Groups of crowded buckets are negative, those of usual ones are not; two cells that share a hash only meet once more.
    split = split.select(cell.bitwiseOR(F.lit(-(1 << 63))).alias("group"), "print")
    grouped = usual.unionByName(split).repartition("group").sortWithinPartitions("group", "print")
    return grouped.mapInArrow(_links_in_buckets, "a bigint, b bigint").distinct()


def rooted_prints(printed: DataFrame) -> DataFrame:
    """``print, root, component_id`` of every distinct fingerprint of a written table ``id, print``."""
    distinct = materialize(printed.groupBy("print").agg(F.min("id").alias("least")), "distinct-prints")
    rooted = materialize(components(links(distinct.select("print"))), "roots")
    named = distinct.join(rooted, F.col("print") == F.col("node"), "left").select("print", "least", "root")
    # A print without a link is its own component; only the others need the least id over the component.  A component
    # may hold a third of all prints, so its row is dealt to several tasks.
    ids = named.filter("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    ids = ids.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = named.withColumn("salt", F.pmod(F.xxhash64("print"), F.lit(_SALTS)).cast("int"))
    return salted.join(ids, ["root", "salt"], "left").select(
        "print", F.coalesce("root", "print").alias("root"),
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
    )


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its ``fingerprint`` (16 hex digits) and ``component_id``, the least id that links reach."""
    printed = materialize(fingerprints(docs, key, text), "prints")
    placed = rooted_prints(printed)
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return printed.join(placed, "print").select(F.col("id").alias(key), hexed.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the least id.

    Only ids are joined with the texts.  Rows that repeat an id are few; of those that also share a group one stays.
    """
    printed = materialize(fingerprints(docs, key, text), "prints")
    placed = materialize(rooted_prints(printed), "placed")
    rows = printed.join(placed, "print")
    not_first = rows.filter(~F.col("id").eqNullSafe(F.col("component_id"))).select("id")
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    # Rows are packed, so no column of theirs can clash with the names used here.
    packed = docs.select(F.struct("*").alias("row"), F.col(key).alias("id"), F.col(text).alias("body"))
    apart = materialize(not_first.unionByName(repeated).distinct().withColumnRenamed("id", "apart"), "apart")
    plain = packed.join(apart, F.col("id").eqNullSafe(F.col("apart")), "left_anti")
    again = materialize(repeated.withColumnRenamed("id", "again"), "repeated")
    doubled = packed.join(again, F.col("id").eqNullSafe(F.col("again")), "left_semi")
    of_text = fingerprints_by_text(doubled.select("body").distinct()).join(placed, "print")
    of_text = of_text.select("digest", "root", "component_id")
    named = doubled.select("row", "id", F.sha2(no_null("body"), 256).alias("digest"))
    kept = named.join(of_text, "digest").filter(F.col("id").eqNullSafe(F.col("component_id")))
    kept = kept.dropDuplicates(["id", "root"])
    return plain.select("row.*").unionByName(kept.select("row.*"))
