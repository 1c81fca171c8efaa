"""Merkle manifest of a dataset: per source a tree over its documents, and a tree over the sources.

The leaves of a source are numbered by key: rows are range-partitioned and sorted, and the counts of the partitions give
each row its place, so a hot source is spread like any other.  A builder takes an aligned block of ``BLOCK`` leaves and
appends every node to the block's log when its last child is written, which is postorder.  The roots of the blocks are the
leaves of the next tier, until each source has one root; the roots of the sources are the leaves of a last forest of one
group.  A log holds digests alone: the place of a node follows from the sizes of the full subtrees to its left (see
``position``), and proofs read the siblings of a run at these places.

A proof is a text: steps from the leaf to the root joined by ``/``, each the digests left of the node, a dot, and those
right of it.  A run of one has the step ``.``; a lone document has the empty proof.

Defined results: null fields are ``-``; a null source is a source, the first one; rows without a key come first in their
source; rows of equal key are ordered by leaf digest, and equal rows are leaves of their own; an empty table has no leaf and
no root; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.session import materialize

ARITY = 3
BLOCK_HEIGHT = 6
BLOCK = ARITY**BLOCK_HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST_BYTES = 32
_ROW_BITS = 33  # of monotonically_increasing_id


def digest_of(*hexes: str) -> str:
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def height_of(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    height = 0
    while leaves > 1:
        leaves, height = -(-leaves // ARITY), height + 1
    return height


def subtree_size(level: int, index: int, leaves: int) -> int:
    """Number of nodes of the subtree of node ``index`` at ``level``; the last one of a level may be ragged."""
    if (index + 1) * ARITY**level <= leaves:
        return (ARITY ** (level + 1) - 1) // (ARITY - 1)
    return sum(-(-leaves // ARITY**m) - index * ARITY ** (level - m) for m in range(level + 1))


def position(level: int, index: int, leaves: int) -> int:
    """Place of a node in the postorder log of a tree: all full subtrees to its left, then its own nodes up to it."""
    before, place, rest = 0, level, index
    while rest:
        before += rest % ARITY * ((ARITY ** (place + 1) - 1) // (ARITY - 1))
        place, rest = place + 1, rest // ARITY
    return before + subtree_size(level, index, leaves) - 1


def append_log(leaves: Sequence[str], height: int) -> list[str]:
    """Digests of a tree in the order in which its nodes are complete."""
    log: list[str] = []
    runs: list[list[str]] = [[] for _ in range(height)]

    def add(level: int, digest: str) -> None:
        log.append(digest)
        if level < height:
            runs[level].append(digest)
            if len(runs[level]) == ARITY:
                close(level)

    def close(level: int) -> None:
        digest = digest_of(*runs[level])
        runs[level].clear()
        add(level + 1, digest)

    for leaf in leaves:
        add(0, leaf)
    for level in range(height):
        if runs[level]:
            close(level)
    return log


def steps_of(log: str, leaves: int, height: int) -> list[list[str]]:
    """For each level below the root, the step of each node: its siblings read from the log at their positions."""

    def node(level: int, index: int) -> str:
        at = position(level, index, leaves) * 2 * DIGEST_BYTES
        return log[at : at + 2 * DIGEST_BYTES]

    out = []
    for level in range(height):
        width = -(-leaves // ARITY**level)
        digests = [node(level, i) for i in range(width)]
        runs = [digests[i : i + ARITY] for i in range(0, width, ARITY)]
        out.append(["".join(run[:k]) + "." + "".join(run[k + 1 :]) for run in runs for k in range(len(run))])
    return out


def fold(leaf: str, proof: str) -> str:
    """The root that a leaf and a proof lead to."""
    for step in proof.split("/") if proof else ():
        left, right = step.split(".")
        leaf = digest_of(left, leaf, right)
    return leaf


def leaf_digest(fields: Sequence[str | Column]) -> Column:
    """SHA-256 of all fields, each as its length in bytes, a colon and its value, or ``-``."""
    texts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def ranked(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of ``grp, id, leaf, altered`` with their ``index`` in the group and the group's ``total``."""
    # Equal rows are many leaves; the last key spreads them over partitions too.
    spread = leaves.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange("grp", *order, "salt").drop("salt")
    placed = spread.sortWithinPartitions("grp", *order).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("part", F.shiftright("at", _ROW_BITS)), "ranked")
    # One row per group and partition: a hot group has as many as there are partitions.
    parts = placed.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    in_order = W.partitionBy("grp").orderBy("part")
    before = F.coalesce(F.sum("n").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(F.col("grp").alias("g"), F.col("part").alias("p"), (before - F.col("first")).alias("shift"),
                           F.sum("n").over(W.partitionBy("grp")).alias("total"))
    offsets = materialize(offsets, "offsets")
    joined = placed.join(offsets, F.col("grp").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return joined.select("grp", "id", "leaf", "altered", (F.col("at") + F.col("shift")).alias("index"), "total")


def _logs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks of a partition sorted by group and index; the last block of a batch waits for the next batch."""
    waiting = None

    def built(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        ends = np.append(starts[1:], rows.num_rows)
        leaves = [x.hex() for x in rows.column("leaf").to_pylist()]
        totals = rows.column("total").take(pa.array(starts)).to_pylist()
        heights = [BLOCK_HEIGHT if total > BLOCK else height_of(total) for total in totals]
        logs = [bytes.fromhex("".join(append_log(leaves[a:b], h))) for a, b, h in zip(starts, ends, heights, strict=True)]
        cuts = pa.array(np.append(starts, rows.num_rows), pa.int32())
        first = pa.array(starts)
        columns = [rows.column("grp").take(first), rows.column("block").take(first), rows.column("total").take(first),
                   pa.array(ends - starts, pa.int32()), pa.array(heights, pa.int32()), pa.array(logs, pa.binary()),
                   *[pa.ListArray.from_arrays(cuts, rows.column(c)) for c in ("id", "altered")]]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        if waiting is not None:
            batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        starts = np.flatnonzero(batch.column("slot").to_numpy() == 0)
        if len(starts) > 1:
            yield built(batch.slice(0, int(starts[-1])), starts[:-1])
        waiting = batch.slice(int(starts[-1])) if len(starts) else batch
    if waiting is not None and waiting.num_rows:
        yield built(waiting, np.zeros(1, np.int64))


def _segments(leaves: DataFrame) -> DataFrame:
    """One row per block: its log, and the ids and altered leaves of its own leaves."""
    block = F.floor(F.col("index") / BLOCK).cast("bigint")
    rows = leaves.select("grp", block.alias("block"), F.pmod("index", F.lit(BLOCK)).alias("slot"), "total", "id", "leaf", "altered")
    kind = rows.schema["id"].dataType
    schema = T.StructType.fromDDL("grp string, block bigint, total bigint, leaves int, height int, log binary")
    schema = schema.add("ids", T.ArrayType(kind)).add("altered", T.ArrayType(T.BinaryType()))
    dealt = rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "slot")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kinds = {f.name: f.type for f in first.schema}
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(kinds["id"]), pa.list_(pa.binary())]
        yield from _logs(chain([first], batches), pa.schema(list(zip(schema.names, types, strict=True))))

    return dealt.mapInArrow(work, schema)


def forest(leaves: DataFrame, order: Sequence[str]) -> list[DataFrame]:
    """Tiers of logs over ``grp, id, leaf, altered``, the lowest first; each tier is ``BLOCK`` times smaller."""
    tiers, now = [], ranked(leaves, order)
    while True:
        segments = materialize(_segments(now), "merkle-log")
        tiers.append(segments)
        above = segments.filter(F.col("total") > BLOCK)
        if above.isEmpty():
            return tiers
        now = above.select(
            "grp", F.col("block").alias("id"), F.substring("log", -DIGEST_BYTES, DIGEST_BYTES).alias("leaf"),
            F.lit(None).cast("binary").alias("altered"), F.col("block").alias("index"), F.ceil(F.col("total") / BLOCK).alias("total"),
        )


def tops(tiers: Sequence[DataFrame]) -> DataFrame:
    """``grp, tier, top``: the root of each group and the tier that holds it."""
    out = None
    for i, segments in enumerate(tiers):
        found = segments.filter(F.col("total") <= BLOCK).select(
            "grp", F.lit(i).alias("tier"), F.substring("log", -DIGEST_BYTES, DIGEST_BYTES).alias("top"))
        out = found if out is None else out.unionByName(found)
    return out


def leaf_proofs(tiers: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """``id, leaf, altered, subroot, root, proof`` of every leaf.

    ``above`` has ``grp, tier, subroot, root, proof``: what leads from the root of each group further up.
    """
    kind = tiers[0].schema["ids"].dataType.elementType
    up = None
    for i in range(len(tiers) - 1, -1, -1):
        own = above.filter(F.col("tier") == i).select(F.col("grp").alias("g"), F.lit(0).cast("bigint").alias("b"), "subroot", "root", "proof")
        up = own if up is None else up.unionByName(own)
        segments = tiers[i].join(up, F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b"))).drop("g", "b")
        schema = T.StructType([T.StructField("grp", T.StringType()), T.StructField("id", kind if i == 0 else T.LongType()),
                               *T.StructType.fromDDL("leaf string, altered binary, subroot string, root string, proof string")])
        below = segments.mapInArrow(_read_proofs, schema)
        up = below.select(F.col("grp").alias("g"), F.col("id").alias("b"), "subroot", "root", "proof") if i else below
    return up.select("id", "leaf", F.lower(F.hex("altered")).alias("altered"), "subroot", "root", "proof")


def _read_proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            n, height, log = row["leaves"].as_py(), row["height"].as_py(), row["log"].as_py().hex()
            steps = steps_of(log, n, height)
            rest = row["proof"].as_py()
            tail = [rest] if rest else []
            paths = ["/".join([*[steps[m][k // ARITY**m] for m in range(height)], *tail]) for k in range(n)]
            leaves = [log[at : at + 2 * DIGEST_BYTES] for at in (position(0, k, n) * 2 * DIGEST_BYTES for k in range(n))]
            same = pa.array(np.zeros(n, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("grp").slice(i, 1).take(same), row["ids"].values, pa.array(leaves), row["altered"].values,
                 batch.column("subroot").slice(i, 1).take(same), batch.column("root").slice(i, 1).take(same), pa.array(paths)],
                ["grp", "id", "leaf", "altered", "subroot", "root", "proof"],
            )


def manifest(docs: DataFrame, key: str = "doc_id", source: str = "source", fields: Sequence[str] = FIELDS, text: str = "text",
             altered: Column | None = None) -> DataFrame:
    """Per document ``key, leaf, subroot, root, proof``, and ``altered``: the leaf of its text as ``altered`` has it.

    ``altered`` is a column over ``docs``; where it is null, so is the leaf.
    """
    changed = F.lit(None).cast("string") if altered is None else altered
    other = F.when(changed.isNotNull(), leaf_digest([changed if f == text else f for f in fields]))
    leaves = docs.select(F.col(source).cast("string").alias("grp"), F.col(key).alias("id"), F.unhex(leaf_digest(fields)).alias("leaf"),
                         F.unhex(other).alias("altered"))
    by_source = forest(materialize(leaves, "leaves"), ["id", "leaf"])
    roots = materialize(tops(by_source), "subroots")
    over = forest(roots.select(F.lit("").alias("grp"), F.col("grp").alias("id"), F.col("top").alias("leaf"), F.lit(None).cast("binary").alias("altered")), ["id"])
    crown = tops(over).select("grp", "tier", F.lit("").alias("subroot"), F.lower(F.hex("top")).alias("root"), F.lit("").alias("proof"))
    ways = leaf_proofs(over, crown).select(F.col("id").alias("of"), F.col("leaf").alias("subroot"), "root", "proof")
    above = roots.join(ways, F.col("grp").eqNullSafe(F.col("of"))).select("grp", "tier", "subroot", "root", "proof")
    found = leaf_proofs(by_source, materialize(above, "ways"))
    return found.withColumnRenamed("id", key)


def folded(rows: DataFrame, leaf: str = "leaf", proof: str = "proof", out: str = "folded_root") -> DataFrame:
    """``rows`` with the root that ``leaf`` and ``proof`` lead to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(leaf).to_pylist(), batch.column(proof).to_pylist(), strict=True)
            yield batch.append_column(out, pa.array([fold(a, b) for a, b in pairs], pa.string()))

    return rows.mapInArrow(work, T.StructType([*rows.schema, T.StructField(out, T.StringType())]))
