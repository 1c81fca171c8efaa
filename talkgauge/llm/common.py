"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_KEPT_POWERS = [np.zeros(0, np.uint64)]
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def no_null(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the named column holds at most ``limit`` bytes in each, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text column and the ``n + 1`` offsets of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(column) else raw[:0], offsets - offsets[0]


# The blanks between words: 0x20 and 0x09 to 0x0D.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def word_spans(raw: np.ndarray, offsets: np.ndarray, letters: np.ndarray = ~BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of ``letters``, and for each row the number of runs before it (``n + 1`` values)."""
    inside = letters[raw]
    first = inside.copy()
    last = inside.copy()
    if len(raw):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
    # A word also begins and ends where its row does.
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash base; those of the usual sizes are kept."""
    if len(_KEPT_POWERS[0]) < n:
        powers = np.full(max(n, STEP_BYTES + 1), _BASE, dtype=np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        if n > STEP_BYTES + 1:
            return powers
        _KEPT_POWERS[0] = powers
    return _KEPT_POWERS[0][:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    # Multiplying by the power that is missing up to a common place makes spans comparable.
    value = (sums[ends] - sums[starts]) * powers[len(raw) - starts]
    undo = np.uint64(pow(int(powers[len(raw)]), -1, 1 << 64))
    value = value * undo
    value ^= value >> np.uint64(33)
    value *= _MIX
    value ^= value >> np.uint64(29)
    return value + (ends - starts).astype(np.uint64) * _BASE
