"""Reproducible pseudo-randomness from row keys: no state, no dependence on partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PRIME = 2_147_483_647
_STEP = 40_503


def hash_place(key: Column | str, seed: int | str) -> Column:
    """Place of a row in hash order: SHA-256 of ``seed:key`` in hex."""
    key = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def row_seed(key: Column | str, seed: int | str) -> Column:
    """60 bits of the MD5 of ``seed:key``: the start of a row's own number sequence."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def unit(start: Column, place: Column) -> Column:
    """The ``place``-th number in [0, 1) of a row's sequence.

    Two squarings modulo a prime on both halves of the seed: a few integer
    operations per number, where a digest per number would cost microseconds.
    """
    low = F.pmod(start.bitwiseAND(F.lit(_PRIME).cast("bigint")) + place.cast("bigint") * _STEP, F.lit(_PRIME))
    once = F.pmod(low * low + F.shiftright(start, 31), F.lit(_PRIME))
    twice = F.pmod(once * once + place.cast("bigint") + 6789, F.lit(_PRIME))
    return twice / F.lit(float(_PRIME))


def units(start: Column, count: Column) -> Column:
    """The first ``count`` numbers; the seed is computed once, not per number."""
    return F.transform(F.array_repeat(start, count), lambda s, i: unit(s, i))
