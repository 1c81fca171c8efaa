"""Exponential time decay on UTC microseconds.

All arithmetic is done on epoch microseconds, so the session time zone never
shifts an age.
"""

from __future__ import annotations

import math
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def to_micros(moment: datetime | str | int) -> int:
    """Epoch microseconds; naive datetimes and ISO strings are read as UTC."""
    if isinstance(moment, int):
        return moment
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    delta = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def micros(ts: Column | str) -> Column:
    """Epoch microseconds of a timestamp column."""
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def day_number(ts: Column | str) -> Column:
    """Days since 1970-01-01 in UTC."""
    return F.floor(micros(ts) / F.lit(MICROS_PER_DAY)).cast("bigint")


def _moment(moment) -> Column:
    return moment if isinstance(moment, Column) else F.lit(to_micros(moment))


def rate(half_life_days: float) -> float:
    if half_life_days <= 0:
        raise ValueError("half life must be positive")
    return math.log(2) / half_life_days


def age_days(ts_micros: Column, as_of) -> Column:
    """Fractional days between an event (microseconds) and ``as_of``."""
    return (_moment(as_of) - ts_micros) / F.lit(float(MICROS_PER_DAY))


def weight(ts_micros: Column, as_of, half_life_days: float, clamp_future: bool = False) -> Column:
    """Half-life weight; events after ``as_of`` weigh more than 1 unless clamped."""
    age = age_days(ts_micros, as_of)
    if clamp_future:
        age = F.greatest(age, F.lit(0.0))
    return F.exp(F.lit(-rate(half_life_days)) * age)


def fade(amount: Column, since_micros: Column, as_of, half_life_days: float) -> Column:
    """Carry a stored sum from its own as-of to a later one."""
    return amount * weight(since_micros, as_of, half_life_days)


def forward_weight(ts_micros: Column, landmark, half_life_days: float) -> Column:
    """Growing weight relative to a fixed landmark (forward decay).

    Sums of it are plain sums: mergeable, order-free and valid for late rows.
    ``forward_scale`` turns such a sum into the backward-decayed sum at a time.
    """
    return F.exp(F.lit(rate(half_life_days)) * (ts_micros - _moment(landmark)) / F.lit(float(MICROS_PER_DAY)))


def forward_scale(landmark, as_of, half_life_days: float) -> Column:
    return F.exp(F.lit(-rate(half_life_days)) * (_moment(as_of) - _moment(landmark)) / F.lit(float(MICROS_PER_DAY)))
