"""Conditions under which a row may be traded, as columns, and their conjunction."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import time as Clock
from functools import reduce
from operator import and_

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def seconds_of_day(time: str | Column) -> Column:
    """Seconds since midnight, fractions of a second included."""
    at = F.col(time) if isinstance(time, str) else time
    return F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at) + F.date_format(at, "SSSSSS").cast("double") / 1e6


def day_and_time(time: str, days: Sequence[int] | None = None, ranges: Sequence[tuple[Clock, Clock]] | None = None) -> Column:
    """True on these weekdays (0 is Monday) and within one of these times of day, both ends included.

    None allows any; a null time is not allowed.
    """
    allowed = F.col(time).isNotNull()
    if days is not None:
        allowed &= F.weekday(time).isin(list(days))
    if ranges is not None:
        now = seconds_of_day(time)
        least = lambda t: t.hour * 3600 + t.minute * 60 + t.second + t.microsecond / 1e6
        allowed &= reduce(lambda a, b: a | b, [now.between(least(a), least(b)) for a, b in ranges], F.lit(False))
    return _sure(allowed)


def spread_below(spread: str, most: float) -> Column:
    """True where the spread is less than the most; a null spread is not."""
    return _sure(F.col(spread) < most)


def positions_below(open_positions: str, most: int) -> Column:
    """True where fewer positions are open; null counts as none."""
    return F.coalesce(F.col(open_positions), F.lit(0)) < most


def every(*conditions: Column) -> Column:
    """True where all hold; of no condition, everywhere."""
    return reduce(and_, [_sure(c) for c in conditions], F.lit(True))


def open_positions(starts: Column, ends: Column, order: WindowSpec) -> Column:
    """Positions opened less those closed before this row, along a window's order; flags may be null."""
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(starts.cast("long"), F.lit(0)) - F.coalesce(ends.cast("long"), F.lit(0))
    return F.coalesce(F.sum(moved).over(before), F.lit(0))
