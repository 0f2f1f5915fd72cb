"""Row windows over a panel. Rows per series are bounded by the calendar, see the package note."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from weeklane.config import GEO, WEEK


def series(keys: str | list[str] = GEO, order: str | Column = WEEK) -> WindowSpec:
    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(order)


def by_day(offset_days: int, keys: str | list[str] = GEO, time: str = WEEK) -> WindowSpec:
    """The row exactly ``offset_days`` away: a calendar look-up without a join."""
    w = Window.partitionBy(*([keys] if isinstance(keys, str) else keys))
    return w.orderBy(F.unix_date(time)).rangeBetween(offset_days, offset_days)


def rolling(
    c: Column,
    width: int,
    over: WindowSpec,
    agg=F.avg,
    shift: int = 0,
    min_periods: int | None = None,
) -> Column:
    """Rolling aggregate of ``width`` rows ending ``shift`` rows before the current one.

    Null until ``min_periods`` (default: ``width``) values are in the frame.
    """
    frame = over.rowsBetween(-(width - 1) - shift, -shift)
    need = width if min_periods is None else min_periods
    return F.when(F.count(c).over(frame) >= need, agg(c).over(frame))


def average_rank(c: str, keys: list[str]) -> Column:
    """Rank with ties averaged; the peer count shares the sort of the rank."""
    w = Window.partitionBy(*keys).orderBy(c)
    peers = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.rank().over(w) + (peers - 1) / F.lit(2.0)
