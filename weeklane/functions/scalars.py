"""Column expressions shared by all operators. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def monday(c: str | Column) -> Column:
    """Monday of the week that holds a date or timestamp."""
    return F.to_date(F.date_trunc("week", F.col(c) if isinstance(c, str) else c))


def monday_by_weekday(c: str | Column) -> Column:
    """The same Monday, by subtracting the day of the week."""
    day = F.to_date(F.col(c) if isinstance(c, str) else c)
    return F.date_sub(day, F.weekday(day))


def add_weeks(day: Column, weeks: int | Column) -> Column:
    return F.date_add(day, (weeks if isinstance(weeks, Column) else F.lit(weeks)) * F.lit(7))


def whole_weeks(later: Column, earlier: Column) -> Column:
    """Weeks between two days, rounded towards minus infinity."""
    return F.floor(F.datediff(later, earlier) / F.lit(7)).cast("int")


def parse_day(c: str | Column) -> Column:
    """Text to a date; unreadable text becomes null."""
    return F.to_date(F.try_to_timestamp(F.col(c) if isinstance(c, str) else c))


def number(c: str | Column) -> Column:
    """Anything to double; unreadable text and NaN become null."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x), x)


def safe_div(num: Column, den: Column) -> Column:
    """Null where the denominator is 0 or null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def clip(c: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Bounds that leave null as null (``greatest``/``least`` alone would skip it)."""
    out = c
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(c.isNotNull(), out)


def round6(c: Column) -> Column:
    """Six decimals and no negative zero: the form in which results are compared."""
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def normalize_name(c: Column) -> Column:
    """Lower case, runs of other characters to one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normalize_text(s: str) -> str:
    """The driver-side twin of ``normalize_name`` for column headers."""
    kept = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in s.lower())
    return "_".join(kept.split())


def season_flag(day: Column, first: str = "06-01", last: str = "10-15") -> Column:
    """1 when the month-day lies within two ``MM-dd`` bounds, both inclusive."""
    return F.date_format(day, "MM-dd").between(first, last).cast("int")


def origin_bucket(c: Column) -> Column:
    """Right-closed bins (-1,0], (0,5], (5,20], (20,100], (100,inf)."""
    return (
        F.when(c <= -1, F.lit(None).cast("string"))
        .when(c <= 0, "zero")
        .when(c <= 5, "1_5")
        .when(c <= 20, "6_20")
        .when(c <= 100, "21_100")
        .when(c > 100, "100p")
    )


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson over pair-complete rows; null where either side is constant."""
    a = F.when(y.isNotNull(), x.cast("double"))
    b = F.when(x.isNotNull(), y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def adjusted_skew(c: Column) -> Column:
    """Bias-adjusted skewness; null for fewer than three values or a constant."""
    n = F.count(c).cast("double")
    g1 = F.when((n >= 3) & (F.stddev_pop(c) > 0), F.skewness(c))
    return F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2)
