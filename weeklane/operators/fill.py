"""Capped carry-forward beyond an as-of day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weeklane.config import GEO, WEEK
from weeklane.functions.scalars import whole_weeks


def locf_cap(
    df: DataFrame,
    cols: list[str],
    ceiling: dt.date,
    max_weeks: int,
    keys: tuple[str, ...] = (GEO,),
    time: str = WEEK,
) -> DataFrame:
    """After ``ceiling`` take the values of the last row at or before it, for ``max_weeks``; then null."""
    day = F.lit(ceiling)
    after = F.col(time) > day
    upto = F.when(F.col(time) <= day, F.col(time))
    last = F.max_by(F.struct(*cols), upto).over(Window.partitionBy(*keys))
    near = whole_weeks(F.col(time), day) <= max_weeks
    out = df.withColumn("_last", last)
    fixed = {c: F.when(~after, F.col(c)).when(near, F.col(f"_last.{c}")) for c in cols}
    return out.withColumns(fixed).drop("_last")
