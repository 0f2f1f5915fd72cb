"""Building, completing and checking a panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weeklane.config import GEO, NAME, VALUE, WEEK
from weeklane.functions.scalars import monday
from weeklane.functions.windows import series


def dedupe(df: DataFrame, keys: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """One row per key: the first (or last) in ``order``; nulls are never preferred.

    An aggregation, not a window: copies of a key are folded before the shuffle,
    so a key that holds a third of the table is no hot spot. Where keys are
    known to have few copies, ``first_in_series`` sorts the shuffled rows only.
    """
    rest = [c for c in df.columns if c not in keys]
    pick, absent = (F.min_by, Column.isNull) if keep == "first" else (F.max_by, Column.isNotNull)
    parts = [x for c in order for x in (absent(F.col(c)), F.col(c))]
    chosen = pick(F.struct(*rest), F.struct(*parts)).alias("_row")
    return df.groupBy(*keys).agg(chosen).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_in_series(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """As ``dedupe``, by a window: for keys whose copies are few, as those of a panel's series."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") == 1).drop("_k")


def build_panel(counts: DataFrame, covariates: DataFrame, tie_break: list[str] | None = None) -> DataFrame:
    """Counts with covariates where there are any, Monday anchored, one row per key."""
    joined = counts.join(covariates, [GEO, NAME, WEEK], "left").withColumn(WEEK, monday(WEEK))
    return first_in_series(joined, [GEO, WEEK], tie_break or [VALUE, NAME])


def densify(
    df: DataFrame,
    key: str = GEO,
    time: str = WEEK,
    carry: tuple[str, ...] = (NAME,),
    span: str = "series",
    fill: dict[str, object] | None = None,
) -> DataFrame:
    """Every Monday between the first and last week of the series (or of the table).

    Each row emits the weeks up to its successor, so one window over the series
    does it and later windows over the same key reuse its partitioning. Days are
    anchored to their Monday first; of rows that share a week the first in the
    order of the other columns stays.
    """
    others = [c for c in df.columns if c not in (key, time)]
    df = first_in_series(df.withColumn(time, monday(time)).filter(F.col(time).isNotNull()), [key, time], others or [time])
    df = df.select(key, time, *others)
    w = series(key, time)
    start = F.col(time)
    stop = F.coalesce(F.date_sub(F.lead(time).over(w), 7), F.col(time))
    if span == "table":
        ends = df.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
        start = F.when(F.lag(time).over(w).isNull(), ends.select("lo").scalar()).otherwise(F.col(time))
        stop = F.coalesce(F.date_sub(F.lead(time).over(w), 7), ends.select("hi").scalar())
    spanned = df.withColumn("_from", start).withColumn("_to", stop)
    week = F.explode(F.sequence("_from", "_to", F.expr("interval 7 days"))).alias("_week")
    rest = [c for c in df.columns if c not in (key, time)]
    out = spanned.select("*", week)
    own = F.col("_week") == F.col(time)
    cols = []
    for c in rest:
        if c in carry:
            cols.append(F.col(c))
            continue
        kept = F.when(own, F.col(c))
        if fill and c in fill:
            kept = F.coalesce(kept, F.lit(fill[c]).cast(df.schema[c].dataType))
        cols.append(kept.alias(c))
    return out.select(key, F.col("_week").alias(time), *cols)


def panel_qc(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Rows (check, n): null keys and values, negatives, surplus key copies, absent series."""
    per_key = df.groupBy(GEO, WEEK).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(WEEK).isNull()).alias("null_week"),
        F.count_if(F.col(VALUE).isNull()).alias("null_value"),
        F.count_if(F.col(VALUE) < 0).alias("negative"),
    )
    checks = {
        "null_weeks": F.sum("null_week"),
        "null_values": F.sum("null_value"),
        "negative_values": F.sum("negative"),
        "duplicate_keys": F.sum(F.col("n") - 1),
    }
    one = per_key.agg(*[F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in checks.items()])
    out = one.unpivot([], list(checks), "check", "n")
    if not required:
        return out
    ids = df.sparkSession.createDataFrame([(g,) for g in required], f"{GEO} string")
    absent = missing_members(df, ids).withColumn("n", F.lit(1).cast("long"))
    every = ids.join(absent, GEO, "left").select(F.concat(F.lit("missing_"), GEO).alias("check"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return out.unionByName(every)


def missing_members(df: DataFrame, required: DataFrame, key: str = GEO) -> DataFrame:
    """Required ids that have no row."""
    return required.select(key).distinct().join(df.select(key).distinct(), key, "left_anti")


def week_anchor_check(df: DataFrame, key: str = GEO, time: str = WEEK) -> DataFrame:
    """Per series: are all weeks Mondays, and does every week step forward from the one before?

    A table has no row order, so after the sort a step can only be missing where a week repeats.
    """
    weeks = df.groupBy(key, time).agg(F.count(F.lit(1)).alias("_n"))
    return weeks.groupBy(key).agg(
        F.bool_and(F.weekday(time) == 0).alias("all_mondays"),
        F.bool_and(F.col("_n") == 1).alias("increasing"),
    )


def head_sample(df: DataFrame, n: int = 200, order: tuple[str, ...] = (GEO, WEEK)) -> DataFrame:
    return df.orderBy(*order).limit(n)


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop("any", subset=cols)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers in one form only, so that aggregates skip them."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    fixed: dict[str, Column] = {c: F.when(~F.isnan(c), F.col(c)) for c in floats}
    return df.withColumns(fixed) if fixed else df
