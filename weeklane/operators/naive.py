"""Forecasts that need no fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weeklane.config import GEO, TARGET_WEEK, VALUE, WEEK
from weeklane.functions.scalars import clip, monday


def persistence(df: DataFrame) -> DataFrame:
    return df.withColumn("y_pred", F.col(VALUE).cast("double"))


def seasonal_naive(df: DataFrame, panel: DataFrame, days: int = 364) -> DataFrame:
    """Value of the target week a year earlier, else the value at the origin."""
    past = panel.select(GEO, F.col(WEEK).alias("_ref"), F.col(VALUE).cast("double").alias("_past"))
    return (
        df.withColumn("_ref", monday(F.date_sub(F.col(TARGET_WEEK), days)))
        .join(past, [GEO, "_ref"], "left")
        .withColumn("y_pred", F.coalesce(F.col("_past"), F.col(VALUE).cast("double")))
        .drop("_ref", "_past")
    )


def tail_mean(panel: DataFrame, n: int = 4, value: str = VALUE) -> DataFrame:
    """Mean of the last ``n`` non-null values up to each row, as ``tail_mean``."""
    upto = Window.partitionBy(GEO).orderBy(WEEK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.sum(F.col(value).isNotNull().cast("int")).over(upto)
    frame = Window.partitionBy(GEO).orderBy("_seen").rangeBetween(-(n - 1), Window.currentRow)
    return (
        panel.withColumn("_seen", seen)
        .withColumn("tail_mean", F.when(F.col("_seen") > 0, F.avg(F.col(value).cast("double")).over(frame)))
        .drop("_seen")
    )


def seasonal_naive_tail(splits: DataFrame, panel: DataFrame, days: int = 364, n: int = 4) -> DataFrame:
    """Last year's value if it lies at or before the origin, else the mean of the last n values up to
    the origin (on a panel with holes: up to the last week there is), else 0; never negative."""
    clipped = panel.withColumn(VALUE, clip(F.col(VALUE), 0))
    asked = splits.select(GEO, WEEK).distinct().join(clipped.select(GEO, WEEK), [GEO, WEEK], "left_anti")
    tails = tail_mean(clipped.select(GEO, WEEK, VALUE).unionByName(asked.withColumn(VALUE, F.lit(None))), n).select(GEO, WEEK, "tail_mean")
    past = clipped.select(GEO, F.col(WEEK).alias("_ref"), F.col(VALUE).cast("double").alias("_past"))
    truth = panel.select(GEO, F.col(WEEK).alias(TARGET_WEEK), F.col(VALUE).cast("double").alias("y_true"))
    usable = F.when(F.col("_ref") <= F.col(WEEK), F.col("_past"))
    return (
        splits.withColumn("_ref", F.date_sub(F.col(TARGET_WEEK), days))
        .join(past, [GEO, "_ref"], "left")
        .join(tails, [GEO, WEEK], "left")
        .join(truth, [GEO, TARGET_WEEK], "left")
        .withColumn("y_pred", F.coalesce(usable, F.col("tail_mean"), F.lit(0.0)))
        .drop("_ref", "_past", "tail_mean")
    )


def naive_columns(supervised: DataFrame) -> DataFrame:
    """Wide predictions of the naive ladder on rows of ``supervised_from_panel``."""
    c = F.col(VALUE).cast("double")
    return supervised.withColumns(
        {
            "persistence": c,
            "seasonal_naive_52": F.coalesce(F.col("last_year"), c),
            "tail_mean_4": F.col("cases_recent_sum_4") / 4.0,
            "previous_mean_4": F.col("cases_rollmean_4"),
        }
    )


# How a naive forecast is marked.
NAIVE_STATUS = {
    "persistence": "naive_current_cases",
    "seasonal_naive_52": "naive_same_week_last_year",
    "tail_mean_4": "naive_tail_mean",
    "previous_mean_4": "naive_previous_mean",
}


def to_long(wide: DataFrame, models: list[str], keep: list[str], status: dict[str, str] | None = None) -> DataFrame:
    """One row per model; a projection, so no shuffle."""
    label = status or {}
    entries = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                clip(F.col(m).cast("double"), 0.0).alias("y_pred"),
                F.lit(label.get(m, "trained")).alias("fit_status"),
            )
            for m in models
        ]
    )
    return wide.select(*keep, F.inline(entries))
