"""Errors (truth minus forecast), their cube, macro averages, deciles and windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weeklane.config import GEO, TARGET_WEEK, VALUE
from weeklane.functions.quantiles import grouped_quantiles
from weeklane.functions.scalars import monday_by_weekday

FULL_KEYS = ["track", "split_group", "model", "fold_id", "role", GEO, "horizon"]
CUBE = {
    "by_fold_geo_horizon": FULL_KEYS,
    "by_fold_geo": ["track", "split_group", "model", "fold_id", "role", GEO],
    "by_fold_horizon_pooled": ["track", "split_group", "model", "fold_id", "role", "horizon"],
    "overall_pooled": ["track", "split_group", "model", "role"],
}
MACRO = {
    "by_fold_horizon": ["track", "split_group", "model", "fold_id", "role", "horizon"],
    "by_fold": ["track", "split_group", "model", "fold_id", "role"],
    "by_geo_horizon": ["track", "split_group", "model", "role", GEO, "horizon"],
    "overall": ["track", "split_group", "model", "role"],
}


def score(df: DataFrame) -> DataFrame:
    e = F.col("y_true") - F.col("y_pred")
    return df.select("*", e.alias("error"), F.abs(e).alias("abs_error"), (e * e).alias("sq_error"))


def error_cells(df: DataFrame, keys: list[str]) -> DataFrame:
    """Additive sums per key: the one pass over the predictions that all tables share."""
    e = F.col("y_true") - F.col("y_pred")
    origin = F.col(VALUE) if VALUE in df.columns else F.lit(None)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(e).alias("n_err"),
        F.count("y_true").alias("n_y"),
        F.sum("y_true").alias("s_y"),
        F.count("y_pred").alias("n_pred"),
        F.sum("y_pred").alias("s_pred"),
        F.sum(e).alias("s_err"),
        F.sum(F.abs(e)).alias("s_abs"),
        F.sum(e * e).alias("s_sq"),
        F.count(origin).alias("n_origin"),
        F.sum(origin.cast("double")).alias("s_origin"),
    )


def _metrics(with_origin: bool) -> list[Column]:
    n, m = F.sum("n_rows"), F.sum("n_err")
    cols = [n.alias("n_rows")]
    if with_origin:
        cols.append(F.try_divide(F.sum("s_origin"), F.sum("n_origin")).alias("mean_origin"))
    return cols + [
        F.try_divide(F.sum("s_y"), F.sum("n_y")).alias("mean_y"),
        F.try_divide(F.sum("s_pred"), F.sum("n_pred")).alias("mean_pred"),
        F.try_divide(F.sum("s_err"), m).alias("bias"),
        F.try_divide(F.sum("s_abs"), m).alias("MAE"),
        F.sqrt(F.try_divide(F.sum("s_sq"), m)).alias("RMSE"),
    ]


def roll_up(cells: DataFrame, keys: list[str], with_origin: bool = False) -> DataFrame:
    """Metrics of any coarser grouping, from the cells alone."""
    return cells.groupBy(*keys).agg(*_metrics(with_origin))


def metric_frame(df: DataFrame, keys: list[str], with_origin: bool = False) -> DataFrame:
    return roll_up(error_cells(df, keys), keys, with_origin)


def metric_cube(df: DataFrame) -> DataFrame:
    """The four fixed groupings, told apart by ``level``; absent keys are null."""
    cells = error_cells(df, FULL_KEYS)
    sets = [[F.col(c) for c in keys] for keys in CUBE.values()]
    gid = F.grouping(GEO) * 2 + F.grouping("horizon")
    out = cells.groupingSets(sets, *[F.col(c) for c in FULL_KEYS]).agg(gid.alias("_g"), *_metrics(False))
    level = (
        F.when(F.col("_g") == 0, "by_fold_geo_horizon")
        .when(F.col("_g") == 1, "by_fold_geo")
        .when(F.col("_g") == 2, "by_fold_horizon_pooled")
        .otherwise("overall_pooled")
    )
    return out.withColumn("level", level).drop("_g")


def macro_average(frame: DataFrame, keys: list[str], group_name: str = "n_groups") -> DataFrame:
    """Plain mean of group metrics, each group counting once."""
    return frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(group_name),
        F.avg("MAE").alias("MAE_macro"),
        F.avg("RMSE").alias("RMSE_macro"),
        F.avg("bias").alias("bias_macro"),
    )


def macro_tables(df: DataFrame) -> DataFrame:
    """The four macro groupings, told apart by ``level``; absent keys are null."""
    base = metric_frame(df, FULL_KEYS)
    sets = [[F.col(c) for c in keys] for keys in MACRO.values()]
    gid = F.grouping("fold_id") * 4 + F.grouping(GEO) * 2 + F.grouping("horizon")
    out = base.groupingSets(sets, *[F.col(c) for c in FULL_KEYS]).agg(
        gid.alias("_g"),
        F.count(F.lit(1)).alias("n_groups"),
        F.avg("MAE").alias("MAE_macro"),
        F.avg("RMSE").alias("RMSE_macro"),
        F.avg("bias").alias("bias_macro"),
    )
    level = (
        F.when(F.col("_g") == 2, "by_fold_horizon")
        .when(F.col("_g") == 3, "by_fold")
        .when(F.col("_g") == 4, "by_geo_horizon")
        .otherwise("overall")
    )
    return out.withColumn("level", level).drop("_g")


def segment_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    return metric_frame(df, keys, with_origin=True)


def macro_geo(df: DataFrame, keys: list[str]) -> DataFrame:
    """Segment metrics per series, then averaged over series."""
    return macro_average(segment_metrics(df, [*keys, GEO]), keys, "n_geos")


def role_horizon_metrics(df: DataFrame, source: str) -> DataFrame:
    """MAE and RMSE per role and per role and horizon (horizon null on the coarse rows)."""
    cells = error_cells(df.filter(F.col("role").isNotNull()), ["role", "horizon"])
    sets = [[F.col("role")], [F.col("role"), F.col("horizon")]]
    out = cells.groupingSets(sets, F.col("role"), F.col("horizon")).agg(*_metrics(False))
    return out.select(F.lit(source).alias("source"), "role", "horizon", "MAE", "RMSE")


def mae_by_geo(df: DataFrame) -> DataFrame:
    return df.groupBy(GEO).agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("MAE"))


def _with_bucket(df: DataFrame, value: str, parts: int) -> DataFrame:
    """Quantile bucket: equal edges are merged, bins are right-closed, the first also left-closed.

    Edges are exact and found without gathering the column in one task.
    """
    probs = {f"q{i}": i / parts for i in range(parts + 1)}
    edges = grouped_quantiles(df.select(value), [], value, probs)
    arr = edges.select(F.array_distinct(F.array(*probs)).alias("e")).scalar()
    below = F.size(F.filter("_e", lambda x: x < F.col(value)))
    return (
        df.withColumn("_e", arr)
        .withColumn("bucket", F.greatest(below, F.lit(1)) - 1)
        .withColumn("lower", F.element_at("_e", F.col("bucket") + 1))
        .withColumn("upper", F.element_at("_e", F.least(F.col("bucket") + 2, F.size("_e"))))
        .drop("_e")
    )


def error_by_quantile(df: DataFrame, parts: int = 10) -> DataFrame:
    rows = _with_bucket(df.filter(F.col("y_true").isNotNull()), "y_true", parts)
    return rows.groupBy("bucket", "lower", "upper").agg(
        F.count(F.lit(1)).alias("count"), F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("MAE")
    )


def calibration(df: DataFrame, parts: int = 10) -> DataFrame:
    rows = _with_bucket(df.filter(F.col("y_pred").isNotNull()), "y_pred", parts)
    return rows.groupBy("bucket", "lower", "upper").agg(
        F.avg("y_true").alias("mean_y"), F.avg("y_pred").alias("mean_pred")
    )


def window_metrics(pred: DataFrame, truth: DataFrame, windows: dict[str, tuple], keys: list[str]) -> DataFrame:
    """MAE and RMSE per closed target-week window; windows may overlap and may be empty."""
    spans = F.array(
        *[
            F.struct(F.lit(n).alias("window"), F.lit(a).alias("a"), F.lit(b).alias("b"))
            for n, (a, b) in windows.items()
        ]
    )
    week = monday_by_weekday(TARGET_WEEK)
    low = min((a for a, _ in windows.values()), default=dt.date.max)
    high = max((b for _, b in windows.values()), default=dt.date.min)
    near = pred.filter(F.col(TARGET_WEEK).between(F.lit(low), F.lit(high) + F.expr("interval 6 days")))
    rows = near.drop("y_true").withColumn(TARGET_WEEK, week).select("*", F.inline(spans))
    rows = rows.filter(F.col(TARGET_WEEK).between(F.col("a"), F.col("b")))
    e = F.col("y_true") - F.col("y_pred")
    return (
        rows.join(truth, [GEO, TARGET_WEEK], "inner")
        .groupBy("window", *keys)
        .agg(F.avg(F.abs(e)).alias("MAE"), F.sqrt(F.avg(e * e)).alias("RMSE"))
    )


def gap_impact(metrics: DataFrame, windows: list[str], keys: list[str]) -> DataFrame:
    """Window metrics side by side; a window without rows gives null columns."""
    out = metrics.filter(F.col("window").isin(windows)).groupBy(*keys).pivot("window", windows)
    return out.agg(F.avg("MAE").alias("MAE"), F.avg("RMSE").alias("RMSE"))
