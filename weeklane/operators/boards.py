"""Leaderboards, winners and report slices over metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weeklane.config import GEO, TOTAL_NODE
from weeklane.functions.scalars import number
from weeklane.operators.panel import dedupe

BOARD_ORDER = ["MAE_macro", "RMSE_macro", "model"]


def _in_order() -> list[Column]:
    """Board order with missing errors last."""
    return [F.col(c).asc_nulls_last() for c in BOARD_ORDER]


def _val(df: DataFrame, group: str | None) -> DataFrame:
    out = df.filter(F.col("role") == "val")
    return out if group is None else out.filter(F.col("split_group") == group)


def leaderboard(overall_macro: DataFrame, group: str) -> DataFrame:
    return _val(overall_macro, group).orderBy("track", *_in_order())


def leaderboard_by_horizon(by_fold_horizon: DataFrame, group: str) -> DataFrame:
    means = _val(by_fold_horizon, group).groupBy("track", "model", "horizon")
    return means.agg(F.avg("MAE_macro").alias("MAE_macro"), F.avg("RMSE_macro").alias("RMSE_macro")).orderBy(
        "track", "horizon", *_in_order()
    )


def ranked(board: DataFrame, by: str = "track") -> DataFrame:
    """Rank from 1 in board order; a board has one row per model."""
    w = Window.partitionBy(by).orderBy(*_in_order())
    return board.withColumn("rank", F.row_number().over(w))


def winners(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in ``order``, folded before the shuffle."""
    return dedupe(df, keys, order)


def fold_winners(by_fold_macro: DataFrame, group: str = "development") -> DataFrame:
    return winners(_val(by_fold_macro, group), ["track", "fold_id"], BOARD_ORDER)


def horizon_winners(board_by_horizon: DataFrame, group: str) -> DataFrame:
    rows = board_by_horizon.withColumn("split_group", F.lit(group))
    return winners(rows, ["track", "split_group", "horizon"], BOARD_ORDER)


def geo_model_summary(by_geo_horizon_macro: DataFrame, track: str, group: str = "development") -> DataFrame:
    rows = _val(by_geo_horizon_macro, group).filter(F.col("track") == track)
    return rows.groupBy(GEO, "model").agg(
        *[F.avg(c).alias(c) for c in ("MAE_macro", "RMSE_macro", "bias_macro")]
    )


def legacy_leaderboards(rows: DataFrame) -> DataFrame:
    """Means of metric rows, overall, by fold and by horizon; a null horizon marks an overall row."""
    val = rows.filter(F.col("role") == "val").withColumns({c: number(c) for c in ("MAE", "RMSE")})
    means = [F.avg(c).alias(c) for c in ("MAE", "RMSE")]
    flat = val.filter(F.col("horizon").isNull()).groupingSets(
        [[F.col("model")], [F.col("model"), F.col("fold")]], F.col("model"), F.col("fold")
    )
    flat = flat.agg(F.grouping("fold").alias("_g"), *means)
    overall = flat.withColumn("level", F.when(F.col("_g") == 1, "overall").otherwise("by_fold")).drop("_g")
    by_h = val.filter(F.col("horizon").isNotNull()).groupBy("model", "horizon").agg(*means)
    return overall.unionByName(by_h.withColumn("level", F.lit("by_horizon")), allowMissingColumns=True)


def coerce_metric_keys(df: DataFrame, text: str = "index") -> DataFrame:
    """Role and horizon from texts such as ``val`` or ``('val', 7)``."""
    s = F.trim(F.col(text))
    role = F.regexp_extract(s, r"(train|val)", 1)
    horizon = F.regexp_extract(s, r"(\d+(?:\.\d+)?)\D*$", 1).try_cast("double").cast("int")
    return df.withColumns({"role": F.when(role != "", role), "horizon": F.when(role != "", horizon)}).drop(text)


def metric_summary(rows: DataFrame) -> DataFrame:
    """Means per (source, role, horizon) and, where the horizon is null, per (source, role)."""
    kept = rows.filter(F.col("role").isin("train", "val"))
    return kept.groupBy("source", "role", "horizon").agg(
        F.round(F.avg("MAE"), 3).alias("MAE"), F.round(F.avg("RMSE"), 3).alias("RMSE")
    )


def fold_overall(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The overall row of a fold where there is one, else the mean over its horizons."""
    val = rows.filter(F.col("role") == "val")
    by_h = val.groupBy(*keys, "horizon").agg(F.avg("MAE").alias("MAE"), F.avg("RMSE").alias("RMSE"))
    coarse = F.col("horizon").isNull()

    def pick(c: str) -> Column:
        return F.coalesce(F.max(F.when(coarse, F.col(c))), F.avg(F.when(~coarse, F.col(c)))).alias(c)

    return by_h.groupBy(*keys).agg(pick("MAE"), pick("RMSE"))


def sweep_summary(rows: DataFrame) -> DataFrame:
    """Mean and median error per setting; a setting has one row per fold."""
    return rows.groupBy("alpha").agg(
        F.avg("MAE").alias("MAE_mean"),
        F.avg("RMSE").alias("RMSE_mean"),
        F.median("MAE").alias("MAE_median"),
        F.median("RMSE").alias("RMSE_median"),
    )


def sweep_best(rows: DataFrame) -> DataFrame:
    return winners(rows, ["fold"], ["RMSE", "alpha"])


def forecast_slices(forecast: DataFrame) -> DataFrame:
    """The total node of every model and all nodes of the primary model."""
    total = forecast.filter(F.col(GEO) == TOTAL_NODE).withColumn("slice", F.lit("country"))
    primary = forecast.filter(F.col("is_primary_model") == 1).withColumn("slice", F.lit("primary"))
    return total.unionByName(primary)


EVIDENCE = ("holdout", "selection", "development")


def evidence_fallback(overall_macro: DataFrame, track: str, order: tuple[str, ...] = EVIDENCE) -> DataFrame:
    """Rankings of the first split group that has rows, and its name as ``ranking_source``."""
    priority = F.array_position(F.array(*[F.lit(g) for g in order]), F.col("split_group"))
    rows = _val(overall_macro, None).filter(F.col("track") == track).withColumn("_p", priority)
    rows = rows.filter(F.col("_p") > 0)
    best = rows.agg(F.min("_p").alias("p")).scalar()
    out = rows.filter(F.col("_p") == best).drop("_p").withColumn("ranking_source", F.col("split_group"))
    return ranked(out)


def promotion_policy(ranking: DataFrame) -> DataFrame:
    """One row: the holdout winner leads; without a holdout it is persistence. The texts are fixed values."""
    best = ranking.agg(
        F.min("ranking_source").alias("ranking_source"),
        F.min_by("model", F.struct(*[x for c in BOARD_ORDER for x in (F.col(c).isNull(), F.col(c))])).alias("_m"),
    )
    held = F.coalesce(F.col("ranking_source") == "holdout", F.lit(False))
    return best.select(
        "ranking_source",
        F.when(held, F.col("_m")).otherwise("persistence").alias("primary_model"),
        F.when(held, "holdout_winner")
        .otherwise("cautious_default_persistence_without_true_holdout")
        .alias("promotion_policy"),
    )


def horizon_mae(by_fold_horizon: DataFrame, track: str) -> DataFrame:
    """Backtest MAE per horizon and model, averaged over development folds."""
    rows = _val(by_fold_horizon, "development").filter(F.col("track") == track)
    return rows.groupBy("horizon", "model").agg(F.avg("MAE_macro").alias("MAE_macro"))
