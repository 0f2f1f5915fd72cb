"""Blending models: weights from other folds, inverse errors, or a closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weeklane.config import GEO, TARGET_WEEK, VALUE, WEEK, Stack
from weeklane.functions.scalars import clip

# Fixed value: the rule as written to the weight table.
WEIGHT_RULE = "leave_one_fold_out_inverse_mae"
BLEND_KEYS = [GEO, WEEK, TARGET_WEEK, "horizon", "role", "fold_id"]


def pivot_models(long: DataFrame, models: list[str], ids: list[str], value: str = "y_pred") -> DataFrame:
    """One column per model. Rows with a null identity are dropped, as an index would."""
    rows = long.na.drop("any", subset=ids)
    picks = [F.max(F.when(F.col("model") == m, F.col(value))).alias(m) for m in models]
    return rows.groupBy(*ids).agg(*picks)


def model_pair(long: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Two models' forecasts side by side as y_a and y_b where both exist; one aggregation of the long table."""
    keys = BLEND_KEYS if keys is None else keys
    rows = long.filter(F.col("model").isin(a, b)).na.drop("any", subset=keys)
    picks = [F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(f"y_{n}") for m, n in ((a, "a"), (b, "b"))]
    both = rows.groupBy(*keys).agg(F.max("y_true").alias("y_true"), *picks, F.count_distinct("model").alias("_n"))
    return both.filter("_n = 2").drop("_n")


def lofo_mae(long: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Validation MAE per (fold, horizon, model) over the *other* development folds.

    Totals minus the own fold, on one row per fold, horizon and model. A fold
    that leaves no other development rows falls back to all of them. ``models``:
    the base models; rows of others are left out.
    """
    long = long if models is None else long.filter(F.col("model").isin(models))
    dev = (F.col("role") == "val") & (F.col("split_group") == "development")
    e = F.abs(F.col("y_true") - F.col("y_pred"))
    cells = long.groupBy("track", "fold_id", "horizon", "model").agg(
        F.sum(F.when(dev, e)).alias("own_abs"), F.count(F.when(dev, e)).alias("own_n")
    )
    across = Window.partitionBy("track", "horizon", "model")
    out = cells.withColumns({"all_abs": F.sum("own_abs").over(across), "all_n": F.sum("own_n").over(across)})
    other_n = F.col("all_n") - F.col("own_n")
    other_abs = F.col("all_abs") - F.coalesce(F.col("own_abs"), F.lit(0.0))
    any_other = F.sum(other_n).over(Window.partitionBy("track", "fold_id", "horizon")) > 0
    mae = F.when(any_other, F.try_divide(other_abs, other_n)).otherwise(
        F.try_divide(F.col("all_abs"), F.col("all_n"))
    )
    return out.select("track", "fold_id", "horizon", "model", mae.alias("source_mae"))


def stack_weights(maes: DataFrame, cfg: Stack = Stack(), by: tuple[str, ...] = ("track", "fold_id", "horizon")) -> DataFrame:
    """Inverse-error weights with a floor for persistence; they sum to 1 per setting."""
    w = Window.partitionBy(*by)
    mae = F.col("source_mae")
    ok = mae.isNotNull() & ~F.isnan(mae)
    power = max(cfg.inverse_mae_power, 1e-6)
    score = F.when(ok, F.lit(1.0) / F.pow(F.greatest(mae, F.lit(1e-6)), F.lit(power))).otherwise(0.0)
    out = maes.withColumn("_s", score).withColumn("_t", F.sum("_s").over(w))
    n = F.count(F.lit(1)).over(w)
    out = out.withColumn("_w", F.when(F.col("_t") <= 0, F.lit(1.0) / n).otherwise(F.col("_s") / F.col("_t")))
    is_base = F.col("model") == "persistence"
    floor = min(max(cfg.persistence_floor, 0.0), 1.0)
    out = out.withColumns(
        {
            "_p": F.max(F.when(is_base, F.col("_w"))).over(w),
            "_o": F.coalesce(F.sum(F.when(~is_base, F.col("_w"))).over(w), F.lit(0.0)),
        }
    )
    lift = F.coalesce((F.col("_p") < floor) & F.lit(floor > 0), F.lit(False))
    alone = F.col("_o") <= 0 if floor < 1.0 else F.lit(True)
    lifted = F.when(is_base, F.when(alone, 1.0).otherwise(floor)).otherwise(
        F.when(alone, 0.0).otherwise(F.try_divide(F.col("_w") * (1.0 - floor), F.col("_o")))
    )
    out = out.withColumn("_w", F.when(lift, lifted).otherwise(F.col("_w")))
    weight = F.col("_w") / F.sum("_w").over(w)
    return out.select(
        *by,
        "model",
        weight.alias("weight"),
        "source_mae",
        F.lit(WEIGHT_RULE).alias("weight_rule"),
        F.lit(float(cfg.persistence_floor)).alias("persistence_floor"),
        F.lit(float(cfg.inverse_mae_power)).alias("inverse_mae_power"),
    )


def conservative_stack(
    wide: DataFrame,
    weights: DataFrame,
    models: list[str],
    by: tuple[str, ...] = ("fold_id", "horizon"),
    missing: Column | None = None,
) -> DataFrame:
    """Weighted sum over at least two model columns as ``conservative_stack``.

    A null forecast counts as the origin value; without an origin value the blend is null.
    """
    if len(models) < 2:
        raise ValueError("a stack needs two models at least")
    picks = [F.max(F.when(F.col("model") == m, F.col("weight"))).alias(f"_w_{m}") for m in models]
    table = weights.groupBy(*by).agg(*picks)
    out = wide.join(table, list(by), "left")
    instead = F.col(VALUE).cast("double") if missing is None else missing
    blend: Column = F.lit(0.0)
    for m in models:
        y = F.when(~F.isnan(F.col(m)), F.col(m))
        blend = blend + F.coalesce(F.col(f"_w_{m}"), F.lit(0.0)) * F.coalesce(y, instead)
    return out.withColumn("conservative_stack", clip(blend, 0.0)).drop(*[f"_w_{m}" for m in models])


def level0_merge(a: DataFrame, b: DataFrame, name_a: str, name_b: str, keys: list[str] = BLEND_KEYS) -> DataFrame:
    """Two forecasts side by side where both exist; truth from the first."""
    left = a.select(*keys, "y_true", F.col("y_pred").alias(f"y_{name_a}"))
    return left.join(b.select(*keys, F.col("y_pred").alias(f"y_{name_b}")), keys, "inner")


def inverse_rmse_stack(
    merged: DataFrame, rmse: DataFrame, name_a: str, name_b: str, by: tuple[str, ...] = ("fold_id", "horizon")
) -> DataFrame:
    """Blend with weights 1/RMSE; an unknown RMSE gives null. ``rmse`` has columns rmse_a and rmse_b; a missing horizon uses the mean."""
    means = rmse.groupBy(*by[:-1]).agg(F.avg("rmse_a").alias("_ma"), F.avg("rmse_b").alias("_mb"))
    out = merged.join(rmse, list(by), "left").join(means, list(by[:-1]), "left")
    wa = F.lit(1.0) / clip(F.coalesce("rmse_a", "_ma"), 1e-9)
    wb = F.lit(1.0) / clip(F.coalesce("rmse_b", "_mb"), 1e-9)
    pred = (wa * F.col(f"y_{name_a}") + wb * F.col(f"y_{name_b}")) / (wa + wb)
    return out.withColumn("y_pred", pred).drop("rmse_a", "rmse_b", "_ma", "_mb")


def blend_weight(
    merged: DataFrame, name_a: str, name_b: str, by: tuple[str, ...] = ("fold_id", "horizon"), learn_on: str = "val"
) -> DataFrame:
    """Weight of the first model that minimises squared error, from three sums per setting.

    The error is a parabola in the weight, so the clamped vertex is the best of
    any grid on [0, 1]. Equal forecasts give 0, no rows to learn on give 0.5.
    """
    on = F.col("role") == learn_on
    d = F.col(f"y_{name_a}") - F.col(f"y_{name_b}")
    r = F.col("y_true") - F.col(f"y_{name_b}")
    sums = merged.groupBy(*by).agg(
        F.count_if(on).alias("_n"),
        F.sum(F.when(on, d * d)).alias("_dd"),
        F.sum(F.when(on, d * r)).alias("_dr"),
    )
    vertex = F.least(F.greatest(F.try_divide(F.col("_dr"), F.col("_dd")), F.lit(0.0)), F.lit(1.0))
    w = F.when(F.col("_n") == 0, 0.5).when(F.col("_dd") > 0, vertex).otherwise(0.0)
    return sums.select(*by, F.col("_n").alias("n_learn"), w.alias("weight"))


def apply_blend(merged: DataFrame, weights: DataFrame, name_a: str, name_b: str, by: tuple[str, ...] = ("fold_id", "horizon")) -> DataFrame:
    out = merged.join(weights.select(*by, "weight"), list(by), "left")
    w = F.col("weight")
    return out.withColumn("y_pred", w * F.col(f"y_{name_a}") + (1 - w) * F.col(f"y_{name_b}"))


def rmse_pair(merged: DataFrame, name_a: str, name_b: str, by: tuple[str, ...] = ("fold_id", "horizon")) -> DataFrame:
    val = merged.filter(F.col("role") == "val")
    ea, eb = F.col("y_true") - F.col(f"y_{name_a}"), F.col("y_true") - F.col(f"y_{name_b}")
    return val.groupBy(*by).agg(F.sqrt(F.avg(ea * ea)).alias("rmse_a"), F.sqrt(F.avg(eb * eb)).alias("rmse_b"))


