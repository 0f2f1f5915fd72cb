"""Forecasts from the latest origin: models, stack, total, rank and policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weeklane.config import GEO, NAME, TARGET_WEEK, TOTAL_NODE, VALUE, WEEK, FeatureSpec, Stack, Training
from weeklane.models.fits import Fitted, fit_models
from weeklane.models.settings import HELPERS, numbered, settings
from weeklane.operators.features import all_features, feature_columns
from weeklane.operators.guardrail import apply_guardrail, low_origin_stats
from weeklane.operators.naive import NAIVE_STATUS, naive_columns
from weeklane.operators.splits import training_pairs_from_panel
from weeklane.operators.stacking import conservative_stack, stack_weights
from weeklane.sources.sinks import staged

# How a live forecast came about.
STACKED, STACKED_GUARDED = "stack_from_backtest_mae", "stack_from_backtest_mae_low_origin_guardrail"


def latest_rows(panel: DataFrame, horizons: tuple[int, ...], spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    """Features of the latest week once per horizon, with the target week and last year's value."""
    feats = all_features(panel, spec)
    rows = feats.join(panel.agg(F.max(WEEK).alias(WEEK)), WEEK, "left_semi").withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    rows = rows.withColumn(TARGET_WEEK, F.date_add(F.col(WEEK), F.col("horizon") * 7))
    past = panel.select(GEO, F.col(WEEK).alias("_ref"), F.col(VALUE).cast("double").alias("last_year"))
    return rows.withColumn("_ref", F.date_sub(F.col(TARGET_WEEK), 364)).join(past, [GEO, "_ref"], "left").drop("_ref")


def trained_live(panel: DataFrame, latest: DataFrame, models: list[str], horizons: tuple[int, ...], cfg: Training = Training()) -> DataFrame:
    """latest with a column per trained model, fitted on all pairs of the panel, all horizons together.

    The models go through their table, so that a later origin can be scored without fitting again:
    ``scored(Fitted.of(table), latest)``.
    """
    pairs = training_pairs_from_panel(panel, "operational", horizons)
    features = feature_columns(pairs, False, ("last_year",))
    known = settings(pairs, features, ("horizon",), base=VALUE)
    table = staged(fit_models(known, models, cfg).table(panel.sparkSession), "models")
    return scored(Fitted.of(table), latest)


def scored(models: Fitted, rows: DataFrame) -> DataFrame:
    """rows with a column per model; settings that no model knows are left out."""
    core = models.core
    return models.applied(numbered(rows, core.features, core.by, core.keys, core.series, VALUE)).drop(*HELPERS)


def live_forecast(
    panel: DataFrame, horizons: tuple[int, ...], mae: DataFrame, ranking: DataFrame, policy: DataFrame,
    naive: list[str], trained: list[str] | None = None, stack: Stack = Stack(), cfg: Training = Training(),
) -> DataFrame:
    """One row per model, node and horizon, with the total of all nodes.

    mae: horizon, model, MAE_macro of the backtest. ranking: model, rank. policy: primary_model. A
    model without a rank comes after the ranked ones; without an error it has no weight in the
    stack. A missing forecast counts as 0 in the stack.
    """
    rows = naive_columns(latest_rows(panel, horizons))
    rows = trained_live(panel, rows, trained, horizons, cfg) if trained else rows
    models = [*naive, *(trained or [])]
    base = [m for m in stack.base_models if m in models]
    every = panel.sparkSession.createDataFrame([(h, m) for h in horizons for m in base], "horizon int, model string")
    known = every.join(mae.select("horizon", "model", F.col("MAE_macro").alias("source_mae")), ["horizon", "model"], "left")
    weights = stack_weights(known, stack, ("horizon",))
    wide = conservative_stack(rows, weights, base, ("horizon",), missing=F.lit(0.0))
    pairs = training_pairs_from_panel(panel, "operational", horizons)
    wide = apply_guardrail(wide, low_origin_stats(pairs, cfg.guardrail, ("horizon",)), ["conservative_stack"], cfg.guardrail, ("horizon",))
    guarded = F.max("conservative_stack__guarded").over(Window.partitionBy("horizon"))
    wide = wide.withColumn("_status", F.when(guarded, STACKED_GUARDED).otherwise(STACKED))
    label = {**NAIVE_STATUS, **{m: "trained" for m in trained or []}}
    entries = [F.struct(F.lit(m).alias("model"), F.greatest(F.col(m).cast("double"), F.lit(0.0)).alias("y_pred"), F.lit(label[m]).alias("fit_status")) for m in models]
    entries.append(F.struct(F.lit("conservative_stack").alias("model"), F.col("conservative_stack").alias("y_pred"), F.col("_status").alias("fit_status")))
    long = wide.select(GEO, NAME, F.col(WEEK).alias("origin_week"), TARGET_WEEK, "horizon", F.inline(F.array(*entries)))
    total = long.groupBy("origin_week", TARGET_WEEK, "horizon", "model").agg(F.sum("y_pred").alias("y_pred"))
    first = long.groupBy("model").agg(F.min_by("fit_status", F.struct("horizon", GEO)).alias("fit_status"))
    total = total.join(first, "model").withColumns({GEO: F.lit(TOTAL_NODE), NAME: F.lit(TOTAL_NODE)})
    both = long.unionByName(total)
    names = [*models, "conservative_stack"]
    table = panel.sparkSession.createDataFrame([(m,) for m in names], "model string").join(ranking.select("model", "rank"), "model", "left")
    table = table.withColumn("rank", F.coalesce("rank", F.coalesce(F.max("rank").over(Window.partitionBy(F.lit(1))), F.lit(0)) + 1))  # a row per model
    table = table.join(policy.select(F.col("primary_model").alias("model"), F.lit(1).alias("primary")).distinct(), "model", "left")
    return both.join(table, "model").select(
        GEO, NAME, "origin_week", TARGET_WEEK, "horizon", "y_pred", "model", "fit_status",
        F.col("rank").alias("model_rank_from_backtest"), F.coalesce("primary", F.lit(0)).alias("is_primary_model"),
    )
