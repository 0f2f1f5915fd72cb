"""All trained models of a track over its folds and horizons, with their fallbacks and safety rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weeklane.config import VALUE, Training
from weeklane.models.fits import Fitted, fit_models
from weeklane.models.settings import settings
from weeklane.operators.features import feature_columns
from weeklane.operators.guardrail import BY, apply_guardrail, instability, low_origin_stats
from weeklane.operators.naive import to_long
from weeklane.operators.regimes import low_origin
from weeklane.operators.splits import identity_columns
from weeklane.sources.sinks import staged

# How a forecast came about.
MEAN, MEAN_AFTER_ERROR = "fallback_mean", "fallback_mean_after_error"
PERSISTENCE, PLAIN, GUARDED = "fallback_persistence_after_instability", "trained", "trained_low_origin_guardrail"


def fitted(rows: DataFrame, models: list[str], features: list[str], cfg: Training, by: tuple[str, ...] = BY) -> tuple[DataFrame, Fitted]:
    """(rows with a column per model and {model}__status, the models): each model fitted for all settings together.

    A setting with fewer than cfg.min_train_rows training rows, or whose fit fails, takes its training
    mean (0 without any).
    """
    table = settings(rows, features, by, base=VALUE)
    trained = fit_models(table, models, cfg, cfg.min_train_rows)
    few = F.col("_s").isin([s for s, n in enumerate(table.sizes) if n < cfg.min_train_rows])
    means = F.create_map(*[x for s, m in enumerate(table.means) for x in (F.lit(s), F.lit(float(m)))])[F.col("_s")] if len(table.keys) else F.lit(0.0)
    out = trained.applied(table.rows)
    for m in models:
        status = F.when(few, MEAN).when(F.col(m).isNull(), MEAN_AFTER_ERROR).otherwise(PLAIN)
        out = out.withColumn(f"{m}__status", status).withColumn(m, F.coalesce(m, means))
    return out.select(*rows.columns, *[c for m in models for c in (m, f"{m}__status")]), trained


def safe(wide: DataFrame, models: list[str], cfg: Training) -> DataFrame:
    """Unstable settings of a model take persistence; the others pass the low-origin rule."""
    long = to_long(wide, models, ["fold_id", "horizon", "role", "y_true"])
    bad = instability(long, ["model", *BY]).filter(F.col("reason").isNotNull())
    reasons = bad.groupBy(*BY).agg(*[F.max(F.when(F.col("model") == m, F.col("reason"))).alias(f"{m}__reason") for m in models])
    out = wide.join(reasons, list(BY), "left")
    for m in models:
        unstable = F.col(f"{m}__reason").isNotNull() & (F.col(f"{m}__status") == PLAIN)
        out = out.withColumns({m: F.when(unstable, F.col(VALUE).cast("double")).otherwise(F.col(m)), f"{m}__status": F.when(unstable, PERSISTENCE).otherwise(F.col(f"{m}__status"))})
    ruled = [m for m in models if m in cfg.guardrail.models]
    if not ruled:
        return out
    stats = low_origin_stats(wide.filter(F.col("role") == "train"), cfg.guardrail)
    done = apply_guardrail(out, stats, ruled, cfg.guardrail)
    for m in ruled:
        plain = F.col(f"{m}__status") == PLAIN
        used = F.max(F.col(f"{m}__guarded")).over(Window.partitionBy(*BY))
        done = done.withColumns({m: F.when(plain, F.col(m)).otherwise(F.col(f"{m}__raw")), f"{m}__guarded": F.col(f"{m}__guarded") & plain})
        done = done.withColumn(f"{m}__status", F.when(plain & used, GUARDED).otherwise(F.col(f"{m}__status")))
    return done


def run_track(supervised: DataFrame, models: list[str], cfg: Training = Training(), with_covariates: bool = False) -> tuple[DataFrame, DataFrame, Fitted]:
    """(long predictions, fit notes, the models) of the trained models."""
    features = feature_columns(supervised, with_covariates, ("last_year",))
    rows, trained = fitted(supervised, models, features, cfg)
    wide = staged(safe(staged(rows, "fits"), models, cfg), "track")
    entries = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("y_pred"), F.col(f"{m}__status").alias("fit_status")) for m in models])
    predictions = wide.select(*identity_columns(wide), F.inline(entries))
    return predictions, fit_notes(wide, models, len(features), cfg), trained


def fit_notes(wide: DataFrame, models: list[str], n_features: int, cfg: Training = Training()) -> DataFrame:
    """Per model and setting: training and scored rows, strategy, reason of a fallback, effect of the rule. One scan for all models."""
    low = low_origin(wide.columns, cfg.guardrail)
    none = F.lit(None)
    parts = []
    for m in models:
        ruled = f"{m}__guarded" in wide.columns
        shrink = F.greatest(F.col(f"{m}__raw") - F.col(m), F.lit(0.0)) if ruled else none
        parts += [
            F.struct(
                F.lit(m).alias("model"), F.count_if(F.col("role") == "train").alias("train_rows"), F.count(F.lit(1)).alias("score_rows"), F.lit(n_features).alias("feature_count"),
                F.min(f"{m}__status").alias("fit_strategy"), (F.max(f"{m}__reason") if f"{m}__reason" in wide.columns else none.cast("string")).alias("instability_reason"),
                (F.count_if(F.col(f"{m}__guarded")) if ruled else none.cast("long")).alias("guardrail_rows"), (F.count_if(low) if ruled else none.cast("long")).alias("guardrail_low_origin_rows"),
                (F.avg(shrink) if ruled else none.cast("double")).alias("guardrail_avg_shrink"),
            )
        ]
    return wide.groupBy(*BY).agg(F.array(*parts).alias("notes")).select(*BY, F.inline("notes"))
