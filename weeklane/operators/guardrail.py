"""Safety rules on predictions, as statistics plus one expression per model column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weeklane.config import GEO, VALUE, Guardrail
from weeklane.functions.quantiles import grouped_quantiles
from weeklane.functions.scalars import clip
from weeklane.operators.regimes import low_origin

BY = ("fold_id", "horizon")


@dataclass(frozen=True)
class GuardrailStats:
    """Per-series statistics (rows bounded by series x settings) and one row per setting."""

    per_series: DataFrame
    overall: DataFrame


def low_origin_stats(
    train: DataFrame, cfg: Guardrail = Guardrail(), by: tuple[str, ...] = BY
) -> GuardrailStats:
    """Chance of a positive target and high quantiles of target and rise, from low-origin training rows.

    A setting without low-origin rows uses all its training rows. Quantiles of
    one series in one setting are taken in place (a series is bounded by the
    calendar); those of a whole setting are computed in slices.
    """
    low = low_origin(train.columns, cfg)
    rise = clip(F.col("y_true") - F.col(VALUE).cast("double"), 0.0)
    rows = train.select(
        *by, GEO, F.col("y_true").cast("double").alias("_y"), rise.alias("_d"), low.alias("_low"),
        (F.coalesce(F.col(VALUE), F.lit(1)) <= 0).alias("_zero"),
    )
    q = F.lit(cfg.cap_quantile)

    def over(flag: Column, c: str) -> Column:
        return F.percentile(F.when(flag, F.col(c)), q)

    is_low, every = F.col("_low"), F.lit(True)
    positive = (F.col("_y") > 0).cast("double")
    cells = rows.groupBy(*by, GEO).agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(is_low).alias("n_low"),
        F.sum(positive).alias("pos_all"),
        F.sum(F.when(is_low, positive)).alias("pos_low"),
        F.avg(F.col("_zero").cast("double")).alias("zero_share"),
        over(is_low, "_y").alias("y_low"),
        over(is_low, "_d").alias("d_low"),
        over(every, "_y").alias("y_all"),
        over(every, "_d").alias("d_all"),
    )
    totals = cells.groupBy(*by).agg(
        F.sum("n_all").alias("t_all"),
        F.sum("n_low").alias("t_low"),
        F.sum("pos_all").alias("tp_all"),
        F.sum("pos_low").alias("tp_low"),
    )
    has_low = F.col("t_low") > 0
    # the setting's quantiles in one pass: target and rise as values of two kinds, all and low rows as two more
    kinds = F.array(
        F.struct(F.lit("y_all").alias("kind"), F.col("_y").alias("x")),
        F.struct(F.lit("d_all").alias("kind"), F.col("_d").alias("x")),
        F.struct(F.when(is_low, "y_low").alias("kind"), F.col("_y").alias("x")),
        F.struct(F.when(is_low, "d_low").alias("kind"), F.col("_d").alias("x")),
    )
    values = rows.select(*by, F.inline(kinds)).filter(F.col("kind").isNotNull())
    q_all = grouped_quantiles(values, [*by, "kind"], "x", {"cap": cfg.cap_quantile})
    caps = q_all.groupBy(*by).agg(*[F.max(F.when(F.col("kind") == k, F.col("cap"))).alias(f"_{k}") for k in ("y_all", "d_all", "y_low", "d_low")])
    cap = {n: F.when(has_low, F.col(f"_{k}_low")).otherwise(F.col(f"_{k}_all")) for n, k in (("global_y_cap", "y"), ("global_delta_cap", "d"))}
    overall = totals.join(caps, list(by)).select(
        *by,
        F.when(has_low, F.col("t_low")).otherwise(F.col("t_all")).alias("global_rows"),
        (F.when(has_low, F.col("tp_low") / F.col("t_low")).otherwise(F.col("tp_all") / F.col("t_all"))).alias(
            "global_p_nonzero"
        ),
        *[c.alias(n) for n, c in cap.items()],
    )
    flagged = cells.withColumn("t_low", F.sum("n_low").over(Window.partitionBy(*by)))
    per_series = flagged.select(
        *by,
        GEO,
        F.when(has_low, F.col("n_low")).otherwise(F.col("n_all")).alias("n_rows"),
        F.when(has_low, F.try_divide(F.col("pos_low"), F.col("n_low")))
        .otherwise(F.col("pos_all") / F.col("n_all"))
        .alias("p_nonzero"),
        F.when(has_low, F.col("y_low")).otherwise(F.col("y_all")).alias("y_cap"),
        F.when(has_low, F.col("d_low")).otherwise(F.col("d_all")).alias("delta_cap"),
        "zero_share",
    )
    return GuardrailStats(per_series, overall)


def apply_guardrail(
    score: DataFrame,
    stats: GuardrailStats,
    models: list[str],
    cfg: Guardrail = Guardrail(),
    by: tuple[str, ...] = BY,
) -> DataFrame:
    """Shrink and cap the given prediction columns on low-origin rows that rise above the origin.

    Adds ``{model}__guarded`` (did the rule apply to the row). Settings without
    training rows are left as they are.
    """
    rows = score.join(stats.per_series, [*by, GEO], "left").join(
        stats.overall, list(by), "left"
    )
    own = F.coalesce(F.col("n_rows") >= cfg.min_group_rows, F.lit(False))
    sparse = F.coalesce(F.col("zero_share") >= cfg.sparse_zero_share, F.lit(False))
    global_p = F.col("global_p_nonzero") * F.when(sparse, F.lit(cfg.sparse_multiplier)).otherwise(1.0)
    p = clip(F.when(own, F.col("p_nonzero")).otherwise(global_p), 0.0, 1.0)
    y_cap = F.when(own, F.col("y_cap")).otherwise(F.col("global_y_cap"))
    rise = F.when(own, F.col("delta_cap")).otherwise(F.col("global_delta_cap"))
    base = F.col(VALUE).cast("double")
    cap = F.greatest(base, F.least(y_cap, base + F.greatest(rise, F.lit(0.0))))
    low = low_origin(score.columns, cfg)
    trained = F.col("global_rows").isNotNull()
    out = rows.withColumns({"_p": p, "_cap": cap, "_hit": low & trained})
    new: dict[str, Column] = {}
    for m in models:
        y = F.col(m)
        hit = F.col("_hit") & F.coalesce(y > base, F.lit(False))
        shrunk = F.least(F.greatest(base + F.col("_p") * (y - base), F.lit(0.0)), F.col("_cap"))
        new[f"{m}__guarded"] = hit
        new[f"{m}__raw"] = y
        new[m] = F.when(hit, shrunk).otherwise(y)
    keep = score.columns + [f"{m}__guarded" for m in models] + [f"{m}__raw" for m in models]
    return out.withColumns(new).select(*keep)


def guardrail_notes(guarded: DataFrame, model: str, cfg: Guardrail = Guardrail(), by: tuple[str, ...] = BY) -> DataFrame:
    """Per setting: rows changed, low-origin rows, mean shrink."""
    low = low_origin(guarded.columns, cfg)
    shrink = clip(F.col(f"{model}__raw") - F.col(model), 0.0)
    return guarded.groupBy(*by).agg(
        F.count_if(F.col(f"{model}__guarded")).alias("guardrail_rows"),
        F.count_if(low).alias("guardrail_low_origin_rows"),
        F.avg(shrink).alias("guardrail_avg_shrink"),
    )


def instability(
    scored: DataFrame, model_keys: list[str], y_pred: str = "y_pred"
) -> DataFrame:
    """Per (model, setting): is a prediction not finite, or far above the training maximum?

    ``scored`` holds training rows (``role`` = train) and scored rows alike. The
    99th percentile of a setting is exact and found in slices.
    """
    y = F.col(y_pred)
    bad = y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))
    finite = F.when(~bad, y)
    base = scored.groupBy(*model_keys).agg(
        F.bool_or(bad).alias("non_finite"),
        F.max(finite).alias("pred_max"),
        F.greatest(F.max(F.when(F.col("role") == "train", F.col("y_true"))), F.lit(1.0)).alias("train_max"),
    )
    p99 = grouped_quantiles(scored, model_keys, finite, {"pred_p99": 0.99})
    out = base.join(p99, model_keys, "left")
    boom = (F.col("pred_max") > F.col("train_max") * 25.0) | (F.col("pred_p99") > F.col("train_max") * 10.0)
    reason = F.when(F.col("non_finite"), "non_finite_predictions").when(boom, "prediction_explosion")
    return out.withColumn("reason", reason)
