"""Where forecasts fail: low origins, outbreaks, zero origins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weeklane.config import GEO, VALUE, Guardrail
from weeklane.functions.scalars import origin_bucket
from weeklane.operators.metrics import macro_geo, segment_metrics
from weeklane.operators.panel import dedupe


def low_origin(columns: list[str], cfg: Guardrail = Guardrail(), value: str = VALUE) -> Column:
    """Few cases, a zero run, or hardly any recent positive week; null counts as false per term."""
    terms = [F.col(value) <= cfg.max_cases]
    for c, test in (
        (f"{value}_zero_run_length", lambda x: x >= cfg.zero_run),
        (f"{value}_weeks_since_nonzero", lambda x: x >= cfg.weeks_since_nonzero),
        (f"{value}_nonzero_recent_4", lambda x: x <= cfg.recent_nonzero_max),
    ):
        if c in columns:
            terms.append(test(F.col(c)))
    out = F.lit(False)
    for t in terms:
        out = out | F.coalesce(t, F.lit(False))
    return out


def regime_flags(df: DataFrame, cfg: Guardrail = Guardrail()) -> DataFrame:
    outbreak = F.col("cases_outbreak_flag_4_8") if "cases_outbreak_flag_4_8" in df.columns else F.lit(0)
    return df.withColumns(
        {
            "origin_bucket": origin_bucket(F.col(VALUE)),
            "low_origin": low_origin(df.columns, cfg).cast("int"),
            "outbreak_flag": F.coalesce(outbreak, F.lit(0)).cast("int"),
            "zero_origin": F.coalesce(F.col(VALUE) <= 0, F.lit(False)).cast("int"),
        }
    )


def active_split(df: DataFrame) -> DataFrame:
    """Rows of the holdout if there is one, else of the diagnostic split."""
    held = df.agg(F.coalesce(F.bool_or(F.col("split_group") == "holdout"), F.lit(False)).alias("h")).scalar()
    return df.filter(F.col("split_group") == F.when(held, "holdout").otherwise("diagnostic"))


def regime_metrics(flagged: DataFrame) -> DataFrame:
    """Macro errors under four overlapping regimes, one grouping over exploded memberships."""
    names = F.array(
        F.when(F.col("low_origin") == 1, "low_origin").otherwise("not_low_origin"),
        F.when(F.col("outbreak_flag") == 1, "outbreak_flag").otherwise("not_outbreak_flag"),
    )
    rows = flagged.withColumn("regime", F.explode(names))
    return macro_geo(rows, ["model", "regime"])


def low_origin_board(flagged: DataFrame) -> DataFrame:
    return macro_geo(flagged.filter(F.col("low_origin") == 1), ["model"])


def origin_bucket_metrics(flagged: DataFrame) -> DataFrame:
    return segment_metrics(flagged, ["model", "origin_bucket"])


def zero_origin_by_horizon(flagged: DataFrame) -> DataFrame:
    return segment_metrics(flagged.filter(F.col("zero_origin") == 1), ["model", "horizon"])


def geo_winners(df: DataFrame) -> DataFrame:
    return dedupe(segment_metrics(df, ["model", GEO]), [GEO], ["MAE", "RMSE", "model"])


