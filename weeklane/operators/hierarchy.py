"""Overlapping nodes: residuals, closure, bottom-up totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weeklane.config import COVARIATES, GEO, NAME, TARGET_WEEK, TOTAL_NODE, VALUE, WEEK, Hierarchy
from weeklane.functions.scalars import clip


def _parent_child(panel: DataFrame, h: Hierarchy) -> DataFrame:
    """Parent rows with the child value beside them: one aggregation, no self-join."""
    is_parent, is_child = F.col(GEO) == h.parent, F.col(GEO) == h.child
    covs = [c for c in COVARIATES if c in panel.columns]
    return (
        panel.filter(is_parent | is_child)
        .groupBy(WEEK)
        .agg(
            F.count_if(is_parent).alias("_parents"),
            F.sum(F.when(is_parent, F.col(VALUE))).alias("parent_cases"),
            F.coalesce(F.sum(F.when(is_child, F.col(VALUE))), F.lit(0)).alias("child_cases"),
            *[F.max(F.when(is_parent, F.col(c))).alias(c) for c in covs],
        )
        .filter(F.col("_parents") > 0)
        .drop("_parents")
        .withColumn("raw_residual", F.col("parent_cases") - F.col("child_cases"))
        .withColumn("residual_cases", F.bround(clip(F.col("raw_residual"), 0)).cast("long"))
    )


def fix_hierarchy(panel: DataFrame, h: Hierarchy) -> DataFrame:
    """Replace the parent by what the child does not cover; its covariates become a proxy."""
    covs = [c for c in COVARIATES if c in panel.columns]
    residual = _parent_child(panel, h).select(
        F.lit(h.residual_id).alias(GEO),
        F.lit(h.residual_name).alias(NAME),
        WEEK,
        F.col("residual_cases").alias(VALUE),
        *covs,
        F.lit(h.parent).alias("covariate_proxy_source"),
        F.lit(1).alias("covariate_is_proxy"),
    )
    kept = (
        panel.filter(F.col(GEO) != h.parent)
        .withColumn("covariate_proxy_source", F.col(GEO))
        .withColumn("covariate_is_proxy", F.lit(0))
    )
    return kept.unionByName(residual, allowMissingColumns=True)


def closure(panel: DataFrame, h: Hierarchy) -> DataFrame:
    """Per week: parent minus child minus residual."""
    return _parent_child(panel, h).select(
        WEEK,
        "parent_cases",
        "child_cases",
        "residual_cases",
        (F.col("parent_cases") - F.col("child_cases") - F.col("residual_cases")).alias("closure_error"),
    )


def hierarchy_summary(panel: DataFrame, h: Hierarchy) -> DataFrame:
    """One row on the repair. The distinct id count is taken before the one-row sums meet it."""
    weekly = _parent_child(panel, h)
    sums = weekly.agg(
        F.count(F.lit(1)).alias("weeks"),
        F.count_if(F.col("raw_residual") < 0).alias("negative_raw_residual_weeks"),
        F.max(F.abs(F.col("raw_residual") - F.col("residual_cases"))).cast("double").alias("max_abs_closure_error"),
        F.sum("parent_cases").cast("double").alias("parent_total_cases"),
        F.sum("residual_cases").cast("double").alias("residual_total_cases"),
    )
    others = panel.agg(
        F.sum(F.when(F.col(GEO) == h.child, F.col(VALUE))).cast("double").alias("t")
    ).scalar()
    ids = panel.filter(F.col(GEO) != h.parent).agg(F.count_distinct(GEO).alias("n")).scalar()
    return sums.select(
        F.lit(h.parent).alias("parent_geo"),
        F.lit(h.child).alias("child_geo"),
        F.lit(h.residual_id).alias("residual_geo_id"),
        "*",
        others.alias("child_total_cases"),
        (ids + F.when(F.col("weeks") > 0, 1).otherwise(0)).alias("fixed_geographies"),
    )


def residual_node(
    df: DataFrame,
    big: str,
    sub: str,
    value: str = "y_pred",
    time: str = TARGET_WEEK,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Replace ``big`` by ``big`` less ``sub`` (not below 0) where both have a row."""
    keys = [time, "horizon", *by]
    is_big, is_sub = F.col(GEO) == big, F.col(GEO) == sub
    rest = (
        df.filter(is_big | is_sub)
        .groupBy(*keys)
        .agg(F.sum(F.when(is_big, F.col(value))).alias("_b"), F.sum(F.when(is_sub, F.col(value))).alias("_s"))
        .filter(F.col("_b").isNotNull() & F.col("_s").isNotNull())
        .select(*keys, clip(F.col("_b") - F.col("_s"), 0.0).alias(value), F.lit(f"{big}_ex_{sub}").alias(GEO))
    )
    return df.filter(~is_big).unionByName(rest, allowMissingColumns=True)


def bottom_up(
    df: DataFrame,
    value: str = "y_pred",
    time: str = TARGET_WEEK,
    by: tuple[str, ...] = (),
    total: str = TOTAL_NODE,
    bottom: DataFrame | None = None,
) -> DataFrame:
    """Append the sum of the bottom nodes; ``by`` keeps folds and models apart."""
    base = df if bottom is None else df.join(bottom.select(GEO).distinct(), GEO, "left_semi")
    summed = base.groupBy(time, "horizon", *by).agg(F.sum(value).alias(value)).withColumn(GEO, F.lit(total))
    return df.unionByName(summed, allowMissingColumns=True)


def consistency(wide: DataFrame, checks: dict[str, tuple[str, list[str]]], complete: tuple[str, ...] = ()) -> DataFrame:
    """Rows (check, max_abs_diff) of whole-minus-parts over a wide count table.

    A missing part counts as 0, but for the checks named in ``complete``, which skip such rows.
    """
    diffs = [
        F.max(F.abs(F.col(whole) - sum(F.col(p) if name in complete else F.coalesce(F.col(p), F.lit(0)) for p in parts))).cast("double").alias(name)
        for name, (whole, parts) in checks.items()
    ]
    return wide.agg(*diffs).unpivot([], list(checks), "check", "max_abs_diff")
