"""Rolling-origin folds, supervised frames and origin selections."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weeklane.config import GEO, NAME, TARGET_WEEK, VALUE, WEEK, FeatureSpec, Fold
from weeklane.functions.scalars import add_weeks, monday, monday_by_weekday
from weeklane.functions.windows import by_day
from weeklane.operators.features import all_features, feature_columns, required_columns


def _monday_of(day: dt.date) -> dt.date:
    return day - dt.timedelta(days=day.weekday())


def fold_grid(horizons: Sequence[int], folds: Sequence[Fold]) -> Column:
    """All (fold, horizon) settings as one literal array; exploding it is the fan-out."""
    cells = [
        F.struct(
            F.lit(f.name).alias("fold_id"),
            F.lit(f.group).alias("split_group"),
            F.lit(h).alias("horizon"),
            F.lit(_monday_of(f.train_end)).alias("train_end"),
            F.lit(_monday_of(f.val_end)).alias("val_end"),
        )
        for f in folds
        for h in horizons
    ]
    return F.array(*cells)


def _with_role(df: DataFrame, keep: list[Column | str], horizons, folds) -> DataFrame:
    out = df.select(*keep, F.explode(fold_grid(horizons, folds)).alias("_g"))
    target = add_weeks(F.col(WEEK), F.col("_g.horizon"))
    role = F.when(target <= F.col("_g.train_end"), "train").when(target <= F.col("_g.val_end"), "val")
    return out.select(
        *[c for c in out.columns if c != "_g"],
        F.col("_g.horizon").alias("horizon"),
        target.alias(TARGET_WEEK),
        role.alias("role"),
        F.col("_g.fold_id").alias("fold_id"),
        F.col("_g.split_group").alias("split_group"),
    ).filter(F.col("role").isNotNull())


def rolling_origin_splits(
    features: DataFrame, horizons: Sequence[int], folds: Sequence[Fold], unique: bool = False
) -> DataFrame:
    """(series, origin) x folds x horizons with their role; pass ``unique`` if keys already are."""
    base = features.select(GEO, monday(WEEK).alias(WEEK))
    return _with_role(base if unique else base.distinct(), [GEO, WEEK], horizons, folds)


def split_counts(splits: DataFrame) -> DataFrame:
    return splits.groupBy("fold_id", "horizon", "role").agg(F.count(F.lit(1)).alias("rows"))


def supervised_frame(features: DataFrame, splits: DataFrame, panel: DataFrame) -> DataFrame:
    """Features at the origin and the value at the target week, for any split table.

    For the folds of ``rolling_origin_splits`` use ``supervised_from_panel``: same rows, one shuffle.
    """
    labels = panel.select(GEO, F.col(WEEK).alias(TARGET_WEEK), F.col(VALUE).cast("double").alias("y_true"))
    return (
        splits.join(features, [GEO, WEEK], "left")
        .join(labels, [GEO, TARGET_WEEK], "left")
        .filter(F.col("y_true").isNotNull())
    )


def with_calendar_lookups(df: DataFrame, horizons: Sequence[int], season_days: int = 364) -> DataFrame:
    """Columns ``_y_h`` (value at week + h) and ``_s_h`` (the same week last year) by RANGE frames.

    The panel is already partitioned by series for its features, so the look-ups
    cost no join; they happen before the fan-out, on the narrow side of it.
    """
    value = F.col(VALUE).cast("double")
    ahead = [F.max(value).over(by_day(7 * h)).alias(f"_y_{h}") for h in horizons]
    back = [F.max(value).over(by_day(7 * h - season_days)).alias(f"_s_{h}") for h in horizons]
    return df.select("*", *ahead, *back)


def supervised_from_panel(
    panel: DataFrame,
    track: str,
    horizons: Sequence[int],
    folds: Sequence[Fold],
    spec: FeatureSpec = FeatureSpec(),
    with_covariates: bool = False,
) -> DataFrame:
    """Panel to supervised rows in one shuffle by series; adds ``last_year`` (null if absent).

    Same rows as ``supervised_frame`` over ``rolling_origin_splits`` of the feature panel.
    """
    feats = all_features(panel, spec, with_covariates)
    need = required_columns(feats, spec, with_covariates)
    base = with_calendar_lookups(feats, horizons).na.drop("any", subset=need)
    rows = _with_role(base, ["*"], horizons, folds)
    h = F.col("horizon")

    def pick(stem: str) -> Column:
        return F.coalesce(*[F.when(h == k, F.col(f"{stem}_{k}")) for k in horizons])

    helper = [f"_{s}_{k}" for s in "ys" for k in horizons]
    return (
        rows.withColumns({"y_true": pick("_y"), "last_year": pick("_s"), "track": F.lit(track)})
        .drop(*helper)
        .filter(F.col("y_true").isNotNull())
    )


def training_pairs_from_panel(
    panel: DataFrame, track: str, horizons: Sequence[int], spec: FeatureSpec = FeatureSpec(), with_covariates: bool = False
) -> DataFrame:
    """All origins x horizons whose target week has a value, in one shuffle by series."""
    feats = all_features(panel, spec, with_covariates)
    need = required_columns(feats, spec, with_covariates)
    base = with_calendar_lookups(feats, horizons).na.drop("any", subset=need)
    rows = base.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    truth = F.coalesce(*[F.when(F.col("horizon") == h, F.col(f"_y_{h}")) for h in horizons])
    rows = rows.withColumns({TARGET_WEEK: add_weeks(F.col(WEEK), F.col("horizon")), "y_true": truth, "track": F.lit(track)})
    return rows.drop(*[f"_{s}_{h}" for s in "ys" for h in horizons]).filter(F.col("y_true").isNotNull())


def next_fold_id(fold_ids: Sequence[str]) -> str:
    """One more than the largest fold id where all are numbers, else ``gap``."""
    return str(max(map(int, fold_ids)) + 1) if fold_ids and all(f.isdigit() for f in fold_ids) else "gap"


def latest_origin(features: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Rows of the latest feature week, once per horizon, with the target week."""
    last = features.agg(F.max(WEEK).alias("w")).scalar()
    rows = features.filter(F.col(WEEK) == last)
    rows = rows.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    return rows.withColumn(TARGET_WEEK, add_weeks(F.col(WEEK), F.col("horizon")))


def asof_ceiling(df: DataFrame, ceiling: dt.date, time: str = WEEK) -> DataFrame:
    return df.filter(F.col(time) <= F.lit(ceiling))


def gap_splits(
    features: DataFrame,
    splits: DataFrame,
    first: dt.date,
    last: dt.date,
    horizons: Sequence[int],
    fold_id: str = "gap",
) -> DataFrame:
    """Add a scored fold whose targets fill [first, last], wherever an origin has features.

    Built from the origins outwards (origin + h must fall into the gap), so no
    series x horizon x week product is formed.
    """
    lo, hi = _monday_of(first), _monday_of(last)
    origins = features.select(GEO, WEEK).distinct()
    rows = origins.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    rows = rows.withColumn(TARGET_WEEK, add_weeks(F.col(WEEK), F.col("horizon")))
    rows = rows.filter(F.col(TARGET_WEEK).between(F.lit(lo), F.lit(hi)) & (F.weekday(WEEK) == 0))
    cols = [GEO, WEEK, TARGET_WEEK, "horizon", "role", "fold_id"]
    rows = rows.withColumns({"role": F.lit("val"), "fold_id": F.lit(fold_id)})
    return splits.select(*cols).unionByName(rows.select(*cols)).dropDuplicates(cols)


def label_lookup(splits: DataFrame, panel: DataFrame) -> DataFrame:
    """Value at the target as ``y_true`` and at the origin as ``y_pred``; null where absent."""
    at = panel.select(GEO, F.col(WEEK), F.col(VALUE).cast("double").alias("_v"))
    target = at.select(GEO, F.col(WEEK).alias(TARGET_WEEK), F.col("_v").alias("y_true"))
    origin = at.select(GEO, WEEK, F.col("_v").alias("y_pred"))
    return splits.join(target, [GEO, TARGET_WEEK], "left").join(origin, [GEO, WEEK], "left")


def reanchor(df: DataFrame, time: str = TARGET_WEEK) -> DataFrame:
    return df.withColumn(time, monday_by_weekday(time))


def track_summary(features: DataFrame, splits: DataFrame) -> DataFrame:
    """One row per split group: feature rows and columns, series, span, fold ids, horizons; ids of
    proxy series are counted."""
    proxy = F.col("covariate_is_proxy") == 1 if "covariate_is_proxy" in features.columns else F.lit(False)
    info = features.agg(
        F.struct(
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct(GEO).alias("geographies"),
            F.min(WEEK).alias("weeks_start"),
            F.max(WEEK).alias("weeks_end"),
            F.count_distinct(F.when(proxy, F.col(GEO))).alias("proxy_geographies"),
        ).alias("s")
    ).scalar()
    folds = splits.groupBy("split_group", "fold_id", "horizon").agg(F.count(F.lit(1)).alias("n"))
    groups = folds.groupBy("split_group").agg(
        F.array_join(F.sort_array(F.collect_set("fold_id")), ",").alias("fold_ids"),
        F.array_join(F.transform(F.sort_array(F.collect_set("horizon")), lambda h: h.cast("string")), ",").alias("horizons"),
        F.lit(len(feature_columns(features, False))).alias("feature_count"),
    )
    names = ("rows", "geographies", "weeks_start", "weeks_end", "proxy_geographies")
    return groups.select("split_group", "fold_ids", "horizons", "feature_count", *[info.getField(n).alias(n) for n in names])


IDENTITY = (
    "track", "split_group", GEO, NAME, WEEK, TARGET_WEEK, "role", "fold_id", "horizon", "y_true", VALUE,
    "cases_nonzero_recent_4", "cases_zero_run_length", "cases_weeks_since_nonzero", "cases_outbreak_flag_4_8",
)


def identity_columns(df: DataFrame) -> list[str]:
    return [c for c in IDENTITY if c in df.columns]
