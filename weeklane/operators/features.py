"""Window features. Each function is one projection over one window partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weeklane.config import COVARIATES, GEO, VALUE, WEEK, FeatureSpec
from weeklane.functions.scalars import number, season_flag
from weeklane.functions.windows import rolling, series


def lags(df: DataFrame, col: str, ks: list[int], key: str = GEO, time: str = WEEK) -> DataFrame:
    w = series(key, time)
    return df.select("*", *[F.lag(col, k).over(w).alias(f"{col}_lag_{k}") for k in ks])


def _runs(value: Column, row: Column, over) -> tuple[Column, Column]:
    """Zero-run length and rows since the last positive, from the row number (from 0)."""
    past = over.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    broke = F.last(F.when(value.isNull() | (value != 0), row), ignorenulls=True).over(past)
    hit = F.last(F.when(value > 0, row), ignorenulls=True).over(past)
    run = F.when(value == 0, row - F.coalesce(broke, F.lit(-1))).otherwise(0)
    since = F.coalesce(row - hit, row + 1)
    return run.cast("double"), since.cast("double")


def run_features(df: DataFrame, value: str = VALUE, key: str = GEO, time: str = WEEK) -> DataFrame:
    w = series(key, time)
    run, since = _runs(F.col(value), F.col("_rn"), w)
    return (
        df.withColumn("_rn", F.row_number().over(w) - 1)
        .select("*", run.alias(f"{value}_zero_run_length"), since.alias(f"{value}_weeks_since_nonzero"))
        .drop("_rn")
    )


def case_features(df: DataFrame, spec: FeatureSpec = FeatureSpec(), value: str = VALUE) -> DataFrame:
    """Lags, strict rolling statistics, growth, outbreak index, zero runs: one shuffle, one sort."""
    w = series()
    c = F.col(value)
    x = c.cast("double")
    log0 = F.log1p(x)
    cols: list[Column] = [F.lag(x, k).over(w).alias(f"{value}_lag_{k}") for k in spec.case_lags]
    cols += [rolling(x, n, w, F.avg, shift=1).alias(f"{value}_rollmean_{n}") for n in spec.mean_windows]
    cols += [rolling(x, n, w, F.sum).alias(f"{value}_recent_sum_{n}") for n in spec.sum_windows]
    cols += [rolling(x, n, w, F.stddev_samp).alias(f"{value}_recent_std_{n}") for n in spec.std_windows]
    cols.append(log0.alias(f"{value}_log1p"))
    positive = (F.coalesce(x, F.lit(0.0)) > 0).cast("double")
    cols += [rolling(positive, n, w, F.sum).alias(f"{value}_nonzero_recent_{n}") for n in spec.nonzero_windows]
    cols += [
        (log0 - F.log1p(F.lag(x, k).over(w))).alias(f"{value}_growth_logdiff_{k}") for k in spec.growth_lookbacks
    ]
    log1, log2 = F.log1p(F.lag(x, 1).over(w)), F.log1p(F.lag(x, 2).over(w))
    cols.append(((log0 - log1) - (log1 - log2)).alias(f"{value}_accel_logdiff_1"))
    run, since = _runs(c, F.col("_rn"), w)
    cols += [run.alias(f"{value}_zero_run_length"), since.alias(f"{value}_weeks_since_nonzero")]
    out = df.withColumn("_rn", F.row_number().over(w) - 1).select("*", *cols).drop("_rn")
    recent, base = f"{value}_recent_sum_{spec.outbreak_recent}", f"{value}_rollmean_{spec.outbreak_baseline}"
    if recent not in out.columns or base not in out.columns:
        return out
    index = (F.col(recent) + 1.0) / (F.col(base) * float(spec.outbreak_recent) + 1.0)
    flag = F.coalesce(index >= spec.outbreak_ratio, F.lit(False)).cast("double")
    return out.select("*", index.alias(f"{value}_outbreak_index_4_8"), flag.alias(f"{value}_outbreak_flag_4_8"))


def calendar(df: DataFrame, time: str = WEEK, first: str = "06-01", last: str = "10-15") -> DataFrame:
    """ISO week, its sine and cosine on a 52-week circle, and the season flag."""
    week = F.weekofyear(time)
    angle = F.lit(2.0) * F.pi() * week / 52.0
    return df.select(
        "*",
        week.alias("week_of_year"),
        F.sin(angle).alias("woy_sin"),
        F.cos(angle).alias("woy_cos"),
        season_flag(F.col(time), first, last).alias("monsoon_flag"),
    )


def covariate_features(
    df: DataFrame,
    variables: tuple[str, ...],
    lag_list: tuple[int, ...],
    mean_windows: tuple[int, ...],
    sum_windows: tuple[int, ...],
    summed: tuple[str, ...] = ("rain",),
    strict: bool = True,
) -> DataFrame:
    """Lags and rolling means or sums of covariates.

    ``strict``: means over the previous rows only, null until the window is full,
    and sums besides means for ``summed``. Otherwise the current row is included,
    one value is enough, and ``summed`` have sums instead of means.
    """
    w = series()
    present = [v for v in variables if v in df.columns]
    base = df.withColumns({v: number(v) for v in present}) if present else df
    cols: list[Column] = []
    for v in present:
        c = F.col(v)
        cols += [F.lag(c, k).over(w).alias(f"{v}_lag_{k}") for k in lag_list]
        shift, need = (1, None) if strict else (0, 1)
        if strict or v not in summed:
            cols += [rolling(c, n, w, F.avg, shift, need).alias(f"{v}_rollmean_{n}") for n in mean_windows]
        if v in summed:
            cols += [rolling(c, n, w, F.sum, shift, need).alias(f"{v}_rollsum_{n}") for n in sum_windows]
    return base.select("*", *cols)


def all_features(df: DataFrame, spec: FeatureSpec = FeatureSpec(), with_covariates: bool = False) -> DataFrame:
    """Case, calendar and, if asked, covariate features; no row is dropped yet."""
    out = calendar(case_features(df, spec))
    if with_covariates:
        out = covariate_features(
            out,
            spec.covariates,
            spec.covariate_lags,
            spec.covariate_mean_windows,
            spec.covariate_sum_windows,
            spec.summed_covariates,
        )
    return out


def required_columns(df: DataFrame, spec: FeatureSpec, with_covariates: bool, value: str = VALUE) -> list[str]:
    """Columns that must not be null in a feature panel: the lags."""
    need = [f"{value}_lag_{k}" for k in spec.case_lags]
    if with_covariates:
        need += [f"{v}_lag_{k}" for v in spec.covariates for k in spec.covariate_lags]
    return [c for c in need if c in df.columns]


def feature_panel(
    df: DataFrame, track: str, spec: FeatureSpec = FeatureSpec(), with_covariates: bool = False
) -> DataFrame:
    out = all_features(df, spec, with_covariates)
    kept = out.na.drop("any", subset=required_columns(out, spec, with_covariates))
    return kept.withColumn("track", F.lit(track))


def design_matrix(df: DataFrame, spec: FeatureSpec = FeatureSpec(), max_lag: int = 8) -> DataFrame:
    """The older design: lags 1..k of counts and covariates, lenient rollings, calendar; lags not null."""
    ks = list(range(1, max_lag + 1))
    out = covariate_features(
        lags(df, VALUE, ks),
        spec.covariates,
        tuple(ks),
        spec.covariate_mean_windows,
        spec.covariate_sum_windows,
        spec.summed_covariates,
        strict=False,
    )
    out = calendar(out)
    return out.na.drop("any", subset=[c for c in out.columns if "_lag_" in c])


def feature_columns(df: DataFrame, with_covariates: bool, protected: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns that are neither identity nor raw covariates, sorted."""
    hidden = {
        "geo_id", "geo_name", "week_start_date", "target_week", "role", "fold_id", "horizon", "track",
        "split_group", "y_true", "covariate_proxy_source", "covariate_is_proxy", *protected,
    }
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    out = []
    for c, t in df.dtypes:
        if c in hidden or c in COVARIATES or not t.startswith(numeric):
            continue
        if not with_covariates and c.startswith(tuple(f"{v}_" for v in COVARIATES)):
            continue
        out.append(c)
    return sorted(out)


def drop_exogenous(cols: list[str], fragments: tuple[str, ...]) -> list[str]:
    return [c for c in cols if not any(f in c.lower() for f in fragments)]


def slow_and_fast(cols: list[str], slow: tuple[str, ...], fast: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """Split covariate columns by name; a slow fragment wins over a fast one."""
    is_slow = [c for c in cols if any(f in c.lower() for f in slow)]
    return is_slow, [c for c in cols if c not in is_slow and any(f in c.lower() for f in fast)]
