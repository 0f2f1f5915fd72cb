"""Exploratory statistics per series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weeklane.config import GEO, VALUE, WEEK
from weeklane.functions.scalars import adjusted_skew, clip, safe_corr, safe_div, whole_weeks
from weeklane.functions.windows import average_rank, by_day, rolling, series
from weeklane.operators.panel import dedupe


def top_share(panel: DataFrame, share: float = 0.1) -> DataFrame:
    """Share of the series total that falls into its top ``share`` of weeks (at least one)."""
    rows = panel.filter(F.col(VALUE).isNotNull())
    down = Window.partitionBy(GEO).orderBy(F.col(VALUE).desc())
    n = F.count(F.lit(1)).over(Window.partitionBy(GEO))
    k = F.greatest(F.ceil(n * F.lit(share)), F.lit(1))
    marked = rows.withColumn("_top", F.row_number().over(down) <= k)
    ratio = safe_div(F.sum(F.when(F.col("_top"), F.col(VALUE))), F.sum(VALUE))
    return marked.groupBy(GEO).agg(ratio.alias("top_10pct_weeks_share"))


def series_summary(dense: DataFrame) -> DataFrame:
    """Span, gaps, moments, quantiles and burstiness per series of a densified panel.

    Quantiles are taken in place: the values of a series are bounded by the calendar.
    """
    y = F.col(VALUE).cast("double")
    mean, std = F.avg(y), F.stddev_samp(y)
    q = F.percentile(y, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    stats = dense.groupBy(GEO).agg(
        F.min(WEEK).alias("start_date"),
        F.max(WEEK).alias("end_date"),
        F.count(F.lit(1)).alias("weeks"),
        F.count_if(y.isNull()).alias("missing_weeks"),
        (F.avg((F.coalesce(y, F.lit(0.0)) == 0).cast("double")) * 100).alias("zero_pct"),
        mean.alias("mean_cases"),
        q[0].alias("median_cases"),
        std.alias("std_cases"),
        safe_div(std, mean).alias("cv"),
        F.max(y).alias("max_cases"),
        q[1].alias("p95_cases"),
        q[2].alias("p99_cases"),
        F.sum(y).alias("sum_cases"),
        adjusted_skew(y).alias("skewness"),
        safe_div(F.var_samp(y), mean).alias("variance_to_mean"),
    )
    return stats.join(top_share(dense), GEO, "left")


def covariate_coverage(panel: DataFrame, covariates: list[str]) -> DataFrame:
    """Non-null weeks per series and covariate; counted wide, then unpivoted (few rows)."""
    present = [c for c in covariates if c in panel.columns]
    aggs = []
    for c in present:
        week = F.when(F.col(c).isNotNull(), F.col(WEEK))
        aggs.append(
            F.struct(
                F.lit(c).alias("covariate"),
                F.count(c).alias("non_null_weeks"),
                (F.count(c) * 100.0 / F.count(F.lit(1))).alias("pct_non_null"),
                F.min(week).alias("first_non_null_date"),
                F.max(week).alias("last_non_null_date"),
            )
        )
    return panel.groupBy(GEO).agg(F.array(*aggs).alias("_r")).select(GEO, F.inline("_r"))


def coverage_gap(panel: DataFrame, covariate: str = "rain") -> DataFrame:
    """Weeks between the last covariate of a series and the latest week of the whole panel."""
    latest = panel.agg(F.max(WEEK).alias("w")).scalar()
    last = panel.groupBy(GEO).agg(F.max(F.when(F.col(covariate).isNotNull(), F.col(WEEK))).alias("last_covariate_week"))
    return last.withColumn("latest_case_week", latest).withColumn(
        "gap_weeks", whole_weeks(F.col("latest_case_week"), F.col("last_covariate_week"))
    )


def annual_peaks(panel: DataFrame) -> DataFrame:
    """Total and highest week per series and year; the earliest week wins a tie."""
    year = F.year(WEEK).alias("year")
    return (
        panel.groupBy(GEO, year)
        .agg(
            F.sum(VALUE).cast("double").alias("annual_total_cases"),
            F.min_by(F.when(F.col(VALUE).isNotNull(), F.col(WEEK)), F.struct(F.col(VALUE).isNull(), -F.col(VALUE), F.col(WEEK))).alias("peak_week_start"),
            F.max(VALUE).cast("double").alias("peak_cases"),
        )
        .withColumn("peak_share_of_year", safe_div(F.col("peak_cases"), F.col("annual_total_cases")))
    )


def week_profile(panel: DataFrame) -> DataFrame:
    return panel.groupBy(GEO, F.weekofyear(WEEK).alias("week")).agg(F.avg(VALUE).alias("mean_cases"))


def seasonality_index(panel: DataFrame) -> DataFrame:
    """ISO week with the highest mean (the first on ties) and that mean over the mean profile."""
    return week_profile(panel).groupBy(GEO).agg(
        F.min_by("week", F.struct(F.col("mean_cases").isNull(), -F.col("mean_cases"), F.col("week"))).alias("peak_week_of_year"),
        safe_div(F.max("mean_cases"), F.avg("mean_cases")).alias("seasonality_index"),
    )


def dataset_overview(counts: DataFrame, covariates: DataFrame, panel: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """One row of table sizes and spans; scans that meet as one-row subqueries. ``raw``: the wide table."""
    w = covariates.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.min(WEEK).alias("lo"), F.max(WEEK).alias("hi")).alias("s")
    ).scalar()
    n_panel = panel.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_raw = [] if raw is None else [raw.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_case_rows_wide")]
    per_series = counts.groupBy(GEO).agg(F.count(F.lit(1)).alias("n"), F.min(WEEK).alias("lo"), F.max(WEEK).alias("hi"))
    one = per_series.agg(
        F.sum("n").alias("n_case_rows_long"),
        F.count(F.lit(1)).alias("n_geos"),
        F.min("lo").alias("case_date_min"),
        F.max("hi").alias("case_date_max"),
    )
    return one.select(
        "*",
        w.getField("n").alias("n_weather_rows_long"),
        w.getField("lo").alias("weather_date_min"),
        w.getField("hi").alias("weather_date_max"),
        n_panel.alias("n_panel_rows"),
        *n_raw,
    ).withColumn("weather_gap_weeks_to_latest_cases", whole_weeks(F.col("case_date_max"), F.col("weather_date_max")))


def series_ids(df: DataFrame) -> DataFrame:
    """The distinct ids as rows (a list of all ids would have to fit one row)."""
    return df.select(GEO).distinct()


def baseline_forecastability(dense: DataFrame, horizons: list[int], season: int = 52, ref: str = "origin") -> DataFrame:
    """MAE and RMSE of persistence and the seasonal naive rule per series and horizon.

    ``ref`` names the week the season is counted back from: ``origin`` (t - season)
    or ``target`` (t + h - season).
    """
    y = F.col(VALUE).cast("double")
    w = series()
    last_year = F.max(y).over(by_day(-7 * season))
    pairs = []
    for h in horizons:
        truth = F.lead(y, h).over(w)
        past = last_year if ref == "origin" else F.max(y).over(by_day(7 * (h - season)))
        for m, p in (("persistence", y), ("seasonal_naive", past)):
            pairs.append(
                F.struct(F.lit(h).alias("horizon"), F.lit(m).alias("model"), truth.alias("t"), p.alias("p"))
            )
    rows = dense.select(GEO, F.array(*pairs).alias("_a")).select(GEO, F.inline("_a"))
    e = F.col("t") - F.col("p")
    return (
        rows.filter(e.isNotNull())
        .groupBy(GEO, "horizon", "model")
        .agg(F.count(F.lit(1)).alias("n_obs"), F.avg(F.abs(e)).alias("MAE"), F.sqrt(F.avg(e * e)).alias("RMSE"))
    )


def forecastability_macro(by_series: DataFrame) -> DataFrame:
    return by_series.groupBy("model", "horizon").agg(
        F.avg("MAE").alias("MAE_macro"), F.avg("RMSE").alias("RMSE_macro"), F.count(F.lit(1)).alias("n_geos")
    )


def lead_lag(panel: DataFrame, covariates: list[str], max_lag: int = 12, min_rows: int = 30) -> DataFrame:
    """Correlation of the count with each covariate 0..max_lag rows earlier.

    Lags are exploded inside the series partition, so ranks and sums per
    (series, covariate, lag) need no further shuffle. Ranks are retaken per lag
    because the complete rows differ.
    """
    w = series()
    entries = [
        F.struct(
            F.lit(c).alias("covariate"),
            F.lit(k).alias("lag_weeks"),
            (F.lag(F.col(c).cast("double"), k).over(w) if k else F.col(c).cast("double")).alias("x"),
        )
        for c in covariates
        if c in panel.columns
        for k in range(max_lag + 1)
    ]
    rows = panel.select(GEO, F.col(VALUE).cast("double").alias("y"), F.array(*entries).alias("_a"))
    rows = rows.select(GEO, "y", F.inline("_a")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    keys = [GEO, "covariate", "lag_weeks"]
    level = F.dense_rank().over(Window.partitionBy(*keys).orderBy("x"))
    ranked = rows.withColumns({"_d": level, "_rx": average_rank("x", keys)}).withColumn("_ry", average_rank("y", keys))
    out = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.max("_d").alias("_levels"),
        safe_corr(F.col("x"), F.col("y")).alias("pearson_corr"),
        safe_corr(F.col("_rx"), F.col("_ry")).alias("spearman_corr"),
    )
    return out.filter((F.col("n_obs") >= min_rows) & (F.col("_levels") >= 3)).drop("_levels")


def lead_lag_best(table: DataFrame) -> DataFrame:
    """Strongest absolute rank correlation per series and covariate; the smaller lag wins a tie."""
    strength = F.round(F.abs(F.coalesce("spearman_corr", F.lit(-1.0))), 12)
    rows = table.withColumn("_o", F.when(F.col("spearman_corr").isNull(), F.lit(1.0)).otherwise(-strength))
    return dedupe(rows, [GEO, "covariate"], ["_o", "lag_weeks"]).drop("_o")


def pair_spearman(panel: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rank correlation of the series of each row (geo_a, geo_b) of ``pairs``, over their common weeks.

    The pairs are a table, for example the nodes of one parent; all series against all others is
    not offered, its output alone grows with the square of the series.
    """
    y = panel.filter(F.col(VALUE).isNotNull()).select(GEO, WEEK, F.col(VALUE).cast("double").alias("v"))
    a = pairs.select("geo_a", "geo_b").distinct().join(y.select(F.col(GEO).alias("geo_a"), WEEK, F.col("v").alias("_x")), "geo_a")
    rows = a.join(y.select(F.col(GEO).alias("geo_b"), WEEK, F.col("v").alias("_y")), ["geo_b", WEEK])
    keys = ["geo_a", "geo_b"]
    ranked = rows.withColumn("_rx", average_rank("_x", keys)).withColumn("_ry", average_rank("_y", keys))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs"), safe_corr(F.col("_rx"), F.col("_ry")).alias("spearman"))


def partner_candidates(panel: DataFrame, tables: int = 24, near: int = 8, crowd: int = 64, seed: int = 11) -> DataFrame:
    """Pairs (geo_a < geo_b) of series whose ranks may rise together, or against each other.

    A series' centred ranks are projected on random signs of the weeks. The signs of some projections
    are a bucket, whose number follows the series so that buckets hold ``crowd`` of them; within a
    bucket the series stand in the order of one more projection, and each meets its ``near`` followers. A series' mirror image is
    in the tables too, for negative correlations. So candidates grow with the series, not with
    their square, however crowded a bucket is.
    """
    rows = panel.filter(F.col(VALUE).isNotNull()).select(GEO, WEEK, F.col(VALUE).cast("double").alias("v"))
    ranked = rows.withColumn("_r", average_rank("v", [GEO]))
    middle = Window.partitionBy(GEO)
    unit = ranked.withColumn("_e", F.col("_r") - F.avg("_r").over(middle))
    series_ = panel.select(GEO).distinct().count()
    bits = max(0, round(math.log2(max(series_ / crowd, 1))))
    sign = [F.when(F.xxhash64(WEEK, F.lit(seed * 1000 + k)) % 2 == 0, F.col("_e")).otherwise(-F.col("_e")) for k in range(tables * (bits + 1))]
    norm = F.sqrt(F.sum(F.col("_e") * F.col("_e")))
    made = unit.groupBy(GEO).agg(norm.alias("_n"), *[F.sum(x).alias(f"_p{k}") for k, x in enumerate(sign)]).filter(F.col("_n") > 0)
    both = made.withColumn("_side", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    entries = []
    for t in range(tables):
        at = [F.col(f"_p{t * (bits + 1) + k}") * F.col("_side") for k in range(bits + 1)]
        bucket = F.concat_ws("", *[F.when(x > 0, "1").otherwise("0") for x in at[1:]]) if bits else F.lit("")
        entries.append(F.struct(F.lit(t).alias("t"), bucket.alias("bucket"), (at[0] / F.col("_n")).alias("place")))
    placed = both.select(F.col(GEO).alias("geo_a"), F.inline(F.array(*entries)))
    order = Window.partitionBy("t", "bucket").orderBy("place", "geo_a")
    met = placed.withColumn("_next", F.array(*[F.lead("geo_a", k).over(order) for k in range(1, near + 1)])).withColumn("geo_b", F.explode("_next"))
    pairs = met.filter(F.col("geo_b").isNotNull() & (F.col("geo_a") != F.col("geo_b")))
    return pairs.select(F.least("geo_a", "geo_b").alias("geo_a"), F.greatest("geo_a", "geo_b").alias("geo_b")).distinct()


def strongest_partners(panel: DataFrame, top: int = 5, **tables) -> DataFrame:
    """(geo_id, rank, partner, n_obs, spearman): each series' strongest rank correlations among its candidates, confirmed exactly."""
    found = pair_spearman(panel, partner_candidates(panel, **tables)).filter(F.col("spearman").isNotNull())
    one = found.select(F.col("geo_a").alias(GEO), F.col("geo_b").alias("partner"), "n_obs", "spearman")
    both = one.unionByName(found.select(F.col("geo_b").alias(GEO), F.col("geo_a").alias("partner"), "n_obs", "spearman"))
    order = Window.partitionBy(GEO).orderBy(F.round(F.abs("spearman"), 9).desc(), "partner")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(GEO, "rank", "partner", "n_obs", "spearman")


def seasonal_diff(dense: DataFrame, season: int = 52) -> DataFrame:
    """The six transforms a stationarity table tests, as columns."""
    w = series()
    y = F.col(VALUE).cast("double")
    log = F.log1p(y)
    cols = {
        "raw": y,
        "log1p": log,
        "diff_1": y - F.lag(y, 1).over(w),
        f"diff_{season}": y - F.lag(y, season).over(w),
        "log1p_diff_1": log - F.lag(log, 1).over(w),
        f"log1p_diff_{season}": log - F.lag(log, season).over(w),
    }
    return dense.select(GEO, WEEK, *[c.alias(n) for n, c in cols.items()])


def transforms_long(dense: DataFrame, season: int = 52) -> DataFrame:
    wide = seasonal_diff(dense, season)
    names = [c for c in wide.columns if c not in (GEO, WEEK)]
    entries = F.array(*[F.struct(F.lit(n).alias("transform"), F.col(n).alias("x")) for n in names])
    return wide.select(GEO, WEEK, F.inline(entries)).filter(F.col("x").isNotNull())


def autocorr(dense: DataFrame, ks: tuple[int, ...] = (1, 4, 13, 26, 52)) -> DataFrame:
    w = series()
    y = F.col(VALUE).cast("double")
    lagged = dense.select(GEO, y.alias("_y"), *[F.lag(y, k).over(w).alias(f"_l{k}") for k in ks])
    return lagged.groupBy(GEO).agg(*[safe_corr(F.col("_y"), F.col(f"_l{k}")).alias(f"acf_lag_{k}") for k in ks])


def acf_table(dense: DataFrame, max_lag: int = 60) -> DataFrame:
    """Autocorrelation with the full-sample mean and variance, lags 1..min(max_lag, n-1)."""
    rows = dense.filter(F.col(VALUE).isNotNull())
    whole = Window.partitionBy(GEO)
    y = F.col(VALUE).cast("double")
    base = rows.select(GEO, WEEK, (y - F.avg(y).over(whole)).alias("_e"))
    w = series()
    prods = base.select(GEO, "_e", *[(F.col("_e") * F.lag("_e", k).over(w)).alias(f"_p{k}") for k in range(1, max_lag + 1)])
    whole_sq = F.sum(F.col("_e") * F.col("_e"))
    rows = [
        F.struct(F.lit(k).alias("lag"), F.try_divide(F.sum(f"_p{k}"), whole_sq).alias("acf"), F.count(f"_p{k}").alias("n_pairs"))
        for k in range(1, max_lag + 1)
    ]
    out = prods.groupBy(GEO).agg(F.array(*rows).alias("_a")).select(GEO, F.inline("_a"))
    return out.filter(F.col("n_pairs") > 0)


def rolling_moments(dense: DataFrame, width: int = 8, need: int = 4) -> DataFrame:
    w = series()
    y = F.col(VALUE).cast("double")
    return dense.select(
        GEO,
        WEEK,
        rolling(y, width, w, F.avg, 0, need).alias("rolling_mean"),
        rolling(y, width, w, F.stddev_samp, 0, need).alias("rolling_std"),
    )


def seasonal_strength(dense: DataFrame, season: int = 52) -> DataFrame:
    """Strength of season and trend from a classical decomposition.

    Trend: centred moving average over ``season`` rows (ends at half weight when
    ``season`` is even). Season: mean of the detrended value per position in the
    cycle, centred. Strength: max(0, 1 - var(rest) / var(rest + component)).
    """
    w = series()
    y = F.col(VALUE).cast("double")
    half = season // 2
    if season % 2 == 0:
        inner = F.sum("_y").over(w.rowsBetween(-(half - 1), half - 1))
        edge = (F.lag("_y", half).over(w) + F.lead("_y", half).over(w)) / 2.0
        trend = (inner + edge) / float(season)
        frame = w.rowsBetween(-half, half)
        full = F.count("_y").over(frame) == season + 1
    else:
        frame = w.rowsBetween(-half, half)
        trend, full = F.avg("_y").over(frame), F.count("_y").over(frame) == season
    base = dense.select(GEO, WEEK, y.alias("_y"), F.pmod(F.row_number().over(w) - 1, F.lit(season)).alias("_pos"))
    base = base.withColumn("_trend", F.when(full, trend)).withColumn("_d", F.col("_y") - F.col("_trend"))
    at = F.avg("_d").over(Window.partitionBy(GEO, "_pos"))
    base = base.withColumn("_s", at)
    means = F.avg("_m").over(Window.partitionBy(GEO))
    first = F.row_number().over(Window.partitionBy(GEO, "_pos").orderBy(WEEK)) == 1
    base = base.withColumn("_m", F.when(first, F.col("_s"))).withColumn("_season", F.col("_s") - means)
    base = base.withColumn("_r", F.col("_d") - F.col("_season"))

    def strength(part: str) -> Column:
        ratio = safe_div(F.var_samp("_r"), F.var_samp(F.col("_r") + F.col(part)))
        return clip(F.lit(1.0) - ratio, 0.0)  # null for a series shorter than a cycle

    return base.groupBy(GEO).agg(
        strength("_season").alias("seasonal_strength"), strength("_trend").alias("trend_strength")
    )


def dataset_summary(summary: DataFrame, seasonality: DataFrame, gap: DataFrame) -> DataFrame:
    out = summary.join(seasonality, GEO, "left").join(gap.select(GEO, "gap_weeks"), GEO, "left")
    wanted = (
        GEO, "weeks", "zero_pct", "mean_cases", "variance_to_mean", "peak_week_of_year", "seasonal_strength",
        "acf_lag_1", "acf_lag_52", "gap_weeks",
    )
    return out.select(*[c for c in wanted if c in out.columns])


def top_list(df: DataFrame, name: str, column: str, n: int = 3, ties: tuple[str, ...] = (GEO,)) -> DataFrame:
    """The n largest by one column, as (list, item, value)."""
    top = df.filter(F.col(column).isNotNull()).orderBy(F.col(column).desc(), *ties).limit(n)
    return top.select(F.lit(name).alias("list"), F.col(GEO).alias("item"), F.col(column).alias("value"))


def top_lead_lags(best: DataFrame, n: int = 5) -> DataFrame:
    """The strongest of the best lags, by absolute rank correlation."""
    rows = best.filter(F.col("spearman_corr").isNotNull())
    return rows.orderBy(F.round(F.abs("spearman_corr"), 12).desc(), GEO, "covariate").limit(n)


def stationary_count(tests: DataFrame) -> DataFrame:
    """Series per transform that pass both tests."""
    return tests.groupBy("transform").agg(F.count_if("stationary_candidate").alias("n_stationary"), F.count(F.lit(1)).alias("n_series"))


def best_baseline(macro: DataFrame) -> DataFrame:
    return dedupe(macro, ["horizon"], ["MAE_macro", "model"])
