"""Unit-root and level-stationarity tests per series and transform."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weeklane.config import GEO, WEEK
from weeklane.operators.explore import transforms_long

# Level-stationarity table (statistic, p-value), published by Kwiatkowski et al. 1992.
KPSS_STAT = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)
# Response surface for one series with a constant, MacKinnon 1994.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def kpss_p_value(stat: Column) -> Column:
    """Linear between table points, constant outside."""
    out = F.when(stat <= KPSS_STAT[0], KPSS_P[0])
    for (s0, s1), (p0, p1) in zip(zip(KPSS_STAT, KPSS_STAT[1:]), zip(KPSS_P, KPSS_P[1:])):
        out = out.when(stat <= s1, p0 + (stat - s0) * ((p1 - p0) / (s1 - s0)))
    return out.when(stat > KPSS_STAT[-1], KPSS_P[-1])


def kpss(long: DataFrame, max_lag: int, min_rows: int = 20) -> DataFrame:
    """Level-stationarity statistic per (series, transform) with a fixed bandwidth, by windows alone.

    Series with fewer than ``min_rows`` values or three levels give null.
    """
    keys = [GEO, "transform"]
    whole, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(WEEK)
    level = F.dense_rank().over(Window.partitionBy(*keys).orderBy("x"))
    base = long.withColumns({"_e": F.col("x") - F.avg("x").over(whole), "_lv": level})
    run = F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    prods = [(F.col("_e") * F.lag("_e", k).over(w)).alias(f"_c{k}") for k in range(1, max_lag + 1)]
    base = base.select(*keys, "_e", "_lv", run.alias("_run"), *prods)
    spread: Column = F.sum(F.col("_e") * F.col("_e"))
    for k in range(1, max_lag + 1):
        spread = spread + 2.0 * (1.0 - k / (max_lag + 1.0)) * F.coalesce(F.sum(f"_c{k}"), F.lit(0.0))
    sums = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.max("_lv").alias("_levels"),
        F.sum(F.col("_run") * F.col("_run")).alias("_eta"),
        spread.alias("_spread"),
    )
    n = F.col("n_obs").cast("double")
    usable = (F.col("n_obs") >= min_rows) & (F.col("_levels") >= 3)
    stat = F.when(usable, F.try_divide(F.col("_eta") / n, F.col("_spread")))
    out = sums.withColumn("kpss_stat", stat).withColumn("kpss_pvalue", kpss_p_value(F.col("kpss_stat")))
    return out.select(*keys, "n_obs", "kpss_stat", "kpss_pvalue")


def kpss_auto(x: np.ndarray) -> tuple[float, int]:
    """The statistic with the data-driven bandwidth of Hobijn et al. (1998)."""
    n = len(x)
    e = x - x.mean()
    near = int(n ** (2.0 / 9.0))
    cov = [2.0 * float(e[i:] @ e[: n - i]) / n for i in range(1, near + 1)]
    s0 = float(e @ e) / n + sum(cov)
    s1 = sum(i * c for i, c in enumerate(cov, start=1))
    gamma = 1.1447 * ((s1 / s0) ** 2) ** (1.0 / 3.0)
    lags = min(int(gamma * n ** (1.0 / 3.0)), n - 1)
    spread = float(e @ e)
    for i in range(1, lags + 1):
        spread += 2.0 * (1.0 - i / (lags + 1.0)) * float(e[i:] @ e[: n - i])
    return float((e.cumsum() ** 2).sum() / n / spread), lags


def _ols_t(y: np.ndarray, x: np.ndarray) -> tuple[float, float, int]:
    """t-value of the first column and the AIC of a least-squares fit."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    n, k = x.shape
    rss = float(e @ e)
    cov = np.linalg.pinv(x.T @ x)
    se = math.sqrt(max(rss / (n - k) * cov[0, 0], 0.0))
    aic = n * math.log(max(rss, 1e-300) / n) + n * (1 + math.log(2 * math.pi)) + 2 * k
    return (float(beta[0]) / se if se > 0 else math.nan), aic, n


def adf_test(x: np.ndarray) -> tuple[float, float, int]:
    """Augmented Dickey-Fuller with a constant; the lag count minimises AIC on a common sample."""
    n = len(x)
    top = max(min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2), 0)
    dx = np.diff(x)

    def design(lag: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        y = dx[skip:]
        cols = [x[skip:-1]] + [dx[skip - i : len(dx) - i] for i in range(1, lag + 1)]
        return y, np.column_stack([*cols, np.ones(len(y))])

    best = min(range(top + 1), key=lambda k: _ols_t(*design(k, top))[1])
    stat, _, _ = _ols_t(*design(best, best))
    return stat, tau_p_value(stat), best


def tau_p_value(stat: float) -> float:
    if math.isnan(stat):
        return math.nan
    if stat > TAU_MAX:
        return 1.0
    if stat < TAU_MIN:
        return 0.0
    coef = TAU_SMALL if stat <= TAU_STAR else TAU_LARGE
    z = sum(c * stat**i for i, c in enumerate(coef))
    return 0.5 * (1.0 + math.erf(z / math.sqrt(2.0)))


def unit_root_tests(long: DataFrame, min_rows: int = 20) -> DataFrame:
    """Both tests per (series, transform); a group is one series, bounded by the calendar."""
    schema = f"{GEO} string, transform string, n_obs long, adf_stat double, adf_pvalue double, kpss_stat double"

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(WEEK)["x"].to_numpy(float)
        stat = p = level = math.nan
        if len(x) >= min_rows and len(np.unique(x)) >= 3:
            try:
                stat, p, _ = adf_test(x)
                level, _ = kpss_auto(x)
            except (np.linalg.LinAlgError, ZeroDivisionError):
                pass
        row = {GEO: key[0], "transform": key[1], "n_obs": len(x), "adf_stat": stat, "adf_pvalue": p, "kpss_stat": level}
        return pd.DataFrame([row])

    out = long.groupBy(GEO, "transform").applyInPandas(fit, schema)
    out = out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("adf_stat", "adf_pvalue", "kpss_stat")})
    return out.withColumn("kpss_pvalue", kpss_p_value(F.col("kpss_stat")))


def adf(long: DataFrame, min_rows: int = 20) -> DataFrame:
    return unit_root_tests(long, min_rows).select(GEO, "transform", "n_obs", "adf_stat", "adf_pvalue")


def stationarity(dense: DataFrame, season: int = 52) -> DataFrame:
    """Both tests on six transforms; a candidate rejects the unit root and keeps level stationarity."""
    flag = (F.col("adf_pvalue") < 0.05) & (F.col("kpss_pvalue") > 0.05)
    tests = unit_root_tests(transforms_long(dense, season))
    return tests.withColumn("stationary_candidate", F.coalesce(flag, F.lit(False)))
