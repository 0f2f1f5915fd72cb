"""Small fits per series and horizon: negative-binomial regression with a cascade of fallbacks.

A group is one series at one horizon (and fold), so it is bounded by the calendar.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weeklane.config import GEO, WEEK

CASCADE = ("negative_binomial", "poisson", "tweedie", "ridge_log1p")
MIN_ROWS = 20
FLAT = 1e-12  # deviation below which a column is constant


def scaled(train: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both standardised by train, with an intercept; constant columns left out, missing values at the mean."""
    mean, std = np.nanmean(train, axis=0), np.nanstd(train, axis=0)
    keep = std > FLAT
    z = [np.nan_to_num((x[:, keep] - mean[keep]) / std[keep]) for x in (train, rows)]
    return tuple(np.column_stack([np.ones(len(x)), x]) for x in z)


def log_glm(x: np.ndarray, y: np.ndarray, variance, alpha: float, steps: int = 100) -> np.ndarray:
    """Coefficients with a log link and an L2 penalty (not on the intercept), by reweighted least squares."""
    beta = np.zeros(x.shape[1])
    beta[0] = np.log(max(y.mean(), 1e-6))
    ridge = np.eye(x.shape[1]) * alpha * len(y)
    ridge[0, 0] = 0.0
    for _ in range(steps):
        eta = np.clip(x @ beta, -20, 20)
        mu = np.exp(eta)
        w = mu * mu / np.maximum(variance(mu), 1e-9)
        new = np.linalg.solve(x.T @ (w[:, None] * x) + ridge, x.T @ (w * (eta + (y - mu) / mu)))
        if not np.isfinite(new).all():
            raise ArithmeticError("no finite step")
        done = np.abs(new - beta).max() < 1e-8
        beta = new
        if done:
            return beta
    raise ArithmeticError("no convergence")


def predict_group(train_x: np.ndarray, y: np.ndarray, rows_x: np.ndarray, alpha: float) -> tuple[np.ndarray, str]:
    """Forecasts of all rows and the member of the cascade that gave them."""
    if len(y) < MIN_ROWS:
        return np.full(len(rows_x), y.mean() if len(y) else 0.0), "mean"
    x, rows = scaled(train_x, rows_x)
    m, v = y.mean(), y.var()
    a = max((v - m) / (m * m + 1e-12), 1e-6) if m > 0 else 1.0
    for kind, variance in zip(CASCADE, (lambda mu: mu + a * mu * mu, lambda mu: mu, lambda mu: mu**1.5), strict=False):
        try:
            out = np.exp(np.clip(rows @ log_glm(x, y, variance, alpha), -20, 20))
            if np.isfinite(out).all():
                return out, kind
        except (ArithmeticError, np.linalg.LinAlgError):
            continue
    beta = np.linalg.solve(x.T @ x + np.eye(x.shape[1]), x.T @ np.log1p(y))
    return np.clip(np.expm1(rows @ beta), 0, None), CASCADE[-1]


def grouped_glm(supervised: DataFrame, features: list[str], alpha: float | Column = 0.005, by: tuple[str, ...] = ("fold_id", "horizon", GEO)) -> DataFrame:
    """Adds y_pred and fit_status: fitted on the training rows of each group, applied to all its rows.

    alpha: one penalty, or a column that makes the penalties of a grid; they are a column of the result then.
    """
    keep = [*by, WEEK, "target_week", "role", "y_true"]
    keep = list(dict.fromkeys(c for c in keep if c in supervised.columns))
    grid = isinstance(alpha, Column)
    one = None if grid else float(alpha)
    rows = supervised.select(*keep, *[F.col(f).cast("double").alias(f"x_{f}") for f in features], *([alpha.alias("alpha")] if grid else []))
    if grid:
        keep, by = [*keep, "alpha"], (*by, "alpha")
    xs = [f"x_{f}" for f in features]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        train = (pdf["role"] == "train").to_numpy()
        x, y = pdf[xs].to_numpy(float), pdf["y_true"].to_numpy(float)
        pred, how = predict_group(x[train], y[train], x, float(pdf["alpha"].iloc[0]) if grid else one)
        return pdf[keep].assign(y_pred=pred, fit_status=how)

    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("y_pred", T.DoubleType()), T.StructField("fit_status", T.StringType())])
    return rows.groupBy(*by).applyInPandas(fit, schema)


def alpha_sweep(supervised: DataFrame, features: list[str], alphas: list[float]) -> DataFrame:
    """(alpha, fold, MAE, RMSE) on validation rows; results are kept by alpha.

    One plan for the whole grid: the rows are fanned out by alpha after they are narrowed.
    """
    grid = F.explode(F.array(*[F.lit(float(a)) for a in alphas]))
    rows = grouped_glm(supervised, features, grid, ("fold_id", "horizon", GEO)).filter(F.col("role") == "val")
    e = F.col("y_true") - F.col("y_pred")
    return rows.groupBy("alpha", F.col("fold_id").alias("fold")).agg(F.avg(F.abs(e)).alias("MAE"), F.sqrt(F.avg(e * e)).alias("RMSE")).select("alpha", "fold", "MAE", "RMSE")
