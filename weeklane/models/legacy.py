"""The older pooled runs: Poisson ridge per horizon, its reduced backtest, residual node and total."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weeklane.config import EXOGENOUS_FRAGMENTS, FAST_FRAGMENTS, GEO, SLOW_FRAGMENTS, TARGET_WEEK, WEEK
from weeklane.models.design import fill_constant
from weeklane.models.linear import FLAT, Design, Linear, Scaling, fit_glm
from weeklane.models.settings import Settings, numbered, settings
from weeklane.operators.features import drop_exogenous, slow_and_fast
from weeklane.operators.fill import locf_cap
from weeklane.operators.hierarchy import bottom_up, residual_node
from weeklane.operators.splits import asof_ceiling, latest_origin

MODEL = "glm_poisson_ridge"


# Sample deviations, missing values at the mean, scores within six.
SCORES = Scaling(fill="mean", ddof=1, limit=6.0, series=False)


def strength(shape: Design, s: int) -> float:
    """max(0.5, 0.1 a feature that varies), spread over the training rows."""
    return max(0.5, 0.1 * int((shape.deviations[s] > FLAT).sum())) / max(int(shape.settings.sizes[s]), 1)


def fitted(rows: DataFrame, features: list[str], by: tuple[str, ...]) -> tuple[Settings, Linear]:
    """Poisson ridge of each setting of ``by`` on the rows whose role is train (all, without a role)."""
    known = settings(rows, features, by)
    return known, fit_glm(known, 1.0, strength, SCORES)


def poisson_live(features_panel: DataFrame, pairs: DataFrame, features: list[str], horizons: tuple[int, ...]) -> DataFrame:
    """Latest origin, one fit per horizon over all pairs (training and validation rows alike)."""
    known, model = fitted(pairs, features, ("horizon",))
    latest = numbered(latest_origin(features_panel, horizons), features, ("horizon",), known.keys, known.series)
    return model.predict(MODEL, latest).select(GEO, F.col(WEEK).alias("origin_week"), TARGET_WEEK, "horizon", F.col(MODEL).alias("y_pred"), F.lit(MODEL).alias("model"))


def poisson_backtest(supervised: DataFrame, features: list[str], ceiling: dt.date, mode: str = "exolite", max_weeks: int = 8) -> DataFrame:
    """Per fold and horizon: fitted on training origins up to ``ceiling``, scored on validation rows.

    ``exolite`` leaves covariates out; ``locf`` carries the slow ones forward for ``max_weeks`` after
    the ceiling and leaves the fast ones out. Missing features are 0.
    """
    rows = supervised
    if mode == "locf":
        slow, fast = slow_and_fast(features, SLOW_FRAGMENTS, FAST_FRAGMENTS)
        features = [f for f in features if f not in fast]
        rows = locf_cap(rows, slow, ceiling, max_weeks, (GEO, "fold_id", "horizon")) if slow else rows
    else:
        features = drop_exogenous(features, EXOGENOUS_FRAGMENTS)
    rows = fill_constant(rows, features)
    known, model = fitted(asof_ceiling(rows.filter(F.col("role") == "train"), ceiling), features, ("fold_id", "horizon"))
    held = numbered(rows.filter(F.col("role") == "val"), features, known.by, known.keys, known.series)
    return model.predict(MODEL, held).select(GEO, WEEK, TARGET_WEEK, "horizon", "fold_id", "role", "y_true", F.col(MODEL).alias("y_pred"))


def with_total(forecast: DataFrame, big: str | None = None, sub: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The forecast with the residual of an overlapping node, if asked, and the country total."""
    nodes = residual_node(forecast, big, sub, by=by) if big and sub else forecast
    return bottom_up(nodes, by=by)
