"""Grouped linear models against plain solvers on each setting's rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weeklane.config import Training
from weeklane.models import fits, legacy, linear, runner
from weeklane.models.linear import Scaling, fit_elastic_net, fit_glm
from weeklane.models.settings import numbered, settings

KINDS = {"pooled": Scaling(), "older": legacy.SCORES}


@pytest.fixture(scope="module")
def rows(spark):
    r, out = np.random.default_rng(8), []
    for fold, n in (("A", 300), ("B", 150), ("C", 2)):
        for i in range(n):
            x = [float(r.normal()), float(r.normal(5, 3)), 1.0 if i % 9 else float("nan"), 7.0]
            geo = "pqr"[i % 3]
            y = float(r.poisson(np.exp(1 + 0.4 * x[0] + 0.1 * x[1] + 0.5 * (geo == "q"))))
            out.append((fold, 1, geo, i, "val" if i % 6 == 5 else "train", *[None if np.isnan(v) else v for v in x], y, float(r.integers(0, 9))))
    return spark.createDataFrame(out, "fold_id string, horizon int, geo_id string, i int, role string, a double, b double, c double, flat double, y_true double, cases double")


@pytest.fixture(scope="module")
def frame(rows):
    return settings(rows, ["a", "b", "c", "flat"], base="cases")


def own_rows(frame, s):
    rows = [r for r in frame.rows.collect() if r["_s"] == s and r["_train"]]
    return np.array([r["_x"] for r in rows], float), np.array([r["_c"] for r in rows]), np.array([r["_y"] for r in rows]), np.array([r["_base"] for r in rows])


def plain_design(x, c, scaling, series):
    if scaling.fill == "median":
        x = np.where(np.isnan(x), np.sort(x, axis=0)[(np.sum(~np.isnan(x), axis=0) - 1) // 2, range(x.shape[1])], x)
    mean, std = np.nanmean(x, axis=0), np.nanstd(x, axis=0, ddof=scaling.ddof)
    z = np.nan_to_num(np.where(std > 1e-12, (x - mean) / np.where(std > 1e-12, std, 1), 0))
    z = np.clip(z, -scaling.limit, scaling.limit) if scaling.limit else z
    return np.hstack([np.ones((len(x), 1)), z, *([np.eye(series)[c]] if scaling.series else [])])


@pytest.mark.parametrize("kind", list(KINDS))
@pytest.mark.parametrize(("power", "alpha"), [(1.0, 0.01), (1.5, 0.25)])
def test_glm_as_by_gradient_steps(spark, frame, kind, power, alpha):
    model = fit_glm(frame, power, alpha, KINDS[kind])
    assert model.steps <= 25
    for s in (0, 1):
        x, c, y, _ = own_rows(frame, s)
        z = plain_design(x, c, KINDS[kind], len(frame.series))
        w = model.coefficients[s]
        mu = np.exp(z @ w)
        slope = z.T @ ((mu - y) * mu ** (1 - power)) / len(y) + alpha * np.r_[0, w[1:]]
        assert np.abs(slope).max() < 1e-6  # the objective is convex: its stationary point is the solution


def test_elastic_net_path(spark, frame):
    alphas = [0.001, 0.02, 0.3, 5.0]
    models = fit_elastic_net(frame, fits.goal(fits.ELASTIC), alphas, 0.2)
    for s in (0, 1):
        x, c, y, base = own_rows(frame, s)
        z, t = plain_design(x, c, Scaling(), len(frame.series))[:, 1:], np.log1p(y) - np.log1p(base)
        sizes = []
        for a in alphas:
            w = models[a].coefficients[s]
            r = t - w[0] - z @ w[1:]
            slope = z.T @ r / len(t) - a * 0.8 * w[1:]
            assert abs(r.mean()) < 1e-7
            assert np.all(np.where(w[1:] != 0, np.abs(slope - 0.2 * a * np.sign(w[1:])), np.maximum(np.abs(slope) - 0.2 * a, 0)) < 1e-6)
            sizes.append(np.abs(w[1:]).sum())
        assert sizes == sorted(sizes, reverse=True) and sizes[-1] == 0


def test_models_are_stored_and_read(spark, rows, frame):
    cfg = Training(gbm_rounds=5, residual_gbm_rounds=5, forest_trees=4)
    fitted = fits.fit_models(frame, list(fits.TRAINED), cfg, least=10)
    again = fits.Fitted.of(fitted.table(spark))
    fresh = numbered(rows, again.core.features, again.core.by, again.core.keys, again.core.series, "cases")
    a, b = ({(r.fold_id, r.i): [r[m] for m in fits.TRAINED] for r in f.collect()} for f in (fitted.applied(frame.rows), again.applied(fresh)))
    assert len(a) == 452
    for k, v in a.items():
        assert (b[k] == [None] * 5 and v == b[k]) if k[0] == "C" else b[k] == pytest.approx(v, rel=1e-12)


def test_runner_falls_back_by_setting(spark, rows):
    out, _ = runner.fitted(rows, [fits.TWEEDIE, fits.FOREST], ["a", "b"], Training(min_train_rows=40, forest_trees=3))
    found = {(r.fold_id, r[f"{fits.TWEEDIE}__status"], r[f"{fits.FOREST}__status"]) for r in out.collect()}
    assert found == {("A", "trained", "trained"), ("B", "trained", "trained"), ("C", "fallback_mean", "fallback_mean")}
    mean = rows.filter("fold_id = 'C' AND role = 'train'").agg(F.avg("y_true")).first()[0]
    assert {r[fits.FOREST] for r in out.filter("fold_id = 'C'").collect()} == {mean}


def test_a_step_that_overshoots_is_halved(spark):
    y = [0.0] * 40 + [4000.0, 1.0]
    df = spark.createDataFrame([("A", 1, "g", "train", float(i >= 40) * (i - 39) + 0.01 * i, v) for i, v in enumerate(y)], "fold_id string, horizon int, geo_id string, role string, x double, y_true double")
    known = settings(df, ["x"])
    model = fit_glm(known, 1.0, 1e-6, Scaling(series=False))
    x, c, t, _ = own_rows(known, 0)
    mu = np.exp(plain_design(x, c, Scaling(series=False), 1) @ model.coefficients[0])
    assert np.isfinite(mu).all() and mu.mean() == pytest.approx(t.mean(), rel=1e-4)


def test_solved_leaves_empty_columns_out():
    a = np.diag([2.0, 0.0, 4.0])
    assert linear.solved(a, np.array([2.0, 0.0, 4.0])).tolist() == [1.0, 0.0, 1.0]
