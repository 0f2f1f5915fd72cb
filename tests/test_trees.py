"""Histogram trees: one task against the whole cluster, and both against a plain recursion."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from weeklane.models import trees as tr
from weeklane.models.settings import settings
from weeklane.models.trees import TreeSpec, fit_trees


@pytest.fixture(scope="module")
def frame(spark):
    r = np.random.default_rng(4)
    rows = []
    for fold in ("A", "B"):
        for i in range(160 if fold == "A" else 90):
            x = [float(r.integers(0, 9)), float(r.normal()), float("nan") if r.random() < 0.1 else float(r.integers(0, 3))]
            geo = "pqr"[i % 3]
            mean = np.exp(0.2 * x[0] + 0.5 * x[1] + (geo == "q"))
            rows.append((fold, 1, geo, i, "val" if i % 5 == 4 else "train", *x, float(r.poisson(mean))))
    rows.append(("A", 1, "new", 999, "val", 1.0, 1.0, 1.0, 3.0))  # a series that no training row has
    rows.append(("C", 1, "p", 1, "val", 1.0, 1.0, 1.0, 3.0))  # a setting without training rows
    df = spark.createDataFrame(rows, "fold_id string, horizon int, geo_id string, i int, role string, a double, b double, c double, y_true double")
    return settings(df, ["a", "b", "c"], bins=16)


def values(frame, model, name="p"):
    return {(r.fold_id, r.i): (r.role, r.y_true, r[name]) for r in model.predict(name, frame.rows).collect()}


SPECS = {
    "poisson": TreeSpec("poisson", 12, 0.3, 3, 5),
    "squared": TreeSpec("squared", 12, 0.3, 2, 5),
    "tweedie": TreeSpec("tweedie", 40, 0.5, 3, power=1.3, leaves=15, row_share=0.8, feature_share=0.8, patience=3, shrink=True),
    "forest": TreeSpec("squared", 11, 0, 4, 4, leaves=16),
}


@pytest.mark.parametrize("name", list(SPECS))
def test_one_task_and_the_whole_cluster_build_the_same(spark, frame, name, monkeypatch):
    monkeypatch.setattr(tr, "STAGE", 5)
    alone, spread = fit_trees(frame, None, SPECS[name], cells=10**9), fit_trees(frame, None, SPECS[name], cells=0)
    assert [len(t) for t in alone.trees] == [len(t) for t in spread.trees] and alone.trees[2] == []
    for a, b in zip(alone.trees, spread.trees, strict=True):
        for s, t in zip(a, b, strict=True):
            assert s.feature.tolist() == t.feature.tolist() and s.at.tolist() == t.at.tolist()
            assert np.allclose(s.value, t.value, atol=1e-9)
    if name == "tweedie":
        assert all(len(t) < 40 for t in alone.trees[:2])  # ended early


def plain_boost(frame, s, spec):
    """Recursion over rows; forecasts of all rows by (fold, i)."""
    rows = [r for r in frame.rows.collect() if r["_s"] == s]
    codes = frame.codes(s, np.array([r["_x"] for r in rows], float), np.array([r["_c"] for r in rows]))
    y, train = np.array([r["_y"] for r in rows]), np.array([r["_train"] for r in rows])
    f = np.full(len(rows), spec.start(y[train].mean()))
    last = codes.shape[1] - 1

    def value(at, g, h):
        return -spec.rate * g[at & train].sum() / h[at & train].sum()

    def split(at, g, h, depth):
        best, own = (1e-9, None), at & train
        if depth:
            for k in range(codes.shape[1]):
                for v in range(codes[train, k].max() + 1):
                    left = own & ((codes[:, k] == v) if k == last else (codes[:, k] <= v))
                    right = own & ~left
                    if min(left.sum(), right.sum()) >= spec.min_leaf and min(h[left].sum(), h[right].sum()) >= tr.LEAST_CURVATURE:
                        gain = sum(g[q].sum() ** 2 / h[q].sum() for q in (left, right)) - g[own].sum() ** 2 / h[own].sum()
                        if gain > best[0] + 1e-9:
                            best = gain, (k, v)
        if best[1] is None:
            return np.where(at, value(at, g, h), 0.0)
        k, v = best[1]
        left = at & ((codes[:, k] == v) if k == last else (codes[:, k] <= v))
        return split(left, g, h, depth - 1) + split(at & ~left, g, h, depth - 1)

    for _ in range(spec.rounds):
        g, h = tr.gradients(spec.loss, y, f, spec.power)
        f = f + split(np.ones(len(rows), bool), g, h, spec.depth)
    return {(r.fold_id, r.i): v for r, v in zip(rows, tr.back(spec, f), strict=True)}


@pytest.mark.parametrize("name", ["poisson", "squared"])
def test_boosting_as_by_recursion(spark, frame, name):
    found = values(frame, fit_trees(frame, None, SPECS[name]))
    for s in (0, 1):
        expected = plain_boost(frame, s, SPECS[name])
        assert {k: found[k][2] for k in expected} == pytest.approx(expected, rel=1e-9)
    start = 1e-6 if name == "poisson" else 0  # nothing was learned in setting C
    assert found["C", 1][2] == pytest.approx(start, rel=1e-6)


def test_models_pass_through_a_table(spark, frame):
    model = fit_trees(frame, None, SPECS["poisson"])
    again = tr.Trees.of(model.settings, model.spec, model.table(spark))
    assert values(frame, again) == values(frame, model)


def test_forest_learns(spark, frame):
    found = values(frame, fit_trees(frame, F.col("_y"), TreeSpec("squared", 60, 0, 6, 4, leaves=64)))
    rows = [v for v in found.values() if v[0] == "val"]
    mean = np.mean([v[1] for v in found.values() if v[0] == "train"])
    assert np.mean([(v[1] - v[2]) ** 2 for v in rows]) < 0.7 * np.mean([(v[1] - mean) ** 2 for v in rows])


def test_rows_are_drawn_alike_everywhere():
    rows = np.arange(20_000)
    times = tr.drawn(SPECS["forest"], rows, 3)
    assert abs(times.mean() - 1) < 0.03 and abs((times == 0).mean() - np.exp(-1)) < 0.02
    assert (tr.drawn(SPECS["forest"], rows[::-1], 3)[::-1] == times).all()
    assert abs(tr.drawn(SPECS["tweedie"], rows, 3).mean() - 0.8) < 0.02


def test_trees_are_grown_once(spark, frame, monkeypatch, tmp_path):
    """One call a setting and specification: nothing between the fits and the driver runs them again."""
    plain = tr.fit_alone

    def counted(*args):
        (tmp_path / uuid.uuid4().hex).touch()
        return plain(*args)

    monkeypatch.setattr(tr, "fit_alone", counted)
    models = tr.fit_several(frame, [(None, SPECS["poisson"]), (None, SPECS["forest"])])
    assert [len(t) for t in models[0].trees] == [12, 12, 0] and [len(t) for t in models[1].trees] == [11, 11, 0]
    assert len(list(tmp_path.iterdir())) == 4
