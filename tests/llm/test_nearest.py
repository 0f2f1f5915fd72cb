"""Neighbour search on tables that are larger than a leaf, or whose lengths differ."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weeklane.llm import nn_descent


def vectors(n, dim, spread, seed=3):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None] * r.lognormal(0, spread, n)[:, None]


def recall(spark, x, every, **settings):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = {}
    for r in nn_descent.nearest(df, F.col("vec_id") % every == 0, **settings).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(x), every):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-score)[:20].tolist()))
    return hits / (20 * len(found))


def test_one_long_vector_leaves_the_others_apart(spark):
    x = vectors(1500, 16, 0.3)
    x[17] *= 1e6
    assert recall(spark, x, 30, leaf=128, k=16) >= 0.95


def test_lists_are_joined_until_they_settle_and_the_beam_follows(spark):
    x = vectors(2500, 24, 0)
    assert recall(spark, x, 50, trees=2, leaf=64, k=12, beam=35, opened=12) >= 0.93


def test_lists_grow_where_no_beam_does(spark):
    x = vectors(500, 8, 0.3)
    assert recall(spark, x, 50, trees=1, leaf=16, k=2, reverse=2, beam=24, opened=12, most=48, settled=0.2) >= 0.9


def test_recall_that_is_not_reached_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "GROWN", 0)
    with pytest.raises(RuntimeError, match="recall is 0"):
        recall(spark, vectors(600, 8, 0.3), 50, trees=1, leaf=8, k=1, reverse=1, beam=21, opened=1, most=20)


def test_codes_keep_each_vector_at_its_own_scale():
    x = vectors(50, 9, 0.5)
    x[3] *= 1e9
    x[4] = 0
    for kind, error in ((nn_descent.MIDDLE, 2e-4), (nn_descent.SHORT, 3e-2)):
        y = nn_descent.decoded(nn_descent.coded(x, kind), 9, kind)
        assert (np.linalg.norm(x - y, axis=1) <= error * np.linalg.norm(x, axis=1)).all()


def test_near_copies_are_told_apart(spark):
    """A group of near copies beyond the beam, too few queries of it for the sample's recall to show."""
    r = np.random.default_rng(3)
    x = r.standard_normal((4000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:160] = x[0] + 1e-4 * r.standard_normal((160, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asks = F.col("vec_id") % 4 == 0
    found = nn_descent.nearest(df, asks, leaf=256, k=16, beam=40, opened=15, recall=0.9).where("query_id < 160").toPandas()
    sims = x[:160] @ x.T
    sims[np.arange(160), np.arange(160)] = -np.inf
    least = np.sort(sims, axis=1)[:, -20]
    assert (found["score"].to_numpy() >= least[found["query_id"]] - 1e-12).sum() >= 0.9 * 40 * 20
