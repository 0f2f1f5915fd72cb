"""Small frames with nulls, ties, repeats, constants and gaps."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from weeklane.config import Stack
from weeklane.functions.quantiles import grouped_quantiles
from weeklane.functions import quantiles
from weeklane.functions.scalars import adjusted_skew
from weeklane.models import grouped
from weeklane.models.settings import settings
from weeklane.models.trees import TreeSpec, fit_trees
from weeklane.operators import boards, design, explore, features, fill, guardrail, hierarchy, metrics, naive, panel, splits, stacking
from weeklane.sources import artifacts, counts, covariates, sinks

D = dt.date(2024, 1, 1)


def week(k):
    return D + dt.timedelta(days=7 * k)


def series(spark, values, geo="A"):
    return spark.createDataFrame([(geo, geo, week(i), v) for i, v in enumerate(values)], "geo_id string, geo_name string, week_start_date date, cases long")


def one(df):
    return df.collect()[0]


def test_means_skip_missing(spark):
    df = spark.createDataFrame([("m", 10.0, None), ("m", 30.0, 20.0)], "model string, y_true double, y_pred double")
    r = one(metrics.metric_frame(df, ["model"]))
    assert (r.n_rows, r.mean_y, r.mean_pred, r.bias, r.MAE, r.RMSE) == (2, 20.0, 20.0, 10.0, 10.0, 10.0)


def test_skewness_far_from_zero(spark):
    df = spark.createDataFrame([(x + 1e7,) for x in (1.0, 2.0, 3.0, 4.0, 100.0)], "x double")
    assert math.isclose(one(df.agg(adjusted_skew(F.col("x")).alias("s"))).s, 2.2316, abs_tol=1e-3)
    assert one(spark.createDataFrame([(5.0,)] * 4, "x double").agg(adjusted_skew(F.col("x")).alias("s"))).s is None


def test_missing_week_is_no_peak(spark):
    r = one(explore.annual_peaks(series(spark, [None, 3, 9, 9])))
    assert (r.peak_week_start, r.peak_cases) == (week(2), 9.0)
    assert one(explore.seasonality_index(series(spark, [None, 3, 9, 9]))).peak_week_of_year == 3


def test_missing_errors_rank_last(spark):
    rows = [("operational", "holdout", "val", m, e, e) for m, e in (("a", None), ("b", 2.0), ("c", 1.0))]
    board = spark.createDataFrame(rows, "track string, split_group string, role string, model string, MAE_macro double, RMSE_macro double")
    assert [r.model for r in boards.leaderboard(board, "holdout").collect()] == ["c", "b", "a"]
    assert {r.model: r["rank"] for r in boards.evidence_fallback(board, "operational").collect()} == {"c": 1, "b": 2, "a": 3}
    assert one(boards.winners(board, ["track"], boards.BOARD_ORDER)).model == "c"
    assert one(boards.promotion_policy(boards.evidence_fallback(board, "operational"))).primary_model == "c"


def test_metric_keys_from_text(spark):
    df = spark.createDataFrame([("('val', 7.0)",), ("('train', 3)",), ("val",), ("other",)], "index string")
    assert sorted(boards.coerce_metric_keys(df).collect(), key=str) == sorted([("val", 7), ("train", 3), ("val", None), (None, None)], key=str)


def test_missing_forecast_stays_missing(spark):
    df = spark.createDataFrame([("A", None, -1.0)], "geo_id string, a double, b double")
    assert [(r.model, r.y_pred) for r in naive.to_long(df, ["a", "b"], ["geo_id"]).collect()] == [("a", None), ("b", 0.0)]
    wide = spark.createDataFrame([("F", 1, None, None, 4.0)], "fold_id string, horizon int, cases long, a double, b double")
    weights = spark.createDataFrame([("F", 1, "a", 0.5), ("F", 1, "b", 0.5)], "fold_id string, horizon int, model string, weight double")
    assert one(stacking.conservative_stack(wide, weights, ["a", "b"])).conservative_stack is None
    with pytest.raises(ValueError):
        stacking.conservative_stack(wide, weights, ["a"])


def test_unknown_rmse_gives_null(spark):
    merged = spark.createDataFrame([("F", 1, 10.0, 20.0)], "fold_id string, horizon int, y_a double, y_b double")
    rmse = spark.createDataFrame([("F", 1, None, 2.0)], "fold_id string, horizon int, rmse_a double, rmse_b double")
    assert one(stacking.inverse_rmse_stack(merged, rmse, "a", "b")).y_pred is None


def test_window_metrics_take_the_truth(spark):
    pred = spark.createDataFrame([("A", week(1), "m", 5.0, 99.0)], "geo_id string, target_week date, model string, y_pred double, y_true double")
    truth = spark.createDataFrame([("A", week(1), 8.0)], "geo_id string, target_week date, y_true double")
    r = one(metrics.window_metrics(pred, truth, {"w": (week(0), week(2)), "none": (week(50), week(60))}, ["model"]))
    assert (r.window, r.MAE) == ("w", 3.0)


def test_densify_with_repeats_and_other_days(spark):
    rows = [("A", "a", D, 1), ("A", "a", D + dt.timedelta(days=2), 2), ("A", "a", D + dt.timedelta(days=15), 3)]
    df = spark.createDataFrame(rows, "geo_id string, geo_name string, week_start_date date, cases long")
    assert [(r.week_start_date, r.cases) for r in panel.densify(df).orderBy("week_start_date").collect()] == [(week(0), 1), (week(1), None), (week(2), 3)]
    again = panel.densify(panel.densify(df))
    assert again.count() == 3


def test_dedupe_prefers_values(spark):
    df = spark.createDataFrame([("k", None, "x"), ("k", 2, "y"), ("k", 2, "a")], "k string, v long, s string")
    assert one(panel.dedupe(df, ["k"], ["v", "s"])).s == "a"
    assert one(panel.dedupe(df, ["k"], ["v", "s"], keep="last")).s == "y"
    assert one(panel.first_in_series(df, ["k"], ["v", "s"])).s == "a"


def test_panel_qc_lists_absent_series(spark):
    got = {r.check: r.n for r in panel.panel_qc(series(spark, [1, None, -2]), ["A", "B"]).collect()}
    assert got == {"null_weeks": 0, "null_values": 1, "negative_values": 1, "duplicate_keys": 0, "missing_A": 0, "missing_B": 1}


def test_second_write_keeps_the_first_track(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    for track in ("one", "two", "two"):
        sinks.save_predictions(spark.createDataFrame([(track, "m", 1.0)], "track string, model string, y_pred double"), path)
    assert sorted(r.track for r in spark.read.parquet(path).collect()) == ["one", "two"]


def test_fold_ids_are_data(spark, tmp_path):
    for fold in ("D1", "X1"):
        spark.createDataFrame([(1.0,)], "y_pred double").coalesce(1).write.parquet(f"{tmp_path}/t-{fold}")
        part = next(p for p in (tmp_path / f"t-{fold}").iterdir() if p.suffix == ".parquet")
        (tmp_path / f"m_{fold}.parquet").write_bytes(part.read_bytes())
    folder = tmp_path / "f"
    folder.mkdir()
    for fold in ("D1", "X1"):
        (folder / f"m_{fold}.parquet").write_bytes((tmp_path / f"m_{fold}.parquet").read_bytes())
    assert sorted(r.fold_id for r in artifacts.fold_union(spark, str(folder), "m").collect()) == ["D1", "X1"]


def test_covariate_files_with_other_layouts(spark, tmp_path):
    (tmp_path / "df_weather_weekly_khulna_division.csv").write_text("date,temperature_2m,extra\n2024-01-03,20.5,x\nbad,1,y\n")
    (tmp_path / "df_weather_weekly_sylhet_division.csv").write_text("week_start_date,total_precipitation,temperature_2m\n2024-01-08,3,\n")
    got = {r.geo_id: r for r in covariates.load_covariates(spark, str(tmp_path)).collect()}
    assert set(got) == {"KHU", "SYL"} and got["KHU"].week_start_date == D and got["KHU"].tmean == 20.5 and got["SYL"].rain == 3.0 and got["SYL"].tmean is None


def test_counts_from_a_wide_file(spark, tmp_path):
    (tmp_path / "c.csv").write_text("date,Khulna EW New Cases,Sylhet_EW_new_cases,other\n2024-01-03,3.7,-2,9\n2024-01-10,x,5,9\n")
    got = sorted((r.geo_id, r.week_start_date, r.cases) for r in counts.load_counts(spark, str(tmp_path / "c.csv")).collect())
    assert got == [("KHU", D, 3), ("SYL", D, 0), ("SYL", week(1), 5)]


def test_tail_mean_reaches_over_a_hole(spark):
    p = series(spark, [4, 8]).unionByName(series(spark, [0] * 9).filter(F.col("week_start_date") == week(8)))
    s = spark.createDataFrame([("A", week(3), week(4), 1)], "geo_id string, week_start_date date, target_week date, horizon int")
    assert one(naive.seasonal_naive_tail(s, p)).y_pred == 6.0


def test_features_on_edge_series(spark):
    out = {r.week_start_date: r for r in features.case_features(series(spark, [0, 0, 5, 0])).collect()}
    assert [out[week(i)].cases_zero_run_length for i in range(4)] == [1, 2, 0, 1]
    assert [out[week(i)].cases_weeks_since_nonzero for i in range(4)] == [1, 2, 0, 1]
    assert out[week(3)].cases_outbreak_flag_4_8 == 0 and out[week(1)].cases_rollmean_2 is None and out[week(2)].cases_rollmean_2 == 0


def test_short_series_keeps_its_row(spark):
    r = one(explore.seasonal_strength(series(spark, [1, 2, 3])))
    assert r.seasonal_strength is None


def test_consistency_rule_per_check(spark):
    wide = spark.createDataFrame([(10, 4, None), (10, 5, 5)], "t long, a long, b long")
    got = {r.check: r.max_abs_diff for r in hierarchy.consistency(wide, {"zero": ("t", ["a", "b"]), "skip": ("t", ["a", "b"])}, ("skip",)).collect()}
    assert got == {"zero": 6.0, "skip": 0.0}


def test_guardrail_notes_follow_settings(spark):
    from weeklane.config import Guardrail

    df = spark.createDataFrame([("F", 1, 50, 1.0, 2.0, True)], "fold_id string, horizon int, cases long, m double, m__raw double, m__guarded boolean")
    assert one(guardrail.guardrail_notes(df, "m", Guardrail(max_cases=1000))).guardrail_low_origin_rows == 1
    assert one(guardrail.guardrail_notes(df, "m")).guardrail_low_origin_rows == 0


@pytest.mark.parametrize("per_slice", [50_000, 7])
def test_quantiles_at_any_slice_size(spark, monkeypatch, per_slice):
    monkeypatch.setattr(quantiles, "PER_SLICE", per_slice)
    df = spark.range(101).select((F.col("id") % 2).alias("k"), F.when(F.col("id") == 100, None).otherwise(F.col("id") % 40).cast("double").alias("v"))
    got = {r.k: (r.a, r.b) for r in grouped_quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.9}).collect()}
    want = {r.k: (r.a, r.b) for r in df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("a"), F.percentile("v", F.lit(0.9)).alias("b")).collect()}
    assert {k: tuple(round(x, 9) for x in v) for k, v in got.items()} == {k: tuple(round(x, 9) for x in v) for k, v in want.items()}


def test_guardrail_reads_its_input_few_times(spark):
    rows = spark.range(50).select(F.lit("F").alias("fold_id"), F.lit(1).alias("horizon"), F.lit("A").alias("geo_id"), F.col("id").alias("cases"), F.col("id").cast("double").alias("y_true"))
    text = guardrail.low_origin_stats(rows).overall._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") <= 12


def test_correlation_skips_missing_by_pair(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, None if i else 1.0) for i in range(5)], "a double, b double, c double")
    assert [(r.feature_a, r.feature_b) for r in design.high_corr_pairs(df, ["a", "b", "c"]).collect()] == [("a", "b")]


def test_gap_fold_id():
    assert splits.next_fold_id(["1", "4"]) == "5" and splits.next_fold_id(["D1"]) == "gap"


def test_locf_stops(spark):
    df = series(spark, [1, 2, 3, 4]).withColumn("x", F.when(F.col("cases") < 3, F.col("cases")))
    got = [r.x for r in fill.locf_cap(df, ["x"], week(1), 1).orderBy("week_start_date").collect()]
    assert got == [1, 2, 2, None]


def test_weights_sum_to_one(spark):
    rows = [("t", "F", 1, m, e) for m, e in (("persistence", 9.0), ("a", 1.0), ("b", None))]
    w = stacking.stack_weights(spark.createDataFrame(rows, "track string, fold_id string, horizon int, model string, source_mae double"), Stack())
    got = {r.model: r.weight for r in w.collect()}
    assert math.isclose(sum(got.values()), 1) and math.isclose(got["persistence"], 0.45) and got["b"] == 0


def test_pair_ranks(spark):
    df = series(spark, [1, 2, 3, 4]).unionByName(series(spark, [4, 3, 2, 1], "B")).unionByName(series(spark, [1, 1, 1, 1], "C"))
    pairs = spark.createDataFrame([("A", "B"), ("A", "C")], "geo_a string, geo_b string")
    assert {(r.geo_a, r.geo_b): r.spearman and round(r.spearman, 9) for r in explore.pair_spearman(df, pairs).collect()} == {("A", "B"): -1.0, ("A", "C"): None}


def test_boosting_loss_falls(spark):
    rows = spark.range(400).select(F.lit("A").alias("fold_id"), F.lit(1).alias("horizon"), F.lit("g").alias("geo_id"), F.lit("train").alias("role"), (F.col("id") % 20).cast("double").alias("x"), F.floor((F.col("id") % 20) / 2).cast("double").alias("y_true"))
    known = settings(rows, ["x"])
    for loss in ("squared", "poisson", "tweedie"):
        m = fit_trees(known, None, TreeSpec(loss, 8, 0.3, 2, 5, power=1.3))
        own = m.trees[0]
        losses = []
        for k in range(1, 9):
            m.trees[0] = own[:k]
            losses.append(m.predict("p", known.rows).agg(F.avg(loss_of(loss, F.col("y_true"), F.col("p"), 1.3))).first()[0])
        assert all(b < a for a, b in zip(losses, losses[1:]))
        assert m.predict("p", known.rows).count() == 400


def loss_of(loss, y, mu, power):
    if loss == "squared":
        return (y - mu) * (y - mu)
    if loss == "poisson":
        return mu - y * F.log(mu)
    return F.pow(mu, 2 - power) / (2 - power) - y * F.pow(mu, 1 - power) / (1 - power)


def test_grouped_glm_learns_and_falls_back():
    import numpy as np

    r = np.random.default_rng(0)
    x = r.normal(size=(200, 1))
    y = r.poisson(np.exp(1 + 0.8 * x[:, 0])).astype(float)
    pred, how = grouped.predict_group(x, y, x, 0.001)
    assert how == "negative_binomial" and np.abs(pred - y).mean() < np.abs(y.mean() - y).mean()
    assert grouped.predict_group(x[:5], y[:5], x, 0.1)[1] == "mean"
    assert grouped.predict_group(np.zeros((30, 1)), np.zeros(30), np.zeros((2, 1)), 0.1)[0].max() < 1e-3
