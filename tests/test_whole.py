"""Registered queries cover every horizon and fold."""

import __spark_entry__
from pyspark.sql import functions as F

from weeklane import fixtures as fx
from weeklane.models.fits import TRAINED
from weeklane.operators import explore, features

SF = "/root/testdata/sf0.001"


def test_live_ridge_has_all_horizons(spark):
    found = __spark_entry__.queries()["poisson_ridge_live"](spark, SF)
    assert {r.horizon for r in found.select("horizon").distinct().collect()} == set(fx.HORIZONS)


def test_grouped_glm_has_all_folds(spark):
    found = __spark_entry__.queries()["grouped_nb_glm"](spark, SF)
    folds = {r.fold_id for r in fx.supervised(spark, SF).where("role = 'val'").select("fold_id").distinct().collect()}
    assert {r.fold_id for r in found.select("fold_id").distinct().collect()} == folds


def test_windows_over_a_bucketed_table_need_no_shuffle(spark):
    out = features.case_features(fx.bucketed_counts(spark, SF))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == fx.counts(spark, SF).count()


def test_the_backtest_has_every_model_fold_and_horizon(spark):
    predictions, notes, models = fx.backtest(spark, SF)
    settings = fx.supervised(spark, SF).select("fold_id", "horizon").distinct().count()
    assert predictions.select("model", "fold_id", "horizon").distinct().count() == settings * len(TRAINED) == notes.count()
    assert predictions.filter("y_pred IS NULL OR y_pred < 0 OR isnan(y_pred)").isEmpty()
    assert {r.model for r in models.filter("model <> ''").select("model").distinct().collect()} == set(TRAINED)
    assert fx.backtest(spark, SF)[0] is predictions  # written once a session


def test_candidates_of_partners_follow_the_series(spark):
    """Two waves, their mirror image and noise: the strongest partners are found among few candidates."""
    weeks = spark.range(60).select(F.col("id").alias("k"), F.expr("date_add(date '2024-01-01', CAST(7 * id AS INT))").alias("week_start_date"))
    wave = F.when(F.col("s") % 3 == 0, F.sin(F.col("k") / 5 + F.floor(F.col("s") / 60))).when(F.col("s") % 3 == 1, -F.sin(F.col("k") / 5 + F.floor(F.col("s") / 60))).otherwise(F.rand(3))
    panel = weeks.crossJoin(spark.range(300).select(F.col("id").alias("s"))).select(F.format_string("g%03d", "s").alias("geo_id"), "week_start_date", (wave + F.rand(7) / 10).alias("cases"))
    pairs = explore.partner_candidates(panel, tables=12, near=4)
    assert 0 < pairs.count() <= 300 * 12 * 4 * 2
    best = explore.strongest_partners(panel, top=1, tables=12, near=4).collect()
    waves = [r for r in best if int(r.geo_id[1:]) % 3 < 2]
    assert len(waves) == 200 and all(abs(r.spearman) > 0.9 for r in waves)


def test_the_backtest_reads_the_orders_once(spark):
    """What the models are fitted and scored from is a written panel, not the order tables."""
    assert all("orders" not in f for f in fx.supervised(spark, SF).inputFiles())
