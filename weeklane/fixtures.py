"""A weekly panel and everything built on it, from the order tables.

Series: nations; value: orders per week; covariates: line items shipped per supplier nation.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weeklane.config import GEO, NAME, VALUE, WEEK, Fold, Hierarchy, Stack
from weeklane.functions.scalars import monday
from weeklane.models import runner
from weeklane.models.fits import TRAINED
from weeklane.operators import features, guardrail, metrics, naive, panel, regimes, splits, stacking
from weeklane.sources.sinks import save_bucketed, shared_path, staged

HORIZONS = (1, 2, 3, 4)
FOLDS = (
    Fold("D1", dt.date(1998, 6, 30), dt.date(1998, 12, 31)),
    Fold("D2", dt.date(1998, 12, 31), dt.date(1999, 6, 30)),
    Fold("D3", dt.date(1999, 6, 30), dt.date(1999, 12, 31)),
    Fold("D4", dt.date(1999, 12, 31), dt.date(2000, 6, 30)),
    Fold("S1", dt.date(2000, 6, 30), dt.date(2000, 12, 31), "selection"),
    Fold("X1", dt.date(2000, 12, 31), dt.date(2001, 7, 30), "holdout"),
)
MODELS = ["persistence", "seasonal_naive_52", "tail_mean_4", "previous_mean_4"]
COVS = ["rain", "tmean", "humidity", "dewpoint", "soil_moist_0_7cm"]
GAP_FROM = dt.date(2001, 5, 14)  # covariates end before the counts do
STACK = Stack(base_models=tuple(MODELS))
OVERLAP = Hierarchy("ASIA", "NATION_12", "ASIA_EX", "Asia without one nation")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_by_nation(spark: SparkSession, sf_dir: str, by: str = "n_name") -> DataFrame:
    """(geo_id, geo_name, week, cases) where there are orders; by n_name or r_name."""
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    per_key = rows.groupBy("c_nationkey", monday("o_orderdate").alias(WEEK)).agg(F.count(F.lit(1)).alias("n"))
    named = per_key.join(nation.select("n_nationkey", F.col(by).alias(GEO)), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy(GEO, WEEK).agg(F.sum("n").alias(VALUE)).select(GEO, F.col(GEO).alias(NAME), WEEK, VALUE)


def counts(spark: SparkSession, sf_dir: str, by: str = "n_name") -> DataFrame:
    """Every series in every week of the table, 0 where there are no orders."""
    return densified(orders_by_nation(spark, sf_dir, by))


def densified(weeks: DataFrame) -> DataFrame:
    return panel.densify(weeks, span="table", fill={VALUE: 0})


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    items = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = items.join(supplier.select("s_suppkey", F.col("n_name").alias(GEO)), F.col("l_suppkey") == F.col("s_suppkey"))
    def mean(c: str, scale: float):
        """Of whole hundredths, so that the sum is exact in any order."""
        return F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / F.count(c) / F.lit(scale)

    means = {"tmean": mean("l_extendedprice", 100_000.0), "humidity": mean("l_discount", 1.0), "dewpoint": mean("l_tax", 1.0), "soil_moist_0_7cm": mean("l_quantity", 100.0)}
    return rows.groupBy(GEO, monday("l_shipdate").alias(WEEK)).agg(
        F.sum("l_quantity").cast("double").alias("rain"), *[x.alias(c) for c, x in means.items()]
    ).withColumn(NAME, F.col(GEO))


def full_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.build_panel(counts(spark, sf_dir), covariates(spark, sf_dir))


def gap_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel whose covariates end early, for the operators that look at the gap."""
    late = F.col(WEEK) > F.lit(GAP_FROM)
    return full_panel(spark, sf_dir).withColumns({c: F.when(~late, F.col(c)) for c in COVS})


def feature_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_panel(counts(spark, sf_dir), "operational")


def fold_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.rolling_origin_splits(feature_panel(spark, sf_dir), HORIZONS, FOLDS, unique=True)


def stored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts as a written table, a row per series and week: the orders are read once, however often it is used."""
    return staged(densified(staged(orders_by_nation(spark, sf_dir), "orders")), "counts")


def supervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.supervised_from_panel(stored_counts(spark, sf_dir), "operational", HORIZONS, FOLDS)


def wide_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive.naive_columns(supervised(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wide_predictions(spark, sf_dir)
    return naive.to_long(rows, MODELS, splits.identity_columns(rows), naive.NAIVE_STATUS)


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.regime_flags(predictions(spark, sf_dir).filter(F.col("role") == "val"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro_tables(predictions(spark, sf_dir))


def macro_level(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    return macro(spark, sf_dir).filter(F.col("level") == level)


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacking.stack_weights(stacking.lofo_mae(predictions(spark, sf_dir), MODELS), STACK)


def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacking.conservative_stack(wide_predictions(spark, sf_dir), weights(spark, sf_dir).drop("track"), MODELS)


def region_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region as a parent that overlaps with one of its nations, and the other nations."""
    nations = counts(spark, sf_dir)
    whole = counts(spark, sf_dir, "r_name").filter(F.col(GEO) == OVERLAP.parent)
    return nations.unionByName(whole)


def bucketed_counts(spark: SparkSession, sf_dir: str, buckets: int = 8) -> DataFrame:
    """The counts as a bucketed table of its own name, in the shared folder."""
    path = shared_path(spark, "panel")
    return save_bucketed(counts(spark, sf_dir), "weeklane_" + path.rsplit("-", 1)[1], path, buckets)


def wide_count_files(spark: SparkSession, sf_dir: str) -> tuple[list[str], dict[str, tuple[str, str]]]:
    """(folders of CSV files, node of each header): the counts as a wide table of text, as such files come.

    Every seventh value has a fraction, is negative or unreadable; a folder of its own holds the first
    line of each year without its last field.
    """
    rows = counts(spark, sf_dir)
    names = [r[0] for r in rows.select(GEO).distinct().orderBy(GEO).collect()]  # columns of the table
    kind, whole = F.col(VALUE) % 7, F.col(VALUE).cast("string")
    text = F.when(kind == 1, F.concat(F.lit("-"), whole)).when(kind == 2, "n/a").when(kind == 3, F.concat(whole, F.lit(".9"))).otherwise(whole)
    wide = rows.select(F.date_format(WEEK, "yyyy-MM-dd").alias("date"), GEO, text.alias("t")).groupBy("date").pivot(GEO, names).agg(F.first("t"))
    headers = {n: n.lower() for n in names}
    wide = staged(wide.select("date", *[F.col(n).alias(h) for n, h in headers.items()]), "wide")
    folders = [shared_path(spark, "counts"), shared_path(spark, "broken")]
    wide.write.option("header", True).csv(folders[0])
    first = wide.groupBy(F.substring("date", 1, 4)).agg(F.min("date").alias("date")).select("date")
    short = wide.join(first, "date").select(F.concat_ws(",", "date", *list(headers.values())[:-1]).alias("value"))
    heading = spark.createDataFrame([(",".join(["date", *headers.values()]),)], "value string")
    heading.unionByName(short).coalesce(1).write.text(folders[1])  # a line a year, after the header
    return folders, {h: (n, n) for n, h in headers.items()}


_backtests: dict[tuple[str, str], list[DataFrame]] = {}


def backtest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(long predictions, fit notes, models) of all trained models over all folds and horizons, as written tables.

    Reports of one session share the tables, as reports share a backtest's folder; they are made anew
    where their files are gone.
    """
    key = spark.sparkContext.applicationId, sf_dir
    try:
        for t in _backtests.get(key, []):
            t.limit(1).collect()
    except Exception:  # the folder was cleaned
        _backtests.pop(key)
    if key not in _backtests:
        predictions, notes, models = runner.run_track(supervised(spark, sf_dir), list(TRAINED))
        _backtests[key] = [staged(predictions, "predictions"), staged(notes, "notes"), staged(models.table(spark), "models")]
    return tuple(_backtests[key])


def every_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long predictions of the naive and the trained models of the track."""
    return predictions(spark, sf_dir).filter(F.col("model").isin(MODELS[:2])).unionByName(backtest(spark, sf_dir)[0], allowMissingColumns=True)


def trained_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stack of persistence and the trained models, behind the low-origin rule."""
    rows = every_prediction(spark, sf_dir)
    base = list(Stack().base_models)
    table = stacking.stack_weights(stacking.lofo_mae(rows, base), Stack()).drop("track")
    own = supervised(spark, sf_dir)
    keys = [GEO, WEEK, "horizon", "fold_id"]
    wide = own.join(stacking.pivot_models(rows.filter(F.col("model").isin(base)), base, keys), keys)
    out = stacking.conservative_stack(wide, table, base)
    return guardrail.apply_guardrail(out, guardrail.low_origin_stats(own.filter("role = 'train'")), ["conservative_stack"])
