"""All settings of a backtest (fold, horizon, ...) as one table that every model is fitted from.

A setting is numbered; its training rows give its medians, means and bin edges in one aggregation for
all settings together. What the driver holds is bounded by settings x features and by the series.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weeklane.config import GEO
from weeklane.sources.sinks import staged

BINS = 255
ACCURACY = 10_000  # of approximate quantiles; exact for settings of as many rows
HELPERS = ("_s", "_row", "_train", "_x", "_c", "_y", "_base")


@dataclass
class Settings:
    """rows: their own columns, and _s (setting), _row, _train, _x (features; NaN if missing), _c (series number), _y, _base."""

    rows: DataFrame
    own: list[str]
    by: tuple[str, ...]
    keys: list[tuple]
    features: list[str]
    series: list[str]
    sizes: np.ndarray  # training rows
    means: np.ndarray  # of the training target; 0 without rows
    medians: np.ndarray  # settings x features; 0 without values
    edges: list[list[np.ndarray]]  # a row is in bin k of a feature if k of its edges are below its value

    def codes(self, s: int, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Bin numbers by feature, the series number in the last column; missing values at the median."""
        out = np.empty((len(x), len(self.features) + 1), np.int32)
        for f, edges in enumerate(self.edges[s]):
            v = x[:, f]
            out[:, f] = np.searchsorted(edges, np.where(np.isnan(v), self.medians[s][f], v))
        out[:, -1] = c
        return out

    def widths(self, s: int) -> np.ndarray:
        return np.array([*(len(e) + 1 for e in self.edges[s]), len(self.series) + 1], np.int64)


def features_of(column: pa.Array, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), n)


def numbered(rows: DataFrame, features: list[str], by: tuple[str, ...], keys: list[tuple], series: list[str], base: str | None = None) -> DataFrame:
    """rows with the helper columns; settings and series that aren't listed are left out and number len(series)."""
    spark, own = rows.sparkSession, rows.columns
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    listed = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], f"{schema}, _s int")
    places = spark.createDataFrame([(g, i) for i, g in enumerate(series)], f"{GEO} string, _c int")
    train = F.col("role") == "train" if "role" in own else F.lit(True)
    y = F.col("y_true").cast("double") if "y_true" in own else F.lit(None).cast("double")
    nan = F.lit(float("nan"))
    return (
        rows.withColumn("_row", F.monotonically_increasing_id())
        .join(F.broadcast(listed), list(by))
        .join(F.broadcast(places), GEO, "left")
        .select(
            *own, "_s", "_row", train.alias("_train"), F.array(*[F.coalesce(F.col(f).cast("double"), nan) for f in features]).cast("array<double>").alias("_x"),
            F.coalesce("_c", F.lit(len(series))).alias("_c"), y.alias("_y"), (F.col(base).cast("double") if base else F.lit(0.0)).alias("_base"),
        )
    )


def settings(supervised: DataFrame, features: list[str], by: tuple[str, ...] = ("fold_id", "horizon"), base: str | None = None, bins: int = BINS) -> Settings:
    """Writes the table and takes the statistics of each setting's training rows.

    Rows without a target are no training rows. The series are collected, as an indexer does.
    """
    table = staged(supervised, "supervised")
    keys = [tuple(r) for r in table.select(*by).distinct().orderBy(*by).collect()]
    known = table.filter(F.col("role") == "train") if "role" in table.columns else table
    series = [r[0] for r in known.select(GEO).distinct().orderBy(GEO).collect() if r[0] is not None]
    rows = staged(numbered(table, features, by, keys, series, base), "settings")
    cuts = [k / bins for k in range(1, bins)]
    train = rows.filter(F.col("_train") & F.col("_y").isNotNull())
    values = [F.when(~F.isnan(F.col("_x")[i]), F.col("_x")[i]) for i in range(len(features))]
    found = train.groupBy("_s").agg(
        F.count("*").alias("n"), F.avg("_y").alias("m"),
        *[F.percentile_approx(v, [0.5, *cuts], ACCURACY).alias(f"q{i}") for i, v in enumerate(values)],
    )
    stats = {r["_s"]: r for r in found.collect()}
    sizes, means = np.zeros(len(keys), np.int64), np.zeros(len(keys))
    medians, edges = np.zeros((len(keys), len(features))), []
    for s in range(len(keys)):
        r = stats.get(s)
        if r:
            sizes[s], means[s] = r["n"], r["m"]
        q = [r[f"q{i}"] if r else None for i in range(len(features))]
        medians[s] = [v[0] if v else 0.0 for v in q]
        edges.append([np.unique(v[1:]) if v else np.zeros(0) for v in q])
    return Settings(rows, supervised.columns, by, keys, features, series, sizes, means, medians, edges)
