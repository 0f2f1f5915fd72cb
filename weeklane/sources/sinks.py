"""Writing predictions, metric tables, stages and run records."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_predictions(predictions: DataFrame, path: str) -> None:
    """One directory per (track, model), so that reading one model prunes the others.

    Directories of other tracks and models stay.
    """
    writer = predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("track", "model").parquet(path)


def save_tables(tables: dict[str, DataFrame], folder: str, skip: tuple[str, ...] = ("predictions_scored",)) -> None:
    """Small report tables as CSV, one directory each; row-level tables are left out."""
    for name, df in tables.items():
        if name not in skip:
            df.write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/{name}")


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write a stage and go on from the written table: the lineage ends here and survives lost executors.

    ``path`` must be on storage that all executors share.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def save_bucketed(df: DataFrame, table: str, path: str, buckets: int, by: str = "geo_id", order: tuple[str, ...] = ("geo_id", "week_start_date")) -> DataFrame:
    """A table whose files are dealt by series and sorted by week: windows per series over it need no shuffle.

    ``path``: on storage that all executors share. A whole series is in one file, so it is bounded as a window is.
    """
    df.repartition(buckets, by).write.mode("overwrite").format("parquet").bucketBy(buckets, by).sortBy(*order).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def save_sample(df: DataFrame, path: str, n: int = 200, order: tuple[str, ...] = ("geo_id", "week_start_date")) -> None:
    df.orderBy(*order).limit(n).write.mode("overwrite").option("header", True).csv(path)


def save_records(df: DataFrame, path: str) -> None:
    """Nested run records, one JSON object per line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder that ``spark.checkpoint.dir`` names (a temporary one in local mode)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="weeklane-")
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` under the shared folder."""
    return materialize(df, shared_path(df.sparkSession, name))


def save_metric_files(metrics: DataFrame, folder: str) -> None:
    """One directory of CSV files per model and fold, named as ``metric_union`` reads them."""
    named = metrics.select(F.concat(F.lit("metrics_"), "model", F.lit("_"), "fold", F.lit(".csv")).alias("table"), "role", "horizon", "MAE", "RMSE")
    named.write.mode("overwrite").option("header", True).partitionBy("table").csv(folder)
