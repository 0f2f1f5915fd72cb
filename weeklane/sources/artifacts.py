"""Tables written by earlier runs: forecasts per fold, metric files, panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weeklane.functions.scalars import number
from weeklane.sources.counts import read_text_csv


def _fold_of(file_name: Column) -> Column:
    fold = F.regexp_extract(file_name, r"_([^_.]+)\.[^.]*$", 1)
    return F.when(fold != "", fold)


def load_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def fold_union(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """``{model}_*.parquet`` of a folder; the fold, any text, comes from the file name if no column says it."""
    files = spark.read.option("pathGlobFilter", f"{model}_*.parquet").parquet(folder)
    if "fold_id" not in files.columns:
        files = files.select("*", _fold_of(F.col("_metadata.file_name")).alias("fold_id"))
    return files.withColumn("model", F.lit(model))


def metric_union(spark: SparkSession, folder: str, models: list[str]) -> DataFrame:
    """``metrics_{model}_*.csv`` of a folder, files or directories of parts, as (model, fold, role, horizon, MAE, RMSE)."""
    wanted = "*metrics_{" + ",".join(models) + "}_*.csv"
    rows = read_text_csv(spark, f"{folder.rstrip('/')}/{wanted}")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"metrics_([^/]+)\.csv", 1)
    return rows.select(
        F.regexp_extract(name, r"^(.+)_[^_]+$", 1).alias("model"),
        F.regexp_extract(name, r"_([^_]+)$", 1).alias("fold"),
        "role",
        number("horizon").cast("int").alias("horizon"),
        number("MAE").alias("MAE"),
        number("RMSE").alias("RMSE"),
    )
