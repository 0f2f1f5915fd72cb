"""Covariate files, one per node, with differing headers."""

from __future__ import annotations

import csv
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weeklane.config import COVARIATE_FILES, COVARIATE_HEADERS, COVARIATES, GEO, NAME, WEEK
from weeklane.functions.scalars import monday, normalize_name, number, parse_day


def _date_column(columns: list[str]) -> str | None:
    return next((c for c in columns if "week_start" in c.lower() or c.lower() == "date"), None)


def _node(stem: Column, nodes: Mapping[str, tuple[str, str]], at: int) -> Column:
    out = F.lit(None).cast("string")
    for fragment, meta in reversed(list(nodes.items())):
        out = F.when(F.contains(stem, F.lit(fragment)), F.lit(meta[at])).otherwise(out)
    return out


def tidy_covariates(
    wide: DataFrame, stem: Column, nodes: Mapping[str, tuple[str, str]] = COVARIATE_FILES
) -> DataFrame:
    """One layout to panel columns: node from the file name, known headers renamed, the rest dropped."""
    day = _date_column(wide.columns)
    if day is None:
        raise ValueError(f"no week or date column among {wide.columns}")
    names = {c: COVARIATE_HEADERS.get(c, c) for c in wide.columns}
    kept = {n: c for c, n in names.items() if n in COVARIATES}
    s = normalize_name(stem)
    out = wide.select(
        _node(s, nodes, 0).alias(GEO),
        _node(s, nodes, 1).alias(NAME),
        monday(parse_day(day)).alias(WEEK),
        *[number(c).alias(n) for n, c in sorted(kept.items())],
    )
    return out.filter(F.col(GEO).isNotNull() & F.col(WEEK).isNotNull())


def load_covariates(
    spark: SparkSession,
    folder: str,
    pattern: str = "df_weather_weekly_*.csv",
    nodes: Mapping[str, tuple[str, str]] = COVARIATE_FILES,
) -> DataFrame:
    """All files of a folder. Files of one layout are read together; layouts are united by name.

    Only the distinct header lines come to the driver. A file's header is its first line, whole;
    lines are read as text and parsed by the header of their file.
    """
    lines = spark.read.option("pathGlobFilter", pattern).text(folder).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_name").alias("_name"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at")
    )
    heads = lines.filter(F.col("_start") == 0).groupBy("_file").agg(F.min_by("value", "_at").alias("_head"))
    layouts = [r["_head"] for r in heads.select("_head").distinct().orderBy("_head").collect()]
    if not layouts:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    rows = lines.join(heads, "_file").filter(F.col("value") != F.col("_head"))
    parts = []
    for head in layouts:
        names = [n.strip() for n in next(csv.reader([head.lstrip("\ufeff")]))]
        schema = ", ".join(f"`{n.replace('`', '')}` string" for n in names)
        own = rows.filter(F.col("_head") == head).select("_name", F.from_csv("value", F.lit(schema)).alias("_r"))
        wide = own.select("_name", "_r.*")
        parts.append(tidy_covariates(wide, F.regexp_replace(F.col("_name"), r"\.[^.]*$", ""), nodes))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select(GEO, NAME, WEEK, *[c for c in COVARIATES if c in out.columns])
