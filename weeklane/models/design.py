"""Scores and fillings of feature columns by training statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weeklane.functions.scalars import clip

LIMIT = 6.0  # of a z-score


def zscore_fit(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """(mean, sample deviation) per column that varies; one row, bounded by the schema."""
    row = train.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns if row[f"s_{c}"]}


def zscore_apply(df: DataFrame, stats: dict[str, tuple[float, float]], prefix: str = "") -> DataFrame:
    """Scores of another table by the train statistics, within +-6; missing is 0."""

    def score(c: str) -> Column:
        mean, std = stats[c]
        return F.coalesce(clip((F.col(c).cast("double") - mean) / std, -LIMIT, LIMIT), F.lit(0.0))

    return df.withColumns({f"{prefix}{c}": score(c) for c in stats})


def zscore_by(df: DataFrame, columns: list[str], by: tuple[str, ...], prefix: str = "") -> DataFrame:
    """Scores of all rows by the training statistics of their setting, within +-6; missing is 0, as is a column that doesn't vary."""
    train = df.filter(F.col("role") == "train")
    stats = train.groupBy(*by).agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_d_{c}"))])

    def score(c: str) -> Column:
        z = F.when(F.col(f"_d_{c}") > 0, (F.col(c).cast("double") - F.col(f"_m_{c}")) / F.col(f"_d_{c}"))
        return F.coalesce(clip(z, -LIMIT, LIMIT), F.lit(0.0))

    return df.join(stats, list(by), "left").withColumns({f"{prefix}{c}": score(c) for c in columns}).drop(*[f"_{x}_{c}" for c in columns for x in "md"])


def fill_constant(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    """Missing and NaN features become a constant."""
    return df.withColumns({c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(value)).otherwise(F.col(c).cast("double")) for c in columns})
