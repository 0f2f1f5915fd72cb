"""Diagnostics of a design matrix. Features are columns, so their number is bounded by the schema."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def nb_dispersion(df: DataFrame, keys: list[str], y: str = "y_true") -> DataFrame:
    """Moment estimate of the NB2 dispersion: at least 1e-6, and 1 where the mean is not positive."""
    m, v = F.avg(F.col(y)), F.var_pop(F.col(y))
    raw = F.greatest((v - m) / (m * m + 1e-12), F.lit(1e-6))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.when(m <= 0, 1.0).otherwise(raw).alias("nb_alpha")
    )


def design_moments(df: DataFrame, y: str = "y_true", by: tuple[str, ...] = ()) -> DataFrame:
    c = F.col(y).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(c).alias("y_mean"),
        F.var_pop(c).alias("y_var"),
        F.min(c).alias("y_min"),
        F.max(c).alias("y_max"),
        F.avg((c == 0).cast("double")).alias("prop_y_zero"),
    )


SALTS = 16  # parts of a group's sums


def pair_sums(df: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """Per group, sums over the rows that have both of two features: rows, x, x*x and x*y of each pair, as four blocks of one array.

    One pass whatever the number of features: a task folds its rows to products of matrices, and only
    these are shuffled. Values are taken about the table's mean, so that sums of squares keep their digits.
    """
    values = [F.col(f).cast("double") for f in features]
    middle = np.array([v or 0.0 for v in df.agg(*[F.avg(F.when(~F.isnan(v), v)) for v in values]).first()])
    p = len(features)
    nan = F.lit(float("nan"))
    rows = df.select(*by, F.array(*[F.coalesce(v, nan) for v in values]).alias("_x"))
    keys = [rows.schema[c] for c in by]
    schema = T.StructType([*keys, T.StructField("_salt", T.IntegerType()), T.StructField("_v", T.ArrayType(T.DoubleType()))])

    def folded(x: np.ndarray) -> np.ndarray:
        known = ~np.isnan(x)
        z, m = np.where(known, x - middle, 0.0), known.astype(float)
        return np.stack([m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z])

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            x = batch.column(len(by)).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            own = pa.table(batch.columns[: len(by)], by).append_column("_at", pa.array(np.arange(len(x))))
            for g in own.group_by(by).aggregate([("_at", "list")]).to_pylist():
                key = tuple(g[c] for c in by)
                part = folded(x[g["_at_list"]])
                total[key] = total[key] + part if key in total else part
        salt = TaskContext.get().partitionId() % SALTS
        out = list(total.items())
        yield pa.RecordBatch.from_arrays(
            [*[pa.array([k[i] for k, _ in out], t) for i, t in enumerate(types)], pa.array([salt] * len(out), pa.int32()), pa.array([v.ravel() for _, v in out], pa.list_(pa.float64()))], schema.names
        )

    def add(table: pa.Table) -> pa.Table:
        one = table.slice(0, 1)
        return pa.table([*[one[c] for c in [*by, "_salt"]], pa.array([np.stack(table["_v"].to_pylist()).sum(0)], pa.list_(pa.float64()))], schema.names)

    types = to_arrow_schema(T.StructType(keys)).types
    parts = rows.mapInArrow(run, schema).groupBy(*by, "_salt").applyInArrow(add, schema)
    return parts.groupBy(*by).applyInArrow(add, schema).drop("_salt")


def correlations(df: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """(group, feature_a, feature_b, n, r) of all pairs, a feature with itself included; r is null where either doesn't vary."""
    p = len(features)
    sums = pair_sums(df, features, by)
    schema = T.StructType([*[sums.schema[c] for c in by], T.StructField("feature_a", T.StringType()), T.StructField("feature_b", T.StringType()), T.StructField("n", T.LongType()), T.StructField("r", T.DoubleType())])

    def table(batches):
        for batch in batches:
            for k, v in enumerate(batch.column(len(by)).to_pylist()):
                n, s, q, xy = np.array(v).reshape(4, p, p)
                with np.errstate(divide="ignore", invalid="ignore"):
                    var = q - s * s / n
                    r = (xy - s * s.T / n) / np.sqrt(var * var.T)
                flat = (var <= 1e-12 * np.maximum(q, 1e-300)) | (n < 2)
                r = np.where(flat | flat.T, np.nan, np.clip(r, -1.0, 1.0))
                i, j = np.triu_indices(p)
                names = np.array(features, object)
                keys = [pa.array([batch.column(c)[k].as_py()] * len(i), batch.column(c).type) for c in range(len(by))]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(names[i]), pa.array(names[j]), pa.array(n[i, j].astype(np.int64)), pa.array(r[i, j], from_pandas=True)], schema.names)

    return sums.select(*by, "_v").mapInArrow(table, schema)


def feature_spread(df: DataFrame, features: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (group, feature, std): one pass, then each group's row is turned."""
    one = df.groupBy(*by).agg(*[F.stddev_pop(F.col(f).cast("double")).alias(f) for f in features])
    return one.unpivot(list(by), features, "feature", "std")


def constant_columns(df: DataFrame, features: list[str], eps: float = 1e-12, by: tuple[str, ...] = ()) -> DataFrame:
    return feature_spread(df, features, by).filter(F.col("std") <= eps)


def quasi_separation(df: DataFrame, features: list[str], y: str = "y_true", by: tuple[str, ...] = ()) -> DataFrame:
    """Features with few levels (at most five) whose zeros, or non-zeros, never meet a positive target.

    Levels are folded to (feature, level) counts before the shuffle; a feature
    with many levels is spread over as many keys.
    """
    entries = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]
    )
    pos = (F.col(y) > 0).cast("long")
    long = df.select(*by, F.col(y), F.inline(entries)).filter(F.col("x").isNotNull())
    few = long.groupBy(*by, "feature").agg(F.approx_count_distinct("x").alias("n")).filter(F.col("n") <= 10)  # levels that may be five
    levels = long.join(few.select(*by, "feature"), [*by, "feature"], "left_semi").groupBy(*by, "feature", "x").agg(F.sum(pos).alias("pos"))
    stats = levels.groupBy(*by, "feature").agg(
        F.count(F.lit(1)).alias("levels"),
        F.coalesce(F.sum(F.when(F.col("x") == 0, F.col("pos"))), F.lit(0)).alias("pos_at_zero"),
        F.coalesce(F.sum(F.when(F.col("x") != 0, F.col("pos"))), F.lit(0)).alias("pos_elsewhere"),
    )
    a, b = F.col("pos_at_zero"), F.col("pos_elsewhere")
    return stats.filter((F.col("levels") > 1) & (F.col("levels") <= 5) & (((a == 0) & (b > 0)) | ((b == 0) & (a > 0))))


def high_corr_pairs(df: DataFrame, features: list[str], threshold: float = 0.995, top: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """All pairs above the threshold (or the ``top`` strongest of each group); constant columns do not take part."""
    strong = F.round(F.abs("r"), 9)
    pairs = grouped(df, features, by).filter((F.col("feature_a") != F.col("feature_b")) & (F.abs("r") > threshold)).drop("n")
    if top is not None:
        order = Window.partitionBy(*(by or ["_all"])).orderBy(strong.desc(), "feature_a", "feature_b")
        pairs = pairs.withColumn("_all", F.lit(1)).withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= top).drop("_k", "_all")
    return pairs


def grouped(df: DataFrame, features: list[str], by: tuple[str, ...]) -> DataFrame:
    if by:
        return correlations(df, features, list(by))
    return correlations(df.withColumn("_all", F.lit(1)), features, ["_all"]).drop("_all")


def corr_condition(df: DataFrame, features: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Condition number of each group's feature correlation matrix (non-constant columns)."""
    rows = df if by else df.withColumn("_all", F.lit(1))
    keys = list(by) or ["_all"]
    table = correlations(rows, features, keys)
    schema = T.StructType([*[table.schema[c] for c in keys], T.StructField("n_features", T.IntegerType()), T.StructField("cond_number_corr", T.DoubleType())])

    def condition(own: pa.Table) -> pa.Table:
        at = {f: k for k, f in enumerate(features)}
        m = np.zeros((len(features), len(features)))
        for a, b, r in zip(own["feature_a"].to_pylist(), own["feature_b"].to_pylist(), own["r"].to_pylist(), strict=True):
            m[at[a], at[b]] = m[at[b], at[a]] = r or 0.0
        keep = np.diag(m) > 0
        m = m[np.ix_(keep, keep)]
        cond = float(np.linalg.cond(m + 1e-10 * np.eye(len(m)))) if len(m) >= 2 else None
        return pa.table([*[own[c].slice(0, 1) for c in keys], pa.array([int(keep.sum())], pa.int32()), pa.array([cond], pa.float64())], schema.names)

    out = table.groupBy(*keys).applyInArrow(condition, schema)
    return out if by else out.drop("_all")
