"""Rows of a vector column that can be computed with, and their matrix."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vec: Column) -> Column:
    """Neither null nor with a component that is null, NaN or infinite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(False))


def common_length(df: DataFrame, vec_col: str) -> int:
    """The length that most vectors have (of several, the longest); 0 without any vector."""
    top = df.groupBy(F.size(vec_col).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return top["n"] if top else 0


def matrix(column: pa.Array, dim: int, dtype) -> np.ndarray:
    """Lists of dim numbers without nulls as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, dim)
