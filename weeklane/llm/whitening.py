"""Whitening of embeddings, with covariances by polarisation.

Components become whole numbers x. Sums of squares are taken of each dimension and of each sum of
two dimensions, all centred; as var(a + b) = var(a) + var(b) + 2 cov(a, b), differences of these
variances are the covariances. Everything up to the covariances is whole numbers, so it is exact
whatever the order of the sums: tasks centre on the rounded mean, the rest of the mean is taken off
in the driver's unbounded integers. A task sends D (D + 1) / 2 sums, in limbs of 32 bits that Spark
adds up, so what reaches the driver depends on the dimensions alone. The eigenvectors of that one
D x D matrix whiten all rows where they lie; no row is shuffled.

Rows take no part if their vector is null, holds null, NaN or infinite components, or isn't of
the length that most vectors have. Repeated ids and vectors are rows of their own; a null id stays.
A component whose eigenvalue is zero up to rounding can't be scaled: its whitened value is null,
and it doesn't count for the identity. Without rows the result is empty.
"""

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weeklane.llm.common import cut
from weeklane.llm.vectors import common_length, finite, matrix

FAR = float(1 << 61)  # scaled components stay within it, so that differences fit 64 bits
CELLS = 1 << 22  # of a block that is computed at once
LIMB = 32
DIGITS = 10**38  # of a decimal


def whole(block: np.ndarray, scale: float, shift: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * block), -FAR, FAR).astype(np.int64) + shift


def blocks(batches, dim: int, scale: float, shift: int):
    """(place, matrix of whole numbers) of the vectors, the last column of each batch."""
    step = max(1, CELLS // dim)
    for batch in batches:
        x = whole(matrix(batch.columns[-1], dim, np.float64), scale, shift)
        for at in range(0, len(x), step):
            yield batch.slice(at, step), x[at : at + step]


def fits(x: np.ndarray, times: int, power: int) -> bool:
    """times sums of the given power of x stay below 2**62."""
    return times * int(np.abs(x).max(initial=0)) ** power < 1 << 62


def limbs(sums: dict[tuple, int]) -> pa.RecordBatch:
    """Whole numbers of any size, by key, as signed limbs."""
    out = []
    for key, v in sums.items():
        sign, v, k = (1 if v >= 0 else -1), abs(v), 0
        while v:
            out.append((*key, k, sign * (v & ((1 << LIMB) - 1))))
            v, k = v >> LIMB, k + 1
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["i", "j", "limb", "part"])


def added(parts: DataFrame) -> dict[tuple, int]:
    """The sums by (i, j); as many rows as there are pairs of dimensions."""
    out: dict[tuple, int] = {}
    for r in parts.groupBy("i", "j", "limb").agg(F.sum("part").alias("part")).collect():
        out[r["i"], r["j"]] = out.get((r["i"], r["j"]), 0) + (r["part"] << LIMB * r["limb"])
    return out


LIMBS = "i int, j int, limb int, part long"


def dimension_sums(rows: DataFrame, dim: int, scale: float, shift: int) -> tuple[int, list[int]]:
    """(rows, exact sum of each dimension)."""

    def run(batches):
        n, total = 0, np.zeros(dim, object)
        for _, x in blocks(batches, dim, scale, shift):
            n += len(x)
            total = total + (x.sum(0) if fits(x, len(x), 1) else x.astype(object).sum(0))
        yield limbs({(-1, -1): n} | {(i, i): int(v) for i, v in enumerate(total)})

    sums = added(rows.mapInArrow(run, LIMBS))
    return sums.get((-1, -1), 0), [sums.get((i, i), 0) for i in range(dim)]


def square_sums(rows: DataFrame, middle: np.ndarray, scale: float, shift: int) -> dict[tuple, int]:
    """Exact sums of squares of each centred dimension (i, i) and each sum of two (i < j)."""
    dim = len(middle)

    def run(batches):
        total = [np.zeros(dim - i, object) for i in range(dim)]
        for _, x in blocks(batches, dim, scale, shift):
            d = x - middle
            d = np.ascontiguousarray((d if fits(d, 4 * len(d), 2) else d.astype(object)).T)
            for i in range(dim):
                pair = d[i + 1 :] + d[i]
                total[i][0] += int((d[i] * d[i]).sum())
                total[i][1:] += (pair * pair).sum(1)
        yield limbs({(i, i + k): int(v) for i in range(dim) for k, v in enumerate(total[i])})

    sums = added(rows.mapInArrow(run, LIMBS))
    return {(i, j): sums.get((i, j), 0) for i in range(dim) for j in range(i, dim)}


@dataclass
class Whitening:
    """n rows; their sums by dimension; variances (falling) and unit vectors (columns) of the components."""

    n: int
    sums: list[int]
    variances: np.ndarray
    vectors: np.ndarray
    total: float  # variance over all dimensions

    @property
    def scaled(self) -> np.ndarray:
        """Components whose variance isn't zero up to rounding."""
        return self.variances > self.total * len(self.sums) * np.finfo(float).eps

    @property
    def explained(self) -> list[float | None]:
        return [float(e) / self.total if self.total > 0 else None for e in self.variances]


def covariance(n: int, sums: list[int], middle: list[int], squares: dict[tuple, int]) -> tuple[np.ndarray, float]:
    """(covariance matrix, its trace), rounded once from whole numbers."""
    dim = len(sums)
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]

    def var(i: int, j: int) -> int:
        """n**2 times the variance of dimension i, or of the sum of i and j."""
        r = rest[i] if i == j else rest[i] + rest[j]
        return n * squares[i, j] - r * r

    own = [var(i, i) for i in range(dim)]
    out = np.empty((dim, dim))
    for i in range(dim):
        out[i, i] = own[i] / (n * n)
        for j in range(i + 1, dim):
            out[i, j] = out[j, i] = (var(i, j) - own[i] - own[j]) / (2 * n * n)
    return out, sum(own) / (n * n)


def fit(rows: DataFrame, dim: int, components: int, scale: float, shift: int) -> Whitening:
    """rows: one column of finite vectors of dim components, at least one row."""
    n, sums = dimension_sums(rows, dim, scale, shift)
    middle = [(2 * s + n) // (2 * n) for s in sums]
    squares = square_sums(rows, np.array(middle, np.int64), scale, shift)
    matrix_, total = covariance(n, sums, middle, squares)
    values, vectors = np.linalg.eigh(matrix_)
    order = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)
    return Whitening(n, sums, np.maximum(values[order], 0.0), vectors, total)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Per row the exact sum of (n x - S)**2; null beyond 38 digits."""
    middle = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    d = x - np.array(middle, np.int64)
    far = int(np.abs(d).max(initial=0)) + n
    if len(sums) * far * far >= 1 << 62:
        d = d.astype(object)
    squares, mixed = (d * d).sum(1).astype(object), (d * np.array(rest, d.dtype)).sum(1).astype(object)
    out = (squares * n - 2 * mixed) * n + sum(r * r for r in rest)
    if max(out, default=0) < 1 << 63:
        return pa.array(out.astype(np.int64)).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(v) if v < DIGITS else None for v in out], pa.decimal128(38, 0))


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the whitened rows' covariance minus the identity. rows: whitened, an array."""
    good = np.flatnonzero(model.scaled)
    if not len(good):
        return None

    def run(batches):
        total = np.zeros((len(good), len(good) + 1))
        for batch in batches:
            w = matrix(batch.columns[-1], len(model.variances), np.float64)[:, good]
            total[:, 0] += w.sum(0)
            total[:, 1:] += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    out = np.zeros((len(good), len(good) + 1))
    for r in rows.select("whitened").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"] / model.n
    return float(np.abs(out[:, 1:] - np.outer(out[:, 0], out[:, 0]) - np.eye(len(good))).max())


def whiten(df: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024, shift: int = 100_000) -> tuple[DataFrame, Whitening | None, float | None]:
    """(rows, model, identity error). rows: the id column, deviation (decimal) and whitened, an array by component.

    The model is fitted on all rows that take part and returned with them; None without such rows.
    """
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    rows = df.select(id_col, F.col(vec_col).alias("_v")).where(finite(F.col("_v")))
    dim = common_length(rows, "_v")
    if not dim:
        return df.sparkSession.createDataFrame([], schema), None, None
    rows = rows.where(F.size("_v") == dim)
    model = fit(rows.select("_v"), dim, components, scale, shift)
    middle = [s // model.n for s in model.sums]
    rest = np.array([(s - model.n * m) / model.n for s, m in zip(model.sums, middle, strict=True)])
    good = model.scaled
    turn = model.vectors[:, good] / np.sqrt(model.variances[good])

    def run(batches):
        for own, x in blocks(batches, dim, scale, shift):
            w = np.full((len(x), len(good)), np.nan)
            w[:, good] = ((x - np.array(middle, np.int64)) - rest) @ turn
            flat = pa.array(w.ravel(), from_pandas=True)  # NaN, of components without variance, as null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(good), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([own.columns[0], deviations(x, model.n, model.sums), lists], schema.names)

    done = cut(rows.mapInArrow(run, schema), "whitened")
    return done, model, identity_error(done, model)
