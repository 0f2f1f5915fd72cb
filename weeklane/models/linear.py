"""Linear models of all settings at once, on sums of products.

A step of reweighted least squares is one pass over the rows: each task sends, per setting, the
weighted products of the design columns, which are summed on the executors; a matrix of columns x
columns per setting is solved on the driver, and settings that have converged leave. An elastic net
needs the products once: coordinate descent runs on them for a whole path of penalties, from the
strongest on, each starting from the last.

The design is an intercept, scaled features and one column per series of the training rows; the
number of columns must be small enough for a dense matrix (thousands), as for any normal equations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weeklane.models.settings import Settings, features_of
from weeklane.models.trees import settings_core, with_scores

SALTS = 32  # parts of a setting's sum
HIGH = 30.0  # of a log mean
FLAT = 1e-12  # deviation of a constant column
HALVINGS = 20


@dataclass(frozen=True)
class Scaling:
    """How features become design columns.

    fill: missing values become the training "median" before scaling, or the "mean" after it.
    ddof: 1 for sample deviations. limit: of a scaled value. series: with a column per series.
    """

    fill: str = "median"
    ddof: int = 0
    limit: float | None = None
    series: bool = True


@dataclass
class Design:
    settings: Settings  # without rows
    scaling: Scaling
    means: np.ndarray  # settings x features
    deviations: np.ndarray  # 0: the column is left out

    def columns(self) -> int:
        return 1 + self.means.shape[1] + (len(self.settings.series) if self.scaling.series else 0)

    def matrix(self, s: int, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        if self.scaling.fill == "median":
            x = np.where(np.isnan(x), self.settings.medians[s], x)
        std = self.deviations[s]
        with np.errstate(divide="ignore", invalid="ignore"):
            z = np.where(std > FLAT, (x - self.means[s]) / std, 0.0)
        z = np.nan_to_num(z, posinf=0.0, neginf=0.0)
        if self.scaling.limit:
            z = np.clip(z, -self.scaling.limit, self.scaling.limit)
        parts = [np.ones((len(x), 1)), z]
        if self.scaling.series:
            parts.append((c[:, None] == np.arange(len(self.settings.series))).astype(float))
        return np.hstack(parts)


def sums(rows: DataFrame, features: int, part: Callable, shape: Callable) -> dict[int, np.ndarray]:
    """By setting the sum of part(setting, x, c, y), arrays of one shape; a row a setting reaches the driver."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            s, y = batch.column("_s").to_numpy(), batch.column("_y").to_numpy(zero_copy_only=False)
            x, c = features_of(batch.column("_x"), features), batch.column("_c").to_numpy()
            for k in np.unique(s):
                at = np.flatnonzero(s == k)
                own = part(int(k), x[at], c[at], y[at])
                total[int(k)] = total[int(k)] + own if int(k) in total else own
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([TaskContext.get().partitionId() % SALTS] * len(keys), pa.int32()), pa.array([total[k].ravel() for k in keys], pa.list_(pa.float64()))], ["_s", "salt", "v"])

    def add(table: pa.Table) -> pa.Table:
        values = np.stack(table["v"].to_pylist()).sum(0)
        return pa.table({"_s": table["_s"][:1], "salt": table["salt"][:1], "v": pa.array([values], pa.list_(pa.float64()))})

    schema = "_s int, salt int, v array<double>"
    parts = rows.select("_s", "_x", "_c", "_y").mapInArrow(run, schema)
    salted = parts.groupBy("_s", "salt").applyInArrow(add, schema)
    return {r["_s"]: np.array(r["v"]).reshape(shape(r["_s"])) for r in salted.groupBy("_s").applyInArrow(add, schema).collect()}


def training(settings: Settings, target: Column | None = None) -> DataFrame:
    goal = F.col("_y") if target is None else target
    return settings.rows.filter(F.col("_train") & F.col("_y").isNotNull()).select("_s", "_x", "_c", goal.cast("double").alias("_y"))


def design(settings: Settings, rows: DataFrame, scaling: Scaling) -> Design:
    """Means and deviations of the training rows, in one pass of sums about the median."""
    core, n = settings_core(settings), len(settings.features)

    def part(s, x, c, y):
        d = x - core.medians[s]
        d = np.where(np.isnan(d), 0.0, d) if scaling.fill == "median" else d
        known = ~np.isnan(d)
        d = np.where(known, d, 0.0)
        return np.stack([known.sum(0), d.sum(0), (d * d).sum(0)])

    found = sums(rows, n, part, lambda s: (3, n))
    means, deviations = np.zeros((len(core.keys), n)), np.zeros((len(core.keys), n))
    for s, (count, one, two) in found.items():
        count = np.maximum(count, 1)
        means[s] = core.medians[s] + one / count
        deviations[s] = np.sqrt(np.maximum(two - one * one / count, 0.0) / np.maximum(count - scaling.ddof, 1))
    return Design(core, scaling, means, deviations)


MODEL = "_s int, mean array<double>, deviation array<double>, coefficients array<double>"


@dataclass
class Linear:
    """Coefficients by setting; none where the fit failed or wasn't tried. log_link: the score is a log mean."""

    design: Design
    log_link: bool
    coefficients: dict[int, np.ndarray] = field(default_factory=dict)
    steps: int = 0

    def scores(self, s: int, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        if s not in self.coefficients:
            return np.full(len(x), self.design.settings.means[s])
        eta = self.design.matrix(s, x, c) @ self.coefficients[s]
        return np.exp(np.clip(eta, -HIGH, HIGH)) if self.log_link else eta

    def predict(self, name: str, df: DataFrame) -> DataFrame:
        return with_scores(df, [name], len(self.design.settings.features), lambda s, x, c: self.scores(s, x, c)[None])

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(s, self.design.means[s].tolist(), self.design.deviations[s].tolist(), b.tolist()) for s, b in self.coefficients.items()]
        return spark.createDataFrame(rows, MODEL)

    @staticmethod
    def of(core: Settings, scaling: Scaling, log_link: bool, table: DataFrame) -> Linear:
        n = len(core.features)
        out = Linear(Design(core, scaling, np.zeros((len(core.keys), n)), np.zeros((len(core.keys), n))), log_link)
        for r in table.collect():
            out.design.means[r["_s"]], out.design.deviations[r["_s"]], out.coefficients[r["_s"]] = r["mean"], r["deviation"], np.array(r["coefficients"])
        return out


def deviance(y: np.ndarray, eta: np.ndarray, power: float) -> float:
    """Half the Tweedie deviance with a log link, up to what doesn't depend on the fit (1 <= power < 2)."""
    return float((np.exp((2 - power) * eta) / (2 - power) - (y * eta if power == 1 else y * np.exp((1 - power) * eta) / (1 - power))).sum())


def fit_glm(settings: Settings, power: float, alpha: float | Callable[[Design, int], float], scaling: Scaling = Scaling(), least: int = 1, steps: int = 50, tolerance: float = 1e-8) -> Linear:
    """Tweedie regression with a log link and a ridge: mean half deviance + alpha / 2 |w|**2, the intercept free.

    A step that raises the objective is halved. alpha: one value, or a function of the design and the
    setting. Settings with fewer than ``least`` training rows, or without a finite step, have no
    coefficients and are scored by their mean.
    """
    rows = training(settings)
    shape = design(settings, rows, scaling)
    p, n = shape.columns(), settings.sizes
    live = [s for s in range(len(settings.keys)) if n[s] >= max(least, 1)]
    ridge = {s: np.r_[0.0, np.full(p - 1, alpha(shape, s) if callable(alpha) else alpha)] for s in live}
    now = {s: np.r_[np.log(max(settings.means[s], 1e-6)), np.zeros(p - 1)] for s in live}
    best: dict[int, tuple[float, np.ndarray]] = {}
    halved = dict.fromkeys(live, 0)
    model = Linear(shape, True)
    for step in range(steps):
        if not live:
            break
        model.steps = step + 1
        at = {s: now[s] for s in live}

        def part(s, x, c, y, at=at):
            if s not in at:
                return np.zeros(p * p + p + 1)
            z = shape.matrix(s, x, c)
            eta = np.clip(z @ at[s], -HIGH, HIGH)
            mu = np.exp(eta)
            w = mu ** (2 - power)
            return np.r_[(z.T @ (w[:, None] * z)).ravel(), z.T @ (w * (eta + (y - mu) / mu)), deviance(y, eta, power)]

        for s, v in sums(rows.filter(F.col("_s").isin(live)), len(settings.features), part, lambda s: (p * p + p + 1,)).items():
            loss = v[-1] / n[s] + 0.5 * float(ridge[s] @ (now[s] * now[s]))
            if s in best and loss > best[s][0] + 1e-10 * abs(best[s][0]) and halved[s] < HALVINGS:
                halved[s] += 1
                now[s] = (now[s] + best[s][1]) / 2
                continue
            best[s], halved[s] = (loss, now[s]), 0
            try:
                new = solved(v[: p * p].reshape(p, p) / n[s] + np.diag(ridge[s]), v[p * p : -1] / n[s])
            except np.linalg.LinAlgError:
                new = np.full(p, np.nan)
            if not np.isfinite(new).all() or not np.isfinite(loss):
                live.remove(s)
                continue
            moved = np.abs(new - now[s]).max()
            now[s] = new
            if moved < tolerance:
                model.coefficients[s] = new
                live.remove(s)
    for s in live:  # the best of the steps that were allowed
        if s in best:
            model.coefficients[s] = best[s][1]
    return model


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution; columns that are all zero get the coefficient 0."""
    keep = np.diag(a) > FLAT
    out = np.zeros(len(b))
    if keep.any():
        out[keep] = np.linalg.lstsq(a[np.ix_(keep, keep)], b[keep], rcond=None)[0]
    return out


def descent(a: np.ndarray, b: np.ndarray, l1: float, l2: float, start: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """argmin of w'aw / 2 - b'w + l1 |w| + l2 / 2 |w|**2 by cyclic coordinate descent."""
    w, r = start.copy(), b - a @ start
    for _ in range(steps):
        moved = 0.0
        for j in np.flatnonzero(np.diag(a) > FLAT):
            rho = r[j] + a[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (a[j, j] + l2)
            if new != w[j]:
                r -= a[:, j] * (new - w[j])
                moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < tolerance:
            break
    return w


def fit_elastic_net(settings: Settings, target: Column | None, alphas: list[float], l1_ratio: float, scaling: Scaling = Scaling(), least: int = 1, steps: int = 5000, tolerance: float = 1e-9) -> dict[float, Linear]:
    """A model for each penalty alpha: mean squared error / 2 + alpha (l1_ratio |w| + (1 - l1_ratio) / 2 |w|**2), the intercept free.

    target: column of the settings' rows. The rows are read once for all penalties.
    """
    rows = training(settings, target)
    shape = design(settings, rows, scaling)
    p = shape.columns()

    def part(s, x, c, y):
        z = np.hstack([shape.matrix(s, x, c), y[:, None]])
        return z.T @ z

    means = np.zeros(len(settings.keys))
    out = {a: Linear(Design(replace(shape.settings, means=means), scaling, shape.means, shape.deviations), False) for a in alphas}
    for s, v in sums(rows, len(settings.features), part, lambda s: (p + 1, p + 1)).items():
        n = v[0, 0]
        means[s] = v[0, -1] / n
        if n < least:
            continue
        centre = v[0, 1:] / n
        moments = v[1:, 1:] / n - np.outer(centre, centre)
        w = np.zeros(p - 1)
        for a in sorted(alphas, reverse=True):
            w = descent(moments[:-1, :-1], moments[:-1, -1], a * l1_ratio, a * (1 - l1_ratio), w, steps, tolerance)
            out[a].coefficients[s] = np.r_[centre[-1] - centre[:-1] @ w, w]
    return out
