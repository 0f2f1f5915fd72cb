"""Regression trees on histograms, for all settings of a table together: boosting for any loss, and forests.

Features are binned once. A level of a tree is one histogram of gradient, curvature and row count by
(node, feature, bin), and the best cut of each node is read from it. Settings of at most CELLS binned
values are fitted one to a task, all side by side; larger ones level by level over the whole
cluster, where a pass over the rows sends each task's histograms to one aggregation for all settings
and nodes. Both build the same trees: rows are drawn by a hash of their number, not by their place.
A model is three small arrays per tree, kept as rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weeklane.models.settings import Settings, features_of
from weeklane.sources.sinks import staged

CELLS = 1 << 22  # binned values of a setting that one task fits alone
HIGH = 30.0  # of a log score
LEAST_CURVATURE = 1e-3  # on either side of a cut
STAGE = 25  # rounds between two writings of the scores
WALKED = 1 << 20  # rows x trees that are walked at once
TREES = 8  # of a forest that are grown together


@dataclass(frozen=True)
class TreeSpec:
    """rate 0 is a forest: trees of weighted rows that don't see one another, averaged.

    shrink: leaf limits that follow the training rows (at least rows / 20 to a leaf, at most rows / 3
    leaves). patience: rounds without a better squared error on validation rows before the rounds end.
    """

    loss: str = "squared"
    rounds: int = 300
    rate: float = 0.05
    depth: int = 3
    min_leaf: int = 20
    leaves: int = 31
    power: float = 1.5
    row_share: float = 1.0
    feature_share: float = 1.0
    patience: int | None = None
    shrink: bool = False
    seed: int = 42

    @property
    def forest(self) -> bool:
        return self.rate == 0

    @property
    def log_link(self) -> bool:
        return self.loss != "squared"

    def limits(self, n: int) -> tuple[int, int]:
        """(least rows of a leaf, most leaves) for n training rows."""
        if not self.shrink:
            return self.min_leaf, min(self.leaves, 1 << self.depth)
        return max(10, n // 20), min(max(7, min(self.leaves, n // 3)), 1 << self.depth)

    def start(self, mean: float) -> float:
        return 0.0 if self.forest else float(np.log(max(mean, 1e-6))) if self.log_link else mean


def gradients(loss: str, y: np.ndarray, f: np.ndarray, power: float) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, curvature) of the loss at score f."""
    if loss == "squared":
        return f - y, np.ones(len(y))
    e = np.exp(np.minimum(f, HIGH))
    if loss == "poisson":
        return e - y, e
    if loss == "tweedie":
        a, b = np.exp((1 - power) * np.minimum(f, HIGH)), np.exp((2 - power) * np.minimum(f, HIGH))
        return b - y * a, y * (power - 1) * a + (2 - power) * b
    raise ValueError(f"unknown loss {loss!r}")


def uniform(rows: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) per row number and seed, alike wherever the row is."""
    with np.errstate(over="ignore"):
        z = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xBF58476D1CE4E5B9)
        for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(mult)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) / (1 << 53)


POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))  # distribution of the times a row is drawn


def drawn(spec: TreeSpec, rows: np.ndarray, tree: int) -> np.ndarray:
    """Times that each row counts in a tree."""
    if spec.forest:
        return np.searchsorted(POISSON, uniform(rows, spec.seed * 1_000_003 + tree), side="right").astype(np.float64)
    if spec.row_share < 1:
        return (uniform(rows, spec.seed * 1_000_003 + tree) < spec.row_share).astype(np.float64)
    return np.ones(len(rows))


def chosen_features(spec: TreeSpec, n: int, tree: int) -> np.ndarray:
    if spec.feature_share >= 1:
        return np.ones(n, bool)
    out = np.zeros(n, bool)
    out[np.random.default_rng((spec.seed, tree)).choice(n, max(1, round(n * spec.feature_share)), replace=False)] = True
    return out


class Layout:
    """Where the bins of each feature lie in a histogram; the last feature is cut one bin against the others."""

    def __init__(self, widths: np.ndarray):
        self.first = np.concatenate([[0], np.cumsum(widths)[:-1]])
        self.size = int(widths.sum())
        self.feature = np.repeat(np.arange(len(widths)), widths)
        self.single = self.feature == len(widths) - 1
        self.last = len(widths) - 1

    def cells(self, codes: np.ndarray) -> np.ndarray:
        return codes + self.first.astype(np.int64)


def cuts(hist: np.ndarray, layout: Layout, min_leaf: int, allowed: np.ndarray) -> list[tuple]:
    """Per node of hist (3 x nodes x bins: gradient, curvature, rows): (gain, bin or -1, sums, sums on its left)."""
    sums = hist[:, :, layout.first[0] : layout.first[1] if len(layout.first) > 1 else layout.size].sum(2)
    fine = allowed[layout.feature]
    single = slice(int(layout.first[-1]), layout.size)
    out = []
    for k in range(hist.shape[1]):  # a node's bins stay in the processor's cache
        own, total = hist[:, k], sums[:, k]
        run = np.cumsum(own, axis=1)
        left = run - np.concatenate([np.zeros((3, 1)), run[:, layout.first[1:] - 1]], axis=1)[:, layout.feature]
        left[:, single] = own[:, single]
        right = total[:, None] - left
        fit = (left[2] >= min_leaf) & (right[2] >= min_leaf) & (left[1] >= LEAST_CURVATURE) & (right[1] >= LEAST_CURVATURE) & fine
        at = np.flatnonzero(fit)
        if not len(at):
            out.append((0.0, -1, total, left[:, 0]))
            continue
        gain = left[0, at] ** 2 / left[1, at] + right[0, at] ** 2 / right[1, at] - total[0] ** 2 / np.maximum(total[1], 1e-12)
        best = int(gain.argmax())
        good = gain[best] > 1e-9
        out.append((float(gain[best]) if good else 0.0, int(at[best]) if good else -1, total, left[:, at[best]]))
    return out


@dataclass
class Tree:
    """As a heap: node k has the children 2k + 1 and 2k + 2. feature -1: a leaf."""

    feature: np.ndarray
    at: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(depth: int) -> Tree:
        n = (1 << depth + 1) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))

    def cut(self, found: list[tuple], nodes: list[int], layout: Layout, leaves: int, scale: float) -> list[int]:
        """Takes the cuts of the nodes, best first while leaves are left; returns the nodes that were cut."""
        made = []
        for k, (_, b, sums, _left) in enumerate(found):
            self.value[nodes[k]] = -scale * sums[0] / sums[1] if sums[1] > 0 else 0.0
        taken = int((self.feature >= 0).sum()) + 1  # leaves so far
        for k in sorted(range(len(found)), key=lambda k: -found[k][0]):
            gain, b, sums, left = found[k]
            if b < 0 or taken >= leaves:
                continue
            node, taken = nodes[k], taken + 1
            self.feature[node], self.at[node] = layout.feature[b], b - layout.first[layout.feature[b]]
            for child, part in ((2 * node + 1, left), (2 * node + 2, sums - left)):
                self.value[child] = -scale * part[0] / part[1] if part[1] > 0 else 0.0
            made.append(node)
        return sorted(made)

    def step(self, codes: np.ndarray, node: np.ndarray, last: int) -> np.ndarray:
        """The nodes one level on; rows at a leaf stay."""
        f = self.feature[node]
        v = codes[np.arange(len(node)), np.maximum(f, 0)]
        left = np.where(f == last, v == self.at[node], v <= self.at[node])
        return np.where(f < 0, node, 2 * node + 2 - left)

    def leaf(self, codes: np.ndarray, last: int) -> np.ndarray:
        node = np.zeros(len(codes), np.int64)
        while (self.feature[node] >= 0).any():
            node = self.step(codes, node, last)
        return node

    def score(self, codes: np.ndarray, last: int) -> np.ndarray:
        return self.value[self.leaf(codes, last)]


def scored(trees: list[Tree], codes: np.ndarray) -> np.ndarray:
    """Sum of all trees' values per row, all trees a level at a time."""
    out = np.zeros(len(codes))
    if not trees or not len(codes):
        return out
    feature, at, value = (np.stack([getattr(t, k) for t in trees]) for k in ("feature", "at", "value"))
    last, of = codes.shape[1] - 1, np.arange(len(trees))
    step = max(1, WALKED // len(trees))
    for a in range(0, len(codes), step):
        own = codes[a : a + step]
        node = np.zeros((len(own), len(trees)), np.int64)
        while True:
            f = feature[of, node]
            if (f < 0).all():
                break
            v, cut = np.take_along_axis(own, np.maximum(f, 0), 1), at[of, node]
            left = np.where(f == last, v == cut, v <= cut)
            node = np.where(f < 0, node, 2 * node + 2 - left)
        out[a : a + step] = value[of, node].sum(1)
    return out


def histogram(cells: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, count: np.ndarray, nodes: int, size: int) -> np.ndarray:
    """3 x nodes x bins of rows whose node (from 0) is given."""
    at = (cells + (node * size)[:, None]).ravel()
    per = cells.shape[1]
    return np.stack([np.bincount(at, np.repeat(w, per), nodes * size) for w in (g, h, count)]).reshape(3, nodes, size)


def grow(codes: np.ndarray, cells: np.ndarray, g: np.ndarray, h: np.ndarray, weight: np.ndarray, spec: TreeSpec, layout: Layout, limits: tuple[int, int], allowed: np.ndarray, scale: float) -> tuple[Tree, np.ndarray]:
    """(tree, node of each row)."""
    tree, node = Tree.of(spec.depth), np.zeros(len(codes), np.int64)
    live = weight > 0
    g, h, count = g * weight, h * weight, live.astype(np.float64)
    first = (cells, node, g, h, count) if live.all() else (cells[live], node[live], g[live], h[live], count[live])
    hist, nodes = histogram(*first, 1, layout.size), [0]
    for level in range(spec.depth):
        found = cuts(hist, layout, limits[0], allowed)
        parents = tree.cut(found, nodes, layout, limits[1], scale)
        if not parents:
            break
        node = tree.step(codes, node, layout.last)
        if level + 1 == spec.depth:
            break
        # the smaller child of each cut node is counted, the other one is the rest of its parent
        rows = {p: found[nodes.index(p)] for p in parents}
        small = [2 * p + 1 if 2 * rows[p][3][2] <= rows[p][2][2] else 2 * p + 2 for p in parents]
        place = np.full(len(tree.feature), -1, np.int64)
        place[small] = np.arange(len(small))
        own = live & (place[node] >= 0)
        part = histogram(cells[own], place[node[own]], g[own], h[own], count[own], len(small), layout.size)
        new, order = [], []
        for k, p in enumerate(parents):
            other = hist[:, nodes.index(p)] - part[:, k]
            pair = {small[k]: part[:, k], 4 * p + 3 - small[k]: other}
            for child in (2 * p + 1, 2 * p + 2):
                order.append(child)
                new.append(pair[child])
        hist, nodes = np.stack(new, axis=1), order
    return tree, node


def fit_alone(codes: np.ndarray, rows: np.ndarray, y: np.ndarray, train: np.ndarray, widths: np.ndarray, spec: TreeSpec) -> list[Tree]:
    """The trees of one setting whose rows are at hand. Rows that aren't training rows only end the rounds."""
    layout, n = Layout(widths), int(train.sum())
    own, ty, numbers = codes[train], y[train], rows[train]
    cells, limits = layout.cells(own), spec.limits(n)
    f = np.full(n, spec.start(ty.mean() if n else 0.0))
    held, hy = codes[~train], y[~train]
    hf = np.full(len(held), f[0] if n else 0.0)
    trees, errors = [], []
    for k in range(spec.rounds):
        g, h = gradients(spec.loss, ty, f, spec.power)
        tree, node = grow(own, cells, g, h, drawn(spec, numbers, k), spec, layout, limits, chosen_features(spec, len(widths), k), 1.0 if spec.forest else spec.rate)
        trees.append(tree)
        if not spec.forest:
            f = f + tree.value[node]
        if spec.patience is not None and len(held):
            hf = hf + tree.score(held, layout.last)
            errors.append(float(((hy - back(spec, hf)) ** 2).mean()))
            if ended(errors, spec.patience):
                break
    return trees[: best_round(errors)] if errors else trees


def back(spec: TreeSpec, f: np.ndarray) -> np.ndarray:
    return np.exp(np.minimum(f, HIGH)) if spec.log_link else f


def best_round(errors: list[float]) -> int:
    return int(np.argmin(errors)) + 1


def ended(errors: list[float], patience: int) -> bool:
    return len(errors) - best_round(errors) >= patience


MODEL = "_s int, tree int, feature array<int>, at array<int>, value array<double>"


@dataclass
class Trees:
    """Trees by setting. table() and of() carry them through storage. settings: without rows; the means are those of the target."""

    settings: Settings
    spec: TreeSpec
    trees: list[list[Tree]]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(s, k, t.feature.tolist(), t.at.tolist(), t.value.tolist()) for s, own in enumerate(self.trees) for k, t in enumerate(own)]
        return spark.createDataFrame(rows, MODEL)

    @staticmethod
    def of(core: Settings, spec: TreeSpec, table: DataFrame) -> Trees:
        """Settings x trees x nodes of one tree, all bounded by the specification."""
        out: list[list[Tree]] = [[] for _ in core.keys]
        for r in table.orderBy("_s", "tree").collect():
            out[r["_s"]].append(Tree(np.array(r["feature"], np.int32), np.array(r["at"], np.int32), np.array(r["value"])))
        return Trees(core, spec, out)

    def scores(self, s: int, codes: np.ndarray) -> np.ndarray:
        """Forecasts of the target (its mean, for losses with a log link)."""
        total = scored(self.trees[s], codes)
        if self.spec.forest:
            return total / max(len(self.trees[s]), 1)
        return back(self.spec, total + self.spec.start(self.settings.means[s]))

    def predict(self, name: str, df: DataFrame) -> DataFrame:
        """df, rows of the settings, with the forecast."""
        return with_scores(df, [name], len(self.settings.features), lambda s, x, c: self.scores(s, self.settings.codes(s, x, c))[None])


def with_scores(df: DataFrame, names: list[str], features: int, score) -> DataFrame:
    """df with the columns of score(setting, features, series). What score holds is bounded by settings, features and trees."""

    def run(batches):
        for batch in batches:
            out = np.full((len(names), batch.num_rows), np.nan)
            s = batch.column("_s").to_numpy()
            x, c = features_of(batch.column("_x"), features), batch.column("_c").to_numpy()
            for k in np.unique(s):
                at = np.flatnonzero(s == k)
                out[:, at] = score(int(k), x[at], c[at])
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], [*batch.schema.names, *names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)]))


def fit_trees(settings: Settings, target: Column | None, spec: TreeSpec, least: int = 1, cells: int | None = None) -> Trees:
    """target: column of the settings' rows (y_true if None). Settings with fewer than ``least`` training rows get no trees."""
    return fit_several(settings, [(target, spec)], least, cells)[0]


def fit_several(settings: Settings, wanted: list[tuple[Column | None, TreeSpec]], least: int = 1, cells: int | None = None) -> list[Trees]:
    """One model for each (target, specification), all settings of all of them side by side."""
    goals = [(F.col("_y") if target is None else target).cast("double") for target, _ in wanted]
    rows = settings.rows.filter(F.col("_y").isNotNull())
    means = np.zeros((len(wanted), len(settings.keys)))
    for r in rows.filter("_train").groupBy("_s").agg(*[F.avg(g).alias(f"m{k}") for k, g in enumerate(goals)]).collect():
        means[:, r["_s"]] = [r[f"m{k}"] for k in range(len(wanted))]
    core = settings_core(settings)
    models = [Trees(replace(core, means=means[k]), spec, [[] for _ in settings.keys]) for k, (_, spec) in enumerate(wanted)]
    limit = CELLS if cells is None else cells
    amount = settings.sizes * (len(settings.features) + 1)
    alone = [s for s in range(len(settings.keys)) if settings.sizes[s] >= least and amount[s] <= limit]
    spread = [s for s in range(len(settings.keys)) if settings.sizes[s] >= least and amount[s] > limit]
    if alone:
        grown = fitted_alone(rows.filter(F.col("_s").isin(alone)), core, goals, [spec for _, spec in wanted], len(alone)).collect()
        for r in sorted(grown, key=lambda r: (r["k"], r["_s"], r["tree"])):  # a sort on the cluster would grow all trees again for its bounds
            models[r["k"]].trees[r["_s"]].append(Tree(np.array(r["feature"], np.int32), np.array(r["at"], np.int32), np.array(r["value"])))
    for k, (_, spec) in enumerate(wanted):
        if spread:
            own = rows.filter(F.col("_s").isin(spread) & (F.col("_train") if spec.patience is None else F.lit(True)))
            for s, found in spread_out(own.select("_s", "_row", "_train", "_x", "_c", goals[k].alias("_y")), core, spec, spread, means[k]).items():
                models[k].trees[s] = found
    return models


def fitted_alone(rows: DataFrame, core: Settings, goals: list[Column], specs: list[TreeSpec], settings: int) -> DataFrame:
    """One task fits one model of one setting; the setting's binned values are within the bound."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), g.alias("_y")) for k, g in enumerate(goals)])).alias("_j")
    rows = rows.select("_s", "_row", "_train", "_x", "_c", each).select("_s", "_row", "_train", "_x", "_c", "_j.k", "_j._y")

    def run(table: pa.Table) -> pa.Table:
        s, k = table["_s"][0].as_py(), table["k"][0].as_py()
        order = np.argsort(table["_row"].to_numpy())  # sums in the same order, whatever the shuffle
        train = table["_train"].to_numpy()[order].astype(bool)
        if specs[k].patience is None:
            order, train = order[train], train[train]
        codes = core.codes(s, features_of(table["_x"], len(core.features))[order], table["_c"].to_numpy()[order])
        trees = fit_alone(codes, table["_row"].to_numpy()[order], table["_y"].to_numpy()[order], train, core.widths(s), specs[k])
        n = len(trees)
        return pa.table({
            "k": pa.array([k] * n, pa.int32()), "_s": pa.array([s] * n, pa.int32()), "tree": pa.array(range(n), pa.int32()), "feature": pa.array([t.feature for t in trees], pa.list_(pa.int32())),
            "at": pa.array([t.at for t in trees], pa.list_(pa.int32())), "value": pa.array([t.value for t in trees], pa.list_(pa.float64())),
        })

    dealt = rows.repartition(4 * settings * len(specs), "k", "_s")  # few share a task
    return dealt.groupBy("k", "_s").applyInArrow(run, "k int, " + MODEL)


def settings_core(settings: Settings) -> Settings:
    """Without the table, to be sent to tasks."""
    return replace(settings, rows=None)


def spread_out(rows: DataFrame, core: Settings, spec: TreeSpec, which: list[int], means: np.ndarray) -> dict[int, list[Tree]]:
    """Boosting, or a forest, level by level over all rows; one aggregation a level for all settings.

    Scores are written every STAGE rounds; the trees grown since are applied on the fly.
    """
    layouts = {s: Layout(core.widths(s)) for s in which}
    sizes = {s: int(core.sizes[s]) for s in which}
    limits = {s: spec.limits(sizes[s]) for s in which}
    start = {s: spec.start(means[s]) for s in which}
    first = F.create_map(*[x for s in which for x in (F.lit(s), F.lit(start[s]))])[F.col("_s")]
    table = staged(rows.withColumn("_f", first), "scores")
    done: dict[int, list[Tree]] = {s: [] for s in which}
    errors: dict[int, list[float]] = {s: [] for s in which}
    stage, live, k = {s: 0 for s in which}, list(which), 0
    while live and k < spec.rounds:
        together = min(TREES, spec.rounds - k) if spec.forest else 1
        growing = {(s, t): Tree.of(spec.depth) for s in live for t in range(k, k + together)}
        open_nodes = {key: [0] for key in growing}
        for level in range(spec.depth):
            best = level_cuts(table, core, spec, layouts, limits, {s: [] if spec.forest else done[s][stage[s] :] for s in live}, growing, open_nodes, spec.patience is not None and level == 0 and k > 0)
            for s, e in best.pop("errors", {}).items():
                errors[s].append(e)
            nexts = {}
            for key, nodes in open_nodes.items():
                made = growing[key].cut(best[key], nodes, layouts[key[0]], limits[key[0]][1], 1.0 if spec.forest else spec.rate)
                if made:
                    nexts[key] = [c for p in made for c in (2 * p + 1, 2 * p + 2)]
            open_nodes = nexts
            if not open_nodes:
                break
        for s in list(live):
            if errors[s] and ended(errors[s], spec.patience):
                live.remove(s)  # its last tree so far is the one before this round
                continue
            done[s] += [growing[s, t] for t in range(k, k + together)]
        k += together
        if not spec.forest and k % STAGE == 0 and live:
            table = staged(moved(table.filter(F.col("_s").isin(live)), core, layouts, {s: done[s][stage[s] :] for s in live}), "scores")
            stage = {s: len(done[s]) for s in which}
    if spec.patience is not None:
        last = level_cuts(table, core, spec, layouts, limits, {s: done[s][stage[s] :] for s in live}, {}, {}, True)
        for s, e in last.get("errors", {}).items():
            errors[s].append(e)
        return {s: done[s][: best_round(errors[s])] if errors[s] else done[s] for s in which}
    return done


def batches_by_setting(batches, core: Settings) -> Iterator[tuple]:
    for batch in batches:
        s = batch.column("_s").to_numpy()
        x, c = features_of(batch.column("_x"), len(core.features)), batch.column("_c").to_numpy()
        for k in np.unique(s):
            at = np.flatnonzero(s == k)
            yield batch, int(k), at, core.codes(int(k), x[at], c[at])


def moved(table: DataFrame, core: Settings, layouts: dict, trees: dict) -> DataFrame:
    def run(batches):
        for batch in batches:
            f = batch.column("_f").to_numpy(zero_copy_only=False).copy()
            for _, s, at, codes in batches_by_setting([batch], core):
                f[at] += scored(trees.get(s, []), codes)
            yield pa.RecordBatch.from_arrays([pa.array(f) if c == "_f" else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return table.mapInArrow(run, table.schema)


def level_cuts(table: DataFrame, core: Settings, spec: TreeSpec, layouts: dict, limits: dict, trees: dict, growing: dict, open_nodes: dict, validate: bool) -> dict:
    """By (setting, tree) the cut of each open node, as ``cuts`` has it; with errors: mean squared ones by setting.

    Histograms are summed by bin where they are and a node's cut is chosen there; the driver gets a row a node.
    """
    def run(batches):
        sums: dict = {}
        errors: dict = {}
        for batch, s, at, codes in batches_by_setting(batches, core):
            if s not in trees:
                continue
            f = batch.column("_f").to_numpy(zero_copy_only=False)[at]
            f = f + scored(trees[s], codes)
            y, rows = batch.column("_y").to_numpy(zero_copy_only=False)[at], batch.column("_row").to_numpy()[at]
            train = batch.column("_train").to_numpy(zero_copy_only=False)[at].astype(bool)
            if validate and not train.all():
                old = errors.get(s, (0.0, 0))
                errors[s] = old[0] + float(((y[~train] - back(spec, f[~train])) ** 2).sum()), old[1] + int((~train).sum())
            g, h = gradients(spec.loss, y, f, spec.power)
            for (own, t), nodes in open_nodes.items():
                if own != s:
                    continue
                node = growing[own, t].leaf(codes, layouts[s].last)
                place = np.full(len(growing[own, t].feature), -1, np.int64)
                place[nodes] = np.arange(len(nodes))
                weight = drawn(spec, rows, t)
                use = train & (weight > 0) & (place[node] >= 0)
                if use.any():
                    part = histogram(layouts[s].cells(codes[use]), place[node[use]], (g * weight)[use], (h * weight)[use], np.ones(int(use.sum())), len(nodes), layouts[s].size)
                    sums[own, t] = sums[own, t] + part if (own, t) in sums else part
        for (s, t), part in sums.items():
            n, b = np.nonzero(part[2])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), s), pa.int32()), pa.array(np.full(len(n), t), pa.int32()), pa.array(n, pa.int32()), pa.array(b, pa.int32()), *[pa.array(part[k, n, b]) for k in range(3)]], names)
        if errors:
            e = sorted(errors.items())
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in e], pa.int32()), *[pa.array([-1] * len(e), pa.int32())] * 3, pa.array([v[0] for _, v in e]), pa.array([float(v[1]) for _, v in e]), pa.array([0.0] * len(e))], names)

    names = ["s", "tree", "node", "bin", "g", "h", "n"]
    parts = table.mapInArrow(run, "s int, tree int, node int, bin int, g double, h double, n double")
    summed = parts.groupBy("s", "tree", "node", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))

    def choose(own: pa.Table) -> pa.Table:
        s, t, node = (own[c][0].as_py() for c in ("s", "tree", "node"))
        sums = [own[c].to_numpy() for c in ("g", "h", "n")]
        if node < 0:
            found = (0.0, -1, [float(v[0]) for v in sums], [0.0] * 3)
        else:
            hist = np.zeros((3, 1, layouts[s].size))
            hist[:, 0, own["bin"].to_numpy()] = sums
            found = cuts(hist, layouts[s], limits[s][0], chosen_features(spec, len(layouts[s].first), t))[0]
        return pa.table({"s": pa.array([s], pa.int32()), "tree": pa.array([t], pa.int32()), "node": pa.array([node], pa.int32()), "gain": [found[0]], "bin": pa.array([found[1]], pa.int32()), "sums": [list(map(float, found[2]))], "left": [list(map(float, found[3]))]})

    out: dict = {key: [(0.0, -1, np.zeros(3), np.zeros(3))] * len(nodes) for key, nodes in open_nodes.items()}
    for r in summed.groupBy("s", "tree", "node").applyInArrow(choose, "s int, tree int, node int, gain double, bin int, sums array<double>, left array<double>").collect():
        if r["node"] < 0:
            out.setdefault("errors", {})[r["s"]] = r["sums"][0] / r["sums"][1]
        else:
            out[r["s"], r["tree"]][r["node"]] = (r["gain"], r["bin"], np.array(r["sums"]), np.array(r["left"]))
    return out
