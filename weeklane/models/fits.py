"""The trained models of a track: targets, estimators and the way back to a count, for all settings at once."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weeklane.config import Training
from weeklane.functions.scalars import clip
from weeklane.models.linear import Design, Linear, Scaling, fit_elastic_net, fit_glm
from weeklane.models.settings import Settings
from weeklane.models.trees import Tree, Trees, TreeSpec, fit_several, settings_core, with_scores


# How the trained models are named.
TWEEDIE, ELASTIC, BOOSTED, RESIDUAL, FOREST = "ar_tweedie_global", "residual_elastic_net_global", "panel_hist_gbm", "residual_hist_gbm", "residual_random_forest"
TRAINED = (TWEEDIE, ELASTIC, BOOSTED, RESIDUAL, FOREST)


def goal(model: str) -> Column | None:
    """What is fitted: the count, its log growth from the origin, or its rise."""
    y, base = F.col("_y"), F.col("_base")
    return {ELASTIC: F.log1p(y) - F.log1p(base), RESIDUAL: y - base, FOREST: y - base}.get(model)


def back(model: str, p: Column, base: Column) -> Column:
    if model == ELASTIC:
        p = F.expm1(F.log1p(base) + p)
    elif model in (RESIDUAL, FOREST):
        p = base + p
    return clip(p, 0.0)


def tree_specs(cfg: Training) -> dict[str, TreeSpec]:
    return {
        BOOSTED: TreeSpec("poisson", cfg.gbm_rounds, cfg.gbm_rate, cfg.gbm_depth, cfg.gbm_min_leaf, seed=cfg.seed),
        RESIDUAL: TreeSpec("squared", cfg.residual_gbm_rounds, cfg.residual_gbm_rate, cfg.residual_gbm_depth, cfg.residual_gbm_min_leaf, seed=cfg.seed),
        FOREST: TreeSpec("squared", cfg.forest_trees, 0, cfg.forest_depth, cfg.forest_min_leaf, leaves=1 << cfg.forest_depth, seed=cfg.seed),
    }


SAVED = "model string, _s int, k int, feature array<int>, at array<int>, value array<double>, text string"


@dataclass
class Fitted:
    """Models by name over the same settings. table() holds all that scoring needs, as rows."""

    core: Settings
    models: dict[str, Linear | Trees] = field(default_factory=dict)

    def has(self, model: str, s: int) -> bool:
        m = self.models[model]
        return s in m.coefficients if isinstance(m, Linear) else bool(m.trees[s])

    def applied(self, rows: DataFrame) -> DataFrame:
        """rows of the settings with a column per model, as counts; settings without a fit have null there."""
        models, n = self.models, len(self.core.features)
        codes = any(isinstance(m, Trees) for m in models.values())
        core = self.core

        def score(s: int, x: np.ndarray, c: np.ndarray) -> np.ndarray:
            binned = core.codes(s, x, c) if codes else None
            return np.stack([m.scores(s, binned) if isinstance(m, Trees) else m.scores(s, x, c) for m in models.values()])

        out = with_scores(rows, [f"_p_{m}" for m in models], n, score)
        done = {m: F.when(F.col("_s").isin([s for s in range(len(core.keys)) if self.has(m, s)]), back(m, F.col(f"_p_{m}"), F.col("_base"))) for m in models}
        return out.withColumns(done).drop(*[f"_p_{m}" for m in models])

    def table(self, spark: SparkSession) -> DataFrame:
        core, rows = self.core, []
        about = {"by": core.by, "keys": core.keys, "features": core.features, "series": core.series}
        rows.append(("", -1, 0, None, None, None, json.dumps(about, default=str)))
        for s in range(len(core.keys)):
            rows.append(("", s, -1, None, None, [float(core.sizes[s]), float(core.means[s])], None))
            rows += [("", s, f, None, None, [float(core.medians[s][f]), *map(float, e)], None) for f, e in enumerate(core.edges[s])]
        for name, m in self.models.items():
            if isinstance(m, Trees):
                rows.append((name, -1, 0, None, None, m.settings.means.tolist(), json.dumps(m.spec.__dict__)))
                rows += [(name, s, k, t.feature.tolist(), t.at.tolist(), t.value.tolist(), None) for s, own in enumerate(m.trees) for k, t in enumerate(own)]
            else:
                rows.append((name, -1, 0, None, None, m.design.settings.means.tolist(), json.dumps({"log_link": m.log_link, "scaling": m.design.scaling.__dict__})))
                for s, b in m.coefficients.items():
                    rows += [(name, s, k, None, None, list(map(float, v)), None) for k, v in enumerate((m.design.means[s], m.design.deviations[s], b))]
        return spark.createDataFrame(rows, SAVED)

    @staticmethod
    def of(table: DataFrame) -> Fitted:
        """From rows that table() made; settings x features x trees, which the driver held when they were fitted."""
        rows = table.orderBy("model", "_s", "k").collect()
        about = json.loads(next(r["text"] for r in rows if r["model"] == "" and r["_s"] < 0))
        keys, n = [tuple(k) for k in about["keys"]], len(about["features"])
        sizes, means, medians = np.zeros(len(keys), np.int64), np.zeros(len(keys)), np.zeros((len(keys), n))
        edges = [[np.zeros(0)] * n for _ in keys]
        for r in rows:
            if r["model"] == "" and r["_s"] >= 0:
                s, v = r["_s"], r["value"]
                if r["k"] < 0:
                    sizes[s], means[s] = v
                else:
                    medians[s][r["k"]], edges[s][r["k"]] = v[0], np.array(v[1:])
        core = Settings(None, [], tuple(about["by"]), keys, about["features"], about["series"], sizes, means, medians, edges)
        out = Fitted(core)
        for r in rows:
            if r["model"] and r["_s"] < 0:
                spec, own = json.loads(r["text"]), replace(core, means=np.array(r["value"]))
                if "scaling" in spec:
                    out.models[r["model"]] = Linear(Design(own, Scaling(**spec["scaling"]), np.zeros((len(keys), n)), np.zeros((len(keys), n))), spec["log_link"])
                else:
                    out.models[r["model"]] = Trees(own, TreeSpec(**spec), [[] for _ in keys])
        for r in rows:
            m = out.models.get(r["model"])
            if m is None or r["_s"] < 0:
                continue
            if isinstance(m, Trees):
                m.trees[r["_s"]].append(Tree(np.array(r["feature"], np.int32), np.array(r["at"], np.int32), np.array(r["value"])))
            elif r["k"] == 2:
                m.coefficients[r["_s"]] = np.array(r["value"])
            else:
                (m.design.means if r["k"] == 0 else m.design.deviations)[r["_s"]] = r["value"]
        return out


def fit_models(settings: Settings, names: list[str], cfg: Training = Training(), least: int = 1) -> Fitted:
    """The named models, in the order given. Settings with fewer than ``least`` training rows have none."""
    unknown = set(names) - set(TRAINED)
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}")
    found: dict[str, Linear | Trees] = {}
    if TWEEDIE in names:
        found[TWEEDIE] = fit_glm(settings, cfg.tweedie_power, cfg.tweedie_alpha, least=least)
    if ELASTIC in names:
        found[ELASTIC] = fit_elastic_net(settings, goal(ELASTIC), [cfg.elastic_net_alpha], cfg.elastic_net_l1_ratio, least=least, steps=cfg.elastic_net_max_iter)[cfg.elastic_net_alpha]
    specs = {m: s for m, s in tree_specs(cfg).items() if m in names}
    found |= dict(zip(specs, fit_several(settings, [(goal(m), s) for m, s in specs.items()], least), strict=True)) if specs else {}
    return Fitted(settings_core(settings), {m: found[m] for m in names})
