"""DuckDB SQL of the registered queries, put together from named steps."""

from __future__ import annotations

from weeklane.config import COVARIATES, FeatureSpec, Guardrail
from weeklane.fixtures import COVS, FOLDS, GAP_FROM, HORIZONS, MODELS, OVERLAP, STACK

S, G = FeatureSpec(), Guardrail()
GEO, WEEK = "geo_id", "week_start_date"
W = f"PARTITION BY {GEO} ORDER BY {WEEK}"


def r6(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE), 6) + 0.0)"


def over(fn: str, lo: str, hi: str, w: str = W) -> str:
    return f"{fn} OVER ({w} ROWS BETWEEN {lo} AND {hi})"


def strict(fn: str, x: str, n: int, shift: int = 0, need: int | None = None) -> str:
    lo, hi = f"{n - 1 + shift} PRECEDING", f"{shift} PRECEDING" if shift else "CURRENT ROW"
    return f"CASE WHEN {over(f'count({x})', lo, hi)} >= {n if need is None else need} THEN {over(f'{fn}({x})', lo, hi)} END"


def monday(x: str) -> str:
    return f"CAST(date_trunc('week', {x}) AS DATE)"


def lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER ({W})"


def case_columns() -> dict[str, str]:
    c, out = "CAST(cases AS DOUBLE)", {}
    out |= {f"cases_lag_{k}": lag(c, k) for k in S.case_lags}
    out |= {f"cases_rollmean_{n}": strict("avg", c, n, 1) for n in S.mean_windows}
    out |= {f"cases_recent_sum_{n}": strict("sum", c, n) for n in S.sum_windows}
    out |= {f"cases_recent_std_{n}": strict("stddev_samp", c, n) for n in S.std_windows}
    out["cases_log1p"] = "ln(1 + cases)"
    out |= {f"cases_nonzero_recent_{n}": strict("sum", "CAST(CASE WHEN cases > 0 THEN 1 ELSE 0 END AS DOUBLE)", n) for n in S.nonzero_windows}
    out |= {f"cases_growth_logdiff_{k}": f"ln(1 + cases) - ln(1 + {lag('cases', k)})" for k in S.growth_lookbacks}
    out["cases_accel_logdiff_1"] = f"(ln(1 + cases) - ln(1 + {lag('cases', 1)})) - (ln(1 + {lag('cases', 1)}) - ln(1 + {lag('cases', 2)}))"
    past = f"OVER ({W} ROWS UNBOUNDED PRECEDING)"
    out["cases_zero_run_length"] = f"CAST(CASE WHEN cases = 0 THEN rn - coalesce(max(CASE WHEN cases <> 0 THEN rn END) {past}, -1) ELSE 0 END AS DOUBLE)"
    out["cases_weeks_since_nonzero"] = f"CAST(coalesce(rn - max(CASE WHEN cases > 0 THEN rn END) {past}, rn + 1) AS DOUBLE)"
    return out


CALENDAR = {
    "week_of_year": f"CAST(weekofyear({WEEK}) AS INTEGER)",
    "woy_sin": f"sin(2 * pi() * weekofyear({WEEK}) / 52.0)",
    "woy_cos": f"cos(2 * pi() * weekofyear({WEEK}) / 52.0)",
    "monsoon_flag": f"CAST(strftime({WEEK}, '%m-%d') BETWEEN '06-01' AND '10-15' AS INTEGER)",
}


def listed(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


def covariate_columns(lags, means, sums, is_strict: bool) -> dict[str, str]:
    out = {}
    for v in COVS:
        out |= {f"{v}_lag_{k}": lag(v, k) for k in lags}
        shift, need = (1, None) if is_strict else (0, 1)
        if is_strict or v != "rain":
            out |= {f"{v}_rollmean_{n}": strict("avg", v, n, shift, need) for n in means}
        if v == "rain":
            out |= {f"{v}_rollsum_{n}": strict("sum", v, n, shift, need) for n in sums}
    return out


def fold_values() -> str:
    import datetime as dt

    m = lambda d: d - dt.timedelta(days=d.weekday())
    return ", ".join(f"('{f.name}', '{f.group}', {h}, DATE '{m(f.train_end)}', DATE '{m(f.val_end)}')" for f in FOLDS for h in HORIZONS)


LOW = f"(coalesce(cases <= {G.max_cases}, false) OR coalesce(cases_zero_run_length >= {G.zero_run}, false) OR coalesce(cases_weeks_since_nonzero >= {G.weeks_since_nonzero}, false) OR coalesce(cases_nonzero_recent_4 <= {G.recent_nonzero_max}, false))"
IDENTITY = "track, split_group, geo_id, geo_name, week_start_date, target_week, role, fold_id, horizon, y_true, cases, cases_nonzero_recent_4, cases_zero_run_length, cases_weeks_since_nonzero, cases_outbreak_flag_4_8"
FULL = "track, split_group, model, fold_id, role, geo_id, horizon"
NAIVE = {"persistence": ("cases", "naive_current_cases"), "seasonal_naive_52": ("coalesce(last_year, cases)", "naive_same_week_last_year"), "tail_mean_4": ("cases_recent_sum_4 / 4.0", "naive_tail_mean"), "previous_mean_4": ("cases_rollmean_4", "naive_previous_mean")}
ERR = "(y_true - y_pred)"
METRICS = f"count(*) AS n_rows, avg(y_true) AS mean_y, avg(y_pred) AS mean_pred, avg({ERR}) AS bias, avg(abs({ERR})) AS MAE, sqrt(avg({ERR} * {ERR})) AS RMSE"
METRIC6 = f"count(*) AS n_rows, {r6('avg(y_true)')} AS mean_y, {r6('avg(y_pred)')} AS mean_pred, {r6(f'avg({ERR})')} AS bias, {r6(f'avg(abs({ERR}))')} AS MAE, {r6(f'sqrt(avg({ERR} * {ERR}))')} AS RMSE"
MACRO6 = f"count(*) AS n_groups, {r6('avg(MAE)')} AS MAE_macro, {r6('avg(RMSE)')} AS RMSE_macro, {r6('avg(bias)')} AS bias_macro"


def span(name: str, key: str) -> str:
    return (
        f"SELECT g.geo_id, g.geo_id AS geo_name, w.week_start_date, coalesce(r.cases, 0) AS cases FROM (SELECT DISTINCT geo_id FROM {name}) g "
        f"CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(week_start_date) FROM {name}), (SELECT max(week_start_date) FROM {name}), INTERVAL 7 DAY)) AS DATE) AS week_start_date) w "
        f"LEFT JOIN {name} r ON r.geo_id = g.geo_id AND r.week_start_date = w.week_start_date"
    )


def exact(c: str, scale: float) -> str:
    return f"CAST(sum(CAST(round({c} * 100) AS BIGINT)) AS DOUBLE) / count({c}) / CAST({scale} AS DOUBLE)"


def by_orders(col: str) -> str:
    return f"SELECT {col} AS geo_id, {monday('o_orderdate')} AS week_start_date, count(*) AS cases FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"


STEPS: dict[str, tuple[str, ...] | str] = {
    "RAW": by_orders("n_name"),
    "RAWR": by_orders("r_name"),
    "P": ("RAW", span("RAW", "n_name")),
    "PR_": ("RAWR", span("RAWR", "r_name")),
    "COV": f"SELECT n_name AS geo_id, {monday('l_shipdate')} AS week_start_date, CAST(sum(l_quantity) AS DOUBLE) AS rain, {exact("l_extendedprice", 100_000.0)} AS tmean, {exact("l_discount", 1.0)} AS humidity, {exact("l_tax", 1.0)} AS dewpoint, {exact("l_quantity", 100.0)} AS soil_moist_0_7cm FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2",
    "FULLP": ("P", "COV", f"SELECT P.*, {', '.join(COVS)} FROM P LEFT JOIN COV USING (geo_id, week_start_date)"),
    "GAP": ("FULLP", f"SELECT geo_id, geo_name, week_start_date, cases, {', '.join(f'CASE WHEN week_start_date <= DATE {GAP_FROM.isoformat()!r} THEN {c} END AS {c}' for c in COVS)} FROM FULLP"),
    "N": ("P", f"SELECT *, row_number() OVER ({W}) - 1 AS rn FROM P"),
    "F0": ("N", f"SELECT *, {listed(case_columns())} FROM N"),
    "F1": ("F0", f"SELECT *, (cases_recent_sum_4 + 1.0) / (cases_rollmean_8 * 4 + 1.0) AS cases_outbreak_index_4_8, {listed(CALENDAR)} FROM F0"),
    "FE": ("F1", f"SELECT *, CAST(coalesce(cases_outbreak_index_4_8 >= {S.outbreak_ratio}, false) AS DOUBLE) AS cases_outbreak_flag_4_8 FROM F1"),
    "FP": ("FE", f"SELECT *, 'operational' AS track FROM FE WHERE {' AND '.join(f'cases_lag_{k} IS NOT NULL' for k in S.case_lags)}"),
    "GRID": f"SELECT * FROM (VALUES {fold_values()}) g(fold_id, split_group, horizon, train_end, val_end)",
    "SP": ("FP", "GRID", "SELECT geo_id, week_start_date, horizon, CAST(week_start_date + 7 * horizon AS DATE) AS target_week, CASE WHEN week_start_date + 7 * horizon <= train_end THEN 'train' ELSE 'val' END AS role, fold_id, split_group FROM FP CROSS JOIN GRID WHERE week_start_date + 7 * horizon <= val_end"),
    "SU": ("SP", "FP", "P", "SELECT FP.*, SP.horizon, SP.target_week, SP.role, SP.fold_id, SP.split_group, CAST(t.cases AS DOUBLE) AS y_true, CAST(l.cases AS DOUBLE) AS last_year FROM SP JOIN FP USING (geo_id, week_start_date) JOIN P t ON t.geo_id = SP.geo_id AND t.week_start_date = SP.target_week LEFT JOIN P l ON l.geo_id = SP.geo_id AND l.week_start_date = SP.target_week - 364"),
    "PRED": ("SU", " UNION ALL ".join(f"SELECT {IDENTITY}, '{m}' AS model, greatest(CAST({x} AS DOUBLE), 0.0) AS y_pred, '{s}' AS fit_status FROM SU" for m, (x, s) in NAIVE.items())),
    "FLAG": ("PRED", f"SELECT *, CASE WHEN cases <= -1 THEN NULL WHEN cases <= 0 THEN 'zero' WHEN cases <= 5 THEN '1_5' WHEN cases <= 20 THEN '6_20' WHEN cases <= 100 THEN '21_100' ELSE '100p' END AS origin_bucket, CAST({LOW} AS INTEGER) AS low_origin, CAST(coalesce(cases_outbreak_flag_4_8, 0) AS INTEGER) AS outbreak_flag, CAST(cases <= 0 AS INTEGER) AS zero_origin FROM PRED WHERE role = 'val'"),
    "CELL": ("PRED", f"SELECT {FULL}, {METRICS} FROM PRED GROUP BY ALL"),
    "MACRO": ("CELL", " UNION ALL ".join(f"SELECT '{lv}' AS level, track, split_group, model, {'fold_id' if 'f' in k else 'NULL AS fold_id'}, role, {'geo_id' if 'g' in k else 'NULL AS geo_id'}, {'horizon' if 'h' in k else 'NULL AS horizon'}, count(*) AS n_groups, avg(MAE) AS MAE_macro, avg(RMSE) AS RMSE_macro, avg(bias) AS bias_macro FROM CELL GROUP BY ALL" for lv, k in (("by_fold_horizon", "fh"), ("by_fold", "f"), ("by_geo_horizon", "gh"), ("overall", "")))),
    "DEV": ("PRED", f"SELECT fold_id, horizon, model, sum(CASE WHEN role = 'val' AND split_group = 'development' THEN abs({ERR}) END) AS s, count(CASE WHEN role = 'val' AND split_group = 'development' THEN {ERR} END) AS n, max(track) AS track FROM PRED GROUP BY 1, 2, 3"),
    "LOFO": ("DEV", "SELECT a.track, a.fold_id, a.horizon, a.model, CASE WHEN sum(coalesce(sum(b.n) FILTER (b.fold_id <> a.fold_id), 0)) OVER (PARTITION BY a.track, a.fold_id, a.horizon) > 0 THEN sum(b.s) FILTER (b.fold_id <> a.fold_id) / nullif(sum(b.n) FILTER (b.fold_id <> a.fold_id), 0) ELSE sum(b.s) / nullif(sum(b.n), 0) END AS source_mae FROM DEV a JOIN DEV b USING (horizon, model) GROUP BY 1, 2, 3, 4"),
    "WT0": ("LOFO", f"SELECT *, CASE WHEN source_mae IS NULL THEN 0 ELSE 1 / pow(greatest(source_mae, 1e-6), {STACK.inverse_mae_power}) END AS s FROM LOFO"),
    "WT1": ("WT0", "SELECT *, CASE WHEN sum(s) OVER g <= 0 THEN 1.0 / count(*) OVER g ELSE s / sum(s) OVER g END AS w0 FROM WT0 WINDOW g AS (PARTITION BY track, fold_id, horizon)"),
    "WT2": ("WT1", "SELECT *, max(w0) FILTER (model = 'persistence') OVER g AS p, coalesce(sum(w0) FILTER (model <> 'persistence') OVER g, 0) AS o FROM WT1 WINDOW g AS (PARTITION BY track, fold_id, horizon)"),
    "WT3": ("WT2", f"SELECT *, CASE WHEN coalesce(p < {STACK.persistence_floor}, false) THEN CASE WHEN model = 'persistence' THEN CASE WHEN o <= 0 THEN 1.0 ELSE {STACK.persistence_floor} END WHEN o <= 0 THEN 0.0 ELSE w0 * (1 - {STACK.persistence_floor}) / o END ELSE w0 END AS w1 FROM WT2"),
    "WT": ("WT3", f"SELECT track, fold_id, horizon, model, w1 / sum(w1) OVER (PARTITION BY track, fold_id, horizon) AS weight, source_mae, 'leave_one_fold_out_inverse_mae' AS weight_rule, CAST({STACK.persistence_floor} AS DOUBLE) AS persistence_floor, CAST({STACK.inverse_mae_power} AS DOUBLE) AS inverse_mae_power FROM WT3"),
    "OVERLAPP": ("P", "PR_", f"SELECT * FROM P UNION ALL SELECT * FROM PR_ WHERE geo_id = '{OVERLAP.parent}'"),
    "PC": ("OVERLAPP", f"SELECT week_start_date, sum(cases) FILTER (geo_id = '{OVERLAP.parent}') AS parent_cases, coalesce(sum(cases) FILTER (geo_id = '{OVERLAP.child}'), 0) AS child_cases FROM OVERLAPP GROUP BY 1 HAVING count(*) FILTER (geo_id = '{OVERLAP.parent}') > 0"),
    "TX": ("P", f"SELECT geo_id, week_start_date, CAST(cases AS DOUBLE) AS raw, ln(1 + cases) AS log1p, CAST(cases - {lag('cases', 1)} AS DOUBLE) AS diff_1, CAST(cases - {lag('cases', 52)} AS DOUBLE) AS diff_52, ln(1 + cases) - ln(1 + {lag('cases', 1)}) AS log1p_diff_1, ln(1 + cases) - ln(1 + {lag('cases', 52)}) AS log1p_diff_52 FROM P"),
}


def sql(body: str) -> str:
    """body with the steps it names, and theirs, before it."""
    import re

    need: list[str] = []

    def add(name: str) -> None:
        if name in need:
            return
        step = STEPS[name]
        for n in step[:-1] if isinstance(step, tuple) else ():
            add(n)
        need.append(name)

    for name in re.findall(r"\b[A-Z][A-Z0-9_]*\b", body):
        if name in STEPS:
            add(name)
    text = {n: s[-1] if isinstance(s, tuple) else s for n, s in STEPS.items()}
    return "WITH " + ", ".join(f"{n} AS ({text[n]})" for n in need) + " " + body


assert set(COVS) <= set(COVARIATES) and list(NAIVE) == MODELS
