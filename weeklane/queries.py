"""The registered queries: each operator on the panel of the order tables, with its SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weeklane import fixtures as fx
from weeklane import oracle as o
from weeklane.config import GEO, TARGET_WEEK, VALUE, WEEK, Training
from weeklane.functions.scalars import monday, monday_by_weekday, normalize_name, number, origin_bucket, round6
from weeklane.models import grouped, legacy as legacy_models, live, runner
from weeklane.models.design import fill_constant, zscore_by
from weeklane.models.fits import TRAINED, fit_models
from weeklane.models.settings import settings
from weeklane.models.trees import TreeSpec, fit_trees
from weeklane.operators import boards, design, explore, features, fill, guardrail, hierarchy, metrics, naive, panel, regimes, splits, stacking, stationarity
from weeklane.sources import artifacts, counts as sources, sinks
from weeklane.oracle import ERR, FULL, MACRO6, METRIC6, r6, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEY = [GEO, WEEK]


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, whole numbers to long: the form that is compared."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = round6(c)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)) or isinstance(f.dataType, T.DecimalType):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, text: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if text is not None:
            SQL[name] = text
        return f

    return add


def cols(names, table: str = "") -> str:
    return ", ".join(f"{r6(n)} AS {n}" for n in names)


CASE = list(o.case_columns())

# ---- panel ------------------------------------------------------------------------------------


@query("build_panel", sql(f"SELECT geo_id, geo_name, week_start_date, CAST(cases AS BIGINT) AS cases, {cols(fx.COVS)} FROM FULLP"))
def _(spark, d):
    return fx.full_panel(spark, d)


@query("panel_sample", sql("SELECT geo_id, geo_name, week_start_date, CAST(cases AS BIGINT) AS cases FROM P ORDER BY geo_id, week_start_date LIMIT 200"))
def _(spark, d):
    return panel.head_sample(fx.counts(spark, d))


@query("densify", sql("SELECT g.geo_id, g.geo_id AS geo_name, CAST(w AS DATE) AS week_start_date, CAST(r.cases AS BIGINT) AS cases FROM (SELECT geo_id, unnest(generate_series(min(week_start_date), max(week_start_date), INTERVAL 7 DAY)) AS w FROM RAW GROUP BY 1) g LEFT JOIN RAW r ON r.geo_id = g.geo_id AND r.week_start_date = CAST(g.w AS DATE)"))
def _(spark, d):
    return panel.densify(fx.orders_by_nation(spark, d))


CHECKS = "SELECT 'null_weeks' AS \"check\", CAST(count(*) FILTER (week_start_date IS NULL) AS BIGINT) AS n FROM GAP UNION ALL SELECT 'null_values', count(*) FILTER (cases IS NULL) FROM GAP UNION ALL SELECT 'negative_values', count(*) FILTER (cases < 0) FROM GAP UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT (geo_id, week_start_date)) FROM GAP UNION ALL SELECT 'missing_NATION_1', 0 UNION ALL SELECT 'missing_NOWHERE', 1"


@query("panel_qc", sql(CHECKS))
def _(spark, d):
    return panel.panel_qc(fx.gap_panel(spark, d), ["NATION_1", "NOWHERE"])


@query("missing_members", "SELECT n_name AS geo_id FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000))")
def _(spark, d):
    large = fx.read(spark, d, "orders").filter("o_totalprice > 450000").join(fx.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    nation = fx.read(spark, d, "nation")
    present = large.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias(GEO))
    return panel.missing_members(present, nation.select(F.col("n_name").alias(GEO)))


@query("week_anchor_check", "SELECT CAST(c_nationkey AS VARCHAR) AS geo_id, bool_and(isodow(o_orderdate) = 1) AS all_mondays, count(*) = count(DISTINCT CAST(o_orderdate AS DATE)) AS increasing FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(spark, d):
    rows = fx.read(spark, d, "orders").join(fx.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return panel.week_anchor_check(rows.select(F.col("c_nationkey").cast("string").alias(GEO), F.to_date("o_orderdate").alias(WEEK)))


@query("week_anchor", f"SELECT o_orderkey, {o.monday('o_orderdate')} AS by_trunc, CAST(CAST(o_orderdate AS DATE) - CAST(isodow(o_orderdate) - 1 AS INTEGER) AS DATE) AS by_weekday FROM orders")
def _(spark, d):
    return fx.read(spark, d, "orders").select("o_orderkey", monday("o_orderdate").alias("by_trunc"), monday_by_weekday("o_orderdate").alias("by_weekday"))


@query("complete_cases", sql("SELECT geo_id, week_start_date, CAST(cases AS BIGINT) AS cases FROM GAP WHERE rain IS NOT NULL AND tmean IS NOT NULL"))
def _(spark, d):
    return panel.complete_cases(fx.gap_panel(spark, d), ["rain", "tmean"]).select(*KEY, VALUE)


@query("normalize_names", "SELECT DISTINCT p_type, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM part")
def _(spark, d):
    return fx.read(spark, d, "part").select("p_type", normalize_name(F.col("p_type")).alias("name")).distinct()


@query("coerce_numeric", f"SELECT p_partkey, {r6('TRY_CAST(split_part(p_brand, chr(35), 2) AS DOUBLE)')} AS code, {r6('TRY_CAST(p_name AS DOUBLE)')} AS word FROM part")
def _(spark, d):
    code = F.split_part("p_brand", F.lit("#"), F.lit(2))
    return fx.read(spark, d, "part").select("p_partkey", number(code).alias("code"), number("p_name").alias("word"))


FIRST = "SELECT c_nationkey AS k, {o} AS o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"


@query("dedupe_first", FIRST.format(o="min_by(o_orderkey, (o_totalprice, o_orderkey))"))
def _(spark, d):
    rows = fx.read(spark, d, "orders").join(fx.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("c_nationkey").alias("k"), "o_totalprice", "o_orderkey")
    return panel.dedupe(rows, ["k"], ["o_totalprice", "o_orderkey"]).select("k", "o_orderkey")


@query("dedupe_last", FIRST.format(o="max_by(o_orderkey, (o_totalprice, o_orderkey))"))
def _(spark, d):
    rows = fx.read(spark, d, "orders").join(fx.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("c_nationkey").alias("k"), "o_totalprice", "o_orderkey")
    return panel.dedupe(rows, ["k"], ["o_totalprice", "o_orderkey"], keep="last").select("k", "o_orderkey")


# ---- window features --------------------------------------------------------------------------

ALL_CASE = [*CASE, "cases_outbreak_index_4_8", "cases_outbreak_flag_4_8"]


def case_query(name: str, columns: list[str]) -> None:
    @query(name, sql(f"SELECT geo_id, week_start_date, {cols(columns)} FROM FE"))
    def _(spark, d):
        return features.case_features(fx.counts(spark, d)).select(*KEY, *columns)


for _name, _part in {
    "case_lags": "cases_lag_", "roll_mean_prev": "cases_rollmean_", "roll_sum_strict": "cases_recent_sum_", "roll_std_strict": "cases_recent_std_", "nonzero_recent": "cases_nonzero_recent_",
    "log_growth": "cases_growth_", "log_accel": "cases_accel_", "outbreak_index": "cases_outbreak_", "zero_runs": "cases_zero_run", "weeks_since_nonzero": "cases_weeks_since", "case_features": "cases_",
}.items():
    case_query(_name, [c for c in ALL_CASE if c.startswith(_part)])


@query("calendar_features", sql(f"SELECT geo_id, week_start_date, CAST(week_of_year AS BIGINT) AS week_of_year, {cols(['woy_sin', 'woy_cos'])}, CAST(monsoon_flag AS BIGINT) AS monsoon_flag FROM FE"))
def _(spark, d):
    return features.calendar(fx.counts(spark, d)).select(*KEY, *o.CALENDAR)


COV_ROLLS = o.covariate_columns((), (2, 4, 8), (2, 4, 8), True)
COV_LENIENT = o.covariate_columns((), (2, 4, 8), (2, 4, 8), False)
COV_LAGS = o.covariate_columns((1, 2, 4, 8), (), (), True)


def covariate_query(name: str, columns: dict, lags: tuple, means: tuple, strict: bool) -> None:
    @query(name, sql(f"SELECT geo_id, week_start_date, {', '.join(f'{r6(v)} AS {k}' for k, v in columns.items())} FROM FULLP"))
    def _(spark, d):
        out = features.covariate_features(fx.full_panel(spark, d), tuple(fx.COVS), lags, means, means, strict=strict)
        return out.select(*KEY, *columns)


covariate_query("covariate_lags", COV_LAGS, (1, 2, 4, 8), (), True)
covariate_query("covariate_rolls_strict", COV_ROLLS, (), (2, 4, 8), True)
covariate_query("covariate_rolls_lenient", COV_LENIENT, (), (2, 4, 8), False)


@query("seasonal_diff", sql(f"SELECT geo_id, week_start_date, {cols(['raw', 'log1p', 'diff_1', 'diff_52', 'log1p_diff_1', 'log1p_diff_52'])} FROM TX"))
def _(spark, d):
    return explore.seasonal_diff(fx.counts(spark, d))


@query("rolling_moments", sql(f"SELECT geo_id, week_start_date, {r6(o.strict('avg', 'cases', 8, 0, 4))} AS rolling_mean, {r6(o.strict('stddev_samp', 'cases', 8, 0, 4))} AS rolling_std FROM P"))
def _(spark, d):
    return explore.rolling_moments(fx.counts(spark, d))


@query("tail_mean", sql(f"SELECT geo_id, week_start_date, {r6(f'avg(cases) OVER ({o.W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)')} AS tail_mean FROM P"))
def _(spark, d):
    return naive.tail_mean(fx.counts(spark, d)).select(*KEY, "tail_mean")


def safe_corr_sql(x: str, y: str) -> str:
    return f"CASE WHEN stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) > 0 AND stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END) > 0 THEN corr({x}, {y}) END"


@query("autocorr", sql("SELECT geo_id, " + ", ".join(f"{r6(safe_corr_sql('cases', f'l{k}'))} AS acf_lag_{k}" for k in (1, 4, 13, 26, 52)) + " FROM (SELECT geo_id, cases, " + ", ".join(f"{o.lag('cases', k)} AS l{k}" for k in (1, 4, 13, 26, 52)) + " FROM P) GROUP BY geo_id"))
def _(spark, d):
    return explore.autocorr(fx.counts(spark, d))


@query("acf_table", sql(f"SELECT geo_id, lag, {r6('s / nullif(q, 0)')} AS acf, n_pairs FROM (SELECT a.geo_id, b.rn - a.rn AS lag, sum((a.cases - a.m) * (b.cases - b.m)) AS s, any_value(a.q) AS q, count(*) AS n_pairs FROM E1 a JOIN E1 b ON a.geo_id = b.geo_id AND b.rn - a.rn BETWEEN 1 AND 60 GROUP BY 1, 2)").replace(" SELECT geo_id, lag,", ", E0 AS (SELECT *, avg(cases) OVER (PARTITION BY geo_id) AS m FROM N), E1 AS (SELECT *, sum((cases - m) * (cases - m)) OVER (PARTITION BY geo_id) AS q FROM E0) SELECT geo_id, lag,", 1).replace("WITH ,", f"WITH RAW AS ({o.STEPS['RAW']}), P AS ({o.STEPS['P'][-1]}), N AS ({o.STEPS['N'][-1]}),"))
def _(spark, d):
    return explore.acf_table(fx.counts(spark, d))


# ---- exploration ------------------------------------------------------------------------------

SUMMARY = f"""SELECT geo_id, min(week_start_date) AS start_date, max(week_start_date) AS end_date, count(*) AS weeks, CAST(0 AS BIGINT) AS missing_weeks,
{r6('100.0 * count(*) FILTER (cases = 0) / count(*)')} AS zero_pct, {r6('avg(cases)')} AS mean_cases, {r6('quantile_cont(cases, 0.5)')} AS median_cases, {r6('stddev_samp(cases)')} AS std_cases,
{r6('stddev_samp(cases) / avg(cases)')} AS cv, {r6('max(cases)')} AS max_cases, {r6('quantile_cont(cases, 0.95)')} AS p95_cases, {r6('quantile_cont(cases, 0.99)')} AS p99_cases, {r6('sum(cases)')} AS sum_cases,
{r6('skewness(cases)')} AS skewness, {r6('var_samp(cases) / avg(cases)')} AS variance_to_mean, {r6('sum(cases) FILTER (k <= greatest(ceil(n * 0.1), 1)) / sum(cases)')} AS top_10pct_weeks_share
FROM (SELECT *, row_number() OVER (PARTITION BY geo_id ORDER BY cases DESC) AS k, count(*) OVER (PARTITION BY geo_id) AS n FROM P) GROUP BY 1"""


@query("series_summary", sql(SUMMARY))
def _(spark, d):
    return explore.series_summary(fx.counts(spark, d))


@query("top_share", sql(f"SELECT geo_id, {r6('sum(cases) FILTER (k <= greatest(ceil(n * 0.1), 1)) / sum(cases)')} AS top_10pct_weeks_share FROM (SELECT *, row_number() OVER (PARTITION BY geo_id ORDER BY cases DESC) AS k, count(*) OVER (PARTITION BY geo_id) AS n FROM P) GROUP BY 1"))
def _(spark, d):
    return explore.top_share(fx.counts(spark, d))


@query("covariate_coverage", sql(" UNION ALL ".join(f"SELECT geo_id, '{c}' AS covariate, count({c}) AS non_null_weeks, {r6(f'100.0 * count({c}) / count(*)')} AS pct_non_null, min(week_start_date) FILTER ({c} IS NOT NULL) AS first_non_null_date, max(week_start_date) FILTER ({c} IS NOT NULL) AS last_non_null_date FROM GAP GROUP BY 1" for c in fx.COVS)))
def _(spark, d):
    return explore.covariate_coverage(fx.gap_panel(spark, d), fx.COVS)


GAPS = "SELECT geo_id, max(week_start_date) FILTER (rain IS NOT NULL) AS last_covariate_week, (SELECT max(week_start_date) FROM GAP) AS latest_case_week, CAST(floor(((SELECT max(week_start_date) FROM GAP) - max(week_start_date) FILTER (rain IS NOT NULL)) / 7) AS BIGINT) AS gap_weeks FROM GAP GROUP BY 1"


@query("coverage_gap", sql(GAPS))
def _(spark, d):
    return explore.coverage_gap(fx.gap_panel(spark, d))


@query("annual_peaks", sql(f"SELECT geo_id, CAST(year(week_start_date) AS BIGINT) AS year, {r6('sum(cases)')} AS annual_total_cases, arg_min(week_start_date, (-cases, week_start_date)) AS peak_week_start, {r6('max(cases)')} AS peak_cases, {r6('max(cases) / nullif(sum(cases), 0)')} AS peak_share_of_year FROM P GROUP BY 1, 2"))
def _(spark, d):
    return explore.annual_peaks(fx.counts(spark, d))


@query("week_profile", sql(f"SELECT geo_id, CAST(weekofyear(week_start_date) AS BIGINT) AS week, {r6('avg(cases)')} AS mean_cases FROM P GROUP BY 1, 2"))
def _(spark, d):
    return explore.week_profile(fx.counts(spark, d))


SEASON = f"SELECT geo_id, CAST(arg_min(week, (-m, week)) AS BIGINT) AS peak_week_of_year, {r6('max(m) / nullif(avg(m), 0)')} AS seasonality_index FROM (SELECT geo_id, weekofyear(week_start_date) AS week, avg(cases) AS m FROM P GROUP BY 1, 2) GROUP BY 1"


@query("seasonality_index", sql(SEASON))
def _(spark, d):
    return explore.seasonality_index(fx.counts(spark, d))


@query("dataset_overview", sql("SELECT (SELECT CAST(count(*) AS BIGINT) FROM P) AS n_case_rows_long, (SELECT count(DISTINCT geo_id) FROM P) AS n_geos, (SELECT min(week_start_date) FROM P) AS case_date_min, (SELECT max(week_start_date) FROM P) AS case_date_max, (SELECT count(*) FROM COV) AS n_weather_rows_long, (SELECT min(week_start_date) FROM COV) AS weather_date_min, (SELECT max(week_start_date) FROM COV) AS weather_date_max, (SELECT count(*) FROM FULLP) AS n_panel_rows, CAST(floor(((SELECT max(week_start_date) FROM P) - (SELECT max(week_start_date) FROM COV)) / 7) AS BIGINT) AS weather_gap_weeks_to_latest_cases"))
def _(spark, d):
    return explore.dataset_overview(fx.counts(spark, d), fx.covariates(spark, d), fx.full_panel(spark, d))


BASE_HORIZONS = list(range(1, 13))


def baseline_sql() -> str:
    parts = []
    for h in BASE_HORIZONS:
        for m, p in (("persistence", "a.cases"), ("seasonal_naive", "c.cases")):
            parts.append(f"SELECT a.geo_id, CAST({h} AS BIGINT) AS horizon, '{m}' AS model, b.cases - {p} AS e FROM P a JOIN P b ON a.geo_id = b.geo_id AND b.week_start_date = a.week_start_date + {7 * h} LEFT JOIN P c ON c.geo_id = a.geo_id AND c.week_start_date = a.week_start_date - 364")
    return f"SELECT geo_id, horizon, model, count(*) AS n_obs, avg(abs(e)) AS MAE, sqrt(avg(e * e)) AS RMSE FROM ({' UNION ALL '.join(parts)}) WHERE e IS NOT NULL GROUP BY 1, 2, 3"


@query("baseline_forecastability", sql(f"SELECT geo_id, horizon, model, n_obs, {cols(['MAE', 'RMSE'])} FROM ({baseline_sql()})"))
def _(spark, d):
    return explore.baseline_forecastability(fx.counts(spark, d), BASE_HORIZONS)


@query("forecastability_macro", sql(f"SELECT model, horizon, {r6('avg(MAE)')} AS MAE_macro, {r6('avg(RMSE)')} AS RMSE_macro, count(*) AS n_geos FROM ({baseline_sql()}) GROUP BY 1, 2"))
def _(spark, d):
    return explore.forecastability_macro(explore.baseline_forecastability(fx.counts(spark, d), BASE_HORIZONS))


@query("best_baseline", sql(f"SELECT horizon, model, MAE_macro, RMSE_macro, n_geos FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY MAE_macro, model) AS k FROM (SELECT model, horizon, {r6('avg(MAE)')} AS MAE_macro, {r6('avg(RMSE)')} AS RMSE_macro, count(*) AS n_geos FROM ({baseline_sql()}) GROUP BY 1, 2)) WHERE k = 1"))
def _(spark, d):
    return explore.best_baseline(tidy(explore.forecastability_macro(explore.baseline_forecastability(fx.counts(spark, d), BASE_HORIZONS))))


MAX_LAG = 12


def lead_lag_sql() -> str:
    lags = ", ".join(f"{{'c': '{c}', 'k': {k}, 'x': {o.lag(c, k) if k else c}}}" for c in fx.COVS for k in range(MAX_LAG + 1))
    rows = f"SELECT geo_id, s.c AS covariate, s.k AS lag_weeks, y, s.x AS x FROM (SELECT geo_id, CAST(cases AS DOUBLE) AS y, unnest([{lags}]) AS s FROM FULLP)"
    ranked = f"SELECT *, rank() OVER (g ORDER BY x) + (count(*) OVER (PARTITION BY geo_id, covariate, lag_weeks, x) - 1) / 2.0 AS rx, rank() OVER (g ORDER BY y) + (count(*) OVER (PARTITION BY geo_id, covariate, lag_weeks, y) - 1) / 2.0 AS ry FROM ({rows}) WHERE x IS NOT NULL AND y IS NOT NULL WINDOW g AS (PARTITION BY geo_id, covariate, lag_weeks)"
    return f"SELECT geo_id, covariate, CAST(lag_weeks AS BIGINT) AS lag_weeks, count(*) AS n_obs, {safe_corr_sql('x', 'y')} AS pearson_corr, {safe_corr_sql('rx', 'ry')} AS spearman_corr FROM ({ranked}) GROUP BY 1, 2, 3 HAVING count(*) >= 30 AND count(DISTINCT x) >= 3"


@query("lead_lag", sql(f"SELECT geo_id, covariate, lag_weeks, n_obs, {cols(['pearson_corr', 'spearman_corr'])} FROM ({lead_lag_sql().replace('(g ORDER BY', '(PARTITION BY geo_id, covariate, lag_weeks ORDER BY').replace(' WINDOW g AS (PARTITION BY geo_id, covariate, lag_weeks)', '')})"))
def _(spark, d):
    return explore.lead_lag(fx.full_panel(spark, d), fx.COVS, MAX_LAG)


@query("lead_lag_best", sql(f"SELECT geo_id, covariate, lag_weeks, n_obs, {cols(['pearson_corr', 'spearman_corr'])} FROM (SELECT *, row_number() OVER (PARTITION BY geo_id, covariate ORDER BY round(abs(spearman_corr), 12) DESC NULLS LAST, lag_weeks) AS k FROM ({lead_lag_sql().replace('(g ORDER BY', '(PARTITION BY geo_id, covariate, lag_weeks ORDER BY').replace(' WINDOW g AS (PARTITION BY geo_id, covariate, lag_weeks)', '')})) WHERE k = 1"))
def _(spark, d):
    return explore.lead_lag_best(explore.lead_lag(fx.full_panel(spark, d), fx.COVS, MAX_LAG))


PAIRS = [("NATION_12", "NATION_17"), ("NATION_12", "NATION_2"), ("NATION_0", "NATION_10")]


@query("pair_spearman", sql(f"SELECT geo_a, geo_b, count(*) AS n_obs, {r6(safe_corr_sql('rx', 'ry'))} AS spearman FROM (SELECT geo_a, geo_b, rank() OVER (PARTITION BY geo_a, geo_b ORDER BY x) + (count(*) OVER (PARTITION BY geo_a, geo_b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY geo_a, geo_b ORDER BY y) + (count(*) OVER (PARTITION BY geo_a, geo_b, y) - 1) / 2.0 AS ry FROM (SELECT geo_a, geo_b, a.cases AS x, b.cases AS y FROM (VALUES {', '.join(map(str, PAIRS))}) v(geo_a, geo_b) JOIN P a ON a.geo_id = geo_a JOIN P b ON b.geo_id = geo_b AND b.week_start_date = a.week_start_date)) GROUP BY 1, 2"))
def _(spark, d):
    values = ", ".join(map(str, PAIRS))
    return explore.pair_spearman(fx.counts(spark, d), spark.sql(f"SELECT * FROM VALUES {values} AS v(geo_a, geo_b)"))


ALL_PAIRS = f"SELECT geo_a, geo_b, count(*) AS n_obs, {safe_corr_sql('rx', 'ry')} AS spearman FROM (SELECT geo_a, geo_b, rank() OVER (PARTITION BY geo_a, geo_b ORDER BY x) + (count(*) OVER (PARTITION BY geo_a, geo_b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY geo_a, geo_b ORDER BY y) + (count(*) OVER (PARTITION BY geo_a, geo_b, y) - 1) / 2.0 AS ry FROM (SELECT a.geo_id AS geo_a, b.geo_id AS geo_b, a.cases AS x, b.cases AS y FROM P a JOIN P b ON b.week_start_date = a.week_start_date AND a.geo_id <> b.geo_id)) GROUP BY 1, 2"


@query("strongest_partners", sql(f"SELECT geo_id, rank, partner, n_obs, {r6('spearman')} AS spearman FROM (SELECT geo_a AS geo_id, geo_b AS partner, n_obs, spearman, row_number() OVER (PARTITION BY geo_a ORDER BY round(abs(spearman), 9) DESC, geo_b) AS rank FROM ({ALL_PAIRS}) WHERE spearman IS NOT NULL) WHERE rank <= 5"))
def _(spark, d):
    return explore.strongest_partners(fx.counts(spark, d))


@query("top_lead_lags", sql(f"SELECT geo_id, covariate, lag_weeks, n_obs, {cols(['pearson_corr', 'spearman_corr'])} FROM (SELECT *, row_number() OVER (PARTITION BY geo_id, covariate ORDER BY round(abs(spearman_corr), 12) DESC NULLS LAST, lag_weeks) AS k FROM ({lead_lag_sql().replace('(g ORDER BY', '(PARTITION BY geo_id, covariate, lag_weeks ORDER BY').replace(' WINDOW g AS (PARTITION BY geo_id, covariate, lag_weeks)', '')})) WHERE k = 1 AND spearman_corr IS NOT NULL ORDER BY round(abs(spearman_corr), 12) DESC, geo_id, covariate LIMIT 5"))
def _(spark, d):
    return explore.top_lead_lags(explore.lead_lag_best(explore.lead_lag(fx.full_panel(spark, d), fx.COVS, MAX_LAG)))


STRENGTH = """SELECT geo_id, CASE WHEN s > 0 THEN greatest(0.0, 1 - r / s) END AS seasonal_strength, CASE WHEN t > 0 THEN greatest(0.0, 1 - r / t) END AS trend_strength FROM (SELECT geo_id, var_samp(d - season) AS r, var_samp(d) AS s, var_samp(d - season + trend) AS t
FROM (SELECT *, s - avg(CASE WHEN k = 1 THEN s END) OVER (PARTITION BY geo_id) AS season FROM (SELECT *, avg(d) OVER (PARTITION BY geo_id, pos) AS s, row_number() OVER (PARTITION BY geo_id, pos ORDER BY week_start_date) AS k FROM (SELECT *, y - trend AS d FROM (SELECT geo_id, week_start_date,
CAST(cases AS DOUBLE) AS y, (row_number() OVER g - 1) % 52 AS pos, CASE WHEN count(cases) OVER (g ROWS BETWEEN 26 PRECEDING AND 26 FOLLOWING) = 53 THEN (sum(cases) OVER (g ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) + (lag(cases, 26) OVER g + lead(cases, 26) OVER g) / 2.0) / 52.0 END AS trend
FROM P WINDOW g AS (PARTITION BY geo_id ORDER BY week_start_date))))) GROUP BY geo_id)"""


@query("seasonal_strength", sql(f"SELECT geo_id, {cols(['seasonal_strength', 'trend_strength'])} FROM ({STRENGTH})"))
def _(spark, d):
    return explore.seasonal_strength(fx.counts(spark, d))


ACF = "SELECT geo_id, " + ", ".join(f"{r6(safe_corr_sql('cases', f'l{k}'))} AS acf_lag_{k}" for k in (1, 52)) + " FROM (SELECT geo_id, cases, " + ", ".join(f"{o.lag('cases', k)} AS l{k}" for k in (1, 52)) + " FROM P) GROUP BY geo_id"


@query("dataset_summary", sql(f"SELECT s.geo_id, weeks, zero_pct, mean_cases, variance_to_mean, peak_week_of_year, {r6('seasonal_strength')} AS seasonal_strength, acf_lag_1, acf_lag_52, gap_weeks FROM ({SUMMARY}) s LEFT JOIN ({SEASON}) n ON n.geo_id = s.geo_id LEFT JOIN ({GAPS}) g ON g.geo_id = s.geo_id LEFT JOIN ({STRENGTH}) t ON t.geo_id = s.geo_id LEFT JOIN ({ACF}) a ON a.geo_id = s.geo_id"))
def _(spark, d):
    counts = fx.counts(spark, d)
    summary = explore.series_summary(counts).join(explore.seasonal_strength(counts), GEO, "left").join(explore.autocorr(counts, (1, 52)), GEO, "left")
    return explore.dataset_summary(summary, explore.seasonality_index(counts), explore.coverage_gap(fx.gap_panel(spark, d)))


@query("eda_top_lists", sql(f"(SELECT 'burstiest' AS list, geo_id AS item, variance_to_mean AS value FROM ({SUMMARY}) WHERE variance_to_mean IS NOT NULL ORDER BY round(variance_to_mean, 6) DESC, geo_id LIMIT 3) UNION ALL (SELECT 'seasonal', geo_id, seasonality_index FROM ({SEASON}) WHERE seasonality_index IS NOT NULL ORDER BY round(seasonality_index, 6) DESC, geo_id LIMIT 3) UNION ALL (SELECT 'zero_heavy', geo_id, zero_pct FROM ({SUMMARY}) WHERE zero_pct IS NOT NULL ORDER BY round(zero_pct, 6) DESC, geo_id LIMIT 3)"))
def _(spark, d):
    counts = fx.counts(spark, d)
    summary = tidy(explore.series_summary(counts))
    a = explore.top_list(summary, "burstiest", "variance_to_mean").unionByName(explore.top_list(summary, "zero_heavy", "zero_pct"))
    return a.unionByName(explore.top_list(tidy(explore.seasonality_index(counts)), "seasonal", "seasonality_index"))


TRANSFORMS = ["raw", "log1p", "diff_1", "diff_52", "log1p_diff_1", "log1p_diff_52"]
KPSS_P = "CASE WHEN stat <= 0.347 THEN 0.1 WHEN stat <= 0.463 THEN 0.1 - (stat - 0.347) * 0.05 / 0.116 WHEN stat <= 0.574 THEN 0.05 - (stat - 0.463) * 0.025 / 0.111 WHEN stat <= 0.739 THEN 0.025 - (stat - 0.574) * 0.015 / 0.165 WHEN stat > 0.739 THEN 0.01 END"


@query("kpss_stat", sql(f"SELECT geo_id, transform, n_obs, {r6('stat')} AS kpss_stat, {r6(KPSS_P)} AS kpss_pvalue FROM (SELECT *, CASE WHEN n_obs >= 20 AND levels >= 3 THEN eta / n_obs / nullif(spread, 0) END AS stat FROM (SELECT geo_id, transform, count(*) AS n_obs, count(DISTINCT x) AS levels, sum(run * run) AS eta, sum(e * e) + 2 * sum(0.8 * coalesce(e * l1, 0) + 0.6 * coalesce(e * l2, 0) + 0.4 * coalesce(e * l3, 0) + 0.2 * coalesce(e * l4, 0)) AS spread FROM (SELECT *, sum(e) OVER (PARTITION BY geo_id, transform ORDER BY week_start_date ROWS UNBOUNDED PRECEDING) AS run, " + ", ".join(f"lag(e, {k}) OVER (PARTITION BY geo_id, transform ORDER BY week_start_date) AS l{k}" for k in range(1, 5)) + " FROM (SELECT *, x - avg(x) OVER (PARTITION BY geo_id, transform) AS e FROM (" + " UNION ALL ".join(f"SELECT geo_id, week_start_date, '{t}' AS transform, {t} AS x FROM TX" for t in TRANSFORMS) + ") WHERE x IS NOT NULL)) GROUP BY 1, 2))"))
def _(spark, d):
    return stationarity.kpss(explore.transforms_long(fx.counts(spark, d)), 4)


@query("stationary_count")
def _(spark, d):
    return explore.stationary_count(stationarity.stationarity(fx.counts(spark, d)))


@query("adf_stat")
def _(spark, d):
    return stationarity.adf(explore.transforms_long(fx.counts(spark, d)))


@query("stationarity")
def _(spark, d):
    return stationarity.stationarity(fx.counts(spark, d))


# ---- files: written from the tables, and read back -------------------------------------------------

READ = "SELECT *, cases % 7 AS k FROM P"


@query("unpivot_counts", sql(f"SELECT geo_id, geo_id AS geo_name, week_start_date, CAST(CASE WHEN k = 1 THEN 0 ELSE cases END AS BIGINT) AS cases FROM ({READ}) WHERE k <> 2"))
def _(spark, d):
    folders, nodes = fx.wide_count_files(spark, d)
    return sources.load_counts(spark, folders[0], nodes=nodes, keep=None)


@query("malformed_lines", sql("SELECT count(DISTINCT week_start_date) + count(DISTINCT year(week_start_date)) AS n_lines, count(DISTINCT year(week_start_date)) AS n_malformed FROM P"))
def _(spark, d):
    return sources.line_counts(sources.read_checked_csv(spark, fx.wide_count_files(spark, d)[0]))


@query("truth_melt", sql(f"SELECT geo_id, week_start_date AS target_week, CASE k WHEN 1 THEN -CAST(cases AS DOUBLE) WHEN 3 THEN cases + 0.9 WHEN 2 THEN NULL ELSE cases END AS y_true FROM ({READ})"))
def _(spark, d):
    folders, nodes = fx.wide_count_files(spark, d)
    return sources.melt_truth(sources.read_text_csv(spark, folders[0]), {h: n for h, (n, _) in nodes.items()})


@query("metric_union", sql(f"SELECT model, fold_id AS fold, role, CAST(horizon AS BIGINT) AS horizon, {r6('MAE_macro')} AS MAE, {r6('RMSE_macro')} AS RMSE FROM MACRO WHERE level = 'by_fold_horizon' AND model IN ('persistence', 'tail_mean_4')"))
def _(spark, d):
    folder = sinks.shared_path(spark, "metrics")
    rows = fx.macro_level(spark, d, "by_fold_horizon")
    sinks.save_metric_files(rows.select("model", F.col("fold_id").alias("fold"), "role", "horizon", F.col("MAE_macro").alias("MAE"), F.col("RMSE_macro").alias("RMSE")), folder)
    return artifacts.metric_union(spark, folder, ["persistence", "tail_mean_4"])


@query("stored_panel", sql("SELECT geo_id, geo_name, week_start_date, CAST(cases AS BIGINT) AS cases FROM P"))
def _(spark, d):
    return fx.bucketed_counts(spark, d).select(GEO, "geo_name", WEEK, VALUE)


@query("stored_features", sql(f"SELECT geo_id, week_start_date, {cols(CASE)} FROM FE"))
def _(spark, d):
    return features.case_features(fx.bucketed_counts(spark, d)).select(*KEY, *CASE)


@query("supervised_join", sql(f"SELECT geo_id, week_start_date, target_week, CAST(horizon AS BIGINT) AS horizon, fold_id, role, split_group, {cols(['y_true', 'cases_lag_1', 'cases_rollmean_4', 'woy_sin'])} FROM SU"))
def _(spark, d):
    out = splits.supervised_frame(fx.feature_panel(spark, d), fx.fold_splits(spark, d), fx.counts(spark, d))
    return out.select(*KEY, TARGET_WEEK, "horizon", "fold_id", "role", "split_group", "y_true", "cases_lag_1", "cases_rollmean_4", "woy_sin")


# ---- folds and supervised frames --------------------------------------------------------------


@query("rolling_origin_splits", sql("SELECT geo_id, week_start_date, CAST(horizon AS BIGINT) AS horizon, target_week, role, fold_id, split_group FROM SP"))
def _(spark, d):
    return fx.fold_splits(spark, d)


@query("split_counts", sql('SELECT fold_id, CAST(horizon AS BIGINT) AS horizon, role, count(*) AS "rows" FROM SP GROUP BY 1, 2, 3'))
def _(spark, d):
    return splits.split_counts(fx.fold_splits(spark, d))


SUPERVISED = f"SELECT geo_id, week_start_date, CAST(horizon AS BIGINT) AS horizon, target_week, role, fold_id, split_group, {cols(['y_true', *ALL_CASE])} FROM SU"


@query("supervised_frame", sql(SUPERVISED))
def _(spark, d):
    return fx.supervised(spark, d).select(*KEY, "horizon", TARGET_WEEK, "role", "fold_id", "split_group", "y_true", *ALL_CASE)


@query("full_training_pairs", sql(f"SELECT FP.geo_id, FP.week_start_date, CAST(h AS BIGINT) AS horizon, t.week_start_date AS target_week, {cols(['cases_lag_52', 'cases_rollmean_4'])}, {r6('t.cases')} AS y_true FROM FP CROSS JOIN (VALUES (1), (2), (3), (4)) v(h) JOIN P t ON t.geo_id = FP.geo_id AND t.week_start_date = FP.week_start_date + 7 * h"))
def _(spark, d):
    out = splits.training_pairs_from_panel(fx.counts(spark, d), "operational", fx.HORIZONS)
    return out.select(*KEY, "horizon", TARGET_WEEK, "cases_lag_52", "cases_rollmean_4", "y_true")


@query("latest_origin", sql("SELECT geo_id, week_start_date, CAST(h AS BIGINT) AS horizon, CAST(week_start_date + 7 * h AS DATE) AS target_week FROM FP CROSS JOIN (VALUES (1), (2), (3), (4)) v(h) WHERE week_start_date = (SELECT max(week_start_date) FROM FP)"))
def _(spark, d):
    return splits.latest_origin(fx.feature_panel(spark, d), fx.HORIZONS).select(*KEY, "horizon", TARGET_WEEK)


CEILING = dt.date(2000, 1, 3)


@query("asof_ceiling", sql("SELECT geo_id, week_start_date, CAST(cases AS BIGINT) AS cases FROM P WHERE week_start_date <= DATE '2000-01-03'"))
def _(spark, d):
    return splits.asof_ceiling(fx.counts(spark, d), CEILING).select(*KEY, VALUE)


@query("gap_splits", sql("SELECT geo_id, week_start_date, target_week, CAST(horizon AS BIGINT) AS horizon, role, fold_id FROM SP UNION SELECT geo_id, week_start_date, CAST(week_start_date + 7 * h AS DATE), CAST(h AS BIGINT), 'val', 'gap' FROM FP CROSS JOIN (VALUES (1), (2), (3), (4)) v(h) WHERE week_start_date + 7 * h BETWEEN DATE '2001-05-14' AND DATE '2001-07-30'"))
def _(spark, d):
    return splits.gap_splits(fx.feature_panel(spark, d), fx.fold_splits(spark, d), fx.GAP_FROM, dt.date(2001, 7, 30), fx.HORIZONS, splits.next_fold_id([f.name for f in fx.FOLDS]))


@query("label_lookup", sql(f"SELECT SP.geo_id, SP.week_start_date, CAST(horizon AS BIGINT) AS horizon, target_week, role, fold_id, split_group, {r6('t.cases')} AS y_true, {r6('a.cases')} AS y_pred FROM SP LEFT JOIN P t ON t.geo_id = SP.geo_id AND t.week_start_date = target_week LEFT JOIN P a ON a.geo_id = SP.geo_id AND a.week_start_date = SP.week_start_date"))
def _(spark, d):
    return splits.label_lookup(fx.fold_splits(spark, d), fx.counts(spark, d))


@query("track_summary", sql('SELECT split_group, string_agg(fold_id, \',\' ORDER BY fold_id) AS fold_ids, \'1,2,3,4\' AS horizons, CAST(32 AS BIGINT) AS feature_count, CAST((SELECT count(*) FROM FP) AS BIGINT) AS "rows", (SELECT count(DISTINCT geo_id) FROM FP) AS geographies, (SELECT min(week_start_date) FROM FP) AS weeks_start, (SELECT max(week_start_date) FROM FP) AS weeks_end, CAST(0 AS BIGINT) AS proxy_geographies FROM (SELECT DISTINCT split_group, fold_id FROM SP) GROUP BY 1'))
def _(spark, d):
    out = splits.track_summary(fx.feature_panel(spark, d), fx.fold_splits(spark, d))
    return out.select("split_group", "fold_ids", "horizons", "feature_count", "rows", "geographies", "weeks_start", "weeks_end", "proxy_geographies")


# ---- naive forecasts and errors ---------------------------------------------------------------


@query("persistence", sql(f"SELECT geo_id, fold_id, CAST(horizon AS BIGINT) AS horizon, role, {r6(f'avg(abs({ERR}))')} AS MAE, count(*) AS n FROM PRED WHERE model = 'persistence' GROUP BY 1, 2, 3, 4"))
def _(spark, d):
    rows = naive.persistence(fx.supervised(spark, d))
    return rows.groupBy(GEO, "fold_id", "horizon", "role").agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("MAE"), F.count("*").alias("n"))


@query("seasonal_naive", sql(f"SELECT geo_id, week_start_date, CAST(horizon AS BIGINT) AS horizon, fold_id, {r6('coalesce(last_year, cases)')} AS y_pred FROM SU"))
def _(spark, d):
    rows = fx.supervised(spark, d)
    return naive.seasonal_naive(rows, fx.counts(spark, d)).select(*KEY, "horizon", "fold_id", "y_pred")


@query("seasonal_naive_tail", sql(f"SELECT SP.geo_id, SP.week_start_date, CAST(horizon AS BIGINT) AS horizon, fold_id, {r6('coalesce(l.cases, (SELECT 0))')} AS y_pred FROM SP LEFT JOIN P l ON l.geo_id = SP.geo_id AND l.week_start_date = target_week - 364"))
def _(spark, d):
    return naive.seasonal_naive_tail(fx.fold_splits(spark, d), fx.counts(spark, d)).select(*KEY, "horizon", "fold_id", "y_pred")


@query("metric_frame", sql(f"SELECT track, split_group, model, fold_id, role, geo_id, CAST(horizon AS BIGINT) AS horizon, {METRIC6} FROM PRED GROUP BY ALL"))
def _(spark, d):
    return metrics.metric_frame(fx.predictions(spark, d), metrics.FULL_KEYS)


def cube_sql() -> str:
    parts = []
    for level, keys in metrics.CUBE.items():
        own = ", ".join(k if k in keys else f"NULL AS {k}" for k in metrics.FULL_KEYS).replace(", horizon", ", CAST(horizon AS BIGINT) AS horizon")
        parts.append(f"SELECT '{level}' AS level, {own}, {METRIC6} FROM PRED GROUP BY ALL")
    return " UNION ALL ".join(parts)


@query("metric_cube", sql(cube_sql()))
def _(spark, d):
    return metrics.metric_cube(fx.predictions(spark, d))


MACROS = ["MAE_macro", "RMSE_macro", "bias_macro"]


@query("macro_average", sql(f"SELECT level, track, split_group, model, fold_id, role, geo_id, CAST(horizon AS BIGINT) AS horizon, n_groups, {cols(MACROS)} FROM MACRO"))
def _(spark, d):
    return fx.macro(spark, d)


@query("segment_metrics", sql(f"SELECT model, origin_bucket, {r6('avg(cases)')} AS mean_origin, {METRIC6} FROM FLAG GROUP BY 1, 2"))
def _(spark, d):
    return metrics.segment_metrics(fx.flagged(spark, d), ["model", "origin_bucket"])


def geo_macro(keys: str, where: str = "true", source: str = "FLAG") -> str:
    return f"SELECT {keys}, count(*) AS n_geos, {r6('avg(MAE)')} AS MAE_macro, {r6('avg(RMSE)')} AS RMSE_macro, {r6('avg(bias)')} AS bias_macro FROM (SELECT {keys}, geo_id, {o.METRICS} FROM {source} WHERE {where} GROUP BY ALL) GROUP BY ALL"


@query("macro_geo", sql(geo_macro("model, outbreak_flag").replace("model, outbreak_flag, count", "model, CAST(outbreak_flag AS BIGINT) AS outbreak_flag, count")))
def _(spark, d):
    return metrics.macro_geo(fx.flagged(spark, d), ["model", "outbreak_flag"])


@query("role_horizon_metrics", sql(f"SELECT 'naive' AS source, role, CAST(horizon AS BIGINT) AS horizon, {r6(f'avg(abs({ERR}))')} AS MAE, {r6(f'sqrt(avg({ERR} * {ERR}))')} AS RMSE FROM PRED GROUP BY role, horizon UNION ALL SELECT 'naive', role, NULL, {r6(f'avg(abs({ERR}))')}, {r6(f'sqrt(avg({ERR} * {ERR}))')} FROM PRED GROUP BY role"))
def _(spark, d):
    return metrics.role_horizon_metrics(fx.predictions(spark, d), "naive")


@query("mae_by_geo", sql(f"SELECT geo_id, {r6(f'avg(abs({ERR}))')} AS MAE FROM PRED GROUP BY 1"))
def _(spark, d):
    return metrics.mae_by_geo(fx.predictions(spark, d))


def bucket_sql(value: str, aggs: str) -> str:
    edges = f"SELECT list_sort(list_distinct(quantile_cont({value}, [{', '.join(str(i / 10) for i in range(11))}]))) AS e FROM PRED"
    place = f"SELECT PRED.*, e, greatest(len(list_filter(e, lambda x: x < {value})), 1) - 1 AS bucket FROM PRED, EDGES"
    return f", EDGES AS ({edges}), B AS ({place}) SELECT CAST(bucket AS BIGINT) AS bucket, {r6('e[bucket + 1]')} AS lower, {r6('e[least(bucket + 2, len(e))]')} AS upper, {aggs} FROM B GROUP BY 1, 2, 3"


def with_more(head: str, more: str) -> str:
    """The steps that head needs, then more steps and a query."""
    return sql(f"SELECT 1 FROM {head}").rsplit(" SELECT 1 FROM ", 1)[0] + more


@query("error_by_decile", with_more("PRED", bucket_sql("y_true", f'count(*) AS "count", {r6(f"avg(abs({ERR}))")} AS MAE')))
def _(spark, d):
    return metrics.error_by_quantile(fx.predictions(spark, d))


@query("calibration_deciles", with_more("PRED", bucket_sql("y_pred", f"{r6('avg(y_true)')} AS mean_y, {r6('avg(y_pred)')} AS mean_pred")))
def _(spark, d):
    return metrics.calibration(fx.predictions(spark, d))


WINDOWS = {"pre": (dt.date(2001, 1, 1), dt.date(2001, 3, 31)), "gap": (dt.date(2001, 5, 14), dt.date(2001, 7, 30)), "after": (dt.date(2005, 1, 1), dt.date(2005, 2, 1))}
WINDOW_VALUES = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, (a, b) in WINDOWS.items())
WINDOW_SQL = f"SELECT w, model, horizon, avg(abs({ERR})) AS MAE, sqrt(avg({ERR} * {ERR})) AS RMSE FROM PRED JOIN (VALUES {WINDOW_VALUES}) v(w, a, b) ON target_week BETWEEN a AND b WHERE fold_id = 'X1' AND role = 'val' GROUP BY 1, 2, 3"


def windowed(spark, d, keys=("model", "horizon")):
    pred = fx.predictions(spark, d).filter("fold_id = 'X1' AND role = 'val'")
    truth = fx.counts(spark, d).select(GEO, F.col(WEEK).alias(TARGET_WEEK), F.col(VALUE).cast("double").alias("y_true"))
    return metrics.window_metrics(pred, truth, WINDOWS, list(keys))


@query("window_metrics", sql(f'SELECT w AS "window", model, CAST(horizon AS BIGINT) AS horizon, {cols(["MAE", "RMSE"])} FROM ({WINDOW_SQL})'))
def _(spark, d):
    return windowed(spark, d)


@query("gap_impact_pivot", sql("SELECT model, CAST(horizon AS BIGINT) AS horizon, " + ", ".join(f"{r6(f'max({m}) FILTER (w = {n!r})')} AS {n}_{m}" for n in WINDOWS for m in ("MAE", "RMSE")) + f" FROM ({WINDOW_SQL}) GROUP BY 1, 2"))
def _(spark, d):
    return metrics.gap_impact(windowed(spark, d), list(WINDOWS), ["model", "horizon"])


GEO_WINDOW_SQL = WINDOW_SQL.replace("SELECT w, model, horizon,", "SELECT w, model, geo_id, horizon,").replace("GROUP BY 1, 2, 3", "GROUP BY 1, 2, 3, horizon")


@query("gap_impact_by_geo", sql("SELECT model, geo_id, CAST(horizon AS BIGINT) AS horizon, " + ", ".join(f"{r6(f'max({m}) FILTER (w = {n!r})')} AS {n}_{m}" for n in WINDOWS for m in ("MAE", "RMSE")) + f" FROM ({GEO_WINDOW_SQL}) GROUP BY 1, 2, horizon"))
def _(spark, d):
    keys = ["model", GEO, "horizon"]
    return metrics.gap_impact(windowed(spark, d, keys), list(WINDOWS), keys)


# ---- boards and regimes -----------------------------------------------------------------------

OVERALL = "SELECT * FROM MACRO WHERE level = 'overall' AND role = 'val'"


def overall(spark, d):
    return fx.macro_level(spark, d, "overall").drop("level", "fold_id", GEO, "horizon")


@query("leaderboard", sql(f"SELECT track, split_group, model, role, n_groups, {cols(MACROS)} FROM MACRO WHERE level = 'overall' AND role = 'val' AND split_group = 'development'"))
def _(spark, d):
    return boards.leaderboard(overall(spark, d), "development")


BY_HORIZON = "SELECT track, model, horizon, avg(MAE_macro) AS MAE_macro, avg(RMSE_macro) AS RMSE_macro FROM MACRO WHERE level = 'by_fold_horizon' AND role = 'val' AND split_group = 'development' GROUP BY 1, 2, 3"


@query("leaderboard_by_horizon", sql(f"SELECT track, model, CAST(horizon AS BIGINT) AS horizon, {cols(MACROS[:2])} FROM ({BY_HORIZON})"))
def _(spark, d):
    return boards.leaderboard_by_horizon(fx.macro_level(spark, d, "by_fold_horizon"), "development")


@query("horizon_mae", sql(f"SELECT CAST(horizon AS BIGINT) AS horizon, model, {cols(['MAE_macro'])} FROM ({BY_HORIZON})"))
def _(spark, d):
    return boards.horizon_mae(fx.macro_level(spark, d, "by_fold_horizon"), "operational")


ORDER = "round(MAE_macro, 9), round(RMSE_macro, 9), model"


def rounded(df):
    return df.withColumns({c: F.round(c, 9) for c in MACROS if c in df.columns})


@query("fold_winners", sql(f"SELECT track, fold_id, model, {cols(MACROS[:2])} FROM (SELECT *, row_number() OVER (PARTITION BY track, fold_id ORDER BY {ORDER}) AS k FROM MACRO WHERE level = 'by_fold' AND role = 'val' AND split_group = 'development') WHERE k = 1"))
def _(spark, d):
    return boards.fold_winners(rounded(fx.macro_level(spark, d, "by_fold"))).select("track", "fold_id", "model", *MACROS[:2])


@query("horizon_winners", sql(f"SELECT track, 'development' AS split_group, CAST(horizon AS BIGINT) AS horizon, model, {cols(MACROS[:2])} FROM (SELECT *, row_number() OVER (PARTITION BY track, horizon ORDER BY {ORDER}) AS k FROM ({BY_HORIZON})) WHERE k = 1"))
def _(spark, d):
    return boards.horizon_winners(rounded(boards.leaderboard_by_horizon(fx.macro_level(spark, d, "by_fold_horizon"), "development")), "development")


@query("geo_model_summary", sql("SELECT geo_id, model, " + ", ".join(f"{r6(f'avg({c})')} AS {c}" for c in MACROS) + " FROM MACRO WHERE level = 'by_geo_horizon' AND role = 'val' AND split_group = 'development' GROUP BY 1, 2"))
def _(spark, d):
    return boards.geo_model_summary(fx.macro_level(spark, d, "by_geo_horizon"), "operational")


@query("evidence_fallback", sql(f"SELECT track, split_group, model, role, n_groups, {cols(MACROS)}, split_group AS ranking_source, row_number() OVER (PARTITION BY track ORDER BY {ORDER}) AS rank FROM MACRO WHERE level = 'overall' AND role = 'val' AND split_group = 'holdout'"))
def _(spark, d):
    return boards.evidence_fallback(rounded(overall(spark, d)), "operational")


@query("promotion_policy", sql(f"SELECT 'holdout' AS ranking_source, model AS primary_model, 'holdout_winner' AS promotion_policy FROM MACRO WHERE level = 'overall' AND role = 'val' AND split_group = 'holdout' ORDER BY {ORDER} LIMIT 1"))
def _(spark, d):
    return boards.promotion_policy(boards.evidence_fallback(rounded(overall(spark, d)), "operational"))


LEGACY = f"SELECT model, fold_id AS fold, role, horizon, avg(abs({ERR})) AS MAE, sqrt(avg({ERR} * {ERR})) AS RMSE FROM PRED GROUP BY 1, 2, 3, 4 UNION ALL SELECT model, fold_id, role, NULL, avg(abs({ERR})), sqrt(avg({ERR} * {ERR})) FROM PRED GROUP BY 1, 2, 3"


def legacy(spark, d):
    """(model, fold, role, horizon, MAE, RMSE); a null horizon marks a fold's overall row."""
    cells = metrics.error_cells(fx.predictions(spark, d), ["model", "fold_id", "role", "horizon"])
    sets = [[F.col(c) for c in k] for k in (["model", "fold_id", "role", "horizon"], ["model", "fold_id", "role"])]
    out = cells.groupingSets(sets, *[F.col(c) for c in ("model", "fold_id", "role", "horizon")]).agg(*metrics._metrics(False))
    return out.select("model", F.col("fold_id").alias("fold"), "role", "horizon", "MAE", "RMSE")


MEANS = f"{r6('avg(MAE)')} AS MAE, {r6('avg(RMSE)')} AS RMSE"


@query("legacy_leaderboards", sql(f"SELECT model, NULL AS fold, {MEANS}, 'overall' AS level, CAST(NULL AS BIGINT) AS horizon FROM ({LEGACY}) WHERE role = 'val' AND horizon IS NULL GROUP BY 1 UNION ALL SELECT model, fold, {MEANS}, 'by_fold', NULL FROM ({LEGACY}) WHERE role = 'val' AND horizon IS NULL GROUP BY 1, 2 UNION ALL SELECT model, NULL, {MEANS}, 'by_horizon', horizon FROM ({LEGACY}) WHERE role = 'val' AND horizon IS NOT NULL GROUP BY 1, horizon"))
def _(spark, d):
    return boards.legacy_leaderboards(legacy(spark, d))


@query("metric_summary", sql("SELECT model AS source, role, CAST(horizon AS BIGINT) AS horizon, round(round(avg(MAE), 9), 3) + 0.0 AS MAE, round(round(avg(RMSE), 9), 3) + 0.0 AS RMSE FROM (" + LEGACY + ") GROUP BY 1, 2, 3"))
def _(spark, d):
    return boards.metric_summary(legacy(spark, d).withColumnRenamed("model", "source"))


@query("fold_overall", sql(f"SELECT model, fold, {r6('max(MAE)')} AS MAE, {r6('max(RMSE)')} AS RMSE FROM ({LEGACY}) WHERE role = 'val' AND horizon IS NULL GROUP BY 1, 2"))
def _(spark, d):
    return boards.fold_overall(legacy(spark, d), ["model", "fold"])


@query("sweep_summary", sql(f"SELECT model AS alpha, {r6('avg(MAE)')} AS MAE_mean, {r6('avg(RMSE)')} AS RMSE_mean, {r6('median(MAE)')} AS MAE_median, {r6('median(RMSE)')} AS RMSE_median FROM ({LEGACY}) WHERE role = 'val' AND horizon IS NULL GROUP BY 1"))
def _(spark, d):
    return boards.sweep_summary(legacy(spark, d).filter("role = 'val' AND horizon IS NULL").withColumnRenamed("model", "alpha"))


@query("coerce_metric_keys", sql("SELECT DISTINCT role, CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(horizon AS BIGINT) END AS horizon, k FROM (SELECT role, horizon, unnest([0, 1, 2]) AS k FROM SP)"))
def _(spark, d):
    base = fx.fold_splits(spark, d).select("role", "horizon").distinct().withColumn("k", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    text = F.when(F.col("k") == 0, F.col("role")).when(F.col("k") == 1, F.format_string("('%s', %d)", "role", "horizon")).otherwise(F.format_string("('%s', %d.0)", "role", "horizon"))
    return boards.coerce_metric_keys(base.select(text.alias("index"), "k")).distinct()


@query("low_origin_flag", sql("SELECT geo_id, week_start_date, CAST(horizon AS BIGINT) AS horizon, fold_id, CAST(low_origin AS BIGINT) AS low_origin FROM FLAG WHERE model = 'persistence'"))
def _(spark, d):
    return fx.flagged(spark, d).filter("model = 'persistence'").select(*KEY, "horizon", "fold_id", "low_origin")


@query("regime_flags", sql("SELECT geo_id, week_start_date, CAST(horizon AS BIGINT) AS horizon, fold_id, origin_bucket, CAST(low_origin AS BIGINT) AS low_origin, CAST(outbreak_flag AS BIGINT) AS outbreak_flag, CAST(zero_origin AS BIGINT) AS zero_origin FROM FLAG WHERE model = 'persistence'"))
def _(spark, d):
    return fx.flagged(spark, d).filter("model = 'persistence'").select(*KEY, "horizon", "fold_id", "origin_bucket", "low_origin", "outbreak_flag", "zero_origin")


@query("origin_bucket", "SELECT l_linenumber, CASE WHEN q <= 0 THEN 'zero' WHEN q <= 5 THEN '1_5' WHEN q <= 20 THEN '6_20' WHEN q <= 100 THEN '21_100' ELSE '100p' END AS bucket, count(*) AS n FROM (SELECT l_linenumber, l_quantity AS q FROM lineitem) GROUP BY 1, 2")
def _(spark, d):
    return fx.read(spark, d, "lineitem").groupBy("l_linenumber", origin_bucket(F.col("l_quantity")).alias("bucket")).agg(F.count("*").alias("n"))


@query("active_split", sql("SELECT split_group, model, count(*) AS n FROM FLAG WHERE split_group = 'holdout' GROUP BY 1, 2"))
def _(spark, d):
    return regimes.active_split(fx.flagged(spark, d)).groupBy("split_group", "model").agg(F.count("*").alias("n"))


@query("regime_metrics", sql(geo_macro("model, regime", source="(SELECT *, unnest([CASE WHEN low_origin = 1 THEN 'low_origin' ELSE 'not_low_origin' END, CASE WHEN outbreak_flag = 1 THEN 'outbreak_flag' ELSE 'not_outbreak_flag' END]) AS regime FROM FLAG)")))
def _(spark, d):
    return regimes.regime_metrics(fx.flagged(spark, d))


@query("low_origin_board", sql(geo_macro("model", "low_origin = 1")))
def _(spark, d):
    return regimes.low_origin_board(fx.flagged(spark, d))


@query("origin_bucket_metrics", sql(f"SELECT model, origin_bucket, {r6('avg(cases)')} AS mean_origin, {METRIC6} FROM FLAG GROUP BY 1, 2"))
def _(spark, d):
    return regimes.origin_bucket_metrics(fx.flagged(spark, d))


@query("zero_origin_by_horizon", sql(f"SELECT model, CAST(horizon AS BIGINT) AS horizon, {r6('avg(cases)')} AS mean_origin, {METRIC6} FROM FLAG WHERE zero_origin = 1 GROUP BY 1, 2"))
def _(spark, d):
    return regimes.zero_origin_by_horizon(fx.flagged(spark, d))


@query("geo_winners", sql(f"SELECT geo_id, model FROM (SELECT geo_id, model, row_number() OVER (PARTITION BY geo_id ORDER BY avg(abs({ERR})), sqrt(avg({ERR} * {ERR})), model) AS k FROM FLAG GROUP BY 1, 2) WHERE k = 1"))
def _(spark, d):
    return regimes.geo_winners(fx.flagged(spark, d)).select(GEO, "model")


# ---- hierarchy --------------------------------------------------------------------------------


@query("hierarchy_closure", sql("SELECT week_start_date, CAST(parent_cases AS BIGINT) AS parent_cases, CAST(child_cases AS BIGINT) AS child_cases, CAST(greatest(parent_cases - child_cases, 0) AS BIGINT) AS residual_cases, CAST(parent_cases - child_cases - greatest(parent_cases - child_cases, 0) AS BIGINT) AS closure_error FROM PC"))
def _(spark, d):
    return hierarchy.closure(fx.region_panel(spark, d), fx.OVERLAP)


@query("fix_hierarchy", sql(f"SELECT geo_id, geo_name, week_start_date, CAST(cases AS BIGINT) AS cases, geo_id AS covariate_proxy_source, CAST(0 AS BIGINT) AS covariate_is_proxy FROM P UNION ALL SELECT '{fx.OVERLAP.residual_id}', '{fx.OVERLAP.residual_name}', week_start_date, CAST(greatest(parent_cases - child_cases, 0) AS BIGINT), '{fx.OVERLAP.parent}', 1 FROM PC"))
def _(spark, d):
    return hierarchy.fix_hierarchy(fx.region_panel(spark, d), fx.OVERLAP)


@query("hierarchy_summary", sql(f"SELECT '{fx.OVERLAP.parent}' AS parent_geo, '{fx.OVERLAP.child}' AS child_geo, '{fx.OVERLAP.residual_id}' AS residual_geo_id, count(*) AS weeks, count(*) FILTER (parent_cases < child_cases) AS negative_raw_residual_weeks, {r6('max(abs(parent_cases - child_cases - greatest(parent_cases - child_cases, 0)))')} AS max_abs_closure_error, {r6('sum(parent_cases)')} AS parent_total_cases, {r6('sum(greatest(parent_cases - child_cases, 0))')} AS residual_total_cases, {r6('sum(child_cases)')} AS child_total_cases, (SELECT count(DISTINCT geo_id) FROM P) + 1 AS fixed_geographies FROM PC"))
def _(spark, d):
    return hierarchy.hierarchy_summary(fx.region_panel(spark, d), fx.OVERLAP)


@query("hierarchy_consistency", sql(f"SELECT 'overlap' AS \"check\", {r6('max(abs(parent_cases - child_cases - greatest(parent_cases - child_cases, 0)))')} AS max_abs_diff FROM PC UNION ALL SELECT 'part', {r6('max(abs(parent_cases - child_cases))')} FROM PC"))
def _(spark, d):
    wide = hierarchy.closure(fx.region_panel(spark, d), fx.OVERLAP)
    return hierarchy.consistency(wide, {"overlap": ("parent_cases", ["child_cases", "residual_cases"]), "part": ("parent_cases", ["child_cases"])}, ("overlap",))


@query("bottom_up", sql(f"SELECT geo_id, target_week, CAST(horizon AS BIGINT) AS horizon, fold_id, {r6('y_pred')} AS y_pred FROM PRED WHERE model = 'persistence' AND role = 'val' UNION ALL SELECT 'COUNTRY_TOTAL', target_week, CAST(horizon AS BIGINT), fold_id, {r6('sum(y_pred)')} FROM PRED WHERE model = 'persistence' AND role = 'val' GROUP BY 2, horizon, 4"))
def _(spark, d):
    rows = fx.predictions(spark, d).filter("model = 'persistence' AND role = 'val'").select(GEO, TARGET_WEEK, "horizon", "fold_id", "y_pred")
    return hierarchy.bottom_up(rows, by=("fold_id",))


@query("residual_node", sql(f"SELECT geo_id, target_week, CAST(horizon AS BIGINT) AS horizon, fold_id, {r6('y_pred')} AS y_pred FROM PRED WHERE model = 'persistence' AND role = 'val' AND geo_id <> 'NATION_0' UNION ALL SELECT 'NATION_0_ex_NATION_1', a.target_week, CAST(a.horizon AS BIGINT), a.fold_id, {r6('greatest(a.y_pred - b.y_pred, 0)')} FROM PRED a JOIN PRED b ON a.target_week = b.target_week AND a.horizon = b.horizon AND a.fold_id = b.fold_id WHERE a.geo_id = 'NATION_0' AND b.geo_id = 'NATION_1' AND a.model = 'persistence' AND b.model = 'persistence' AND a.role = 'val' AND b.role = 'val'"))
def _(spark, d):
    rows = fx.predictions(spark, d).filter("model = 'persistence' AND role = 'val'").select(GEO, TARGET_WEEK, "horizon", "fold_id", "y_pred")
    return hierarchy.residual_node(rows, "NATION_0", "NATION_1", by=("fold_id",))


# ---- stacking and safety ----------------------------------------------------------------------


@query("lofo_mae", sql(f"SELECT track, fold_id, CAST(horizon AS BIGINT) AS horizon, model, {cols(['source_mae'])} FROM LOFO"))
def _(spark, d):
    return stacking.lofo_mae(fx.predictions(spark, d), fx.MODELS)


@query("stack_weights", sql(f"SELECT track, fold_id, CAST(horizon AS BIGINT) AS horizon, model, {cols(['weight', 'source_mae'])}, weight_rule, {cols(['persistence_floor', 'inverse_mae_power'])} FROM WT"))
def _(spark, d):
    return fx.weights(spark, d)


@query("conservative_stack", sql(f"SELECT geo_id, week_start_date, CAST(horizon AS BIGINT) AS horizon, fold_id, {r6('greatest(sum(weight * y_pred), 0)')} AS conservative_stack FROM PRED JOIN WT USING (fold_id, horizon, model) GROUP BY 1, 2, horizon, 4"))
def _(spark, d):
    return fx.stacked(spark, d).select(*KEY, "horizon", "fold_id", "conservative_stack")


def merged(spark, d):
    return stacking.model_pair(fx.predictions(spark, d), "persistence", "tail_mean_4")


PAIR = ", ".join(f"max(y_pred) FILTER (model = '{m}') AS y_{n}" for m, n in (("persistence", "a"), ("tail_mean_4", "b")))
MERGED = f"SELECT * FROM (SELECT geo_id, week_start_date, target_week, horizon, role, fold_id, max(y_true) AS y_true, {PAIR} FROM PRED GROUP BY 1, 2, 3, horizon, role, fold_id) WHERE y_a IS NOT NULL AND y_b IS NOT NULL"


@query("level0_merge", sql(f"SELECT geo_id, week_start_date, target_week, CAST(horizon AS BIGINT) AS horizon, role, fold_id, {cols(['y_true', 'y_a', 'y_b'])} FROM ({MERGED})"))
def _(spark, d):
    return merged(spark, d)


@query("pivot_models", sql(f"SELECT geo_id, week_start_date, CAST(horizon AS BIGINT) AS horizon, fold_id, " + ", ".join(f"{r6(f'max(y_pred) FILTER (model = $${m}$$)')} AS {m}" for m in fx.MODELS) + " FROM PRED GROUP BY 1, 2, horizon, fold_id"))
def _(spark, d):
    return stacking.pivot_models(fx.predictions(spark, d), fx.MODELS, [*KEY, "horizon", "fold_id"])


@query("blend_weight", sql(f"SELECT fold_id, CAST(horizon AS BIGINT) AS horizon, n_learn, CASE WHEN n_learn = 0 THEN 0.5 WHEN dd > 0 THEN {r6('greatest(0, least(1, dr / dd))')} ELSE 0.0 END AS weight FROM (SELECT fold_id, horizon, count(*) FILTER (role = 'val') AS n_learn, sum((y_a - y_b) * (y_a - y_b)) FILTER (role = 'val') AS dd, sum((y_a - y_b) * (y_true - y_b)) FILTER (role = 'val') AS dr FROM ({MERGED}) GROUP BY 1, 2)"))
def _(spark, d):
    return stacking.blend_weight(merged(spark, d), "a", "b")


@query("inverse_rmse_stack", sql(f"SELECT geo_id, week_start_date, CAST(horizon AS BIGINT) AS horizon, fold_id, {r6('(y_a / greatest(ra, 1e-9) + y_b / greatest(rb, 1e-9)) / (1 / greatest(ra, 1e-9) + 1 / greatest(rb, 1e-9))')} AS y_pred FROM ({MERGED}) JOIN (SELECT fold_id, horizon, sqrt(avg((y_true - y_a) * (y_true - y_a))) AS ra, sqrt(avg((y_true - y_b) * (y_true - y_b))) AS rb FROM ({MERGED}) WHERE role = 'val' GROUP BY 1, 2) USING (fold_id, horizon)"))
def _(spark, d):
    rows = merged(spark, d)
    return stacking.inverse_rmse_stack(rows, stacking.rmse_pair(rows, "a", "b"), "a", "b").select(*KEY, "horizon", "fold_id", "y_pred")


@query("nb_dispersion", sql(f"SELECT geo_id, CAST(horizon AS BIGINT) AS horizon, count(*) AS n_rows, CASE WHEN avg(y_true) <= 0 THEN 1.0 ELSE {r6('greatest((var_pop(y_true) - avg(y_true)) / (avg(y_true) * avg(y_true) + 1e-12), 1e-6)')} END AS nb_alpha FROM SU WHERE role = 'train' GROUP BY 1, 2"))
def _(spark, d):
    return design.nb_dispersion(fx.supervised(spark, d).filter("role = 'train'"), [GEO, "horizon"])


LOWSU = f"SELECT *, {o.LOW} AS low FROM SU WHERE role = 'train'"
USED = f"SELECT * FROM (SELECT *, count(*) FILTER (low) OVER (PARTITION BY fold_id, horizon) AS any_low FROM ({LOWSU})) WHERE low OR any_low = 0"


@query("low_origin_stats", sql(f"SELECT fold_id, CAST(horizon AS BIGINT) AS horizon, CAST(count(*) AS BIGINT) AS global_rows, {r6('avg(CASE WHEN y_true > 0 THEN 1.0 ELSE 0.0 END)')} AS global_p_nonzero, {r6('quantile_cont(y_true, 0.9)')} AS global_y_cap, {r6('quantile_cont(greatest(y_true - cases, 0.0), 0.9)')} AS global_delta_cap FROM ({USED}) GROUP BY 1, 2"))
def _(spark, d):
    return guardrail.low_origin_stats(fx.supervised(spark, d).filter("role = 'train'")).overall


@query("low_origin_stats_by_series", sql(f"SELECT fold_id, CAST(horizon AS BIGINT) AS horizon, geo_id, count(*) AS n_rows, {r6('avg(CASE WHEN y_true > 0 THEN 1.0 ELSE 0.0 END)')} AS p_nonzero, {r6('quantile_cont(y_true, 0.9)')} AS y_cap, {r6('quantile_cont(greatest(y_true - cases, 0.0), 0.9)')} AS delta_cap FROM ({USED}) GROUP BY 1, 2, 3"))
def _(spark, d):
    return guardrail.low_origin_stats(fx.supervised(spark, d).filter("role = 'train'")).per_series.filter("n_rows > 0").drop("zero_share")


GUARD = f"""WITH_STEPS, U AS ({USED}), OV AS (SELECT fold_id, horizon, avg(CASE WHEN y_true > 0 THEN 1.0 ELSE 0.0 END) AS gp, quantile_cont(y_true, 0.9) AS gy, quantile_cont(greatest(y_true - cases, 0.0), 0.9) AS gd FROM U GROUP BY 1, 2),
PS AS (SELECT fold_id, horizon, geo_id, count(*) AS n, avg(CASE WHEN y_true > 0 THEN 1.0 ELSE 0.0 END) AS p, quantile_cont(y_true, 0.9) AS y, quantile_cont(greatest(y_true - cases, 0.0), 0.9) AS dl FROM U GROUP BY 1, 2, 3),
ZS AS (SELECT fold_id, horizon, geo_id, avg(CASE WHEN cases <= 0 THEN 1.0 ELSE 0.0 END) AS z FROM SU WHERE role = 'train' GROUP BY 1, 2, 3),
X AS (SELECT s.*, cases_rollmean_4 AS m, CASE WHEN coalesce(n >= 12, false) THEN p ELSE gp * CASE WHEN coalesce(z >= 0.35, false) THEN 0.75 ELSE 1 END END AS pp, CASE WHEN coalesce(n >= 12, false) THEN y ELSE gy END AS yc, CASE WHEN coalesce(n >= 12, false) THEN dl ELSE gd END AS dc, gp IS NOT NULL AS trained, {o.LOW} AS low FROM SU s LEFT JOIN OV USING (fold_id, horizon) LEFT JOIN PS USING (fold_id, horizon, geo_id) LEFT JOIN ZS USING (fold_id, horizon, geo_id) WHERE role = 'val')
SELECT geo_id, week_start_date, CAST(horizon AS BIGINT) AS horizon, fold_id, low AND trained AND m > cases AS guarded, CASE WHEN low AND trained AND m > cases THEN {r6('least(greatest(cases + greatest(0, least(1, pp)) * (m - cases), 0), greatest(cases, least(yc, cases + greatest(dc, 0))))')} ELSE {r6('m')} END AS previous_mean_4 FROM X"""


def guarded(spark, d):
    rows = fx.wide_predictions(spark, d)
    stats = guardrail.low_origin_stats(rows.filter("role = 'train'"))
    return guardrail.apply_guardrail(rows.filter("role = 'val'"), stats, ["previous_mean_4"])


@query("low_origin_guardrail", sql("SELECT 1 FROM SU").rsplit(" SELECT 1 FROM ", 1)[0] + GUARD.replace("WITH_STEPS", ""))
def _(spark, d):
    return guarded(spark, d).select(*KEY, "horizon", "fold_id", F.col("previous_mean_4__guarded").alias("guarded"), "previous_mean_4")


NOTES = GUARD.rsplit("SELECT geo_id, week_start_date", 1)[0] + f"SELECT fold_id, CAST(horizon AS BIGINT) AS horizon, count(*) FILTER (low AND trained AND m > cases) AS guardrail_rows, count(*) FILTER (low) AS guardrail_low_origin_rows, {r6('avg(greatest(m - CASE WHEN low AND trained AND m > cases THEN least(greatest(cases + greatest(0, least(1, pp)) * (m - cases), 0), greatest(cases, least(yc, cases + greatest(dc, 0)))) ELSE m END, 0))')} AS guardrail_avg_shrink FROM X GROUP BY 1, 2"


@query("guardrail_notes", sql("SELECT 1 FROM SU").rsplit(" SELECT 1 FROM ", 1)[0] + NOTES.replace("WITH_STEPS", ""))
def _(spark, d):
    return guardrail.guardrail_notes(guarded(spark, d), "previous_mean_4")


NOTHING_FITS = Training(min_train_rows=10**9)  # no setting has so many rows


@query("fallback_notes", sql("SELECT fold_id, CAST(horizon AS BIGINT) AS horizon, 'ar_tweedie_global' AS model, count(*) FILTER (role = 'train') AS train_rows, count(*) AS score_rows, CAST(0 AS BIGINT) AS feature_count, 'fallback_mean' AS fit_strategy, CAST(NULL AS VARCHAR) AS instability_reason FROM SU GROUP BY 1, 2"))
def _(spark, d):
    rows = runner.fitted(fx.supervised(spark, d), ["ar_tweedie_global"], [], NOTHING_FITS)[0]
    return runner.fit_notes(rows, ["ar_tweedie_global"], 0).select("fold_id", "horizon", "model", "train_rows", "score_rows", "feature_count", "fit_strategy", "instability_reason")


@query("fit_notes")
def _(spark, d):
    return fx.backtest(spark, d)[1]


@query("fit_note_counts", sql("SELECT fold_id, CAST(horizon AS BIGINT) AS horizon, model, count(*) FILTER (role = 'train') AS train_rows, count(*) AS score_rows FROM SU, (SELECT unnest(['" + "', '".join(TRAINED) + "']) AS model) GROUP BY 1, 2, 3"))
def _(spark, d):
    return fx.backtest(spark, d)[1].select("fold_id", "horizon", "model", "train_rows", "score_rows")


@query("instability_check", sql(f"SELECT model, fold_id, CAST(horizon AS BIGINT) AS horizon, false AS non_finite, {r6('max(y_pred)')} AS pred_max, {r6('greatest(max(y_true) FILTER (role = $$train$$), 1)')} AS train_max, {r6('quantile_cont(y_pred, 0.99)')} AS pred_p99, CASE WHEN max(y_pred) > greatest(max(y_true) FILTER (role = $$train$$), 1) * 25 OR quantile_cont(y_pred, 0.99) > greatest(max(y_true) FILTER (role = $$train$$), 1) * 10 THEN 'prediction_explosion' END AS reason FROM PRED GROUP BY 1, 2, 3"))
def _(spark, d):
    return guardrail.instability(fx.predictions(spark, d), ["model", "fold_id", "horizon"])


@query("locf_cap", sql(f"SELECT geo_id, week_start_date, " + ", ".join(f"CASE WHEN week_start_date <= DATE '2001-05-14' THEN {r6(c)} WHEN floor((week_start_date - DATE '2001-05-14') / 7) <= 4 THEN {r6(f'(SELECT arg_max_null(b.{c}, b.week_start_date) FROM GAP b WHERE b.geo_id = a.geo_id AND b.week_start_date <= DATE $$2001-05-14$$)')} END AS {c}" for c in ("tmean", "humidity")) + " FROM GAP a"))
def _(spark, d):
    return fill.locf_cap(fx.gap_panel(spark, d), ["tmean", "humidity"], fx.GAP_FROM, 4).select(*KEY, "tmean", "humidity")


FEATS = sorted([*CASE, VALUE, "cases_outbreak_index_4_8", "cases_outbreak_flag_4_8", *o.CALENDAR])
SETTING = ("fold_id", "horizon")
BY_SETTING = "fold_id, CAST(horizon AS BIGINT) AS horizon"
TRAIN_SQL = "SELECT *, 1.0 AS one, CAST(y_true > 0 AS DOUBLE) AS risen FROM SU WHERE role = 'train'"


def design_rows(spark, d):
    """Training rows of all settings, with a constant feature and one that tells positive targets."""
    rows = fx.supervised(spark, d).filter("role = 'train'")
    return rows.withColumns({"one": F.lit(1.0), "risen": (F.col("y_true") > 0).cast("double")})


def structs(items) -> str:
    return "unnest([" + ", ".join("{" + ", ".join(f"'{k}': {v}" for k, v in item.items()) + "}" for item in items) + "])"


SPREAD = f"SELECT fold_id, horizon, {structs({'feature': repr(f), 'std': f'stddev_pop(CAST({f} AS DOUBLE))'} for f in [*FEATS, 'one'])} AS s FROM ({TRAIN_SQL}) GROUP BY 1, 2"


@query("design_constant_cols", sql(f"SELECT {BY_SETTING}, s.feature AS feature, {r6('s.std')} AS std FROM ({SPREAD}) WHERE s.std <= 1e-12"))
def _(spark, d):
    return design.constant_columns(design_rows(spark, d), [*FEATS, "one"], by=SETTING)


@query("design_moments", sql(f"SELECT {BY_SETTING}, count(*) AS n_rows, {r6('avg(y_true)')} AS y_mean, {r6('var_pop(y_true)')} AS y_var, {r6('min(y_true)')} AS y_min, {r6('max(y_true)')} AS y_max, {r6('avg(CASE WHEN y_true = 0 THEN 1.0 ELSE 0.0 END)')} AS prop_y_zero FROM SU WHERE role = 'train' GROUP BY 1, horizon"))
def _(spark, d):
    return design.design_moments(design_rows(spark, d), by=SETTING)


LEVELS = f"SELECT fold_id, horizon, s.feature AS feature, s.x AS x, sum(pos) AS pos FROM (SELECT fold_id, horizon, CAST(y_true > 0 AS BIGINT) AS pos, {structs({'feature': repr(f), 'x': f'CAST({f} AS DOUBLE)'} for f in [*FEATS, 'one', 'risen'])} AS s FROM ({TRAIN_SQL})) WHERE s.x IS NOT NULL GROUP BY 1, 2, 3, 4"


@query("quasi_separation", sql(f"SELECT {BY_SETTING}, feature, CAST(levels AS BIGINT) AS levels, CAST(a AS BIGINT) AS pos_at_zero, CAST(b AS BIGINT) AS pos_elsewhere FROM (SELECT fold_id, horizon, feature, count(*) AS levels, coalesce(sum(pos) FILTER (x = 0), 0) AS a, coalesce(sum(pos) FILTER (x <> 0), 0) AS b FROM ({LEVELS}) GROUP BY 1, 2, 3) WHERE levels BETWEEN 2 AND 5 AND ((a = 0 AND b > 0) OR (b = 0 AND a > 0))"))
def _(spark, d):
    return design.quasi_separation(design_rows(spark, d), [*FEATS, "one", "risen"], by=SETTING)


def corr_sql(features: list[str]) -> str:
    def r(a: str, b: str) -> str:
        return f"CASE WHEN stddev_pop(CAST({a} AS DOUBLE)) > 1e-9 AND stddev_pop(CAST({b} AS DOUBLE)) > 1e-9 THEN corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END"

    pairs = [{"a": repr(a), "b": repr(b), "n": "count(*)", "r": r(a, b)} for i, a in enumerate(features) for b in features[i:]]
    return f"SELECT fold_id, horizon, {structs(pairs)} AS s FROM ({TRAIN_SQL}) GROUP BY 1, 2"


@query("corr_matrix", sql(f"SELECT {BY_SETTING}, s.a AS feature_a, s.b AS feature_b, s.n AS n, {r6('s.r')} AS r FROM ({corr_sql(FEATS)})"))
def _(spark, d):
    return design.correlations(design_rows(spark, d), FEATS, list(SETTING))


@query("high_corr_pairs", sql(f"SELECT {BY_SETTING}, s.a AS feature_a, s.b AS feature_b, {r6('s.r')} AS r FROM ({corr_sql(FEATS)}) WHERE s.a <> s.b AND abs(s.r) > 0.995"))
def _(spark, d):
    return design.high_corr_pairs(design_rows(spark, d), FEATS, by=SETTING)


@query("corr_condition")
def _(spark, d):
    return design.corr_condition(design_rows(spark, d), [*FEATS, "one"], by=SETTING)


# ---- fitted models: all folds and horizons, with the default settings -----------------------------

def fit_settings(spark, d):
    rows = fx.supervised(spark, d)
    return settings(rows, features.feature_columns(rows, False, ("last_year",)), base=VALUE)


def trained_query(name: str, model: str) -> None:
    @query(name)
    def _(spark, d):
        known = fit_settings(spark, d)
        out = fit_models(known, [model]).applied(known.rows.filter("role = 'val'"))
        return out.select(*KEY, "horizon", "fold_id", "y_true", F.col(model).alias("y_pred"))


for _name, _model in zip(("tweedie_glm", "residual_elastic_net", "poisson_boosting", "residual_boosting", "residual_forest"), TRAINED, strict=True):
    trained_query(_name, _model)

Z = ["cases_lag_1", "cases_rollmean_4", "cases_recent_std_4"]


@query("zscore_apply", sql("SELECT s.geo_id, s.week_start_date, CAST(s.horizon AS BIGINT) AS horizon, s.fold_id, " + ", ".join(f"{r6(f'CASE WHEN t.s_{c} > 0 THEN coalesce(greatest(-6, least(6, (s.{c} - t.m_{c}) / t.s_{c})), 0) ELSE 0.0 END')} AS z_{c}" for c in Z) + " FROM SU s LEFT JOIN (SELECT fold_id, horizon, " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in Z) + " FROM SU WHERE role = 'train' GROUP BY 1, 2) t ON t.fold_id = s.fold_id AND t.horizon = s.horizon WHERE role = 'val'"))
def _(spark, d):
    return zscore_by(fx.supervised(spark, d), Z, ("fold_id", "horizon"), "z_").filter("role = 'val'").select(*KEY, "horizon", "fold_id", *[f"z_{c}" for c in Z])


@query("fill_constant", sql("SELECT geo_id, week_start_date, " + ", ".join(f"{r6(f'coalesce({c}, 0)')} AS {c}" for c in fx.COVS) + " FROM GAP"))
def _(spark, d):
    return fill_constant(fx.gap_panel(spark, d), fx.COVS).select(*KEY, *fx.COVS)


@query("fallback_mean", sql(f"SELECT geo_id, week_start_date, CAST(horizon AS BIGINT) AS horizon, fold_id, {r6('coalesce(avg(CASE WHEN role = $$train$$ THEN y_true END) OVER (PARTITION BY fold_id, horizon), 0)')} AS y_pred, 'fallback_mean' AS fit_status FROM SU"))
def _(spark, d):
    out = runner.fitted(fx.supervised(spark, d), ["ar_tweedie_global"], [], NOTHING_FITS)[0]
    return out.select(*KEY, "horizon", "fold_id", F.col("ar_tweedie_global").alias("y_pred"), F.col("ar_tweedie_global__status").alias("fit_status"))


@query("track_run")
def _(spark, d):
    return fx.backtest(spark, d)[0]


@query("trained_models")
def _(spark, d):
    return fx.backtest(spark, d)[2].filter("_s >= 0 AND model <> ''").groupBy("model", F.col("_s").alias("setting")).agg(F.count("*").alias("parts"), F.sum(F.size("value")).cast("long").alias("numbers"))


@query("trained_stack")
def _(spark, d):
    return fx.trained_stack(spark, d).filter("role = 'val'").select(*KEY, "horizon", "fold_id", "y_true", "conservative_stack", "conservative_stack__guarded")


@query("trained_leaderboard")
def _(spark, d):
    return boards.leaderboard(trained_macro(spark, d, "overall").drop("level", "fold_id", GEO, "horizon"), "development")


def trained_macro(spark, d, level: str):
    return metrics.macro_tables(fx.every_prediction(spark, d)).filter(F.col("level") == level)


LIVE_MAE = f"SELECT horizon, model, avg(MAE_macro) AS mae FROM ({BY_HORIZON}) GROUP BY 1, 2"
FLOOR, POWER = fx.STACK.persistence_floor, fx.STACK.inverse_mae_power
LIVE = f"""WITH_STEPS, L AS (SELECT FE.*, h AS horizon, CAST(FE.week_start_date + 7 * h AS DATE) AS target_week, p.cases AS last_year FROM FE CROSS JOIN (VALUES (1), (2), (3), (4)) v(h) LEFT JOIN P p ON p.geo_id = FE.geo_id AND p.week_start_date = FE.week_start_date + 7 * h - 364 WHERE FE.week_start_date = (SELECT max(week_start_date) FROM P)),
B AS ({" UNION ALL ".join(f"SELECT geo_id, week_start_date, target_week, horizon, '{m}' AS model, greatest(CAST({x} AS DOUBLE), 0) AS y_pred, '{s}' AS fit_status FROM L" for m, (x, s) in o.NAIVE.items())}),
R AS (SELECT model, row_number() OVER (ORDER BY {ORDER}) AS rank FROM MACRO WHERE level = 'overall' AND role = 'val' AND split_group = 'holdout')
SELECT geo_id, week_start_date AS origin_week, target_week, CAST(horizon AS BIGINT) AS horizon, B.model, {r6('y_pred')} AS y_pred, fit_status, rank AS model_rank_from_backtest, CAST(rank = 1 AS BIGINT) AS is_primary_model FROM B JOIN R USING (model)
UNION ALL SELECT 'COUNTRY_TOTAL', week_start_date, target_week, CAST(horizon AS BIGINT), B.model, {r6('sum(y_pred)')}, any_value(fit_status), any_value(rank), CAST(any_value(rank) = 1 AS BIGINT) FROM B JOIN R USING (model) GROUP BY 2, 3, horizon, 5"""


def ranked(macro):
    """(ranking, errors by horizon) of a macro table, which is written once for both."""
    macro = sinks.staged(macro, "macro")
    whole = macro.filter("level = 'overall'").drop("level", "fold_id", GEO, "horizon")
    return boards.evidence_fallback(rounded(whole), "operational"), boards.horizon_mae(macro.filter("level = 'by_fold_horizon'"), "operational")


def live_rows(spark, d):
    ranking, mae = ranked(fx.macro(spark, d))
    return live.live_forecast(fx.counts(spark, d), fx.HORIZONS, mae, ranking, boards.promotion_policy(ranking), fx.MODELS, stack=fx.STACK)


@query("live_forecast", sql("SELECT 1 FROM FE, P, MACRO").rsplit(" SELECT 1 FROM ", 1)[0] + LIVE.replace("WITH_STEPS", ""))
def _(spark, d):
    return live_rows(spark, d).filter("model <> 'conservative_stack'").drop("geo_name")


@query("live_stack")
def _(spark, d):
    return live_rows(spark, d).filter("model = 'conservative_stack'")


@query("forecast_slices")
def _(spark, d):
    return boards.forecast_slices(live_rows(spark, d))


@query("live_bundle")
def _(spark, d):
    """Naive and trained models from the latest origin, with the default stack, ranked by the backtest of all of them."""
    ranking, mae = ranked(metrics.macro_tables(fx.every_prediction(spark, d)))
    return live.live_forecast(fx.stored_counts(spark, d), fx.HORIZONS, mae, ranking, boards.promotion_policy(ranking), fx.MODELS[:2], list(TRAINED))


REDUCED = ["cases_lag_1", "cases_lag_2", "cases_rollmean_4", "cases_log1p", "woy_sin", "woy_cos"]


@query("poisson_ridge_live")
def _(spark, d):
    counts = fx.counts(spark, d)
    pairs = splits.training_pairs_from_panel(counts, "operational", fx.HORIZONS)
    return legacy_models.with_total(legacy_models.poisson_live(fx.feature_panel(spark, d), pairs, REDUCED, fx.HORIZONS), by=("model", "origin_week"))


CEILING = dt.date(2000, 1, 3)


@query("poisson_backtest")
def _(spark, d):
    return legacy_models.poisson_backtest(fx.supervised(spark, d), REDUCED, CEILING)


@query("poisson_backtest_locf")
def _(spark, d):
    rows = splits.supervised_from_panel(fx.full_panel(spark, d), "operational", fx.HORIZONS, fx.FOLDS)
    return legacy_models.poisson_backtest(rows, [*REDUCED, *fx.COVS], CEILING, "locf")


@query("grouped_nb_glm")
def _(spark, d):
    return grouped.grouped_glm(fx.supervised(spark, d), REDUCED)


ALPHAS = [0.001, 0.005, 0.008, 0.01, 0.05]


def swept(spark, d):
    return grouped.alpha_sweep(fx.supervised(spark, d), REDUCED, ALPHAS)


@query("alpha_sweep")
def _(spark, d):
    return swept(spark, d)


@query("sweep_best")
def _(spark, d):
    return boards.sweep_best(swept(spark, d))


TWEEDIE_TREES = TreeSpec("tweedie", 400, 0.05, 3, leaves=15, power=1.3, row_share=0.8, feature_share=0.8, patience=50, shrink=True)


@query("tweedie_boosting")
def _(spark, d):
    rows = fx.supervised(spark, d)
    columns = features.feature_columns(rows, False, ("last_year",))
    known = settings(rows, columns)
    out = fit_trees(known, None, TWEEDIE_TREES, least=20).predict("y_pred", known.rows)
    return out.select(*KEY, TARGET_WEEK, "horizon", "fold_id", "role", "y_true", "y_pred")


assert set(SQL) <= set(QUERIES) and FULL and MACRO6
