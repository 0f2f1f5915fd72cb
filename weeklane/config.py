"""Settings as frozen dataclasses. Folds, horizons and models are data, not enums."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

GEO = "geo_id"
NAME = "geo_name"
WEEK = "week_start_date"
VALUE = "cases"
TARGET_WEEK = "target_week"
TOTAL_NODE = "COUNTRY_TOTAL"

# Covariate columns of a panel.
COVARIATES = (
    "tmean",
    "humidity",
    "rain",
    "dewpoint",
    "wind10",
    "wind100",
    "winddir10",
    "gust10",
    "soil_temp_0_7cm",
    "soil_moist_0_7cm",
)

# Raw covariate header -> panel column.
COVARIATE_HEADERS = {
    "temperature_2m": "tmean",
    "relative_humidity_2m": "humidity",
    "total_precipitation": "rain",
    "dew_point_2m": "dewpoint",
    "wind_speed_10m": "wind10",
    "wind_speed_100m": "wind100",
    "wind_direction_10m": "winddir10",
    "wind_gusts_10m": "gust10",
    "soil_temperature_0_to_7cm": "soil_temp_0_7cm",
    "soil_moisture_0_to_7cm": "soil_moist_0_7cm",
}

# Covariate name fragments (slow first) and those of the lite projection.
SLOW_FRAGMENTS = ("temp", "temperature", "rh", "humid", "soil_temp", "soil_moist", "dewpoint")
FAST_FRAGMENTS = ("rain", "precip", "wind")
EXOGENOUS_FRAGMENTS = SLOW_FRAGMENTS + FAST_FRAGMENTS + ("soil", "dew")

# Normalised count headers -> (node id, node name).
COUNT_NODES = {
    "dhaka_metro_ew_new_cases": ("DHA_METRO", "Dhaka Metro"),
    "dhaka_division_ew_new_cases_computed": ("DHA_DIV", "Dhaka Division"),
    "mymensingh_ew_new_cases": ("MYM", "Mymensingh"),
    "chattogram_ew_new_cases": ("CHA", "Chattogram"),
    "khulna_ew_new_cases": ("KHU", "Khulna"),
    "rajshahi_ew_new_cases": ("RAJ", "Rajshahi"),
    "rangpur_ew_new_cases": ("RAN", "Rangpur"),
    "barishal_ew_new_cases": ("BAR", "Barishal"),
    "sylhet_ew_new_cases": ("SYL", "Sylhet"),
    "tot_division_except_dhaka_metro_ew_new_cases": ("NON_DHA_METRO", "All Except Dhaka Metro"),
    "country_wide_total_ew_new_cases": ("NATIONAL", "Bangladesh Total"),
}
# Nodes that are kept.
KEPT_NODES = ("BAR", "CHA", "DHA_DIV", "DHA_METRO", "KHU", "MYM", "RAJ", "RAN", "SYL")

# Node ids of the truth table and their count headers.
TRUTH_NODES = {
    "dhaka_metro_ew_new_cases": "DHA_METRO",
    "dhaka_div_out_metro_ew_new_cases": "DHA_DIV_ex_DHA_METRO",
    "barishal_ew_new_cases": "BAR",
    "chattogram_ew_new_cases": "CHA",
    "khulna_ew_new_cases": "KHU",
    "mymensingh_ew_new_cases": "MYM",
    "rajshahi_ew_new_cases": "RAJ",
    "rangpur_ew_new_cases": "RAN",
    "sylhet_ew_new_cases": "SYL",
    "country_wide_total_ew_new_cases": "COUNTRY_TOTAL",
}

# Covariate file-name fragments -> (node id, node name).
COVARIATE_FILES = {
    "barisal_division": ("BAR", "Barishal"),
    "chattogram_division": ("CHA", "Chattogram"),
    "dhaka_division": ("DHA_DIV", "Dhaka Division"),
    "dhaka_metro_only": ("DHA_METRO", "Dhaka Metro"),
    "khulna_division": ("KHU", "Khulna"),
    "mymensingh_division": ("MYM", "Mymensingh"),
    "rajshahi_division": ("RAJ", "Rajshahi"),
    "rangpur_division": ("RAN", "Rangpur"),
    "sylhet_division": ("SYL", "Sylhet"),
}

# Parent, child, id and name of the rest.
REPAIRED_NODES = ("DHA_DIV", "DHA_METRO", "DHA_DIV_OUT_METRO", "Dhaka Division Outside Metro")


@dataclass(frozen=True)
class Hierarchy:
    parent: str
    child: str
    residual_id: str
    residual_name: str


@dataclass(frozen=True)
class Fold:
    name: str
    train_end: dt.date
    val_end: dt.date
    group: str = "development"


# The defaults.
@dataclass(frozen=True)
class FeatureSpec:
    case_lags: tuple[int, ...] = (1, 2, 3, 4, 8, 13, 26, 52)
    mean_windows: tuple[int, ...] = (2, 4, 8)
    sum_windows: tuple[int, ...] = (2, 4, 8)
    std_windows: tuple[int, ...] = (4, 8)
    nonzero_windows: tuple[int, ...] = (4, 8)
    growth_lookbacks: tuple[int, ...] = (1, 2, 4)
    outbreak_recent: int = 4
    outbreak_baseline: int = 8
    outbreak_ratio: float = 1.25
    covariates: tuple[str, ...] = ("rain", "tmean", "humidity", "dewpoint", "soil_moist_0_7cm")
    covariate_lags: tuple[int, ...] = (1, 2, 4, 8)
    covariate_mean_windows: tuple[int, ...] = (2, 4, 8)
    covariate_sum_windows: tuple[int, ...] = (2, 4, 8)
    summed_covariates: tuple[str, ...] = ("rain",)


# The defaults.
@dataclass(frozen=True)
class Guardrail:
    models: tuple[str, ...] = (
        "ar_tweedie_global",
        "residual_elastic_net_global",
        "panel_hist_gbm",
        "residual_hist_gbm",
        "residual_random_forest",
        "conservative_stack",
    )
    max_cases: float = 5
    zero_run: float = 2
    weeks_since_nonzero: float = 2
    recent_nonzero_max: float = 1
    min_group_rows: int = 12
    cap_quantile: float = 0.9
    sparse_zero_share: float = 0.35
    sparse_multiplier: float = 0.75


# The defaults.
@dataclass(frozen=True)
class Training:
    seed: int = 42
    min_train_rows: int = 40
    tweedie_power: float = 1.5
    tweedie_alpha: float = 0.25
    elastic_net_alpha: float = 0.02
    elastic_net_l1_ratio: float = 0.2
    elastic_net_max_iter: int = 5000
    gbm_rate: float = 0.05
    gbm_depth: int = 3
    gbm_rounds: int = 300
    gbm_min_leaf: int = 20
    residual_gbm_rate: float = 0.03
    residual_gbm_depth: int = 3
    residual_gbm_rounds: int = 400
    residual_gbm_min_leaf: int = 20
    forest_trees: int = 300
    forest_depth: int = 6
    forest_min_leaf: int = 8
    guardrail: Guardrail = field(default_factory=Guardrail)


# The defaults.
@dataclass(frozen=True)
class Stack:
    base_models: tuple[str, ...] = (
        "persistence",
        "residual_elastic_net_global",
        "residual_random_forest",
        "residual_hist_gbm",
        "ar_tweedie_global",
    )
    persistence_floor: float = 0.45
    inverse_mae_power: float = 2.0


@dataclass(frozen=True)
class Track:
    name: str
    horizons: tuple[int, ...]
    with_covariates: bool
    models: tuple[str, ...]
    stack: Stack | None = None


# The two tracks.
OPERATIONAL = Track(
    "operational",
    (1, 2, 3, 4),
    False,
    (
        "persistence",
        "seasonal_naive_52",
        "ar_tweedie_global",
        "residual_elastic_net_global",
        "panel_hist_gbm",
        "residual_hist_gbm",
        "residual_random_forest",
        "conservative_stack",
    ),
    Stack(),
)
EXPERIMENTAL = Track(
    "experimental",
    (5, 6, 7, 8, 9, 10, 11, 12),
    True,
    ("persistence", "seasonal_naive_52", "ar_tweedie_global", "panel_hist_gbm"),
)
