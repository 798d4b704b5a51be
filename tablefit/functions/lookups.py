"""Constant tables: tasks, dimensions, weights, costs, thresholds, word lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSIFICATION = "supervised_classification"
REGRESSION = "supervised_regression"
CLUSTERING = "clustering"
TIME_SERIES = "time_series_forecasting"
TASKS = (CLASSIFICATION, REGRESSION, CLUSTERING, TIME_SERIES)

TASK_ALIASES = {
    "classification": CLASSIFICATION,
    "regression": REGRESSION,
    "descriptive_bi": CLUSTERING,
    "time_series": TIME_SERIES,
}

# The eight dimensions in scoring order, with their short codes.
DIMENSIONS = {
    "completeness": "cmp",
    "validity": "val",
    "consistency": "cns",
    "uniqueness": "unq",
    "timeliness": "tim",
    "outlier_anomaly": "out",
    "distribution_balance": "bal",
    "coverage_representativeness": "cov",
}
CODES = tuple(DIMENSIONS.values())

DIMENSION_ALIASES = {
    "missingness": "completeness",
    "outlier_resilience": "outlier_anomaly",
    "drift_stability": "timeliness",
    "temporal_validity": "timeliness",
    "label_integrity": "distribution_balance",
    "bias_imbalance": "distribution_balance",
    "leakage": "validity",
    "cardinality_schema": "validity",
    "correlation_integrity": "consistency",
}

# Sensitivity of each task to each dimension, in the order of CODES.
SENSITIVITY = {
    CLASSIFICATION: (0.14, 0.18, 0.12, 0.08, 0.04, 0.12, 0.22, 0.10),
    REGRESSION: (0.18, 0.16, 0.14, 0.06, 0.04, 0.24, 0.10, 0.08),
    CLUSTERING: (0.16, 0.14, 0.08, 0.12, 0.03, 0.22, 0.05, 0.20),
    TIME_SERIES: (0.18, 0.10, 0.12, 0.04, 0.30, 0.14, 0.06, 0.06),
}

# Operational cost of each repair action.
ACTION_COSTS = {
    "drop_leakage_columns": 1,
    "sort_timestamps": 2,
    "resample_imbalance": 3,
    "drop_unlabelled_target": 1,
    "winsorize_outliers": 2,
    "drop_high_null_columns": 1,
    "impute_median": 2,
}

# Learning rates of the calibration line search.
STEP_SIZES = (0.001, 0.002, 0.005, 0.01, 0.015, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.4, 0.8, 1.5, 3.0)

# Order in which repairs run, whatever order was asked for.
REPAIR_ORDER = (
    "sort_timestamps",
    "drop_leakage_columns",
    "winsorize_outliers",
    "resample_imbalance",
    "impute_median",
    "drop_redundant_identifiers",
    "drop_unlabelled_target",
    "drop_high_null_columns",
)

# Words that make a column name look like a time axis, an
# identifier, a class target, a numeric target or a plain feature.
INT_YEAR_WORDS = ("year", "yr", "date", "timestamp", "datetime", "time")
TIME_WORDS = ("date", "timestamp", "datetime", "time", "day", "period", "year", "month")
ID_WORDS = ("id", "uuid", "guid", "index", "key", "row", "record", "num", "code", "hash")
ID_PHRASES = (
    "row_?number", "account_?id", "transaction_?id", "record_?id", "customer_?id",
    "user_?id", "session_?id", "order_?id", "item_?id",
)
CLASS_TARGET_WORDS = (
    "target", "label", "class", "species", "churn", "fraud", "outcome", "response", "status",
    "diagnosis", "sentiment", "survived", "rating", "result", "decision", "category", "type", "group",
)
NUMERIC_TARGET_WORDS = (
    "price", "sales", "revenue", "demand", "salary", "cost", "loss", "profit", "yield",
    "amount", "score", "count", "value", "target", "outcome", "response", "measurement",
)
FEATURE_WORDS = (
    "coord", "coordinate", "pos", "position", "lat", "latitude", "lon", "long", "longitude", "geo",
    "altitude", "elevation", "feat", "feature", "var", "variable", "attr", "attribute", "dim",
    "dimension", "sensor", "channel", "input", "covariate", "pred", "predictor",
    "age", "customer_age", "year_born", "dob", "gender", "sex", "zip", "zipcode", "postal", "phone", "ssn",
)
NUMBERED_FEATURE_STEMS = ("x", "z", "f", "v", "c", "col", "column", "feat", "feature", "var", "dim", "sensor")


def word_pattern(words: tuple[str, ...], digits_end_word: bool = False) -> str:
    """Case-blind pattern for any of the words standing between separators."""
    tail = r"[_\s\d-]" if digits_end_word else r"[_\s-]"
    return rf"(?i)(^|[_\s-])({'|'.join(words)})({tail}|$)"


INT_YEAR_PATTERN = word_pattern(INT_YEAR_WORDS)
TIME_PATTERN = word_pattern(TIME_WORDS)
ID_PATTERN = word_pattern(ID_WORDS) + rf"|\b({'|'.join(ID_PHRASES)})\b"
CLASS_TARGET_PATTERN = word_pattern(CLASS_TARGET_WORDS)
NUMERIC_TARGET_PATTERN = word_pattern(NUMERIC_TARGET_WORDS) + "|^y$"
FEATURE_PATTERN = (
    word_pattern(FEATURE_WORDS, digits_end_word=True)
    + rf"|^({'|'.join(NUMBERED_FEATURE_STEMS)})[_\s-]?\d+$|^[xz]$"
)


@dataclass(frozen=True)
class ImbalancePolicy:
    """Minority share (in percent) below which a class target is vetoed or penalised."""

    minority_pct: float = 2.0
    severe_pct: float = 10.0
    veto: bool = True


def canonical_task(task: str) -> str:
    name = task.lower()
    name = TASK_ALIASES.get(name, name)
    if name not in TASKS:
        raise ValueError(f"unknown task {task!r}")
    return name


def canonical_dimension(dimension: str) -> str:
    name = dimension.lower()
    name = DIMENSION_ALIASES.get(name, name)
    if name not in DIMENSIONS:
        raise ValueError(f"unknown dimension {dimension!r}")
    return name


def sensitivity_table(spark: SparkSession) -> DataFrame:
    """32 rows (task, dimension, sensitivity); small and fixed, so safe to broadcast."""
    rows = [
        (task, dimension, weight)
        for task, weights in SENSITIVITY.items()
        for dimension, weight in zip(DIMENSIONS, weights)
    ]
    return spark.createDataFrame(rows, "task string, dimension string, sensitivity double")


def sensitivity_of(code: str, task: str = "task") -> Column:
    """Sensitivity of the task named in a column to one dimension, as an expression."""
    index = CODES.index(code)
    cases = " ".join(f"WHEN '{name}' THEN {SENSITIVITY[name][index]}D" for name in TASKS)
    return F.expr(f"CASE {task} {cases} ELSE {SENSITIVITY[CLUSTERING][index]}D END")
