"""Eight repairs. Each learns its parameters on a (training) table and is then
applied lazily; test rows are never added, removed or reordered.

Learned parameters are a handful of numbers per column. They are plain values
in ``Fitted`` so that a later job can apply them to any table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablefit.functions.frames import materialize
from tablefit.functions.lookups import CLASSIFICATION, REGRESSION, REPAIR_ORDER, TIME_SERIES
from tablefit.functions.stats import as_number, dtype_of, is_numeric, kurtosis, missing, scatter
from tablefit.operators.columns import (
    clip_columns,
    distinct_counts,
    fill_missing,
    lenient_timestamp,
    numeric_columns,
)
from tablefit.operators.dimensions import HEAVY_TAIL, HIGH_MISSING, LEAKAGE
from tablefit.operators.profile import pair_correlations
from tablefit.operators.select import medians, quantiles, with_tile

MINORITY_PCT = 15.0
# Repairs that shuffle rows.
MOVES_ROWS = ("sort_timestamps", "resample_imbalance")


@dataclass
class Fitted:
    """What one repair learned on the training table; ``note`` says why it did nothing."""

    action: str
    drop: list[str] = field(default_factory=list)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    fills: dict[str, object] = field(default_factory=dict)
    time: str | None = None
    note: str | None = None

    @property
    def executed(self) -> bool:
        return self.note is None

    def apply(self, df: DataFrame) -> DataFrame:
        """The row-preserving part, the same for training and test rows."""
        if self.time and self.time in df.columns:
            df = df.withColumn(self.time, lenient_timestamp(df, self.time))
        df = clip_columns(df, self.bounds)
        df = fill_missing(df, self.fills)
        return df.drop(*[c for c in self.drop if c in df.columns])


def sort_timestamps(df: DataFrame, time: str, row_order: str, by: Sequence[str] = ()) -> DataFrame:
    """Parse times, drop unreadable ones, keep the earliest row per time.

    Copies of a frequent time are merged before the shuffle. Order is a matter
    of writing: use ``in_time_order``.
    """
    parsed = df.withColumn(time, lenient_timestamp(df, time)).filter(F.col(time).isNotNull())
    rest = [c for c in df.columns if c != time and c not in by]
    first = parsed.groupBy(*by, time).agg(F.min_by(F.struct(*rest), F.col(row_order)).alias("__row"))
    return first.select(*by, time, "__row.*").select(*df.columns)


def in_time_order(df: DataFrame, time: str) -> DataFrame:
    """Range-partitioned and sorted, so that files written from it are in time order."""
    return df.repartitionByRange(time).sortWithinPartitions(time)


def leaking_columns(df: DataFrame, target: str) -> DataFrame:
    """Numeric columns whose |r| with the target exceeds 0.98 (pairwise deletion)."""
    columns = [c for c in numeric_columns(df) if c != target]
    pairs = pair_correlations(df, columns, target=target, only_target=True)
    return pairs.filter(F.abs("r") > LEAKAGE).select(F.col("feat_a").alias("column"), "r")


def winsor_bounds(df: DataFrame, columns: Sequence[str], exact: bool = True,
                  **options) -> dict[str, tuple[float, float]]:
    """1 % and 99 % quantiles of the columns with heavy tails and more than 10 values."""
    stats = df.agg(*[
        F.struct(F.count(as_number(df, c)).alias("n"), kurtosis(as_number(df, c)).alias("k")).alias(c)
        for c in columns
    ]).first()
    heavy = [c for c in columns if stats[c]["n"] > 10 and abs(stats[c]["k"] or 0.0) > HEAVY_TAIL]
    if not heavy:
        return {}
    row = quantiles(df, heavy, [0.01, 0.99], exact=exact, **options).first()
    return {c: (row[c][0], row[c][1]) for c in heavy}


def fill_values(df: DataFrame, without: Sequence[str] = (), exact: bool = True) -> dict[str, object]:
    """Median of numeric columns and smallest most frequent value of others, where gaps exist."""
    columns = [c for c in df.columns if c not in without]
    counts = df.agg(*[F.max(missing(df, c)).alias(c) for c in columns]).first()
    gappy = [c for c in columns if counts[c]]
    numeric = [c for c in gappy if is_numeric(dtype_of(df, c))]
    fills: dict[str, object] = {}
    if numeric:
        row = medians(df, numeric, exact=exact).first()
        fills.update({c: row[c] for c in numeric if row[c] is not None})
    for c in (c for c in gappy if c not in numeric):
        top = df.filter(~missing(df, c)).groupBy(c).count().orderBy(F.col("count").desc(), c).first()
        fallback = "Unknown" if isinstance(dtype_of(df, c), T.StringType) else None
        fills[c] = top[c] if top else fallback
    return {c: v for c, v in fills.items() if v is not None}


def redundant_columns(df: DataFrame, keep: Sequence[str]) -> list[str]:
    """Columns with at most one value, and texts distinct in over 95 % of the rows."""
    columns = [c for c in df.columns if c not in keep]
    sketch = df.agg(F.count(F.lit(1)).alias("__n"), *[F.approx_count_distinct(c).alias(c) for c in columns])
    row = sketch.first()
    n = max(1, row["__n"])
    texts = [c for c in columns if isinstance(dtype_of(df, c), T.StringType)]
    # Only columns that a sketch leaves open are counted exactly.
    open_cases = [c for c in columns if row[c] <= 3 or (c in texts and row[c] > 0.65 * n)]
    if not open_cases:
        return []
    exact = distinct_counts(df, open_cases).first()
    return [
        c for c in columns if c in open_cases
        and (exact[f"distinct_{c}"] <= 1 or (c in texts and exact[f"distinct_{c}"] > 0.95 * n))
    ]


def high_null_columns(df: DataFrame, keep: Sequence[str]) -> list[str]:
    columns = [c for c in df.columns if c not in keep]
    row = df.agg(*[F.avg(missing(df, c).cast("double")).alias(c) for c in columns]).first()
    return [c for c in columns if (row[c] or 0.0) > HIGH_MISSING]


def copies_needed(df: DataFrame, target: str) -> tuple[object, int, int] | None:
    """(minority class, its rows, rows wanted), or None when balance is acceptable."""
    classes = df.filter(~missing(df, target)).groupBy(target).agg(F.count(F.lit(1)).alias("c"))
    low = F.min_by(F.struct(target, "c"), F.struct("c", target))
    row = classes.agg(low.alias("low"), F.max("c").alias("most"), F.count(F.lit(1)).alias("k")).first()
    if row["k"] <= 1:
        return None
    rows, least = df.count(), row["low"]["c"]
    if least / rows * 100 >= MINORITY_PCT:
        return None
    return row["low"][target], least, max(2 * least, int(row["most"] * 0.40))


def resample_minority(df: DataFrame, target: str, key: str, seed: int = 42, **options) -> DataFrame:
    """Repeat minority rows until the class has the wanted size, exactly and repeatably.

    Every row is copied ``wanted // rows`` times and the first ones in hash
    order once more.
    """
    need = copies_needed(df, target)
    if need is None:
        return df
    value, rows, wanted = need
    minority = F.col(target).eqNullSafe(F.lit(value))
    spread = df.filter(minority).withColumn("__h", scatter(F.col(key), seed))
    extra = wanted % rows
    tiled = with_tile(spread, ["__h", key], [lambda n: F.lit(extra)], name="__late", **options)
    copies = F.lit(wanted // rows) + F.when(F.col("__late") == 0, 1).otherwise(0)
    repeated = tiled.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))).drop("__h", "__late", "__copy")
    return df.filter(~minority).unionByName(repeated.select(*df.columns))


def repair(df: DataFrame, actions: Sequence[str] | None, task: str, target: str | None = None, time: str | None = None,
           row_order: str | None = None, exact: bool = True, written: bool = False) -> tuple[DataFrame, list[Fitted]]:
    """Learn the requested repairs on a table and apply them to it, in the fixed order.

    Several repairs work on a copy that is written once (``written``: the table is one already), and again after each
    step that moves rows, so the source and the shuffles behind a step are not run again by every later fit.
    """
    wanted = list(REPAIR_ORDER) if actions is None else list(actions)
    if len(wanted) > 1 and not written:
        df = materialize(df, "to-repair")
    log: list[Fitted] = []
    for action in REPAIR_ORDER:
        if action not in wanted:
            if actions is not None:
                log.append(Fitted(action, note="not requested"))
            continue
        fitted, rows = _REPAIRS[action](df, task, target, time, row_order, exact)
        log.append(fitted)
        if fitted.executed:
            df = fitted.apply(rows)
            if action in MOVES_ROWS and action != wanted[-1]:
                df = materialize(df, "repaired")
    return df, log


def repair_split(train: DataFrame, test: DataFrame, actions: Sequence[str] | None, task: str, target: str | None = None,
                 time: str | None = None, row_order: str | None = None,
                 exact: bool = True, written: bool = False) -> tuple[DataFrame, DataFrame, list[Fitted]]:
    """Learn on train, apply to both; rows are added or dropped in train only."""
    repaired, log = repair(train, actions, task, target, time, row_order, exact, written)
    for fitted in log:
        if fitted.executed:
            test = fitted.apply(test)
    return repaired, test, log


def action_log(spark, log: Sequence[Fitted]) -> DataFrame:
    rows = [
        (i, f.action, f.executed, f.note, f.drop or list(f.bounds) or list(f.fills) or ([f.time] if f.time else []))
        for i, f in enumerate(log)
    ]
    return spark.createDataFrame(
        rows, "step int, action string, executed boolean, reason string, columns array<string>")


def _fit_sort(df, task, target, time, row_order, exact):
    if time not in df.columns:
        return Fitted("sort_timestamps", note="no time column"), df
    if row_order is None:
        raise ValueError("sort_timestamps needs row_order to keep the earliest row per time")
    return Fitted("sort_timestamps", time=time), sort_timestamps(df, time, row_order)


def _fit_leakage(df, task, target, time, row_order, exact):
    columns = [c for c in numeric_columns(df) if c != target]
    if target not in df.columns or not columns or not is_numeric(dtype_of(df, target)):
        return Fitted("drop_leakage_columns", note="no numeric target or features"), df
    drop = sorted(r["column"] for r in leaking_columns(df, target).collect())
    return Fitted("drop_leakage_columns", drop=drop, note=None if drop else "no leaking column"), df


def _fit_winsor(df, task, target, time, row_order, exact):
    columns = numeric_columns(df, [row_order] if row_order else [])
    if task not in (REGRESSION, TIME_SERIES):
        columns = [c for c in columns if c != target]
    bounds = winsor_bounds(df, columns, exact) if columns else {}
    return Fitted("winsorize_outliers", bounds=bounds, note=None if bounds else "no heavy tail"), df


def _fit_resample(df, task, target, time, row_order, exact):
    if task != CLASSIFICATION or target not in df.columns:
        return Fitted("resample_imbalance", note="not a classification target"), df
    if copies_needed(df, target) is None:
        return Fitted("resample_imbalance", note="balance acceptable"), df
    if row_order is None:
        raise ValueError("resample_imbalance needs row_order as the key of the draw")
    return Fitted("resample_imbalance"), resample_minority(df, target, row_order)


def _fit_fill(df, task, target, time, row_order, exact):
    fills = fill_values(df, [row_order] if row_order else [], exact)
    return Fitted("impute_median", fills=fills, note=None if fills else "no missing cell"), df


def _fit_redundant(df, task, target, time, row_order, exact):
    drop = redundant_columns(df, [c for c in (target, time, row_order) if c])
    return Fitted("drop_redundant_identifiers", drop=drop, note=None if drop else "no redundant column"), df


def _fit_unlabelled(df, task, target, time, row_order, exact):
    if target not in df.columns:
        return Fitted("drop_unlabelled_target", note="no target column"), df
    gaps = df.filter(missing(df, target)).limit(1).count()
    labelled = df.filter(~missing(df, target))
    return Fitted("drop_unlabelled_target", note=None if gaps else "no missing target"), labelled


def _fit_high_null(df, task, target, time, row_order, exact):
    drop = high_null_columns(df, [c for c in (target, time, row_order) if c])
    return Fitted("drop_high_null_columns", drop=drop, note=None if drop else "no sparse column"), df


_REPAIRS: dict[str, Callable] = {
    "sort_timestamps": _fit_sort,
    "drop_leakage_columns": _fit_leakage,
    "winsorize_outliers": _fit_winsor,
    "resample_imbalance": _fit_resample,
    "impute_median": _fit_fill,
    "drop_redundant_identifiers": _fit_redundant,
    "drop_unlabelled_target": _fit_unlabelled,
    "drop_high_null_columns": _fit_high_null,
}
