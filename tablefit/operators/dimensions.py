"""Metrics behind the eight quality dimensions, and the scores made of them.

``*_metrics`` functions return one row per segment; ``score_dimensions`` turns
such rows into eight scores with plain column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefit.functions.frames import join_on, materialize, rows_per_segment
from tablefit.functions.lookups import CLASSIFICATION, DIMENSIONS, REGRESSION, TASKS, TIME_SERIES, ImbalancePolicy
from tablefit.functions.stats import (
    adjusted_skewness,
    as_number,
    clip,
    count_true,
    dtype_of,
    imputed_kurtosis,
    infinite,
    is_float,
    is_integer,
    is_temporal,
    missing,
    total,
)
from tablefit.operators.columns import Roles, distinct_counts, lenient_timestamp
from tablefit.operators.order import with_previous
from tablefit.operators.profile import duplicate_rows, pair_correlations
from tablefit.operators.select import medians, with_tile

HIGH_MISSING = 0.40
COLLINEAR = 0.92
LEAKAGE = 0.98
DRIFT = 0.5
HEAVY_TAIL = 5.0
CONTAMINATION = 0.05
FOREST_SAMPLE = 2000


def names_where(flags: dict[str, Column]) -> Column:
    """Sorted-by-schema array of the names whose flag is true."""
    marked = [F.when(F.coalesce(flag, F.lit(False)), F.lit(name)) for name, flag in flags.items()]
    return F.array_compact(F.array(*marked)) if marked else F.array().cast("array<string>")


def _spread_key(df: DataFrame, column: str) -> Column:
    """A fixed-width value that is constant exactly when the column is."""
    if is_float(dtype_of(df, column)):
        return as_number(df, column)
    dtype = dtype_of(df, column)
    if is_integer(dtype) or is_temporal(dtype) or dtype.typeName() in ("boolean", "decimal"):
        return F.col(column)
    return F.when(F.col(column).isNotNull(), F.xxhash64(F.col(column)))


def cell_table(df: DataFrame, roles: Roles, by: Sequence[str] = ()) -> DataFrame:
    """Raw counts and moments of every column: the one wide scan behind most metrics."""
    by, columns = list(by), roles.columns
    gaps = {c: missing(df, c) for c in columns}
    row_gaps = total([gap.cast("int") for gap in gaps.values()])
    numbers = {c: as_number(df, c) for c in roles.numeric}
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(row_gaps).alias("missing_cells"),
        F.count_if(row_gaps > 0.5 * len(columns)).alias("severely_empty_rows"),
        *[count_true(gap).alias(f"m_{c}") for c, gap in gaps.items()],
        *[F.min(_spread_key(df, c)).alias(f"lo_{c}") for c in columns],
        *[F.max(_spread_key(df, c)).alias(f"hi_{c}") for c in columns],
        *[count_true(infinite(df, c)).alias(f"i_{c}") for c in roles.numeric],
        *[F.avg(F.when(~infinite(df, c), x)).alias(f"c_{c}") for c, x in numbers.items()],
        *[moments(x).alias(f"k_{c}") for c, x in numbers.items() if c in roles.measures],
    )


def moments(x: Column) -> Column:
    return F.struct(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"),
                    F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))


@dataclass(frozen=True)
class TableFacts:
    """A few numbers per table and column that later plans depend on."""

    rows: int
    segments: int
    largest: int
    gappy: frozenset[str]
    centres: dict[str, float]


def table_facts(cells: DataFrame, roles: Roles) -> TableFacts:
    """Totals over the segments of a cell table; one small row reaches the driver."""
    row = cells.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("segments"), F.max("n").alias("largest"), *[F.sum(f"m_{c}").alias(f"m_{c}") for c in roles.columns],
        *[F.try_divide(F.sum(F.col(f"c_{c}") * F.col("n")), F.sum(F.when(F.col(f"c_{c}").isNotNull(), F.col("n"))))
          .alias(f"c_{c}") for c in roles.numeric],
    ).first()
    return TableFacts(
        rows=int(row["rows"] or 0),
        segments=int(row["segments"]),
        largest=int(row["largest"] or 0),
        gappy=frozenset(c for c in roles.columns if row[f"m_{c}"]),
        centres={c: float(row[f"c_{c}"] or 0.0) for c in roles.numeric},
    )


def cell_metrics(df: DataFrame, roles: Roles, by: Sequence[str] = (), cells: DataFrame | None = None) -> DataFrame:
    """Missing, constant and infinite cells, and the spread of the target."""
    by, columns, target = list(by), roles.columns, roles.target
    wide = cell_table(df, roles, by) if cells is None else cells
    rate = {c: F.col(f"m_{c}") / F.col("n") for c in columns}
    none = F.lit(None).cast("double")
    moment = F.col(f"k_{target}") if target in roles.measures else None
    return wide.select(
        *by, "n", F.lit(len(columns)).alias("p"), F.lit(len(roles.numeric)).alias("n_numeric"),
        F.lit(len(roles.features)).alias("n_features"), F.lit(len(roles.measures)).alias("n_measures"),
        "missing_cells", (F.col("missing_cells") / (F.col("n") * len(columns))).alias("missing_rate"),
        names_where({c: r > HIGH_MISSING for c, r in rate.items()}).alias("high_missing_cols"),
        names_where({c: F.col(f"m_{c}") == F.col("n") for c in columns}).alias("empty_cols"),
        "severely_empty_rows",
        names_where({
            c: F.col(f"lo_{c}").eqNullSafe(F.col(f"hi_{c}")) for c in columns
        }).alias("constant_cols"),
        total([F.col(f"i_{c}") for c in roles.numeric]).cast("long").alias("infinite_cells"),
        names_where({c: F.col(f"i_{c}") > 0 for c in roles.numeric}).alias("infinite_cols"),
        F.lit(target is not None and target in columns).alias("target_given"),
        F.lit(target in roles.numeric).alias("target_numeric"),
        (F.col(f"lo_{target}").eqNullSafe(F.col(f"hi_{target}")) if target in columns else F.lit(True))
        .alias("target_constant"),
        (F.col(f"m_{target}") / F.col("n") if target in columns else none).alias("target_missing_rate"),
        (F.sqrt(moment["v"] * moment["n"] / F.nullif(moment["n"] - 1, F.lit(0))) if moment is not None else none)
        .alias("target_std"),
        (adjusted_skewness(moment["n"], moment["g1"]) if moment is not None else none).alias("target_skewness"),
    )


def collinear_pairs(df: DataFrame, roles: Roles, by: Sequence[str] = ()) -> DataFrame:
    """Feature pairs with |r| above 0.92 over complete rows (at least 10 of them)."""
    pairs = pair_correlations(df, roles.features, by, listwise=True)
    return pairs.filter((F.col("n") >= 10) & (F.abs("r") > COLLINEAR))


def leakage_suspects(df: DataFrame, roles: Roles, by: Sequence[str] = ()) -> DataFrame:
    """Features whose |r| with the target exceeds 0.98 over complete rows (more than 10)."""
    pairs = pair_correlations(df, roles.features, by, listwise=True, target=roles.target, only_target=True)
    found = pairs.filter((F.col("n") > 10) & (F.abs("r") > LEAKAGE))
    return found.select(*by, F.col("feat_a").alias("feature"), "n", "r")


def consistency_metrics(df: DataFrame, roles: Roles, by: Sequence[str] = (),
                        centres: dict[str, float] | None = None) -> DataFrame:
    """Complete rows, number of collinear pairs, and leaking features: one scan."""
    by, empty = list(by), F.array().cast("array<string>")
    if len(roles.features) < 2:
        return rows_per_segment(df, by).select(
            *by, F.lit(None).cast("long").alias("clean_rows"), F.lit(0).cast("long").alias("collinear_pairs"),
            empty.alias("leakage_cols"),
        )
    target = roles.target if roles.target in roles.numeric else None
    pairs = pair_correlations(df, roles.features, by, listwise=True, target=target, centres=centres)
    leaking = F.col("feat_b") == target if target else F.lit(False)
    strong = F.coalesce(F.abs("r"), F.lit(0.0))
    metrics = pairs.groupBy(*by).agg(
        F.max(F.when(~leaking, F.col("n"))).alias("clean_rows"),
        F.count_if(~leaking & (strong > COLLINEAR)).alias("collinear_pairs"),
        F.array_sort(F.collect_list(F.when(leaking & (F.col("n") > 10) & (strong > LEAKAGE), F.col("feat_a"))))
        .alias("leakage_cols"),
    )
    if by:
        # A segment without any complete row is absent above.
        metrics = join_on(rows_per_segment(df, by).drop("n"), metrics, by)
    usable = F.coalesce(F.col("clean_rows") >= 10, F.lit(False))
    return metrics.select(
        *by, F.coalesce("clean_rows", F.lit(0)).alias("clean_rows"),
        F.when(usable, F.col("collinear_pairs")).otherwise(0).alias("collinear_pairs"),
        F.when(usable, F.col("leakage_cols")).otherwise(empty).alias("leakage_cols"),
    )


def key_collisions(df: DataFrame, roles: Roles, by: Sequence[str] = ()) -> DataFrame:
    """Surplus rows per identifier column, two missing keys counting as equal."""
    by, ids = list(by), list(roles.identifiers)
    if not ids:
        return rows_per_segment(df, by).select(*by, F.lit(0).cast("long").alias("key_collisions"),
                                               F.lit(0).alias("id_columns"))
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), *[F.max(missing(df, c)).cast("int").alias(f"gap_{c}") for c in ids]
    )
    counts = join_on(counts, distinct_counts(df, ids, by), by)
    surplus = [F.col("rows") - F.col(f"distinct_{c}") - F.col(f"gap_{c}") for c in ids]
    return counts.select(*by, total(surplus).cast("long").alias("key_collisions"),
                         F.lit(len(ids)).alias("id_columns"))


def uniqueness_metrics(df: DataFrame, roles: Roles, by: Sequence[str] = ()) -> DataFrame:
    repeated = duplicate_rows(df, by, roles.columns).drop("n")
    return join_on(repeated, key_collisions(df, roles, by), by)


def first_time_column(df: DataFrame, roles: Roles) -> str | None:
    """The given time axis, else the first column that is a time or is named like one."""
    if roles.time in df.columns:
        return roles.time
    for c in roles.columns:
        if is_temporal(dtype_of(df, c)) or "date" in c.lower() or "time" in c.lower():
            return c
    return None


def duplicate_timestamps(df: DataFrame, time: str, by: Sequence[str] = ()) -> DataFrame:
    """Valid and distinct times, times seen more than once, and their surplus rows."""
    by = list(by)
    stamps = df.select(*by, lenient_timestamp(df, time).alias("ts")).groupBy(*by, "ts").agg(
        F.count(F.lit(1)).alias("c")
    )
    valid = F.col("ts").isNotNull()
    counts = stamps.groupBy(*by).agg(
        F.sum(F.when(~valid, F.col("c")).otherwise(0)).alias("time_invalid"),
        F.sum(F.when(valid, F.col("c")).otherwise(0)).alias("time_valid"),
        F.count_if(valid).alias("time_distinct"),
        count_true(valid & (F.col("c") > 1)).alias("duplicate_groups"),
    )
    surplus = F.col("time_valid") - F.col("time_distinct")
    return counts.withColumns({
        "duplicate_timestamps": surplus,
        "duplicate_rate": surplus / F.greatest(F.lit(1), F.col("time_valid")) * 100,
    })


def temporal_order(df: DataFrame, time: str, row_order: str, by: Sequence[str] = (), **options) -> DataFrame:
    """Backward jumps and cadence of consecutive valid times in arrival order."""
    by = list(by)
    rows = df.select(*by, F.col(row_order).alias("__order"),
                     F.unix_micros(lenient_timestamp(df, time)).alias("at")).filter("at is not null")
    rows = with_previous(rows, ["at"], ["__order"], by, **options)
    gap = (F.col("at") - F.col("prev_at")) / F.lit(1e6)
    stats = rows.select(*by, gap.alias("gap")).groupBy(*by).agg(
        F.count("gap").alias("gaps"), count_true(F.col("gap") < 0).alias("backward_jumps"),
        F.avg("gap").alias("mean"), F.stddev_samp("gap").alias("std"),
    )
    several = F.col("gaps") > 1
    stats = stats.select(
        *by, "gaps", "backward_jumps",
        F.when(several, F.col("mean")).otherwise(1.0).alias("cadence_mean"),
        F.when(several, F.col("std")).otherwise(0.0).alias("cadence_std"),
    )
    return stats.withColumns({
        "cadence_cv": F.when(F.col("cadence_mean") > 0, F.col("cadence_std") / F.col("cadence_mean")).otherwise(0.0),
        "in_order": F.col("backward_jumps") == 0,
    })


def half_split_drift(df: DataFrame, columns: Sequence[str], row_order: str, by: Sequence[str] = (),
                     **options) -> DataFrame:
    """Shift of each column's mean between the first n//2 rows and the rest, in pooled deviations."""
    by, columns = list(by), list(columns)
    rows = df.select(*by, F.col(row_order).alias("__order"), *[as_number(df, c).alias(f"v_{c}") for c in columns])
    rows = with_tile(rows, ["__order"], [lambda n: F.floor(n / 2)], by, "__half", **options)
    first, rest = F.col("__half") == 0, F.col("__half") == 1

    def part(c: str) -> Column:
        a, b = F.when(first, F.col(f"v_{c}")), F.when(rest, F.col(f"v_{c}"))
        pooled = F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)
        moved = F.when(pooled > 1e-6, F.abs(F.avg(a) - F.avg(b)) / F.nullif(pooled, F.lit(0.0))).otherwise(0.0)
        enough = (F.count(F.lit(1)) >= 30) & (F.count(a) >= 10) & (F.count(b) >= 10)
        return F.struct(F.lit(c).alias("column"), F.when(enough, moved).alias("shift"))

    wide = rows.groupBy(*by).agg(*[part(c).alias(f"d{i}") for i, c in enumerate(columns)])
    long = wide.select(*by, F.inline(F.array(*[F.col(f"d{i}") for i in range(len(columns))])))
    return long.withColumn("drifted", F.coalesce(F.col("shift") > DRIFT, F.lit(False)))


def timeliness_metrics(df: DataFrame, roles: Roles, row_order: str, by: Sequence[str] = (),
                       with_axis: bool = True, facts: TableFacts | None = None) -> DataFrame:
    by = list(by)
    base = rows_per_segment(df, by).drop("n") if by else df.sparkSession.range(1).drop("id")
    empty = F.array().cast("array<string>")
    if roles.features:
        counted = (facts.segments, facts.largest) if facts else None
        drift = half_split_drift(df, roles.features, row_order, by, counted=counted).groupBy(*by).agg(
            F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("column")))).alias("drifted_cols")
        )
        base = join_on(base, drift, by)
    else:
        base = base.withColumn("drifted_cols", empty)
    axis = first_time_column(df, roles)
    base = base.withColumns({
        "time_given": F.lit(roles.time is not None and roles.time in df.columns),
        "time_found": F.lit(axis is not None),
    })
    if axis is None or not with_axis:
        nothing = {c: F.lit(None).cast("long") for c in
                   ("time_invalid", "time_valid", "time_distinct", "duplicate_groups", "duplicate_timestamps",
                    "backward_jumps")}
        return base.withColumns({**nothing, **{c: F.lit(None).cast("double") for c in (
            "cadence_mean", "cadence_std", "cadence_cv")}})
    stamps = duplicate_timestamps(df, axis, by).drop("duplicate_rate")
    order = temporal_order(df, axis, row_order, by, rows=facts.rows if facts else None).drop("gaps", "in_order")
    both = join_on(join_on(base, stamps, by), order, by)
    return both.fillna({"backward_jumps": 0, "cadence_mean": 1.0, "cadence_std": 0.0, "cadence_cv": 0.0})


def heavy_tails(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), cells: DataFrame | None = None,
                gappy: Sequence[str] | None = None, **options) -> DataFrame:
    """Adjusted kurtosis of every column after median imputation: ``column, kurtosis, heavy``.

    Medians are only computed for columns that have gaps.
    """
    by, columns = list(by), list(columns)
    numbers = {c: as_number(df, c) for c in columns}
    if gappy is None:
        found = df.agg(*[F.max(x.isNull()).alias(c) for c, x in numbers.items()]).first()
        gappy = [c for c in columns if found[c]]
    gappy = [c for c in columns if c in gappy]
    if cells is None:
        cells = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                                    *[moments(x).alias(f"k_{c}") for c, x in numbers.items()])
    wide = cells.select(*by, "n", *[f"k_{c}" for c in columns])
    if gappy:
        fills = medians(df, gappy, by, **options).withColumnsRenamed({c: f"fill_{c}" for c in gappy})
        wide = join_on(wide, fills, by)

    def entry(c: str) -> Column:
        fill = f"`fill_{c}`" if c in gappy else "CAST(NULL AS DOUBLE)"
        value = imputed_kurtosis(f"`k_{c}`", "n", fill)
        return F.struct(F.lit(c).alias("column"), value.alias("kurtosis"))

    long = wide.select(*by, F.inline(F.array(*[entry(c) for c in columns])))
    return long.withColumn("heavy", F.coalesce(F.abs("kurtosis") > HEAVY_TAIL, F.lit(False)))


def pinned_anomaly_share(n: Column) -> Column:
    """Share of rows strictly below the 5 % quantile of distinct scores, on at most 2,000 rows."""
    size = F.least(n, F.lit(FOREST_SAMPLE)).cast("double")
    return F.ceil(F.round(F.lit(CONTAMINATION) * (size - 1), 9)) / size


def outlier_metrics(df: DataFrame, roles: Roles, by: Sequence[str] = (), **tails) -> DataFrame:
    """Heavy-tailed columns; the anomaly share is the pinned one unless a forest replaces it."""
    by = list(by)
    sizes = rows_per_segment(df, by)
    if not roles.measures:
        return sizes.select(*by, F.array().cast("array<string>").alias("heavy_tail_cols"),
                            F.lit(0.0).alias("anomaly_ratio"))
    heavy = heavy_tails(df, roles.measures, by, **tails).groupBy(*by).agg(
        F.array_sort(F.collect_list(F.when(F.col("heavy"), F.col("column")))).alias("heavy_tail_cols")
    )
    share = F.when(F.col("n") < 15, 0.0).otherwise(pinned_anomaly_share(F.col("n")))
    return join_on(sizes, heavy, by).select(
        *by,
        F.when(F.col("n") < 15, F.array().cast("array<string>")).otherwise(F.col("heavy_tail_cols"))
        .alias("heavy_tail_cols"),
        share.alias("anomaly_ratio"),
    )


def balance_metrics(df: DataFrame, roles: Roles, by: Sequence[str] = (), with_classes: bool = True) -> DataFrame:
    """Minority and majority share of the target's classes, in percent."""
    by = list(by)
    if roles.target not in df.columns or not with_classes:
        sizes = rows_per_segment(df, by)
        return sizes.select(*by, *[F.lit(None).cast("double").alias(c) for c in
                                   ("minority_pct", "majority_pct", "imbalance_ratio")])
    classes = df.groupBy(*by, roles.target).agg(F.count(F.lit(1)).alias("c"))
    given = F.when(~missing(df, roles.target), F.col("c"))
    shares = classes.groupBy(*by).agg(
        F.min(given).alias("least"), F.max(given).alias("most"), F.sum(given).alias("all")
    )
    least, most = F.col("least") / F.col("all"), F.col("most") / F.col("all")
    return shares.select(
        *by, (least * 100).alias("minority_pct"), (most * 100).alias("majority_pct"),
        (most / F.greatest(F.lit(0.001), least)).alias("imbalance_ratio"),
    )


def quality_metrics(df: DataFrame, roles: Roles, row_order: str, by: Sequence[str] = (),
                    tasks: Sequence[str] = TASKS) -> DataFrame:
    """All metrics of all dimensions: one row per segment, written to the shared folder.

    Passes that none of the ``tasks`` needs are left out.
    """
    by = list(by)
    with_axis = roles.time is not None or TIME_SERIES in tasks
    cells = materialize(cell_table(df, roles, by), "cells")
    facts = table_facts(cells, roles)
    metrics = cell_metrics(df, roles, by, cells)
    parts = (
        consistency_metrics(df, roles, by, facts.centres),
        uniqueness_metrics(df, roles, by),
        timeliness_metrics(df, roles, row_order, by, with_axis, facts),
        outlier_metrics(df, roles, by, cells=cells, gappy=facts.gappy, largest=facts.largest),
        balance_metrics(df, roles, by, CLASSIFICATION in tasks),
    )
    for part in parts:
        metrics = join_on(metrics, part, by)
    return materialize(metrics, "metrics")


# ---------------------------------------------------------------- scores


def completeness_score(missing_rate: Column, high: Column, empty: Column) -> Column:
    return clip(100 - 80.0 * missing_rate - 5.0 * high - 15.0 * empty, 0.0, 100.0)


def target_penalty(task: Column, given: Column, constant: Column, numeric: Column) -> Column:
    """Penalty for a target that cannot serve the task; above 0 means veto."""
    supervised = task.isin(CLASSIFICATION, REGRESSION)
    return (
        F.when(~supervised, 0.0).when(~given, 60.0).when(constant, 70.0)
        .when((task == REGRESSION) & ~numeric, 60.0).otherwise(0.0)
    )


def validity_score(constant: Column, infinite_rate: Column, infinite_columns: Column, penalty: Column) -> Column:
    return clip(100 - 10.0 * constant - 100.0 * infinite_rate - 5.0 * infinite_columns - penalty, 10.0, 100.0)


def consistency_score(features: Column, clean: Column, collinear: Column, leaks: Column) -> Column:
    full = clip(100 - 6.0 * collinear - 25.0 * leaks, 15.0, 100.0)
    return F.when(features < 2, 95.0).when(clean < 10, 90.0).otherwise(full)


def uniqueness_score(duplicate_rate: Column, collisions: Column, n: Column, id_columns: Column) -> Column:
    rate = collisions / F.greatest(F.lit(1), n * F.greatest(F.lit(1), id_columns))
    return clip(100 - 100.0 * duplicate_rate - 40.0 * rate, 0.0, 100.0)


def drift_penalty(drifted: Column, features: Column) -> Column:
    return 40.0 * drifted / F.greatest(F.lit(1), features) + 2.0 * drifted


def timeliness_score(task: Column, time_given: Column, time_found: Column, n: Column, invalid: Column,
                     backward: Column, duplicates: Column, cv: Column, drift: Column) -> Column:
    series = task == TIME_SERIES
    penalty = (
        F.when(backward > 0, 45.0).otherwise(0.0)
        + F.when(duplicates > 0, F.least(F.lit(40.0), 150.0 * duplicates / n)).otherwise(0.0)
        + F.when(cv > 1.5, 15.0).otherwise(0.0)
        + 0.5 * drift
    )
    return (
        F.when(series & ~time_found, 15.0)
        .when(series & (invalid / n > 0.2), 25.0)
        .when(series | time_given, clip(100 - penalty, 0.0, 100.0))
        .otherwise(clip(100 - drift, 50.0, 100.0))
    )


def timeliness_veto(task: Column, time_found: Column, n: Column, invalid: Column, backward: Column,
                    duplicates: Column) -> Column:
    broken = ~time_found | (invalid / n > 0.2) | (backward > 0) | (duplicates > 0)
    return F.coalesce((task == TIME_SERIES) & broken, F.lit(False))


def outlier_score(measures: Column, n: Column, share: Column) -> Column:
    full = clip(100 - 300.0 * F.greatest(F.lit(0.0), share - 0.02) - 80.0 * share, 10.0, 100.0)
    return F.when((measures == 0) | (n < 15), 95.0).otherwise(full)


def balance_score(task: Column, minority_pct: Column, target_numeric: Column, target_skewness: Column, n: Column,
                  policy: ImbalancePolicy = ImbalancePolicy()) -> Column:
    penalty = (
        F.when(minority_pct < policy.minority_pct, 80.0).when(minority_pct < policy.severe_pct, 45.0)
        .when(minority_pct < 25, 20.0).otherwise(0.0)
    )
    skew = F.least(F.lit(50.0), 8.0 * F.abs(F.coalesce(target_skewness, F.lit(0.0))))
    return (
        F.when((task == CLASSIFICATION) & minority_pct.isNotNull(), clip(100 - penalty, 10.0, 100.0))
        .when((task == REGRESSION) & target_numeric & (n > 1), clip(100 - skew, 15.0, 100.0))
        .otherwise(95.0)
    )


def coverage_score(features: Column, n: Column) -> Column:
    ratio = n / F.greatest(F.lit(1), features)
    return F.when(features == 0, 90.0).otherwise(
        clip(50 + 50.0 * F.least(F.lit(1.0), ratio / 10), 20.0, 100.0)
    )


def score_dimensions(metrics: DataFrame, tasks: Sequence[str],
                     policy: ImbalancePolicy = ImbalancePolicy()) -> DataFrame:
    """Metrics rows times tasks, with the columns cmp … cov and the veto flags.

    Metrics are computed once; comparing tasks only repeats these expressions.
    """
    rows = metrics.withColumn("task", F.explode(F.array(*map(F.lit, tasks))))
    c = F.col
    drifted = F.size("drifted_cols")
    penalty = target_penalty(c("task"), c("target_given"), c("target_constant"), c("target_numeric"))
    cells = F.greatest(F.lit(1), c("n") * c("n_numeric"))
    scores = {
        "cmp": completeness_score(c("missing_rate"), F.size("high_missing_cols"), F.size("empty_cols")),
        "val": validity_score(F.size("constant_cols"), c("infinite_cells") / cells, F.size("infinite_cols"), penalty),
        "cns": consistency_score(c("n_features"), c("clean_rows"), c("collinear_pairs"), F.size("leakage_cols")),
        "unq": uniqueness_score(c("duplicate_rate"), c("key_collisions"), c("n"), c("id_columns")),
        "tim": timeliness_score(c("task"), c("time_given"), c("time_found"), c("n"), c("time_invalid"),
                                c("backward_jumps"), c("duplicate_timestamps"), c("cadence_cv"),
                                drift_penalty(drifted, c("n_features"))),
        "out": outlier_score(c("n_measures"), c("n"), c("anomaly_ratio")),
        "bal": balance_score(c("task"), c("minority_pct"), c("target_numeric"), c("target_skewness"), c("n"), policy),
        "cov": coverage_score(c("n_features"), c("n")),
    }
    vetoes = {
        "veto_val": penalty > 0,
        "veto_cns": F.size("leakage_cols") > 0,
        "veto_tim": timeliness_veto(c("task"), c("time_found"), c("n"), c("time_invalid"), c("backward_jumps"),
                                    c("duplicate_timestamps")),
        "veto_bal": F.coalesce(
            (c("task") == CLASSIFICATION) & (c("minority_pct") < policy.minority_pct) & F.lit(policy.veto),
            F.lit(False)),
    }
    return rows.withColumns({**{k: v.cast("double") for k, v in scores.items()}, **vetoes})


def scores_long(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and dimension."""
    entries = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(code).alias("score")) for d, code in DIMENSIONS.items()
    ])
    return scored.select(*keys, F.inline(entries))


def scores_wide(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Back to one row per key with the columns cmp … cov."""
    return long.groupBy(*keys).agg(*[
        F.max(F.when(F.col("dimension") == d, F.col("score"))).alias(code)
        for d, code in DIMENSIONS.items()
    ])
