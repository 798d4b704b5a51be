"""Which column is the time axis, which the target, and which task fits the table.

One evidence row per column is gathered by a few aggregates over the table;
every later step is an expression over those small evidence tables, so many
tables are judged in one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablefit.functions.frames import materialize
from tablefit.functions.lookups import (
    CLASS_TARGET_PATTERN,
    CLASSIFICATION,
    CLUSTERING,
    FEATURE_PATTERN,
    ID_PATTERN,
    INT_YEAR_PATTERN,
    NUMERIC_TARGET_PATTERN,
    REGRESSION,
    TIME_PATTERN,
    TIME_SERIES,
    canonical_task,
)
from tablefit.functions.stats import as_number, dtype_of, is_integer, is_numeric, missing
from tablefit.operators.columns import (
    SKETCH_ERROR,
    distinct_counts,
    fitting_layouts,
    kind_of,
    lenient_timestamp,
    time_likeness,
)
from tablefit.operators.order import with_previous


# Numbers of distinct values, and shares of the given cells, that decisions below depend on.
DISTINCT_LIMITS = (1, 2, 5, 10, 12, 15, 20, 30)
DISTINCT_SHARES = (0.05, 0.5, 0.9, 1.0)


def near_a_limit(sketch: float, given: int, errors: float = 6.0) -> bool:
    """May the true count be on another side of a limit than the sketch's estimate? ``errors``: standard errors allowed."""
    low, high = sketch / (1 + errors * SKETCH_ERROR), sketch / (1 - errors * SKETCH_ERROR)
    return any(low - 1 <= x <= high + 1 for x in (*DISTINCT_LIMITS, *(share * given for share in DISTINCT_SHARES)))


def column_evidence(df: DataFrame, dataset: str, row_order: str | None = None,
                    without: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """One row per column: kind, counts, spread, sequence behaviour, time likeness.

    ``row_order`` is the arrival key; it is needed to recognise running numbers. Distinct values are counted by sketches
    in the same scan; columns whose sketch is near a limit that decisions depend on (or all with ``exact``) are counted
    exactly.
    """
    columns = [c for c in df.columns if c not in without]
    kinds = {c: kind_of(dtype_of(df, c)) for c in columns}
    integers = [c for c in columns if is_integer(dtype_of(df, c))]
    numbers = {c: as_number(df, c) for c in columns if is_numeric(dtype_of(df, c))}
    layouts = fitting_layouts(df, [c for c in columns if kinds[c] == "text"])
    base = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(~missing(df, c)).alias(f"given_{c}") for c in columns],
        *[F.approx_count_distinct(F.when(~missing(df, c), F.col(c)), SKETCH_ERROR).alias(f"distinct_{c}") for c in columns],
        *[agg.alias(f"{name}_{c}") for c, x in numbers.items()
          for name, agg in (("min", F.min(x)), ("max", F.max(x)), ("std", F.stddev_samp(x)))],
        *[agg.alias(f"{name}_{c}") for c in columns if kinds[c] == "text"
          for name, agg in time_likeness(c, layouts[c]).items()],
    )
    # One row, which the next decision and all rows below read.
    base = materialize(base, "evidence")
    sketch = base.first()
    close = [c for c in columns if exact or near_a_limit(sketch[f"distinct_{c}"], sketch[f"given_{c}"])]
    if close:
        base = base.drop(*[f"distinct_{c}" for c in close]).crossJoin(distinct_counts(df, close))
    if row_order and integers:
        base = base.crossJoin(_steps(df, integers, row_order))
    none = F.lit(None)

    def entry(i: int, c: str) -> Column:
        def pick(name: str, kind: str) -> Column:
            return F.col(f"{name}_{c}") if f"{name}_{c}" in base.columns else none.cast(kind)

        return F.struct(
            F.lit(c).alias("column"), F.lit(i).alias("position"), F.lit(kinds[c]).alias("kind"),
            F.col("n"), F.col(f"given_{c}").alias("given"), F.col(f"distinct_{c}").alias("n_unique"),
            pick("min", "double").alias("min"), pick("max", "double").alias("max"), pick("std", "double").alias("std"),
            pick("step_min", "double").alias("step_min"), pick("step_max", "double").alias("step_max"),
            pick("all_numbers", "boolean").alias("all_numbers"), pick("parsed", "double").alias("parsed"),
            pick("years_ok", "double").alias("years_ok"),
        )

    rows = base.select(F.inline(F.array(*[entry(i, c) for i, c in enumerate(columns)])))
    many, given = F.col("given"), F.col("given") > 0
    year_range = (F.col("min") >= 1800) & (F.col("max") <= 2100)
    likely = (
        F.when(~given, F.col("kind") == "time")
        .when(F.col("kind") == "time", True)
        .when(F.col("kind") == "int", F.col("column").rlike(INT_YEAR_PATTERN) & year_range)
        .when(F.col("kind") == "text", ~F.col("all_numbers") & (F.col("parsed") >= 0.8) & (F.col("years_ok") >= 0.8))
        .otherwise(False)
    )
    by_name = F.col("column").rlike(TIME_PATTERN) & given & (
        F.when(F.col("kind") == "int", year_range).when(F.col("kind") == "text", F.col("parsed") >= 0.5)
        .otherwise(False)
    )
    return rows.select(
        F.lit(dataset).alias("dataset"), F.lit(len(columns)).alias("n_columns"),
        F.lit(len(numbers)).alias("n_numeric"), "column", "position", "kind", "n", many.alias("given"), "n_unique",
        "min", "max", "std", "step_min", "step_max",
        F.coalesce(likely, F.lit(False)).alias("likely_time"),
        F.coalesce(likely | by_name, F.lit(False)).alias("time_candidate"),
    )


def _steps(df: DataFrame, integers: Sequence[str], row_order: str) -> DataFrame:
    """Smallest and largest difference of consecutive given cells, per integer column."""
    names = {c: f"__v{i}" for i, c in enumerate(integers)}
    rows = df.select(F.col(row_order).alias("__order"), *[F.col(c).cast("double").alias(v) for c, v in names.items()])
    rows = with_previous(rows, list(names.values()), ["__order"])
    step = {c: F.col(v) - F.col(f"prev_{v}") for c, v in names.items()}
    return rows.agg(*[f(step[c]).alias(f"step_{name}_{c}") for c in integers
                      for name, f in (("min", F.min), ("max", F.max))])


def timestamp_candidates(evidence: DataFrame, explicit: str | None = None) -> DataFrame:
    chosen = F.col("column") == explicit if explicit else F.col("time_candidate")
    return evidence.filter(chosen).select("dataset", "column", "position")


def target_candidates(evidence: DataFrame, explicit: str | None = None) -> DataFrame:
    """Scored target candidates per dataset: type, score, confidence, rank."""
    c = F.col
    rate = c("n_unique") / F.greatest(F.lit(1), c("given"))
    if explicit:
        chosen = evidence.filter(c("column") == explicit)
        kind = F.when(c("kind").isin("int", "float", "bool") & (c("n_unique") > 15), "regression")
        return chosen.select(
            "dataset", "column", "position", kind.otherwise("classification").alias("target_type"),
            F.lit(100.0).alias("score"), F.lit(1.0).alias("confidence"), F.lit(1).alias("rank"),
        )
    text, integer, floating = c("kind") == "text", c("kind") == "int", c("kind") == "float"
    constant_step = integer & (c("given") > 10) & (c("step_min") == c("step_max"))
    running = (
        (c("step_min") == 1) & (c("step_max") == 1)
        | ((c("step_min") >= 0) | (c("step_max") <= 0)) & (rate > 0.90)
    )
    identifier = c("column").rlike(ID_PATTERN) | (
        ~floating & ((integer & (c("given") > 10) & running) | ((c("n_unique") == c("n")) & (c("n") > 20)))
    )
    suppressed = c("column").rlike(FEATURE_PATTERN)
    class_word, number_word = c("column").rlike(CLASS_TARGET_PATTERN), c("column").rlike(NUMERIC_TARGET_PATTERN)
    last = c("position") == c("n_columns") - 1
    binary = integer & (c("n_unique") == 2) & (c("min") == 0) & (c("max") == 1)
    classes = binary | (integer & c("n_unique").between(2, 10) & class_word)
    few = c("n_unique").between(2, 10)

    def points(condition: Column, value: float) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(0.0)

    by_word = 60 + points(few, 15) + points(last, 20) + points(binary, 20)
    by_place = 35 + points(binary, 20) + points(~classes & text, 20) + points(c("n_numeric") >= 2, 15)
    class_score = F.when(
        c("n_unique").between(2, 30) & (rate < 0.5),
        F.when(class_word, by_word).when(last & few, by_place).otherwise(0.0),
    ).otherwise(0.0)
    others = W.partitionBy("dataset")
    has_time = F.sum(c("likely_time").cast("int")).over(others) > 0
    supported = number_word | (c("n_numeric") >= 2) | has_time
    high = (c("n_unique") >= 20) | ((c("n_unique") >= 12) & (rate >= 0.05))
    number_score = F.when(
        (c("std") > 1e-7) & (c("n_unique") >= 5) & ~F.coalesce(constant_step, F.lit(False)) & supported,
        points(high, 25) + points(~high & (c("n_unique") >= 10), 15) + points(has_time, 15)
        + points(floating, 15) + points(integer & (c("n_unique") >= 20), 10)
        + points((c("max") > c("min")) & (c("std") > 1e-4), 10) + points(number_word, 40)
        + points(last, 20) + points(~last & (c("position") == c("n_columns") - 2) & (c("n_columns") >= 4), 5)
        + points((c("n_columns") >= 3) & (c("n_numeric") >= 3), 10),
    ).otherwise(0.0)
    as_class = text | classes
    scored = evidence.withColumns({
        "target_type": F.when(as_class, "classification").otherwise("regression"),
        "score": F.when(as_class, class_score).when(integer | floating, number_score).otherwise(0.0),
        "__out": ~(c("given") > 0) | c("likely_time") | F.coalesce(identifier, F.lit(False)) | suppressed,
    }).filter(~F.col("__out") & (F.col("score") >= 45))
    order = W.partitionBy("dataset").orderBy(F.col("score").desc(), "position")
    return scored.select(
        "dataset", "column", "position", "target_type", "score",
        F.least(F.lit(0.99), F.col("score") / 100).alias("confidence"),
        F.row_number().over(order).alias("rank"),
    )


def time_evidence(df: DataFrame, dataset: str, candidates: Sequence[str]) -> DataFrame:
    """Per time candidate: valid and distinct times, and what kind of table they suggest."""
    parsed = {c: lenient_timestamp(df, c) for c in candidates}
    if not parsed:
        return df.sparkSession.createDataFrame(
            [], "dataset string, column string, place int, n long, valid long, distinct_times long, "
                "uniqueness double, duplicate_share double, structure string")
    wide = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(at).alias(f"v_{c}") for c, at in parsed.items()],
        *[F.count_distinct(at).alias(f"d_{c}") for c, at in parsed.items()],
    )
    rows = wide.select(F.inline(F.array(*[
        F.struct(F.lit(dataset).alias("dataset"), F.lit(c).alias("column"), F.lit(i).alias("place"), F.col("n"),
                 F.col(f"v_{c}").alias("valid"), F.col(f"d_{c}").alias("distinct_times"))
        for i, c in enumerate(parsed)
    ])))
    some = F.greatest(F.lit(1), F.col("valid"))
    rows = rows.withColumns({
        "uniqueness": F.col("distinct_times") / some,
        "duplicate_share": (F.col("valid") - F.col("distinct_times")) / some,
    })
    structure = (
        F.when(F.col("valid") <= 0.3 * F.col("n"), "unreadable")
        .when((F.col("uniqueness") >= 0.85) & (F.col("duplicate_share") <= 0.10), "series")
        .when((F.col("uniqueness") < 0.70) | (F.col("duplicate_share") > 0.15), "transactional")
        .otherwise("ambiguous")
    )
    return rows.withColumn("structure", structure)


def time_axis(evidence: DataFrame) -> DataFrame:
    """The candidate with the highest share of distinct times, first one on ties."""
    worth = F.when(F.col("valid") > 0, F.col("distinct_times") / F.col("valid")).otherwise(-1.0)
    return evidence.groupBy("dataset").agg(
        F.max_by(F.struct("column", "structure", "uniqueness"), F.struct(worth, -F.col("place"))).alias("t")
    ).select("dataset", F.col("t.column").alias("time"), F.col("t.structure").alias("structure"),
             F.col("t.uniqueness").alias("uniqueness"))


def task_probabilities(datasets: DataFrame, targets: DataFrame, axes: DataFrame, evidence: DataFrame,
                       override: str | None = None) -> DataFrame:
    """Share of each task per dataset, the most likely one, and the roles behind it."""
    best = targets.filter("rank = 1").select("dataset", F.col("column").alias("target"), "target_type")
    details = evidence.select("dataset", F.col("column").alias("target"), "kind", "n_unique")
    facts = datasets.join(best, "dataset", "left").join(details, ["dataset", "target"], "left").join(
        axes, "dataset", "left")
    return probabilities_of(facts, override)


def probabilities_of(facts: DataFrame, override: str | None = None) -> DataFrame:
    """Task scores from ``target, target_type, kind, n_unique, time, structure`` rows."""
    c = F.col
    structure = F.when(c("structure") != "unreadable", c("structure"))
    series = F.coalesce(structure == "series", F.lit(False))
    transactional = F.coalesce(structure == "transactional", F.lit(False))
    ambiguous = F.coalesce(structure == "ambiguous", F.lit(False))
    given = c("target").isNotNull()
    numeric = c("kind").isin("int", "float", "bool")
    continuous = given & ((numeric & (c("n_unique") > 15)) | (c("target_type") == "regression"))
    continuous = F.coalesce(continuous, F.lit(False))
    discrete = given & ~continuous

    def rule(base: float, *cases: tuple[Column, float]) -> Column:
        value = F.lit(base)
        for condition, points in cases:
            value = value + F.when(condition, points).otherwise(0.0)
        return value

    no_series = ~series & ~ambiguous
    supervised = {
        REGRESSION: rule(0.02, (continuous & no_series, 1.25), (continuous & series, 0.12),
                         (continuous & ambiguous, 0.85)),
        CLASSIFICATION: rule(0.02, (discrete & no_series, 1.25), (discrete & series, 0.55),
                             (discrete & ambiguous, 0.95)),
        TIME_SERIES: rule(0.02, (continuous & transactional, 0.12), (continuous & series, 1.55),
                          (continuous & ambiguous, 0.40), (discrete & transactional, 0.08),
                          (discrete & series, 0.70), (discrete & ambiguous, 0.25), (~given & series, 1.55)),
        CLUSTERING: rule(0.04, (~given & series, 0.08)),
    }
    unlabelled = ~given & ~series
    on_dates = {CLUSTERING: 0.55, TIME_SERIES: 0.20, REGRESSION: 0.15, CLASSIFICATION: 0.10}
    plain = {CLUSTERING: 0.55, TIME_SERIES: 0.15, REGRESSION: 0.15, CLASSIFICATION: 0.15}
    order = (REGRESSION, CLASSIFICATION, TIME_SERIES, CLUSTERING)
    scores = {
        t: F.when(unlabelled & transactional, on_dates[t]).when(unlabelled, plain[t]).otherwise(supervised[t])
        for t in order
    }
    scored = facts.withColumns({f"s_{t}": s for t, s in scores.items()})
    whole = sum([F.col(f"s_{t}") for t in order], F.lit(0.0))
    scored = scored.withColumns({f"p_{t}": F.round(F.col(f"s_{t}") / whole, 3) for t in order})
    # The first task with the highest score wins and takes the rounding residue.
    best = F.array_max(F.array(*[F.struct(F.col(f"s_{t}").alias("s"), F.lit(-i).alias("i"), F.lit(t).alias("task"))
                                 for i, t in enumerate(order)]))
    rounded = sum([F.col(f"p_{t}") for t in order], F.lit(0.0))
    scored = scored.withColumns({"inferred_task": best["task"], "__rest": F.round(1.0 - rounded, 4)})
    scored = scored.withColumns({
        f"p_{t}": F.round(F.col(f"p_{t}") + F.when(F.col("inferred_task") == t, F.col("__rest")).otherwise(0.0), 3)
        for t in order
    })
    confidence = reduce(lambda e, t: F.when(F.col("inferred_task") == t, F.col(f"p_{t}")).otherwise(e), order,
                        F.lit(None).cast("double"))
    chosen = F.lit(canonical_task(override)) if override else F.col("inferred_task")
    return scored.select(
        "dataset", "target", "target_type", "time", "structure", "inferred_task", confidence.alias("confidence"),
        *[F.col(f"p_{t}").alias(f"p_{t}") for t in order], chosen.alias("task"),
        (chosen != F.col("inferred_task")).alias("overridden"),
    )


def infer_task(df: DataFrame, dataset: str, row_order: str | None = None, target: str | None = None,
               time: str | None = None, override: str | None = None, without: Sequence[str] = ()) -> DataFrame:
    """One row: likely task, target and time axis of one table."""
    if not df.columns or df.isEmpty():
        raise ValueError("the table is empty")
    return infer_tasks({dataset: df}, {dataset: row_order}, target, time, override, without)


def infer_tasks(tables: dict[str, DataFrame], row_orders: dict[str, str | None] | None = None,
                target: str | None = None, time: str | None = None, override: str | None = None,
                without: Sequence[str] = ()) -> DataFrame:
    """One row per table, all judged together."""
    row_orders = row_orders or {}
    spark = next(iter(tables.values())).sparkSession
    parts = [column_evidence(df, name, row_orders.get(name), without) for name, df in tables.items()]
    # Evidence has one row per column of each table; it is read several times below.
    rows = [tuple(r) for r in reduce(DataFrame.unionByName, parts).collect()]
    evidence = spark.createDataFrame(rows, parts[0].schema)
    axes: dict[str, list[str]] = {name: [] for name in tables}
    for row in sorted(timestamp_candidates(evidence, time).collect(), key=lambda r: r["position"]):
        axes[row["dataset"]].append(row["column"])
    times = [time_evidence(df, name, axes[name]) for name, df in tables.items()]
    datasets = spark.createDataFrame([(name,) for name in tables], "dataset string")
    return task_probabilities(datasets, target_candidates(evidence, target),
                              time_axis(reduce(DataFrame.unionByName, times)), evidence, override)


def resolve_roles(inferred: DataFrame, columns: DataFrame, target: str | None = None,
                  time: str | None = None) -> DataFrame:
    """Roles per dataset: explicit, else found; a series without target takes its first other number.

    ``columns`` has ``dataset, column, position, kind``.
    """
    axis = F.coalesce(F.lit(time), F.col("time"))
    numbers = columns.filter(F.col("kind").isin("int", "float")).select("dataset", "column", "position")
    joined = inferred.join(numbers, "dataset", "left").withColumn("axis", axis)
    first = F.min_by("column", F.when(~F.col("column").eqNullSafe(F.col("axis")), F.col("position")))
    spare = joined.groupBy("dataset").agg(first.alias("first_number"))
    roles = inferred.join(spare, "dataset", "left")
    series = F.col("task") == TIME_SERIES
    return roles.select(
        "dataset", "task",
        F.coalesce(F.lit(target), F.col("target"), F.when(series, F.col("first_number"))).alias("target"),
        axis.alias("time"),
    )
