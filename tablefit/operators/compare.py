"""Before/after comparison of repaired tables, as expressions over one row per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-4


def lower_is_better(metric: Column) -> Column:
    return metric == "RMSE"


def with_change(runs: DataFrame) -> DataFrame:
    """Add the metric's relative change and whether it improved.

    Needs ``metric_name, metric_before, metric_after, fitness_before, fitness_after``.
    """
    c = F.col
    lower = lower_is_better(c("metric_name"))
    delta = c("metric_after") - c("metric_before")
    base = F.when(lower, c("metric_before")).otherwise(F.greatest(F.lit(0.001), c("metric_before")))
    change = F.when(c("metric_before") > 0, F.round(F.try_divide(delta, base) * 100, 2)).otherwise(0.0)
    change = F.when(delta.isNotNull(), change)
    better = F.when(lower, -change).otherwise(change)
    return runs.withColumns({
        "metric_change_pct": change,
        "metric_improvement_pct": F.when(better == 0, 0.0).otherwise(better),
        "performance": F.when(better > 0, "improved").when(better < 0, "deteriorated")
        .when(better == 0, "neutral"),
        "fitness_gain": F.round(c("fitness_after") - c("fitness_before"), 1),
        "metric_gain": F.round(delta, 2),
    })


def with_decision(runs: DataFrame) -> DataFrame:
    """Add ``decision``; also needs ``train_tier`` and ``test_tier``."""
    c = F.col
    delta = c("metric_after") - c("metric_before")
    gain = F.when(lower_is_better(c("metric_name")), -delta).otherwise(delta)
    improved, regressed = gain > TOLERANCE, gain < -TOLERANCE
    test_red = F.coalesce(c("test_tier") == "RED", F.lit(False))
    stable = c("fitness_after") - c("fitness_before")
    return runs.withColumn(
        "decision",
        F.when(c("train_tier") == "RED", "BLOCKED")
        .when(gain.isNull(), "NO_IMPROVEMENT")
        .when(test_red & ~improved, "BLOCKED")
        .when(regressed, "REGRESSED")
        .when(improved & test_red, "REVIEW_REQUIRED")
        .when(improved, "ACCEPTED")
        .when(F.round(stable, 1) > 5, "ACCEPTED")
        .otherwise("NO_IMPROVEMENT"),
    )


def combined_fitness(runs: DataFrame) -> DataFrame:
    """Fitness after repair: by part shares when the whole is RED but train is not.

    Needs ``train_rows, test_rows, train_fitness, test_fitness, full_fitness,
    train_tier, full_tier``.
    """
    c = F.col
    rows = F.greatest(F.lit(1), c("train_rows") + c("test_rows"))
    share = c("train_rows") / rows
    parts = F.round(share * c("train_fitness") + (1 - share) * c("test_fitness"), 1)
    rescued = (c("full_tier") == "RED") & (c("train_tier") != "RED")
    return runs.withColumns({
        "partition_fitness": parts,
        "fitness_after": F.when(rescued, parts).otherwise(c("full_fitness")),
        "tier_after": F.when(rescued, "YELLOW").otherwise(c("full_tier")),
        "irreducible_test_defects": rescued,
    })


def gain_comparison(runs: DataFrame) -> DataFrame:
    """Predicted against observed gain; needs ``predicted_gain`` and ``fitness_gain``."""
    gap = F.abs(F.col("predicted_gain") - F.col("fitness_gain"))
    return runs.withColumns({"gain_gap": F.round(gap, 2), "within_10_points": gap <= 10})
