"""Repair actions ranked by fitness gain per cost, and what choosing them would give.

Rows are those of the scored table (metrics, scores, weights, tier); the rules
are array expressions, so ranking needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablefit.functions.lookups import ACTION_COSTS, CLASSIFICATION, TIME_SERIES

TRAIN_SHARE = 0.70


def action_rules(fitness: Column, vetoed: Column, compat: bool = True) -> list[tuple[str, str, bool, Column, Column]]:
    """(action, dimension, discounted to the train part, gain, condition) in rule order."""
    c, task = F.col, F.col("task")
    series, clf = task == TIME_SERIES, task == CLASSIFICATION
    incomplete = c("cmp") < 85
    fill_gain = c("w_cmp") * (100 - c("cmp")) * 0.8
    wide_gaps = F.size("high_missing_cols") > 0

    def lifted(floor: float, goal: float, otherwise: Column | float) -> Column:
        return F.when(vetoed, F.greatest(F.lit(floor), goal - fitness)).otherwise(otherwise)

    rules = [
        ("drop_leakage_columns", "consistency", True, F.when(vetoed, 35.0).otherwise(18.0),
         F.size("leakage_cols") > 0),
        ("sort_timestamps", "timeliness", True, lifted(25.0, 92.0, 18.0),
         series & ((c("backward_jumps") > 0) | (c("duplicate_timestamps") > 0))),
        ("winsorize_outliers", "outlier_anomaly", True,
         lifted(20.0, 85.0, c("w_out") * (100 - c("out")) * 0.85), c("out") < 85),
        ("drop_high_null_columns", "completeness", True, fill_gain, incomplete & wide_gaps),
        ("impute_median", "completeness", True, fill_gain, incomplete & ~wide_gaps & (c("missing_rate") > 0.05)),
    ]
    if not compat:
        rules[2:2] = [
            ("resample_imbalance", "distribution_balance", True, lifted(30.0, 90.0, 15.0),
             clf & (c("majority_pct") >= 95)),
            ("drop_unlabelled_target", "validity", False, F.lit(14.0), clf & (c("target_missing_rate") > 0.05)),
        ]
    return rules


def ranked_actions(rows: DataFrame, keys: Sequence[str], fitness: str = "fitness",
                   train_share: float = TRAIN_SHARE, compat: bool = True) -> DataFrame:
    """Candidate actions per key: gain, cost, utility (gain per cost) and rank.

    Gains count only for the train part, since test rows are never repaired.
    ``compat`` leaves out rules whose inputs the reference pipeline never emits.
    """
    share = min(1.0, max(0.1, train_share))
    fired = []
    for i, (action, dimension, discounted, gain, condition) in enumerate(
        action_rules(F.col(fitness), F.col("tier") == "RED", compat)
    ):
        kept = F.round(gain * share if discounted else gain, 1)
        utility = F.round(kept / ACTION_COSTS[action], 2)
        fired.append(F.when(
            F.coalesce(condition, F.lit(False)),
            F.struct((-utility).alias("order"), F.lit(i).alias("rule"), F.lit(action).alias("action"),
                     F.lit(dimension).alias("dimension"), kept.alias("gain"),
                     F.lit(ACTION_COSTS[action]).alias("cost")),
        ))
    found = F.array_sort(F.array_compact(F.array(*fired)))
    ranked = rows.select(*keys, F.col(fitness).alias("fitness"), F.posexplode(found).alias("i", "a"))
    return ranked.select(
        *keys, "fitness", (F.col("i") + 1).alias("rank"), F.col("a.action").alias("action"),
        F.col("a.dimension").alias("dimension"), F.col("a.gain").alias("gain"), F.col("a.cost").alias("cost"),
        (-F.col("a.order")).alias("utility"),
    )


def projected_fitness(actions: DataFrame, chosen: DataFrame, keys: Sequence[str],
                      test_share: float | None = None) -> DataFrame:
    """Fitness after the chosen actions (``keys…, action``), at most 100.

    ``test_share`` bounds it by what the untouched test part allows.
    """
    keys = list(keys)
    picked = chosen.select(*keys, "action", F.lit(True).alias("__chosen")).distinct()
    joined = actions.join(picked, [*keys, "action"], "left")
    sums = joined.groupBy(*keys).agg(
        F.first("fitness").alias("fitness"), F.count("__chosen").alias("chosen"),
        F.sum(F.when(F.col("__chosen"), F.col("gain")).otherwise(0.0)).alias("gain"),
    )
    projected = F.col("fitness") + F.col("gain")
    if test_share:
        projected = F.least(projected, 100 * (1 - test_share) + F.col("fitness") * test_share)
    return sums.withColumn("projected", F.least(F.lit(100.0), projected))


def scenarios(actions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Three plans per key: the first cheap action, the top two, and all worth 1.5 per cost."""
    keys = list(keys)
    entry = F.struct("rank", "action", "gain", "cost", "utility")
    grouped = actions.groupBy(*keys).agg(
        F.first("fitness").alias("fitness"), F.array_sort(F.collect_list(entry)).alias("all")
    )
    worthy = F.filter("all", lambda a: a["utility"] >= 1.5)
    plans = {
        "A": F.slice(F.filter("all", lambda a: a["cost"] <= 2), 1, 1),
        "B": F.slice(F.col("all"), 1, 2),
        "C": F.when(F.size(worthy) > 0, worthy).otherwise(F.col("all")),
    }
    options = F.array(*[F.struct(F.lit(n).alias("scenario"), p.alias("plan")) for n, p in plans.items()])
    gain = F.aggregate("plan", F.lit(0.0), lambda total, a: total + a["gain"])
    listed = grouped.select(*keys, "fitness", F.inline(options))
    done = listed.withColumn("projected", F.least(F.lit(100.0), F.round(F.col("fitness") + gain, 1)))
    return done.select(
        *keys, "scenario", F.transform("plan", lambda a: a["action"]).alias("actions"), "projected",
        F.round(F.col("projected") - F.col("fitness"), 1).alias("improvement"),
        (F.col("scenario") == "C").alias("recommended"),
    )


def counterfactuals(actions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fitness with each action alone and with all actions up to it, capped at 100.

    A key has at most seven actions, so the running window stays tiny.
    """
    upto = W.partitionBy(*keys).orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    return actions.select(
        *keys, "rank", "action", "dimension", "cost", "gain", "utility",
        F.least(F.lit(100.0), F.round(F.col("fitness") + F.col("gain"), 1)).alias("isolated"),
        F.least(F.lit(100.0), F.round(F.col("fitness") + F.sum("gain").over(upto), 1)).alias("cumulative"),
    )


def budgeted_actions(actions: DataFrame, keys: Sequence[str], budget: float) -> DataFrame:
    """Total cost and gain within a budget: by utility, and by gain alone."""
    keys = list(keys)
    entry = F.struct("rank", "gain", "cost")
    grouped = actions.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("by_utility"))
    greedy = F.array_sort("by_utility", lambda a, b: F.when(a["gain"] > b["gain"], -1).when(a["gain"] < b["gain"], 1)
                          .otherwise(a["rank"] - b["rank"]))
    start = F.struct(F.lit(0.0).alias("cost"), F.lit(0.0).alias("gain"), F.lit(0).alias("taken"))

    def take(total: Column, a: Column) -> Column:
        fits = total["cost"] + a["cost"] <= budget
        return F.struct(
            F.when(fits, total["cost"] + a["cost"]).otherwise(total["cost"]).alias("cost"),
            F.when(fits, total["gain"] + a["gain"]).otherwise(total["gain"]).alias("gain"),
            F.when(fits, total["taken"] + 1).otherwise(total["taken"]).alias("taken"),
        )

    plans = F.array(*[
        F.struct(F.lit(name).alias("strategy"), F.aggregate(source, start, take).alias("t"))
        for name, source in (("utility", F.col("by_utility")), ("greedy", greedy))
    ])
    return grouped.select(*keys, F.inline(plans)).select(
        *keys, "strategy", F.col("t.taken").alias("taken"), F.col("t.cost").alias("total_cost"),
        F.col("t.gain").alias("total_gain"),
    )
