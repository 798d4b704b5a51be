"""Statistics over many datasets, conditions and seeds (one result row per run)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.functions.frames import join_on, materialize
from tablefit.functions.lookups import CODES
from tablefit.functions.stats import correlation
from tablefit.operators.order import with_average_rank
from tablefit.operators.scoring import equal_weight_fitness
from tablefit.operators.select import medians

CONDITIONS = ("FULL", "NO_VETO", "NO_CALIBRATION", "NO_REMEDIATION", "STATIC_BASELINE")


def summary(results: DataFrame, keys: Sequence[str], values: Sequence[str], first: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation, minimum and maximum per key; constants by their first value."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), *[F.min(c).alias(c) for c in first],
        *[agg.alias(f"{v}_{name}") for v in values for name, agg in (
            ("mean", F.avg(v)), ("std", F.stddev_samp(v)), ("min", F.min(v)), ("max", F.max(v)))],
    )


def condition_pivot(results: DataFrame, value: str, conditions: Sequence[str] = CONDITIONS,
                    dataset: str = "dataset") -> DataFrame:
    """Mean of a value: datasets in rows, conditions in columns."""
    return results.groupBy(dataset).pivot("condition", list(conditions)).agg(F.avg(value))


def conditions_table(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Five experiment conditions out of one scored and calibrated row."""
    options = {
        "STATIC_BASELINE": (equal_weight_fitness(), equal_weight_fitness(), "NONE"),
        "FULL": (F.col("raw_fitness"), F.col("calibrated_fitness"), None),
        "NO_VETO": (F.col("raw_fitness"), F.col("raw_fitness"), "BYPASSED"),
        "NO_CALIBRATION": (F.col("raw_fitness"), F.col("fitness"), None),
        "NO_REMEDIATION": (F.col("raw_fitness"), F.col("calibrated_fitness"), None),
    }
    entries = F.array(*[
        F.struct(F.lit(name).alias("condition"), raw.alias("raw"), final.alias("final_fitness"),
                 (F.lit(tier) if tier else F.col("tier")).alias("policy_tier"))
        for name, (raw, final, tier) in options.items()
    ])
    return rows.select(*keys, F.inline(entries))


def ablation_deltas(results: DataFrame, value: str, full: str = "FULL", static: str = "STATIC_BASELINE",
                    dataset: str = "dataset") -> DataFrame:
    """Mean per dataset and condition, and its distance from the full and the static one."""
    means = results.groupBy(dataset, "condition").agg(F.avg(value).alias("mean"))
    anchors = means.groupBy(dataset).agg(
        F.max(F.when(F.col("condition") == full, F.col("mean"))).alias("full"),
        F.max(F.when(F.col("condition") == static, F.col("mean"))).alias("static"),
    )
    return join_on(means, anchors, [dataset]).select(
        dataset, "condition", "mean", (F.col("mean") - F.coalesce("full", F.lit(0.0))).alias("delta_from_full"),
        (F.col("mean") - F.coalesce("static", F.lit(0.0))).alias("delta_from_static"),
    )


def seed_stability(results: DataFrame, value: str, keys: Sequence[str] = ("dataset", "condition")) -> DataFrame:
    spread = F.when(F.count(F.lit(1)) > 1, F.stddev_samp(value)).otherwise(0.0)
    return results.groupBy(*keys).agg(F.avg(value).alias("mean"), spread.alias("std"))


def differences(results: DataFrame, value: str, first: str, second: str, dataset: str = "dataset") -> DataFrame:
    """Per dataset: mean under the first condition minus mean under the second."""
    pivoted = condition_pivot(results, value, [first, second], dataset)
    return pivoted.select(dataset, (F.col(first) - F.col(second)).alias("d")).filter("d is not null")


def paired_statistics(diffs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, deviation, effect size, t and degrees of freedom of differences."""
    stats = diffs.groupBy(*by).agg(
        F.count("d").alias("n"), F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("std_difference"))
    middle = medians(diffs, ["d"], by).withColumnRenamed("d", "median_difference")
    stats = join_on(stats, middle, by)
    std = F.col("std_difference")
    return stats.withColumns({
        "df": F.col("n") - 1,
        "cohen_d": F.when(std > 1e-5, F.col("mean_difference") / std).otherwise(0.0),
        "t_statistic": F.when(std > 0, F.col("mean_difference") / (std / F.sqrt("n"))),
    })


def signed_rank(diffs: DataFrame) -> DataFrame:
    """Wilcoxon signed-rank sums of the nonzero differences: n, W+, W-, W."""
    nonzero = diffs.filter("d <> 0").select(F.abs("d").alias("size"), F.signum("d").alias("side"))
    ranked = with_average_rank(nonzero, "size", name="r")
    sums = ranked.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("side") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.when(F.col("side") < 0, F.col("r"))), F.lit(0.0)).alias("w_minus"),
    )
    return sums.withColumn("w", F.least("w_plus", "w_minus"))


def _half_chances(part: pa.Table) -> pa.Table:
    """Chance of each sum of doubled ranks of one half of the pairs, and of all sums up to it."""
    ranks = part.column("rank").to_numpy()
    chance = np.zeros(int(ranks.sum()) + 1)
    chance[0], top = 1.0, 0
    for rank in ranks.tolist():
        # A pair counts its rank or not, with equal chances.
        chance[rank:top + rank + 1] += chance[:top + 1].copy() if rank else 0.0
        top += rank
        chance[:top + 1] *= 0.5 if rank else 1.0
    return pa.table({"half": pa.array([part.column("half")[0].as_py()] * len(chance), pa.int32()),
                     "s": pa.array(np.arange(len(chance))), "chance": pa.array(chance), "upto": pa.array(np.cumsum(chance))})


def signed_rank_exact(diffs: DataFrame) -> DataFrame:
    """Signed-rank sums with the exact two-sided p over all sign patterns, for any number of pairs.

    The chances of all rank sums are built up for two halves of the pairs, each in a task of its own and as one array of
    the order of n^2 cells; a sum of one half then meets the sums of the other that stay within the limit. No pair, no p.
    """
    sums = signed_rank(diffs)
    ranked = with_average_rank(diffs.filter("d <> 0").select(F.abs("d").alias("size")), "size", name="r")
    # A rank of zero changes nothing; it is there for a half without pairs.
    copies = ranked.groupBy(F.round(F.col("r") * 2).cast("long").alias("rank")).agg(F.count(F.lit(1)).alias("copies"))
    ranks = copies.select("rank", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("i")).select(
        F.pmod(F.xxhash64("rank", "i"), F.lit(2)).cast("int").alias("half"), "rank")
    none = diffs.sparkSession.range(2).select(F.col("id").cast("int").alias("half"), F.lit(0).cast("long").alias("rank"))
    chances = materialize(ranks.unionByName(none).groupBy("half").applyInArrow(
        _half_chances, "half int, s long, chance double, upto double"), "rank-sums")
    tops = chances.agg(*[F.max(F.when(F.col("half") == h, F.col("s"))).alias(f"top{h}") for h in (0, 1)])
    limit = F.floor(2 * F.col("w") + 1e-9)
    # One row on either side.
    bounds = sums.crossJoin(F.broadcast(tops)).withColumn("limit", limit)
    first = chances.filter("half = 0").select("s", "chance").crossJoin(F.broadcast(bounds.select("limit", "top1")))
    first = first.select("chance", F.least(F.col("limit") - F.col("s"), F.col("top1")).alias("at"))
    second = chances.filter("half = 1").select(F.col("s").alias("at"), "upto")
    tail = first.join(second, "at").agg(F.coalesce(F.sum(F.col("chance") * F.col("upto")), F.lit(0.0)).alias("tail"))
    half_way = F.floor((F.col("top0") + F.col("top1")) / 2)
    p = F.when(F.col("limit") >= half_way, 1.0).otherwise(F.least(2 * F.col("tail"), F.lit(1.0)))
    return bounds.crossJoin(F.broadcast(tail)).withColumn("p_exact", F.when(F.col("n") > 0, p)).drop(
        "top0", "top1", "limit", "tail")


def rank_correlations(results: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson and Spearman correlation of two values per group, over complete rows."""
    by = list(by)
    rows = results.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = rows.filter("x is not null and y is not null")
    rows = with_average_rank(with_average_rank(rows, "x", by, "rx"), "y", by, "ry")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), correlation(F.col("x"), F.col("y")).alias("pearson"),
        correlation(F.col("rx"), F.col("ry")).alias("spearman"),
    )


def calibration_errors(results: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Absolute prediction error before and after calibration, per dataset.

    Needs ``outer_metric, predicted_before, predicted_after, policy_masked``.
    """
    before = F.abs(F.col("outer_metric") - F.col("predicted_before"))
    after = F.abs(F.col("outer_metric") - F.col("predicted_after"))
    table = results.groupBy(dataset).agg(
        F.max(F.col("policy_masked").cast("int")).cast("boolean").alias("policy_masked"),
        F.avg(before).alias("error_before"), F.avg(after).alias("error_after"),
    )
    delta = F.col("error_after") - F.col("error_before")
    return table.withColumns({
        "delta": delta, "relative_reduction": F.try_divide(-delta, F.nullif("error_before", F.lit(0.0)))})


def subgroup_statistics(errors: DataFrame, group: str = "policy_masked") -> DataFrame:
    """Error statistics for all datasets and for each value of a flag."""
    labelled = errors.withColumn("group", F.explode(F.array(F.lit("all"), F.col(group).cast("string"))))
    d = F.col("delta")
    stats = labelled.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.avg("error_before").alias("error_before"),
        F.avg("error_after").alias("error_after"), F.avg(d).alias("mean_difference"),
        F.stddev_samp(d).alias("std_difference"), F.bool_and(d == 0).alias("all_zero"),
    )
    middle = medians(labelled, ["delta"], ["group"]).withColumnRenamed("delta", "median_difference")
    return join_on(stats, middle, ["group"])


def mean_scores(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in CODES])
