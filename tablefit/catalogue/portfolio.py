"""Queries: statistics over many datasets (nations), conditions and seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablefit.catalogue.registry import query, rounded, table
from tablefit.operators import portfolio
from tablefit.operators.order import with_chunk

# One result row per dataset, condition and seed: customers grouped by nation, segment and key.
RESULTS = """results AS (SELECT c_nationkey % 15 AS dataset, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'FULL'
 WHEN 'BUILDING' THEN 'NO_VETO' WHEN 'FURNITURE' THEN 'NO_CALIBRATION' WHEN 'HOUSEHOLD' THEN 'NO_REMEDIATION'
 ELSE 'STATIC_BASELINE' END AS condition, (c_custkey % 5)::INT AS seed, avg(c_acctbal) / 97 AS final_fitness,
 stddev_pop(c_acctbal) / 1000 AS observed_metric FROM customer GROUP BY ALL)"""


def results(spark, folder):
    named = {"AUTOMOBILE": "FULL", "BUILDING": "NO_VETO", "FURNITURE": "NO_CALIBRATION", "HOUSEHOLD": "NO_REMEDIATION"}
    condition = F.lit("STATIC_BASELINE")
    for segment, name in named.items():
        condition = F.when(F.col("c_mktsegment") == segment, name).otherwise(condition)
    return table(spark, folder, "customer").groupBy(
        (F.col("c_nationkey") % 15).alias("dataset"), condition.alias("condition"),
        (F.col("c_custkey") % 5).cast("int").alias("seed"),
    ).agg((F.avg("c_acctbal") / 97).alias("final_fitness"), (F.stddev_pop("c_acctbal") / 1000).alias("observed_metric"))


@query("portfolio_summary", RESULTS, sql="""
SELECT dataset, condition, count(*) AS runs, min(seed) AS seed, """ + ", ".join(
    f"round({f}({v}), 6) AS {v}_{n}" for v in ("final_fitness", "observed_metric")
    for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
    + " FROM results GROUP BY dataset, condition")
def portfolio_summary(spark, folder):
    return rounded(portfolio.summary(results(spark, folder), ["dataset", "condition"],
                                     ["final_fitness", "observed_metric"], ["seed"]))


@query("condition_pivot", RESULTS, sql="SELECT dataset, " + ", ".join(
    f"round(avg(final_fitness) FILTER (WHERE condition = '{c}'), 6) AS \"{c}\"" for c in portfolio.CONDITIONS)
    + " FROM results GROUP BY dataset")
def condition_pivot(spark, folder):
    return rounded(portfolio.condition_pivot(results(spark, folder), "final_fitness"))


@query("ablation_deltas", RESULTS, sql="""
WITH m AS (SELECT dataset, condition, avg(final_fitness) AS mean FROM results GROUP BY ALL),
a AS (SELECT dataset, max(mean) FILTER (WHERE condition = 'FULL') AS f,
 max(mean) FILTER (WHERE condition = 'STATIC_BASELINE') AS s FROM m GROUP BY dataset)
SELECT dataset, condition, round(mean, 6) AS mean, round(mean - coalesce(f, 0), 6) AS delta_from_full,
 round(mean - coalesce(s, 0), 6) AS delta_from_static FROM m JOIN a USING (dataset)""")
def ablation_deltas(spark, folder):
    return rounded(portfolio.ablation_deltas(results(spark, folder), "final_fitness"))


@query("seed_stability", RESULTS, sql="""
SELECT dataset, condition, round(avg(final_fitness), 6) AS mean,
 round(CASE WHEN count(*) > 1 THEN stddev_samp(final_fitness) ELSE 0 END, 6) AS std
FROM results GROUP BY dataset, condition""")
def seed_stability(spark, folder):
    return rounded(portfolio.seed_stability(results(spark, folder), "final_fitness"))


DIFFS = """diffs AS (SELECT dataset, avg(final_fitness) FILTER (WHERE condition = 'FULL')
 - avg(final_fitness) FILTER (WHERE condition = 'STATIC_BASELINE') AS d FROM results GROUP BY dataset
 HAVING avg(final_fitness) FILTER (WHERE condition = 'FULL') IS NOT NULL
 AND avg(final_fitness) FILTER (WHERE condition = 'STATIC_BASELINE') IS NOT NULL)"""


def diffs(spark, folder):
    return portfolio.differences(results(spark, folder), "final_fitness", "FULL", "STATIC_BASELINE")


@query("paired_stats", RESULTS, DIFFS, sql="""
SELECT count(d) AS n, round(avg(d), 6) AS mean_difference, round(quantile_cont(d, 0.5), 6) AS median_difference,
 round(stddev_samp(d), 6) AS std_difference, count(d) - 1 AS df, round(avg(d) / stddev_samp(d), 6) AS cohen_d,
 round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS t_statistic FROM diffs""")
def paired_stats(spark, folder):
    return rounded(portfolio.paired_statistics(diffs(spark, folder)))


@query("signed_rank_exact", RESULTS, DIFFS, sql="""
WITH r AS (SELECT d, row_number() OVER (ORDER BY abs(d), dataset) - 1 AS i, rank() OVER (ORDER BY abs(d))
 + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM diffs WHERE d <> 0),
s AS (SELECT count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS wp, coalesce(sum(r) FILTER (WHERE d < 0), 0)
 AS wm, sum(r) AS total FROM r),
p AS (SELECT x.m, sum(CASE WHEN (x.m >> r.i) & 1 = 1 THEN r.r ELSE 0 END) AS w FROM
 (SELECT unnest(range((2 ** (SELECT count(*) FROM r))::BIGINT)) AS m) x, r GROUP BY x.m)
SELECT (SELECT n FROM s) AS n, (SELECT wp FROM s) AS w_plus, (SELECT wm FROM s) AS w_minus,
 (SELECT least(wp, wm) FROM s) AS w, round(avg((least(w, (SELECT total FROM s) - w) <= (SELECT least(wp, wm) FROM s)
 + 1e-9)::INT), 6) AS p_exact FROM p""")
def signed_rank_exact(spark, folder):
    return rounded(portfolio.signed_rank_exact(diffs(spark, folder)))


@query("spearman_by_group", RESULTS, sql="""
WITH c AS (SELECT * FROM results WHERE final_fitness IS NOT NULL AND observed_metric IS NOT NULL),
r AS (SELECT condition, final_fitness AS x, observed_metric AS y,
 rank() OVER (PARTITION BY condition ORDER BY final_fitness)
  + (count(*) OVER (PARTITION BY condition, final_fitness) - 1) / 2.0::DOUBLE AS rx,
 rank() OVER (PARTITION BY condition ORDER BY observed_metric)
  + (count(*) OVER (PARTITION BY condition, observed_metric) - 1) / 2.0::DOUBLE AS ry FROM c)
SELECT condition, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman
FROM r GROUP BY condition""")
def spearman_by_group(spark, folder):
    return rounded(portfolio.rank_correlations(results(spark, folder), "final_fitness", "observed_metric",
                                               ["condition"]))


@query("cohorts", sql="""
SELECT o_orderstatus, cohort, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price,
 round(stddev_samp(o_totalprice), 4) AS std_price FROM (SELECT *,
 ntile(3) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey)::INT AS cohort FROM orders)
GROUP BY o_orderstatus, cohort""")
def cohorts(spark, folder):
    # A low limit sends the query down the path that large segments take.
    tiled = with_chunk(table(spark, folder, "orders"), 3, ["o_orderkey"], ["o_orderstatus"], "cohort",
                       rows_per_task=1000)
    return rounded(tiled.groupBy("o_orderstatus", "cohort").agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price"),
        F.stddev_samp("o_totalprice").alias("std_price")), 4)


NESTED = """nested AS (SELECT dataset, final_fitness AS outer_metric, observed_metric * 30 AS predicted_before,
 CASE WHEN dataset % 4 = 0 THEN observed_metric * 30 ELSE observed_metric * 20 + 15 END AS predicted_after,
 dataset % 4 = 0 AS policy_masked FROM results)"""


def nested(spark, folder):
    masked = F.col("dataset") % 4 == 0
    return results(spark, folder).select(
        "dataset", F.col("final_fitness").alias("outer_metric"), (F.col("observed_metric") * 30).alias("predicted_before"),
        F.when(masked, F.col("observed_metric") * 30).otherwise(F.col("observed_metric") * 20 + 15)
        .alias("predicted_after"), masked.alias("policy_masked"))


ERRORS = """errors AS (SELECT dataset, bool_or(policy_masked) AS policy_masked,
 avg(abs(outer_metric - predicted_before)) AS error_before, avg(abs(outer_metric - predicted_after)) AS error_after
 FROM nested GROUP BY dataset)"""


@query("calibration_errors", RESULTS, NESTED, ERRORS, sql="""
SELECT dataset, policy_masked, round(error_before, 6) AS error_before, round(error_after, 6) AS error_after,
 round(error_after - error_before, 6) AS delta,
 round((error_before - error_after) / error_before, 6) AS relative_reduction FROM errors""")
def calibration_errors(spark, folder):
    return rounded(portfolio.calibration_errors(nested(spark, folder)))


@query("subgroup_statistics", RESULTS, NESTED, ERRORS, sql="""
WITH g AS (SELECT 'all' AS "group", *, error_after - error_before AS d FROM errors
 UNION ALL SELECT policy_masked::VARCHAR, *, error_after - error_before FROM errors)
SELECT "group", count(*) AS n, round(avg(error_before), 6) AS error_before, round(avg(error_after), 6) AS error_after,
 round(avg(d), 6) AS mean_difference, round(quantile_cont(d, 0.5), 6) AS median_difference,
 round(stddev_samp(d), 6) AS std_difference, bool_and(d = 0) AS all_zero FROM g GROUP BY "group" """)
def subgroup_statistics(spark, folder):
    return rounded(portfolio.subgroup_statistics(portfolio.calibration_errors(nested(spark, folder))))
