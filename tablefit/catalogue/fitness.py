"""Queries: weights, fitness, policy, calibration and actions over scored segments."""

from __future__ import annotations

import posixpath
import uuid
from functools import lru_cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.catalogue.registry import DIRTY_EVENTS, events, query, rounded
from tablefit.functions.frames import shared_folder
from tablefit.functions.lookups import (
    CLASSIFICATION,
    CLUSTERING,
    CODES,
    DIMENSIONS,
    REGRESSION,
    SENSITIVITY,
    STEP_SIZES,
    TASKS,
    TIME_SERIES,
)
from tablefit.operators import actions as act
from tablefit.operators import portfolio, scoring
from tablefit.operators.columns import column_roles
from tablefit.operators.dimensions import scores_long, scores_wide
from tablefit.plans.evaluate import cohort_fitness, evaluate, score_rows
from tablefit.sources.writers import write_report

BY = ["event_type"]
KEYS = ["event_type", "task"]


def fit_events(spark, folder):
    """Events with a twin column, a sparse column and a rare label."""
    df, key = events(spark, folder), F.col("event_id")
    label = (F.pmod(key * 17, F.lit(1000)) < 60).cast("int")
    return df.select(
        "event_type", "event_id", "user_id", "value", "ts",
        (F.col("user_id") * 2 + label * F.lit(0.01)).alias("twin_user"),
        F.when(F.pmod(key * 7, F.lit(100)) >= 45, F.col("user_id").cast("double")).alias("gap_user"),
        label.alias("label"))


@lru_cache(maxsize=8)
def scored(spark, folder, target: str = "value", tasks: tuple[str, ...] = TASKS):
    """Scored segments; many queries below read the same written table."""
    df = fit_events(spark, folder)
    roles = column_roles(df, target, "ts", BY)
    # SQL can't grow a forest: the share that its contamination implies.
    return score_rows(df, roles, tasks, "event_id", BY, anomaly="pinned")


FIT_EVENTS = """fit_events AS (SELECT event_type, event_id, user_id, value, ts,
  user_id*2 + ((event_id*17) % 1000 < 60)::INT * 1e-2 AS twin_user,
  CASE WHEN (event_id*7) % 100 >= 45 THEN user_id::DOUBLE END AS gap_user,
  ((event_id*17) % 1000 < 60)::INT AS label FROM dirty_events)"""


def scored_ctes(target: str, tasks: tuple[str, ...], segment: str = "event_type") -> list[str]:
    """The whole scoring pipeline of ``scored`` as SQL views; the last one is ``scored``, by the given segment."""
    numbers = ["user_id", "value", "twin_user", "gap_user", "label"]
    features = [c for c in numbers if c != target]
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]

    def strong(a: str, b: str, limit: float) -> str:
        return f"(coalesce(abs(CASE WHEN NOT isnan(corr({a}, {b})) THEN corr({a}, {b}) END), 0) > {limit})::INT"

    collinear = " + ".join(strong(a, b, 0.92) for a, b in pairs)
    leaks = " + ".join(strong(a, target, 0.98) for a in features)

    def drift(c: str) -> str:
        pooled = f"sqrt((var_samp({c}) FILTER (WHERE h) + var_samp({c}) FILTER (WHERE NOT h)) / 2)"
        moved = f"abs(avg({c}) FILTER (WHERE h) - avg({c}) FILTER (WHERE NOT h))"
        return f"(CASE WHEN {pooled} > 1e-6 THEN {moved} / {pooled} ELSE 0 END > 0.5)::INT"

    drifted = " + ".join(drift(c) for c in features)
    heavy = " + ".join(f"(coalesce(abs(kurtosis({c})), 0) > 5)::INT" for c in numbers)
    task_rows = ", ".join(f"('{t}', {', '.join(f'{w}::DOUBLE' for w in SENSITIVITY[t])})" for t in tasks)
    sens = ", ".join(f"m_{k}" for k in CODES)
    minority = "100.0 * least_c / n"
    series = "task = 'time_series_forecasting'"
    return [
        DIRTY_EVENTS, FIT_EVENTS.replace("SELECT event_type", f"SELECT {segment} AS event_type"),
        f"""f_cells AS (SELECT event_type, count(*) AS n, count(*) - count(gap_user) AS missing_cells,
         skewness({target}) AS target_skewness, stddev_samp({target}) AS target_std FROM fit_events
         GROUP BY event_type)""",
        f"""f_pairs AS (SELECT event_type, count(*) AS clean_rows, {collinear} AS collinear_pairs, {leaks} AS leaks
         FROM fit_events WHERE gap_user IS NOT NULL GROUP BY event_type)""",
        f"""f_drift AS (SELECT event_type, {drifted} AS drifted FROM (SELECT *,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id)
          <= count(*) OVER (PARTITION BY event_type) // 2 AS h FROM fit_events) GROUP BY event_type)""",
        """f_stamps AS (SELECT event_type, (sum(c) - count(*))::BIGINT AS duplicate_timestamps FROM (
         SELECT event_type, ts, count(*) AS c FROM fit_events GROUP BY ALL) GROUP BY event_type)""",
        """f_gaps AS (SELECT event_type, count(*) FILTER (WHERE gap < 0) AS backward_jumps,
         stddev_samp(gap) / avg(gap) AS cadence_cv FROM (SELECT event_type,
         (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id)) / 1e6 AS gap
         FROM fit_events) GROUP BY event_type)""",
        f"""f_tails AS (SELECT event_type, {heavy} AS heavy FROM (SELECT e.* REPLACE (
         coalesce(gap_user, q) AS gap_user) FROM fit_events e JOIN (SELECT event_type,
         quantile_cont(gap_user, 0.5) AS q FROM fit_events GROUP BY event_type) USING (event_type))
         GROUP BY event_type)""",
        f"""f_class AS (SELECT event_type, min(c) AS least_c, max(c) AS most_c FROM (SELECT event_type, {target},
         count(*) AS c FROM fit_events GROUP BY ALL) GROUP BY event_type)""",
        """f_metrics AS (SELECT *, missing_cells / (7.0 * n)::DOUBLE AS missing_rate,
         (missing_cells / n::DOUBLE > 0.4)::INT AS high_columns,
         ceil(round(0.05 * (least(n, 2000) - 1), 9)) / least(n, 2000)::DOUBLE AS anomaly_ratio
         FROM f_cells JOIN f_pairs USING (event_type) JOIN f_drift USING (event_type) JOIN f_stamps USING (event_type)
         JOIN f_gaps USING (event_type) JOIN f_tails USING (event_type) JOIN f_class USING (event_type))""",
        f"""f_scores AS (SELECT *,
         greatest(0, 100 - 80 * missing_rate - 5 * high_columns)::DOUBLE AS cmp, 100.0::DOUBLE AS val,
         greatest(15, 100 - 6 * collinear_pairs - 25 * leaks)::DOUBLE AS cns, 100.0::DOUBLE AS unq,
         greatest(0, 100 - 45 * (backward_jumps > 0)::INT - CASE WHEN duplicate_timestamps > 0
          THEN least(40, 150 * duplicate_timestamps / n::DOUBLE) ELSE 0 END - 15 * (cadence_cv > 1.5)::INT
          - 0.5::DOUBLE * (40 * drifted / 4.0::DOUBLE + 2 * drifted))::DOUBLE AS tim,
         greatest(10, 100 - 300 * greatest(0, anomaly_ratio - 0.02::DOUBLE) - 80 * anomaly_ratio)::DOUBLE AS out,
         CASE WHEN task = 'supervised_classification' THEN 100 - CASE WHEN {minority} < 2 THEN 80
           WHEN {minority} < 10 THEN 45 WHEN {minority} < 25 THEN 20 ELSE 0 END
          WHEN task = 'supervised_regression' THEN greatest(15, 100 - least(50, 8 * abs(target_skewness)))
          ELSE 95 END::DOUBLE AS bal,
         greatest(20, 50 + 50 * least(1, n / 4.0::DOUBLE / 10))::DOUBLE AS cov
         FROM f_metrics, (VALUES {task_rows}) t(task, {sens}))""",
        f"""f_factors AS (SELECT *,
         m_cmp * CASE WHEN missing_rate > 0.15 THEN 1 + least(0.35, missing_rate * 0.7) ELSE 1 END AS u_cmp,
         m_val AS u_val, m_cns AS u_cns, m_unq AS u_unq,
         m_tim * CASE WHEN {series} AND cadence_cv > 1 THEN 1 + least(0.25, cadence_cv * 0.1) ELSE 1 END AS u_tim,
         m_out * CASE WHEN heavy > 0 THEN 1 + least(0.3::DOUBLE, heavy * 0.1::DOUBLE) ELSE 1 END AS u_out,
         m_bal AS u_bal,
         m_cov * CASE WHEN 7 / sqrt(n) > 0.5 THEN 1 + least(0.25, 7 / sqrt(n) * 0.2) ELSE 1 END AS u_cov
         FROM f_scores)""",
        f"""f_weights AS (SELECT *, {", ".join(f"u_{k} / ({' + '.join('u_' + j for j in CODES)}) AS w_{k}" for k in CODES)}
         FROM f_factors)""",
        f"""f_fitness AS (SELECT *, least(100, greatest(0, {" + ".join(f"{k} * w_{k}" for k in CODES)})) AS raw_fitness,
         leaks > 0 AS d_leak, {series} AND (backward_jumps > 0 OR duplicate_timestamps > 0) AS d_time,
         task = 'supervised_classification' AND ({minority} < 2 OR 100.0 * most_c / n >= 98) AS d_collapse,
         missing_rate > 0.30 OR cmp < 60 AS d_missing, collinear_pairs > 6 AND leaks = 0 AS d_collinear,
         NOT {series} AND drifted >= 3 AS d_drift,
         task = 'supervised_classification' AND {minority} >= 2 AND 100.0 * most_c / n < 98 AND {minority} < 10 AS d_class
         FROM f_weights)""",
        """scored AS (SELECT *, CASE WHEN d_leak OR d_time OR d_collapse THEN 'RED'
          WHEN d_missing OR d_collinear OR d_drift OR d_class THEN 'YELLOW' ELSE 'GREEN' END AS tier,
         CASE WHEN d_leak OR d_time OR d_collapse THEN 0.0 WHEN d_missing OR d_class THEN 65.0
          WHEN d_collinear OR d_drift THEN 70.0 END::DOUBLE AS cap,
         CASE WHEN d_leak OR d_time OR d_collapse THEN 0.0 WHEN d_missing OR d_class THEN least(raw_fitness, 65.0)
          WHEN d_collinear OR d_drift THEN least(raw_fitness, 70.0) ELSE raw_fitness END::DOUBLE AS fitness
         FROM f_fitness)""",
    ]


CTES = scored_ctes("value", TASKS)
LABEL_CTES = scored_ctes("label", (CLASSIFICATION, CLUSTERING))
SCORES = ", ".join(f"round({k}, 6) AS {k}" for k in CODES)


def long_sql(value: str, source: str = "scored", extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT event_type, task, '{d}' AS dimension{extra}, {value.format(k=k)} FROM {source}"
        for d, k in DIMENSIONS.items())


@query("dimension_scores", *CTES, sql=f"SELECT event_type, task, n, {SCORES} FROM scored")
def dimension_scores(spark, folder):
    return rounded(scored(spark, folder).select(*KEYS, "n", *CODES))


@query("fitness_raw", *CTES, sql="SELECT event_type, task, round(raw_fitness, 6) AS raw_fitness FROM scored")
def fitness_raw(spark, folder):
    return rounded(scored(spark, folder).select(*KEYS, "raw_fitness"))


@query("adaptive_weights", *CTES, sql=long_sql(
    "round({k}, 6) AS score, round(w_{k}, 6) AS weight, round({k} * w_{k}, 6) AS weighted_score, "
    "CASE WHEN w_{k} >= 0.18 THEN 'HIGH' WHEN w_{k} >= 0.10 THEN 'MEDIUM' ELSE 'LOW' END AS sensitivity_level"))
def adaptive_weights(spark, folder):
    return rounded(scoring.weights_long(scored(spark, folder), KEYS))


@query("fitness_by_task", *CTES, sql=f"""
SELECT event_type, task, round({" + ".join(f"{k} * m_{k}" for k in CODES)}, 6) AS raw_fitness,
 round(({" + ".join(CODES)}) / 8, 6) AS equal_weight_fitness FROM scored""")
def fitness_by_task(spark, folder):
    return rounded(scoring.fitness_of_scores(scores_long(scored(spark, folder), KEYS), BY))


@query("equal_weight_baseline", *CTES, sql=f"""
SELECT event_type, task, round(({" + ".join(CODES)}) / 8, 6) AS static_fitness FROM scored""")
def equal_weight_baseline(spark, folder):
    rows = scores_wide(scores_long(scored(spark, folder), KEYS), KEYS)
    return rounded(rows.select(*KEYS, scoring.equal_weight_fitness().alias("static_fitness")))


@query("defects", *CTES, sql="""
SELECT event_type, task, 'TARGET_LEAKAGE' AS defect, 'RED' AS tier, 0.0::DOUBLE AS cap FROM scored WHERE d_leak
UNION ALL SELECT event_type, task, 'TEMPORAL_SEQUENCE_DISORDER', 'RED', 0.0 FROM scored WHERE d_time
UNION ALL SELECT event_type, task, 'SEVERE_CLASS_COLLAPSE', 'RED', 0.0 FROM scored WHERE d_collapse
UNION ALL SELECT event_type, task, 'HIGH_MISSINGNESS', 'YELLOW', 65.0 FROM scored WHERE d_missing
UNION ALL SELECT event_type, task, 'SEVERE_MULTICOLLINEARITY', 'YELLOW', 70.0 FROM scored WHERE d_collinear
UNION ALL SELECT event_type, task, 'PARTITION_DISTRIBUTION_DRIFT', 'YELLOW', 70.0 FROM scored WHERE d_drift
UNION ALL SELECT event_type, task, 'MODERATE_CLASS_IMBALANCE', 'YELLOW', 65.0 FROM scored WHERE d_class""")
def defects(spark, folder):
    return scoring.defects_long(scored(spark, folder), KEYS).drop("rule")


@query("fitness_final", *CTES, sql="""
SELECT event_type, task, round(raw_fitness, 6) AS raw_fitness, tier, cap, round(fitness, 6) AS fitness FROM scored""")
def fitness_final(spark, folder):
    return rounded(scored(spark, folder).select(*KEYS, "raw_fitness", "tier", "cap", "fitness"))


@query("fitness_classification", *LABEL_CTES, sql=f"""
SELECT event_type, task, {SCORES}, round(raw_fitness, 6) AS raw_fitness, tier, cap, round(fitness, 6) AS fitness
FROM scored""")
def fitness_classification(spark, folder):
    rows = scored(spark, folder, "label", (CLASSIFICATION, CLUSTERING))
    return rounded(rows.select(*KEYS, *CODES, "raw_fitness", "tier", "cap", "fitness"))


@query("policy_veto", *LABEL_CTES, sql="""
SELECT event_type, task, tier <> 'GREEN' AS vetoed, cap AS veto_cap FROM scored""")
def policy_veto(spark, folder):
    rows = scored(spark, folder, "label", (CLASSIFICATION, CLUSTERING)).drop("tier", "cap", "fitness", "fitness_status")
    return scoring.policy_veto(rows).select(*KEYS, "vetoed", "veto_cap")


@query("veto_ceilings", *CTES, sql="""
SELECT event_type, task, CASE WHEN cmp < 30 THEN 20.0 WHEN task = 'time_series_forecasting' AND tim < 40 THEN 25.0
 WHEN task = 'supervised_classification' AND bal < 25 THEN 15.0 END::DOUBLE AS ceiling FROM scored""")
def veto_ceilings(spark, folder):
    return scored(spark, folder).select(*KEYS, scoring.veto_ceiling().alias("ceiling"))


@query("status_tier", *CTES, sql="""
SELECT event_type, task, CASE WHEN tier = 'RED' THEN 'Critical Defect / Unfit'
 WHEN fitness >= 85 THEN 'High Fitness / Low Risk' WHEN fitness >= 70 THEN 'Moderate Fitness / Conditional'
 WHEN fitness >= 50 THEN 'Sub-Optimal Fitness / High Risk' ELSE 'Critical Defect / Unfit' END AS status FROM scored""")
def status_tier(spark, folder):
    return scored(spark, folder).select(*KEYS, scoring.status_tier(F.col("tier"), F.col("fitness")).alias("status"))


@query("factor_attribution", *CTES, sql="WITH l AS (" + long_sql(
    "w_{k} * (100 - {k}) AS loss, greatest(0.001, 100 - fitness) AS total, {{i}} AS place".replace("{{i}}", "0"))
    + """), o AS (SELECT *, CASE dimension """ + " ".join(
        f"WHEN '{d}' THEN {i}" for i, d in enumerate(DIMENSIONS)) + """ END AS i FROM l)
SELECT event_type, task, dimension, row_number() OVER (PARTITION BY event_type, task ORDER BY loss DESC, i)::INT AS rank,
 round(loss, 6) AS penalty_points, round(loss / total * 100, 6) AS share_of_loss FROM o""")
def factor_attribution(spark, folder):
    return rounded(scoring.factor_attribution(scored(spark, folder), KEYS))


GAIN = "0.8::DOUBLE * w_{k} * (100 - {k})"


@query("recommendations", *CTES, sql="WITH r AS ("
       "SELECT event_type, task, 0 AS i, 'completeness' AS dimension, 'high_missing_columns' AS issue, "
       "CASE WHEN w_cmp > 0.15 THEN 'high' ELSE 'medium' END AS severity, " + GAIN.format(k="cmp") + " AS gain "
       "FROM scored WHERE cmp < 88 AND high_columns > 0 UNION ALL "
       "SELECT event_type, task, 2, 'outlier_anomaly', 'outliers', CASE WHEN task = 'supervised_regression' "
       "THEN 'critical' ELSE 'medium' END, " + GAIN.format(k="out") + " FROM scored WHERE out < 88 UNION ALL "
       "SELECT event_type, task, 3, 'timeliness', 'distribution_shift', CASE WHEN task IN "
       "('supervised_classification', 'time_series_forecasting') THEN 'high' ELSE 'medium' END, "
       + GAIN.format(k="tim") + " FROM scored WHERE tim < 88 UNION ALL "
       "SELECT event_type, task, 4, 'distribution_balance', 'class_imbalance', 'high', 0.7::DOUBLE * "
       + GAIN.format(k="bal") + " FROM scored WHERE bal < 88 AND task = 'supervised_classification' AND "
       "(most_c / n::DOUBLE) / greatest(0.001, least_c / n::DOUBLE) > 5 UNION ALL "
       "SELECT event_type, task, 6, 'consistency', 'target_leakage', 'critical', " + GAIN.format(k="cns")
       + " FROM scored WHERE cns < 88 AND leaks > 0 UNION ALL "
       "SELECT event_type, task, 7, 'consistency', 'collinear_features', 'medium', 0.5::DOUBLE * "
       + GAIN.format(k="cns") + " FROM scored WHERE cns < 88 AND collinear_pairs > 0) "
       "SELECT event_type, task, dimension, issue, severity, round(gain, 6) AS gain, row_number() OVER (PARTITION BY "
       "event_type, task ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 "
       "END, gain DESC, i)::INT AS rank FROM r")
def recommendations(spark, folder):
    return rounded(scoring.recommendations(scored(spark, folder), KEYS))


PREDICT = """CASE task WHEN 'supervised_classification' THEN least(1, greatest(0, 0.94 * pow({f} / 100, 1.15)))
 WHEN 'clustering' THEN least(0.85, greatest(-0.2, -0.2 + 0.85 * {f} / 100))
 ELSE greatest(0.1, target_std * (0.2 + (100 - {f}) * 0.015)) END"""


@query("predicted_metric", *CTES, sql=f"""
SELECT event_type, task, round(({PREDICT.format(f="fitness")})::DOUBLE, 6) AS predicted FROM scored""")
def predicted_metric(spark, folder):
    value = scoring.predicted_metric(F.col("fitness"), F.col("task"), F.col("target_std"))
    return rounded(scored(spark, folder).select(*KEYS, value.alias("predicted")))


def _variance(low: str, factor: str) -> str:
    return " + ".join(f"pow(w_{k} * greatest({low}, {factor.format(s=f'(100 - {k})')}), 2)" for k in CODES)


@query("fitness_interval", *CTES, sql=f"""
WITH v AS (SELECT event_type, task, fitness, {_variance('0.4', '0.06 * {s} / sqrt(greatest(10, n))')} AS a,
 {_variance('0.2', '0.03 * {s}')} AS b, pow((1 - 0.887) * 2.5, 2) AS c, 0.25 AS d FROM scored),
m AS (SELECT *, least(6, greatest(0.5, 1.96 * sqrt(a + b + c + d))) AS margin FROM v)
SELECT event_type, task, round(a::DOUBLE, 6) AS var_sampling, round(b::DOUBLE, 6) AS var_measurement,
 round(margin::DOUBLE, 6) AS margin, round(greatest(0, fitness - margin)::DOUBLE, 6) AS interval_low,
 round(least(100, fitness + margin)::DOUBLE, 6) AS interval_high FROM m""")
def fitness_interval(spark, folder):
    rows = scoring.with_interval(scored(spark, folder), confidence=F.lit(0.887))
    return rounded(rows.select(*KEYS, "var_sampling", "var_measurement", "margin", "interval_low", "interval_high"))


OBSERVED = {CLASSIFICATION: 0.5, REGRESSION: 14.0, CLUSTERING: 0.4, TIME_SERIES: 14.0}
OBSERVED_SQL = "CASE task " + " ".join(f"WHEN '{t}' THEN {v}::DOUBLE" for t, v in OBSERVED.items()) + " END"


def calibrated(spark, folder, target="value", tasks=TASKS):
    rows = scored(spark, folder, target, tasks)
    seen = F.lit(None).cast("double")
    for t, v in OBSERVED.items():
        seen = F.when(F.col("task") == t, v).otherwise(seen)
    return scoring.with_calibration(rows.withColumns({"observed": seen, "target_spread": F.col("target_std")}))


STEPS = ", ".join(f"({s}::DOUBLE)" for s in STEP_SIZES)
MOVED = {k: f"greatest(0.02, least(0.6, w_{k} - eta * g_{k}))" for k in CODES}
CALIBRATION_SQL = f"""
WITH p AS (SELECT *, {OBSERVED_SQL} AS observed, round({PREDICT.format(f="fitness")}::DOUBLE, 2) AS predicted,
 ({" + ".join(CODES)}) / 8 AS mean_score FROM scored),
q AS (SELECT *, round(observed - predicted, 2) AS residual, CASE WHEN predicted - observed > 0 THEN 1 ELSE -1 END
 * CASE task WHEN 'supervised_classification' THEN 0.94 * 1.15 * pow(greatest(0.01, fitness / 100), 0.15) / 100
  WHEN 'clustering' THEN 1 ELSE -0.015 * greatest(0.5, target_std) END AS push FROM p),
g AS (SELECT *, {", ".join(f"push * ({k} - mean_score) * m_{k} AS g_{k}" for k in CODES)} FROM q),
t AS (SELECT g.*, eta, least(100, greatest(0, ({" + ".join(f"{MOVED[k]} * {k}" for k in CODES)})
 / ({" + ".join(MOVED.values())}))) AS moved FROM g, (VALUES {STEPS}) s(eta)),
l AS (SELECT *, abs(round(observed - round(({PREDICT.format(f="moved")})::DOUBLE, 2), 2)) AS loss FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY event_type, task ORDER BY loss, eta) AS i FROM l)
SELECT event_type, task, predicted, round(residual, 6) AS residual_before,
 tier <> 'RED' AND abs(residual) >= 0.02 AND loss < abs(residual) - 1e-4 AS accepted,
 CASE WHEN tier <> 'RED' AND abs(residual) >= 0.02 AND loss < abs(residual) - 1e-4 THEN eta END AS step,
 round(CASE WHEN tier <> 'RED' AND abs(residual) >= 0.02 AND loss < abs(residual) - 1e-4 THEN loss
  ELSE abs(residual) END, 6) AS loss_after,
 round(CASE WHEN tier = 'RED' THEN 0 ELSE least(coalesce(cap, 100), CASE WHEN abs(residual) >= 0.02
  AND loss < abs(residual) - 1e-4 THEN moved ELSE fitness END) END::DOUBLE, 4) AS calibrated_fitness
FROM b WHERE i = 1"""


def _calibration(rows):
    wanted = rows.select(*KEYS, "predicted", "residual_before", "accepted", "step", "loss_after",
                         "calibrated_fitness")
    return rounded(wanted).withColumn("calibrated_fitness", F.round("calibrated_fitness", 4))


@query("calibrate_weights", *CTES, sql=CALIBRATION_SQL)
def calibrate_weights(spark, folder):
    return _calibration(calibrated(spark, folder))


@query("calibrate_capped", *LABEL_CTES, sql=CALIBRATION_SQL)
def calibrate_capped(spark, folder):
    return _calibration(calibrated(spark, folder, "label", (CLASSIFICATION, CLUSTERING)))


@query("conditions_table", *LABEL_CTES, sql=f"""
SELECT event_type, task, 'STATIC_BASELINE' AS condition, round(({" + ".join(CODES)}) / 8, 6) AS raw, 'NONE' AS policy_tier
FROM scored UNION ALL
SELECT event_type, task, c, round(raw_fitness, 6), CASE WHEN c = 'NO_VETO' THEN 'BYPASSED' ELSE tier END
FROM scored, (VALUES ('FULL'), ('NO_VETO'), ('NO_CALIBRATION'), ('NO_REMEDIATION')) t(c)""")
def conditions_table(spark, folder):
    rows = calibrated(spark, folder, "label", (CLASSIFICATION, CLUSTERING))
    return rounded(portfolio.conditions_table(rows, KEYS).drop("final_fitness"))


SERIES_GAIN = "CASE WHEN tier = 'RED' THEN greatest(25, 92 - fitness) ELSE 18 END"
OUT_GAIN = "CASE WHEN tier = 'RED' THEN greatest(20, 85 - fitness) ELSE w_out * (100 - out) * 0.85 END"
FILL_GAIN = "w_cmp * (100 - cmp) * 0.8"
ACTIONS = f"""actions AS (SELECT *, round(gain / cost, 2) AS utility, row_number() OVER (
 PARTITION BY event_type, task ORDER BY round(gain / cost, 2) DESC, rule)::INT AS rank FROM (
 SELECT event_type, task, fitness, 0 AS rule, 'drop_leakage_columns' AS action, 'consistency' AS dimension,
  round((CASE WHEN tier = 'RED' THEN 35 ELSE 18 END * 0.7)::DOUBLE, 1) AS gain, 1 AS cost FROM scored WHERE leaks > 0
 UNION ALL SELECT event_type, task, fitness, 1, 'sort_timestamps', 'timeliness',
  round(({SERIES_GAIN} * 0.7)::DOUBLE, 1), 2 FROM scored WHERE d_time
 UNION ALL SELECT event_type, task, fitness, 2, 'resample_imbalance', 'distribution_balance',
  round((CASE WHEN tier = 'RED' THEN greatest(30, 90 - fitness) ELSE 15 END * 0.7)::DOUBLE, 1), 3 FROM scored
  WHERE task = 'supervised_classification' AND 100.0 * most_c / n >= 95
 UNION ALL SELECT event_type, task, fitness, 4, 'winsorize_outliers', 'outlier_anomaly',
  round(({OUT_GAIN} * 0.7)::DOUBLE, 1), 2 FROM scored WHERE out < 85
 UNION ALL SELECT event_type, task, fitness, 5, 'drop_high_null_columns', 'completeness',
  round(({FILL_GAIN} * 0.7)::DOUBLE, 1), 1 FROM scored WHERE cmp < 90 AND high_columns > 0))"""


def all_actions(spark, folder):
    """Actions of scored segments whose completeness counts double, so that several rules fire."""
    rows = scored(spark, folder, "label", (CLASSIFICATION, CLUSTERING, TIME_SERIES))
    return act.ranked_actions(rows.withColumn("cmp", F.col("cmp") - 10), KEYS, compat=False)


ACTION_CTES = scored_ctes("label", (CLASSIFICATION, CLUSTERING, TIME_SERIES))
# The Spark side lowers completeness by 10 after scoring, which only the action rules see.
ACTIONS = ACTIONS.replace("cmp < 90", "cmp - 10 < 85").replace("(100 - cmp)", "(110 - cmp)")


@query("ranked_actions", *ACTION_CTES, ACTIONS, sql="""
SELECT event_type, task, rank, action, dimension, gain, cost, utility, round(fitness, 6) AS fitness FROM actions""")
def ranked_actions(spark, folder):
    return rounded(all_actions(spark, folder))


@query("projected_fitness", *ACTION_CTES, ACTIONS, sql="""
SELECT event_type, task, count(*) FILTER (WHERE rank <= 2) AS chosen,
 round(coalesce(sum(gain) FILTER (WHERE rank <= 2), 0), 6) AS gain, round(min(fitness), 6) AS fitness,
 round(least(100, min(fitness) + coalesce(sum(gain) FILTER (WHERE rank <= 2), 0), 70 + min(fitness) * 0.3), 6)
  AS projected FROM actions GROUP BY event_type, task""")
def projected_fitness(spark, folder):
    found = all_actions(spark, folder)
    return rounded(act.projected_fitness(found, found.filter("rank <= 2"), KEYS, test_share=0.3))


@query("scenarios", *ACTION_CTES, ACTIONS, sql="""
WITH w AS (SELECT *, count(*) FILTER (WHERE utility >= 1.5) OVER (PARTITION BY event_type, task) AS worthy,
 min(CASE WHEN cost <= 2 THEN rank END) OVER (PARTITION BY event_type, task) AS cheap FROM actions),
s AS (SELECT event_type, task, 'A' AS scenario, fitness, rank = cheap AS pick, action, rank, gain FROM w
 UNION ALL SELECT event_type, task, 'B', fitness, rank <= 2, action, rank, gain FROM w
 UNION ALL SELECT event_type, task, 'C', fitness, worthy = 0 OR utility >= 1.5, action, rank, gain FROM w)
SELECT event_type, task, scenario, coalesce(string_agg(action, ',' ORDER BY rank) FILTER (WHERE pick), '') AS actions,
 least(100, round(min(fitness) + coalesce(sum(gain) FILTER (WHERE pick), 0), 1)) AS projected,
 scenario = 'C' AS recommended FROM s GROUP BY event_type, task, scenario""")
def scenarios(spark, folder):
    rows = act.scenarios(all_actions(spark, folder), KEYS)
    return rows.select(*KEYS, "scenario", F.array_join("actions", ",").alias("actions"), "projected", "recommended")


@query("counterfactuals", *ACTION_CTES, ACTIONS, sql="""
SELECT event_type, task, rank, action, gain, least(100, round(fitness + gain, 1)) AS isolated,
 least(100, round(fitness + sum(gain) OVER (PARTITION BY event_type, task ORDER BY rank), 1)) AS cumulative
FROM actions""")
def counterfactuals(spark, folder):
    return act.counterfactuals(all_actions(spark, folder), KEYS).select(
        *KEYS, "rank", "action", "gain", "isolated", "cumulative")


# A running choice: an action is taken when what is left of the budget pays for it.
TAKE = """list_reduce(list_prepend({{'cost': 0::DOUBLE, 'gain': 0::DOUBLE, 'taken': 0}},
  list({{'cost': cost::DOUBLE, 'gain': gain::DOUBLE, 'taken': 1}} ORDER BY {order})),
  lambda t, a: CASE WHEN t.cost + a.cost <= 4
   THEN {{'cost': t.cost + a.cost, 'gain': t.gain + a.gain, 'taken': t.taken + 1}} ELSE t END)"""


@query("budgeted_actions", *ACTION_CTES, ACTIONS, sql=f"""
WITH t AS (SELECT event_type, task, 'utility' AS strategy, {TAKE.format(order="rank")} AS t FROM actions
  GROUP BY event_type, task
 UNION ALL SELECT event_type, task, 'greedy', {TAKE.format(order="gain DESC, rank")} FROM actions
  GROUP BY event_type, task)
SELECT event_type, task, strategy, t.taken AS taken, round(t.cost, 6) AS total_cost, round(t.gain, 6) AS total_gain
FROM t""")
def budgeted_actions(spark, folder):
    return rounded(act.budgeted_actions(all_actions(spark, folder), KEYS, 4))


@query("empirical_weights", *CTES, sql="WITH o AS ("
       + long_sql("{k} AS score, anomaly_ratio * 0 + target_std AS std, n").replace("FROM scored", "FROM scored")
       + """), p AS (SELECT task, dimension, score, CASE WHEN task = 'supervised_classification' THEN 1 ELSE -1 END * std
 AS performance FROM o),
r AS (SELECT *, rank() OVER (PARTITION BY task, dimension ORDER BY score) + (count(*) OVER (
  PARTITION BY task, dimension, score) - 1) / 2.0::DOUBLE AS rs, rank() OVER (PARTITION BY task, dimension
  ORDER BY performance) + (count(*) OVER (PARTITION BY task, dimension, performance) - 1) / 2.0::DOUBLE AS rp FROM p),
c AS (SELECT task, dimension, corr(rs, rp) AS x FROM r GROUP BY task, dimension),
d AS (SELECT task, dimension, CASE WHEN NOT isnan(x) THEN x END AS rho FROM c),
e AS (SELECT *, greatest(0.01, coalesce(rho, 0)) AS pull FROM d),
s AS (SELECT * FROM (VALUES """ + ", ".join(
           f"('{t}', '{d}', {w}::DOUBLE)" for t in TASKS for d, w in zip(DIMENSIONS, SENSITIVITY[t]))
       + """) s(task, dimension, prior)),
f AS (SELECT *, least(0.6, greatest(0.02, 0.5 * prior + 0.5 * pull / sum(pull) OVER (PARTITION BY task))) AS blend
 FROM e JOIN s USING (task, dimension))
SELECT task, dimension, round(rho, 6) AS rho, round(blend / sum(blend) OVER (PARTITION BY task), 6) AS weight FROM f""")
def empirical_weights(spark, folder):
    rows = scored(spark, folder)
    long = scores_long(rows, [*KEYS, "target_std"])
    learned = scoring.empirical_weights(long.withColumnRenamed("target_std", "performance"))
    return rounded(learned.select("task", "dimension", "rho", "weight"))


FLAGSHIP_CTES = scored_ctes("value", (REGRESSION, CLUSTERING))


@query("flagship_fitness", *FLAGSHIP_CTES, sql=f"""
WITH v AS (SELECT *, least(6, greatest(0.5, 1.96 * sqrt({_variance('0.4', '0.06 * {s} / sqrt(greatest(10, n))')}
 + {_variance('0.2', '0.03 * {s}')} + 0.25))) AS margin FROM scored)
SELECT event_type, task, n, round(raw_fitness, 6) AS raw_fitness, tier, cap, round(fitness, 6) AS fitness,
 round(fitness, 6) AS final_fitness, CASE WHEN tier = 'RED' THEN 'Critical Defect / Unfit'
 WHEN fitness >= 85 THEN 'High Fitness / Low Risk' WHEN fitness >= 70 THEN 'Moderate Fitness / Conditional'
 WHEN fitness >= 50 THEN 'Sub-Optimal Fitness / High Risk' ELSE 'Critical Defect / Unfit' END AS status,
 round(greatest(0, fitness - margin)::DOUBLE, 6) AS interval_low,
 round(least(100, fitness + margin)::DOUBLE, 6) AS interval_high FROM v""")
def flagship_fitness(spark, folder):
    done = evaluate(fit_events(spark, folder), [REGRESSION, CLUSTERING], "value", "ts", "event_id", BY,
                    anomaly="pinned")
    return rounded(done.fitness())


COHORT_CTES = scored_ctes("value", (REGRESSION, CLUSTERING), "ntile(4) OVER (ORDER BY event_id)::INT")


@query("cohort_fitness", *COHORT_CTES, sql=f"""
SELECT event_type AS cohort, task, n, {SCORES}, round(raw_fitness, 6) AS raw_fitness, tier, round(fitness, 6) AS fitness
FROM scored""")
def cohorts_scored(spark, folder):
    done = cohort_fitness(fit_events(spark, folder).drop("event_type"), 4, [REGRESSION, CLUSTERING], "event_id",
                          target="value", time="ts", anomaly="pinned")
    return rounded(done.rows.select("cohort", "task", "n", *CODES, "raw_fitness", "tier", "fitness"))


@query("written_report", *CTES, sql="""
SELECT 'fitness' AS part, count(*) AS rows, round(sum(fitness), 4) AS fitness FROM scored WHERE task IN (
 'supervised_regression', 'clustering')
UNION ALL SELECT 'scores', 8 * count(*), NULL FROM scored WHERE task IN ('supervised_regression', 'clustering')
UNION ALL SELECT 'receipt', count(*), round(sum(fitness), 4) FROM scored WHERE task IN (
 'supervised_regression', 'clustering')""")
def written_report(spark, folder):
    """The report star, written twice under one run: the second time replaces the first."""
    df = fit_events(spark, folder)
    done = evaluate(df, [REGRESSION, CLUSTERING], "value", "ts", "event_id", BY, anomaly="pinned")
    place = posixpath.join(shared_folder(spark), f"report-{uuid.uuid4().hex}")
    for _ in range(2):
        write_report(done.report(df, "run-1"), place, "events", "run-1")
    none = F.lit(None).cast("double")
    sums = {"fitness": F.sum("fitness"), "scores": none, "receipt": F.sum("final_fitness")}
    parts = [spark.read.parquet(posixpath.join(place, name)).filter("run_id = 'run-1' and dataset = 'events'").agg(
        F.count(F.lit(1)).alias("rows"), F.round(value, 4).alias("fitness")).select(F.lit(name).alias("part"), "rows", "fitness")
        for name, value in sums.items()]
    return reduce(DataFrame.unionByName, parts)
