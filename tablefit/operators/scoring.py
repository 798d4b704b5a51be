"""From dimension scores to fitness: weights, policy, prediction, calibration.

Everything here is a column expression over one row per segment and task, so a
portfolio of any size is scored without a shuffle. Rows carry the columns of
``dimensions.score_dimensions``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefit.functions.lookups import (
    CLASSIFICATION,
    CLUSTERING,
    CODES,
    DIMENSIONS,
    REGRESSION,
    STEP_SIZES,
    TIME_SERIES,
    ImbalancePolicy,
    sensitivity_of,
    sensitivity_table,
)
from tablefit.functions.stats import clip, correlation
from tablefit.operators.order import with_average_rank

W_MIN, W_MAX = 0.02, 0.60


def _sum(columns: Sequence[Column]) -> Column:
    return sum(columns[1:], columns[0])


def weights(code: str) -> Column:
    return F.col(f"w_{code}")


# ---------------------------------------------------------------- weights


def with_base_weights(rows: DataFrame) -> DataFrame:
    """w_cmp … w_cov: sensitivity of the task, normalised to 1."""
    raw = {code: sensitivity_of(code) for code in CODES}
    whole = _sum(list(raw.values()))
    return rows.withColumns({f"w_{code}": value / whole for code, value in raw.items()})


def modulations(compat: bool = True) -> dict[str, Column]:
    """Data-dependent factors on the base weights, per dimension code."""
    c = F.col
    missing_pct, heavy = c("missing_rate") * 100, F.size("heavy_tail_cols")
    load = c("p") / F.sqrt(c("n"))
    factors = {
        "cmp": F.when(missing_pct > 15, 1 + F.least(F.lit(0.35), c("missing_rate") * 0.7)),
        "out": F.when(heavy > 0, 1 + F.least(F.lit(0.30), heavy * 0.1)),
        "cov": F.when(load > 0.5, 1 + F.least(F.lit(0.25), load * 0.2)),
        "tim": F.when((c("task") == TIME_SERIES) & (c("cadence_cv") > 1),
                      1 + F.least(F.lit(0.25), c("cadence_cv") * 0.1)),
        "unq": F.when(c("duplicate_rate") > 0.05, 1 + F.least(F.lit(0.25), c("duplicate_rate") * 0.5)),
    }
    if not compat:
        share = c("majority_pct") / 100
        factors["bal"] = F.when((c("task") == CLASSIFICATION) & (share > 0.85),
                                1 + F.least(F.lit(0.35), (share - 0.5) * 0.7))
    return {code: F.coalesce(factors.get(code, F.lit(None)), F.lit(1.0)).cast("double") for code in CODES}


def with_adaptive_weights(rows: DataFrame, compat: bool = True) -> DataFrame:
    """w_cmp … w_cov: base weights times the data's factors, normalised to 1.

    ``compat`` leaves out the class-dominance factor, whose input the reference
    pipeline never emits.
    """
    factors = modulations(compat)
    raw = {code: sensitivity_of(code) * factors[code] for code in CODES}
    whole = _sum(list(raw.values()))
    return rows.withColumns({f"w_{code}": value / whole for code, value in raw.items()})


def sensitivity_level(weight: Column) -> Column:
    return F.when(weight >= 0.18, "HIGH").when(weight >= 0.10, "MEDIUM").otherwise("LOW")


def weights_long(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(code).alias("score"), weights(code).alias("weight"),
                 (F.col(code) * weights(code)).alias("weighted_score"),
                 sensitivity_level(weights(code)).alias("sensitivity_level"))
        for d, code in DIMENSIONS.items()
    ])
    return rows.select(*keys, F.inline(entries))


# ---------------------------------------------------------------- fitness


def raw_fitness() -> Column:
    return clip(F.expr(" + ".join(f"{code} * w_{code}" for code in CODES)), 0.0, 100.0)


def equal_weight_fitness() -> Column:
    return F.expr(f"({' + '.join(CODES)}) / {len(CODES)}")


def fitness_of_scores(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raw and equal-weight fitness of a long table ``keys…, task, dimension, score``.

    The weight table has 32 fixed rows and is broadcast.
    """
    table = F.broadcast(sensitivity_table(scores.sparkSession))
    joined = scores.join(table, ["task", "dimension"])
    return joined.groupBy(*keys, "task").agg(
        clip(F.sum(F.col("score") * F.col("sensitivity")) / F.sum("sensitivity"), 0.0, 100.0).alias("raw_fitness"),
        F.avg("score").alias("equal_weight_fitness"),
    )


def defect_rules(policy: ImbalancePolicy = ImbalancePolicy()) -> list[tuple[str, str, float, Column]]:
    """(name, tier, cap, condition) in reporting order."""
    # Names, tiers, caps and limits of the defect rules.
    c, task = F.col, F.col("task")
    clf, series = task == CLASSIFICATION, task == TIME_SERIES
    lost = (c("missing_rate") > 0.70) | (c("cmp") < 25)
    leaking = F.size("leakage_cols") > 0
    minority = F.coalesce(c("minority_pct"), F.lit(50.0))
    majority = F.coalesce(c("majority_pct"), F.lit(50.0))
    collapsed = clf & ((minority < policy.minority_pct) | (majority >= 98)) & F.lit(policy.veto)
    return [
        ("CATASTROPHIC_MISSINGNESS", "RED", 0.0, lost),
        ("HIGH_MISSINGNESS", "YELLOW", 65.0, ~lost & ((c("missing_rate") > 0.30) | (c("cmp") < 60))),
        ("INVALID_SCHEMA_OR_TARGET", "RED", 0.0, c("veto_val")),
        ("TARGET_LEAKAGE", "RED", 0.0, leaking),
        ("SEVERE_MULTICOLLINEARITY", "YELLOW", 70.0, ~leaking & (c("collinear_pairs") > 6)),
        ("TEMPORAL_SEQUENCE_DISORDER", "RED", 0.0, series & c("veto_tim")),
        ("PARTITION_DISTRIBUTION_DRIFT", "YELLOW", 70.0, ~series & (F.size("drifted_cols") >= 3)),
        ("SEVERE_CLASS_COLLAPSE", "RED", 0.0, collapsed),
        ("MODERATE_CLASS_IMBALANCE", "YELLOW", 65.0, clf & ~collapsed & (minority < 10)),
        ("HIGH_ROW_DUPLICATION", "YELLOW", 60.0, c("duplicate_rate") > 0.40),
        ("EXTREME_OUTLIER_BURDEN", "YELLOW", 65.0,
         (task == REGRESSION) & (F.size("heavy_tail_cols") >= 2) & (c("anomaly_ratio") > 0.08)),
    ]


def with_defects(rows: DataFrame, policy: ImbalancePolicy = ImbalancePolicy()) -> DataFrame:
    """Add ``defects``: array of (rule, defect, tier, cap) that fired."""
    fired = [
        F.when(F.coalesce(condition, F.lit(False)),
               F.struct(F.lit(i).alias("rule"), F.lit(name).alias("defect"), F.lit(tier).alias("tier"),
                        F.lit(cap).alias("cap")))
        for i, (name, tier, cap, condition) in enumerate(defect_rules(policy))
    ]
    return rows.withColumn("defects", F.array_compact(F.array(*fired)))


def defects_long(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.select(*keys, F.inline("defects"))


def with_tier(rows: DataFrame, raw: str = "raw_fitness") -> DataFrame:
    """Add ``tier``, ``cap`` and ``fitness``: 0 when RED, capped when YELLOW."""
    red = F.exists("defects", lambda d: d["tier"] == "RED")
    caps = F.transform("defects", lambda d: d["cap"])
    tier = F.when(red, "RED").when(F.size("defects") > 0, "YELLOW").otherwise("GREEN")
    cap = F.when(red, 0.0).when(F.size("defects") > 0, F.array_min(caps))
    return rows.withColumns({"tier": tier, "cap": cap}).withColumns({
        "fitness": F.when(F.col("tier") == "RED", 0.0)
        .when(F.col("tier") == "YELLOW", F.least(F.col(raw), F.col("cap"))).otherwise(F.col(raw)),
        "fitness_status": F.when(F.col("tier") == "RED", "UNSAFE").when(F.col("tier") == "YELLOW", "WARNING")
        .otherwise("NORMAL"),
    })


def policy_veto(rows: DataFrame) -> DataFrame:
    """(flag, first reason, cap) view of the policy at raw fitness 100."""
    judged = with_tier(rows.withColumn("__full", F.lit(100.0)), "__full")
    return judged.withColumns({
        "vetoed": F.col("tier") != "GREEN",
        "veto_reason": F.when(F.size("defects") > 0, F.element_at("defects", 1)["defect"]),
        "veto_cap": F.col("cap"),
    }).drop("__full")


def veto_ceiling() -> Column:
    """Ceiling from the scores alone; NULL when none applies."""
    task = F.col("task")
    return (
        F.when(F.col("cmp") < 30, 20.0)
        .when((task == TIME_SERIES) & (F.col("tim") < 40), 25.0)
        .when((task == CLASSIFICATION) & (F.col("bal") < 25), 15.0)
    )


def status_tier(tier: Column, fitness: Column) -> Column:
    # Texts and limits of the status tiers.
    return (
        F.when(tier == "RED", "Critical Defect / Unfit")
        .when(fitness >= 85, "High Fitness / Low Risk")
        .when(fitness >= 70, "Moderate Fitness / Conditional")
        .when(fitness >= 50, "Sub-Optimal Fitness / High Risk")
        .otherwise("Critical Defect / Unfit")
    )


# ---------------------------------------------------------------- explanation


def factor_attribution(rows: DataFrame, keys: Sequence[str], fitness: str = "fitness") -> DataFrame:
    """Points each dimension costs and its share of the loss, largest first."""
    loss = F.greatest(F.lit(0.001), 100 - F.col(fitness))
    entries = [
        F.struct((-weights(code) * (100 - F.col(code))).alias("order"), F.lit(i).alias("place"),
                 F.lit(d).alias("dimension"))
        for i, (d, code) in enumerate(DIMENSIONS.items())
    ]
    ranked = rows.select(*keys, loss.alias("loss"), F.posexplode(F.array_sort(F.array(*entries))).alias("i", "e"))
    return ranked.select(
        *keys, (F.col("i") + 1).alias("rank"), F.col("e.dimension").alias("dimension"),
        (-F.col("e.order")).alias("penalty_points"), (-F.col("e.order") / F.col("loss") * 100).alias("share_of_loss"),
    )


def recommendation_rules(compat: bool = True) -> list[tuple[str, str, Column, float, Column]]:
    """(code, issue, severity, factor on the gain, condition) for dimensions scoring below 88."""
    c, task = F.col, F.col("task")
    rules = [
        ("cmp", "high_missing_columns", F.when(c("w_cmp") > 0.15, "high").otherwise("medium"), 1.0,
         F.size("high_missing_cols") > 0),
        ("cmp", "severely_empty_rows", F.lit("medium"), 0.4, c("severely_empty_rows") > 0),
        ("out", "outliers", F.when(task == REGRESSION, "critical").otherwise("medium"), 1.0, F.lit(True)),
        ("tim", "distribution_shift",
         F.when(task.isin(CLASSIFICATION, TIME_SERIES), "high").otherwise("medium"), 1.0, F.lit(True)),
        ("bal", "class_imbalance", F.lit("high"), 0.7, (task == CLASSIFICATION) & (c("imbalance_ratio") > 5)),
        ("val", "constant_columns", F.lit("low"), 0.5, F.size("constant_cols") > 0),
        ("cns", "target_leakage", F.lit("critical"), 1.0, F.size("leakage_cols") > 0),
        ("cns", "collinear_features", F.lit("medium"), 0.5, c("collinear_pairs") > 0),
    ]
    if not compat:
        rules += [
            ("bal", "missing_target", F.lit("critical"), 1.0, c("target_missing_rate") > 0),
            ("tim", "out_of_order", F.lit("critical"), 1.0, c("backward_jumps") > 0),
            ("tim", "duplicate_timestamps", F.lit("high"), 0.5, c("duplicate_timestamps") > 0),
        ]
    return rules


def recommendations(rows: DataFrame, keys: Sequence[str], compat: bool = True) -> DataFrame:
    """Advice per weak dimension, most severe and most rewarding first."""
    names = dict(zip(CODES, DIMENSIONS))
    fired = []
    for i, (code, issue, severity, factor, condition) in enumerate(recommendation_rules(compat)):
        gain = 0.8 * weights(code) * (100 - F.col(code)) * factor
        order = (
            F.when(severity == "critical", 0).when(severity == "high", 1).when(severity == "medium", 2).otherwise(3)
        )
        fired.append(F.when(
            (F.col(code) < 88) & F.coalesce(condition, F.lit(False)),
            F.struct(order.alias("o"), (-gain).alias("g"), F.lit(i).alias("i"), F.lit(names[code]).alias("dimension"),
                     F.lit(issue).alias("issue"), severity.alias("severity")),
        ))
    ranked = rows.select(*keys, F.posexplode(F.array_sort(F.array_compact(F.array(*fired)))).alias("r", "e"))
    return ranked.select(
        *keys, (F.col("r") + 1).alias("rank"), F.col("e.dimension").alias("dimension"),
        F.col("e.issue").alias("issue"), F.col("e.severity").alias("severity"), (-F.col("e.g")).alias("gain"),
    )


# ---------------------------------------------------------------- prediction and calibration


def metric_name(task: Column) -> Column:
    return F.when(task == CLASSIFICATION, "F1").when(task == CLUSTERING, "Silhouette Score").otherwise("RMSE")


def predicted_metric(fitness: Column, task: Column, target_std: Column) -> Column:
    """Metric a reference model should reach at this fitness (unrounded)."""
    spread = F.coalesce(target_std, F.lit(10.0))
    rmse = F.greatest(F.lit(0.1), spread * (0.20 + (100 - fitness) * 0.015))
    f1 = clip(0.94 * F.pow(fitness / 100, 1.15), 0.0, 1.0)
    silhouette = clip(-0.20 + 0.85 * fitness / 100, -0.20, 0.85)
    return F.when(task == CLASSIFICATION, f1).when(task == CLUSTERING, silhouette).otherwise(rmse)


def with_calibration(rows: DataFrame, observed: str = "observed", target_std: str = "target_spread",
                     fitness: str = "fitness", metric: str | None = None) -> DataFrame:
    """Move the weights so that predicted and observed metric agree, if that helps.

    Adds predicted, residual and loss before and after, the step taken, the
    calibrated weights v_cmp … v_cov and ``calibrated_fitness`` (still capped).
    Fifteen steps are tried per row with array functions: no join, no shuffle.
    """
    task, std, start, seen = F.col("task"), F.col(target_std), F.col(fitness), F.col(observed)
    name = F.col(metric) if metric else metric_name(task)
    slope = (
        F.when(name == "RMSE", -0.015 * F.greatest(F.lit(0.5), std))
        .when(name == "F1", 0.94 * 1.15 * F.pow(F.greatest(F.lit(0.01), start / 100), 0.15) / 100)
        .otherwise(1.0)
    )
    prepared = rows.withColumn("predicted", F.round(predicted_metric(start, task, std), 2))
    prepared = prepared.withColumns({
        "residual_before": F.round(seen - F.col("predicted"), 2),
        "__push": F.when(F.col("predicted") - seen > 0, 1.0).otherwise(-1.0) * slope,
        "__mean": equal_weight_fitness(),
    })
    prepared = prepared.withColumn("loss_before", F.abs("residual_before"))
    pull = {
        code: F.col("__push") * (F.col(code) - F.col("__mean")) * sensitivity_of(code) for code in CODES
    }
    prepared = prepared.withColumns({f"__g_{code}": g for code, g in pull.items()})

    def moved(step: str) -> dict[str, str]:
        return {k: f"greatest({W_MIN}D, least({W_MAX}D, w_{k} - {step} * __g_{k}))" for k in CODES}

    new = moved("eta")
    whole = " + ".join(new.values())
    gained = f"greatest(0D, least(100D, ({' + '.join(f'{new[k]} * {k}' for k in CODES)}) / ({whole})))"
    fitnesses = F.expr(
        f"transform(array({', '.join(f'{e}D' for e in STEP_SIZES)}), "
        f"eta -> named_struct('step', eta, 'fitness', {gained}))")
    best = F.array_min(F.transform(fitnesses, lambda t: F.struct(
        F.abs(F.round(seen - F.round(predicted_metric(t["fitness"], task, std), 2), 2)).alias("loss"),
        t["step"].alias("step"), t["fitness"].alias("fitness"))))
    tried = prepared.withColumn("__best", best)
    helped = (F.col("loss_before") >= 0.02) & (F.col("__best.loss") < F.col("loss_before") - 1e-4)
    tried = tried.withColumn("accepted", F.coalesce((F.col("tier") != "RED") & helped, F.lit(False)))
    new = moved("__best.step")
    whole = " + ".join(new.values())
    result = F.when(F.col("accepted"), F.col("__best.fitness")).otherwise(start)
    capped = F.when(F.col("tier") == "RED", 0.0).otherwise(F.least(result, F.coalesce(F.col("cap"), F.lit(100.0))))
    done = tried.withColumns({
        **{f"v_{code}": F.when(F.col("accepted"), F.expr(f"{new[code]} / ({whole})")).otherwise(weights(code))
           for code in CODES},
        "step": F.when(F.col("accepted"), F.col("__best.step")),
        "loss_after": F.when(F.col("accepted"), F.col("__best.loss")).otherwise(F.col("loss_before")),
        "calibrated_fitness": capped,
    })
    gain = (F.col("loss_before") - F.col("loss_after")) / F.greatest(F.lit(1e-4), F.col("loss_before")) * 100
    status = (
        F.when(F.col("accepted") & (gain >= 5), "Calibration Improved").when(F.col("accepted"), "Calibration Accepted")
        .when(F.col("loss_before") < 0.02, "Calibration Converged").otherwise("Calibration Rejected")
    )
    return done.withColumns({"loss_reduction_pct": gain, "calibration_status": status}).drop(
        "__push", "__mean", "__best", *[f"__g_{code}" for code in CODES]
    )


def with_interval(rows: DataFrame, fitness: str = "fitness", confidence: Column | None = None,
                  residual: Column | None = None) -> DataFrame:
    """Variance components and the interval around the fitness."""
    confidence = F.lit(1.0) if confidence is None else confidence
    residual = F.lit(None).cast("double") if residual is None else residual
    gap = {code: 100 - F.col(code) for code in CODES}
    sample = F.sqrt(F.greatest(F.lit(10), F.col("n")))
    sampling = _sum([F.pow(weights(k) * F.greatest(F.lit(0.4), 0.06 * gap[k] / sample), 2) for k in CODES])
    measurement = _sum([F.pow(weights(k) * F.greatest(F.lit(0.2), 0.03 * gap[k]), 2) for k in CODES])
    task = F.pow((1 - clip(confidence, 0.0, 1.0)) * 2.5, 2)
    gap_size = F.when(residual.isNotNull(), F.least(F.lit(2.5), 0.12 * F.abs(residual)))
    rest = F.pow(F.coalesce(gap_size, F.lit(0.5)), 2)
    few = F.col("n") < 15
    out = rows.withColumns({
        "var_sampling": F.when(few, 1.5).otherwise(sampling),
        "var_measurement": F.when(few, 1.0).otherwise(measurement),
        "var_task": F.when(few, 0.5).otherwise(task),
        "var_residual": F.when(few, 0.2).otherwise(rest),
    })
    spread = F.sqrt(F.col("var_sampling") + F.col("var_measurement") + F.col("var_task") + F.col("var_residual"))
    out = out.withColumn("margin", F.when(few, 3.5).otherwise(clip(1.96 * spread, 0.5, 6.0)))
    return out.withColumns({
        "interval_low": F.greatest(F.lit(0.0), F.col(fitness) - F.col("margin")),
        "interval_high": F.least(F.lit(100.0), F.col(fitness) + F.col("margin")),
    })


def empirical_weights(observations: DataFrame, alpha: float = 0.5, higher_is_better: bool | None = None) -> DataFrame:
    """Weights learned from many scored tables: ``task, dimension, score, performance`` in.

    Per task and dimension the rank correlation of score and performance (at
    least 0.01, shares summing to 1) is blended with the prior weight.
    """
    if higher_is_better is None:
        sign = F.when(F.col("task") == CLASSIFICATION, 1.0).otherwise(-1.0)
    else:
        sign = F.lit(1.0 if higher_is_better else -1.0)
    keys = ["task", "dimension"]
    rows = observations.select(*keys, "score", (F.col("performance") * sign).alias("performance"))
    rows = with_average_rank(rows, "score", keys, "__rs")
    rows = with_average_rank(rows, "performance", keys, "__rp")
    learned = rows.groupBy(*keys).agg(correlation(F.col("__rs"), F.col("__rp")).alias("rho"))
    learned = learned.withColumn("pull", F.greatest(F.lit(0.01), F.coalesce("rho", F.lit(0.0))))
    prior = F.broadcast(sensitivity_table(observations.sparkSession))
    joined = learned.join(prior, keys)
    totals = joined.groupBy("task").agg(F.sum("pull").alias("all_pull"), F.sum("sensitivity").alias("all_prior"))
    blended = joined.join(F.broadcast(totals), "task").withColumn(
        "blend",
        clip((1 - alpha) * F.col("sensitivity") / F.col("all_prior") + alpha * F.col("pull") / F.col("all_pull"),
             W_MIN, W_MAX),
    )
    sums = blended.groupBy("task").agg(F.sum("blend").alias("all_blend"))
    return blended.join(F.broadcast(sums), "task").select(
        *keys, "rho", (F.col("sensitivity") / F.col("all_prior")).alias("prior_weight"),
        (F.col("pull") / F.col("all_pull")).alias("empirical_weight"),
        (F.col("blend") / F.col("all_blend")).alias("weight"),
    )
