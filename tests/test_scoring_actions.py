"""Policy, ceilings, calibration, ranking and decisions on hand-made score rows."""

import pytest
from pyspark.sql import functions as F

from tablefit.functions.lookups import CLASSIFICATION, CODES, DIMENSIONS, REGRESSION, TASKS, TIME_SERIES
from tablefit.operators import actions as act
from tablefit.operators import scoring
from tablefit.operators.compare import with_decision
from tablefit.operators.portfolio import signed_rank_exact

DEFAULTS = {
    "missing_rate": 0.0, "leakage_cols": [], "collinear_pairs": 0, "drifted_cols": [], "minority_pct": 40.0,
    "majority_pct": 60.0, "duplicate_rate": 0.0, "heavy_tail_cols": [], "anomaly_ratio": 0.05, "veto_val": False,
    "veto_tim": False, "cadence_cv": 0.0, "n": 100, "p": 5, "high_missing_cols": [], "backward_jumps": 0,
    "duplicate_timestamps": 0, "target_missing_rate": 0.0, "raw_fitness": 90.0,
    **{code: 90.0 for code in CODES},
}


def rows(spark, task, **changes):
    values = {**DEFAULTS, **changes, "task": task}
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.array(*map(F.lit, value)).cast("array<string>") if isinstance(value, list)
                           else F.lit(value))
    return df


@pytest.mark.parametrize("task, changes, tier, fitness", [
    (REGRESSION, {"missing_rate": 0.75}, "RED", 0.0),
    (REGRESSION, {"missing_rate": 0.35}, "YELLOW", 65.0),
    (CLASSIFICATION, {"minority_pct": 1.2, "majority_pct": 98.8}, "RED", 0.0),
    (CLASSIFICATION, {"minority_pct": 6.0}, "YELLOW", 65.0),
    (REGRESSION, {"collinear_pairs": 7}, "YELLOW", 70.0),
    (REGRESSION, {"leakage_cols": ["a"]}, "RED", 0.0),
    (TIME_SERIES, {"veto_tim": True}, "RED", 0.0),
    (REGRESSION, {"veto_tim": True}, "GREEN", 90.0),
    (REGRESSION, {"drifted_cols": ["a", "b", "c"]}, "YELLOW", 70.0),
    (REGRESSION, {"duplicate_rate": 0.5}, "YELLOW", 60.0),
    (REGRESSION, {"heavy_tail_cols": ["a", "b"], "anomaly_ratio": 0.09}, "YELLOW", 65.0),
    (REGRESSION, {}, "GREEN", 90.0),
])
def test_defect_policy(spark, task, changes, tier, fitness):
    row = scoring.with_tier(scoring.with_defects(rows(spark, task, **changes))).first()
    assert (row["tier"], row["fitness"]) == (tier, fitness)


def test_veto_ceilings(spark):
    def ceiling(task, **scores):
        return rows(spark, task, **scores).select(scoring.veto_ceiling()).first()[0]

    assert ceiling(TIME_SERIES, tim=20.0) == 25 and ceiling(REGRESSION, tim=20.0) is None
    assert ceiling(REGRESSION, cmp=20.0) == 20 and ceiling(CLASSIFICATION, bal=10.0) == 15


@pytest.mark.parametrize("task", TASKS)
def test_weights_sum_to_one(spark, task):
    for weigh in (scoring.with_base_weights, scoring.with_adaptive_weights):
        row = weigh(rows(spark, task, missing_rate=0.4, heavy_tail_cols=["a"])).first()
        assert sum(row[f"w_{c}"] for c in CODES) == pytest.approx(1.0)


def test_calibration_lowers_the_loss_or_keeps_the_weights(spark):
    base = scoring.with_base_weights(rows(spark, REGRESSION, cmp=50.0, out=60.0, cap=None, tier="GREEN"))
    base = base.withColumns({"fitness": scoring.raw_fitness(), "cap": F.lit(None).cast("double")})
    for observed in (1.0, 4.0, 9.0):
        row = scoring.with_calibration(base.withColumns(
            {"observed": F.lit(observed), "target_spread": F.lit(10.0)})).first()
        assert row["loss_after"] <= row["loss_before"]
        assert sum(row[f"v_{c}"] for c in CODES) == pytest.approx(1.0)
        if not row["accepted"]:
            assert row["calibrated_fitness"] == row["fitness"]
    assert scoring.with_calibration(base.withColumns({
        "observed": F.lit(None).cast("double"), "target_spread": F.lit(10.0)})).first()["accepted"] is False


def test_interval_is_narrow_without_doubt(spark):
    base = scoring.with_base_weights(rows(spark, REGRESSION, fitness=90.0))
    row = scoring.with_interval(base).first()
    assert row["var_residual"] == pytest.approx(0.25) and 0.5 <= row["margin"] <= 6


def actions(spark, *gains):
    entries = [("k", 60.0, i + 1, f"a{i + 1}", "completeness", g, c, round(g / c, 2))
               for i, (g, c) in enumerate(gains)]
    return spark.createDataFrame(entries, (
        "key string, fitness double, rank int, action string, dimension string, gain double, cost int, utility double"))


def test_ranking_prefers_gain_per_cost(spark):
    scored = scoring.with_base_weights(rows(spark, TIME_SERIES, leakage_cols=["a"], backward_jumps=1, fitness=0.0,
                                            tier="RED", out=50.0))
    got = act.ranked_actions(scored, ["task"]).collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
    assert [r["utility"] for r in got] == sorted((r["utility"] for r in got), reverse=True)
    assert got[0]["gain"] == pytest.approx(64.4) or got[0]["action"] == "drop_leakage_columns"


def test_projection_scenarios_and_budget(spark):
    df = actions(spark, (28.0, 1), (14.0, 3), (5.0, 2), (6.0, 4))
    first = act.projected_fitness(df, df.filter("rank = 1"), ["key"]).first()
    assert first["projected"] == 88.0
    both = act.projected_fitness(df, df, ["key"]).first()
    assert both["projected"] == 100.0
    plans = {r["scenario"]: r for r in act.scenarios(df, ["key"]).collect()}
    assert plans["A"]["actions"] == ["a1"] and plans["B"]["projected"] == 100.0
    assert plans["C"]["actions"] == ["a1", "a2", "a3", "a4"]
    budget = {r["strategy"]: r for r in act.budgeted_actions(df, ["key"], 4).collect()}
    assert budget["utility"]["total_gain"] == 42.0
    running = [r["cumulative"] for r in act.counterfactuals(df, ["key"]).orderBy("rank").collect()]
    assert running == [88.0, 100.0, 100.0, 100.0]


@pytest.mark.parametrize("before, after, gain, train, test, want", [
    (10.0, 8.0, 0.0, "RED", "GREEN", "BLOCKED"), (10.0, 10.0, 0.0, "GREEN", "RED", "BLOCKED"),
    (10.0, 12.0, 9.0, "GREEN", "GREEN", "REGRESSED"), (10.0, 8.0, 0.0, "GREEN", "RED", "REVIEW_REQUIRED"),
    (10.0, 8.0, 0.0, "GREEN", "GREEN", "ACCEPTED"), (10.0, 10.0, 6.0, "GREEN", "GREEN", "ACCEPTED"),
    (10.0, 10.0, 2.0, "GREEN", "GREEN", "NO_IMPROVEMENT"), (None, 8.0, 9.0, "GREEN", "GREEN", "NO_IMPROVEMENT"),
])
def test_decisions(spark, before, after, gain, train, test, want):
    df = spark.createDataFrame([("RMSE", before, after, 60.0, 60.0 + gain, train, test)], (
        "metric_name string, metric_before double, metric_after double, fitness_before double, fitness_after double, "
        "train_tier string, test_tier string"))
    assert with_decision(df).first()["decision"] == want


def test_signed_rank_of_all_positive_differences(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 9)], "d double")
    row = signed_rank_exact(df).first()
    assert row["w"] == 0 and row["p_exact"] == pytest.approx(2 / 256)


def test_dimension_names_cover_all_codes():
    assert tuple(DIMENSIONS.values()) == CODES
