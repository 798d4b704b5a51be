"""Dimension metrics on small tables with known answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablefit.functions.lookups import CLASSIFICATION, REGRESSION, TIME_SERIES, ImbalancePolicy
from tablefit.functions.stats import kurtosis, skewness
from tablefit.operators import columns, profile
from tablefit.operators import dimensions as dims
from tablefit.operators.columns import column_roles, normalize_missing
from tablefit.operators.profile import column_profile, duplicate_rows, pair_correlations
from tablefit.plans.evaluate import evaluate


def one(df):
    return df.first().asDict()


def test_completeness_counts_every_missing_cell(spark):
    pdf = pd.DataFrame({"a": np.arange(50.0), "b": np.arange(50.0), "c": np.nan, "d": np.arange(50.0)})
    pdf.loc[:9, "a"] = np.nan
    pdf.loc[:4, "d"] = np.nan
    df = spark.createDataFrame(pdf)
    row = one(dims.cell_metrics(df, column_roles(df)))
    assert row["missing_cells"] == 65
    assert row["empty_cols"] == ["c"] and row["high_missing_cols"] == ["c"]
    score = dims.cell_metrics(df, column_roles(df)).select(dims.completeness_score(
        F.col("missing_rate"), F.size("high_missing_cols"), F.size("empty_cols"))).first()[0]
    assert score == pytest.approx(100 - 80 * 65 / 200 - 5 - 15)


def test_duplicate_timestamps_tell_groups_from_rows(spark):
    days = ["2024-01-01"] * 3 + ["2024-01-02"] * 2 + ["2024-01-03", "2024-01-04", "2024-01-05"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i long, t string")
    row = one(dims.duplicate_timestamps(df, "t"))
    assert (row["duplicate_groups"], row["duplicate_timestamps"], row["time_distinct"]) == (2, 3, 5)


def test_swapped_dates_break_the_order(spark):
    days = list(pd.date_range("2024-01-01", periods=20))
    days[5], days[6] = days[6], days[5]
    df = spark.createDataFrame(pd.DataFrame({"i": range(20), "ts": days, "value": np.arange(20.0)}))
    done = evaluate(df, TIME_SERIES, "value", "ts", "i", without=["i"])
    row = one(done.rows)
    assert row["backward_jumps"] == 1 and row["veto_tim"] and row["tim"] < 70 and row["tier"] == "RED"


def test_unordered_sources_must_name_their_order(spark):
    with pytest.raises(ValueError, match="row_order"):
        evaluate(spark.range(5), REGRESSION, "id")


def test_heavy_tails_equal_moments_of_the_imputed_column(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    x[:3] = 60
    x[50:150] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": rng.normal(size=400)}))
    got = {r["column"]: r for r in dims.heavy_tails(df, ["x", "y"]).collect()}
    filled = pd.Series(x).fillna(pd.Series(x).median())
    assert got["x"]["kurtosis"] == pytest.approx(filled.kurt(), rel=1e-9) and got["x"]["heavy"]
    assert not got["y"]["heavy"]


def test_adjusted_moments_equal_pandas(spark):
    x = pd.Series([1.0, 2.0, 2.5, 9.0, 4.0])
    row = spark.createDataFrame(pd.DataFrame({"x": x})).agg(skewness(F.col("x")), kurtosis(F.col("x"))).first()
    assert row[0] == pytest.approx(x.skew()) and row[1] == pytest.approx(x.kurt())


@pytest.mark.parametrize("pct, tier", [(2.0, "YELLOW"), (5.0, "RED")])
def test_imbalance_policy_sets_the_veto(spark, pct, tier):
    pdf = pd.DataFrame({"i": range(100), "feat": np.random.default_rng(0).normal(size=100),
                        "target": [1] * 4 + [0] * 96})
    done = evaluate(spark.createDataFrame(pdf), CLASSIFICATION, "target", row_order="i", without=["i"],
                    policy=ImbalancePolicy(minority_pct=pct))
    assert one(done.rows)["tier"] == tier


def test_collinear_and_leaking_features(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=60)
    pdf = pd.DataFrame({"i": range(60), "a": a, "b": a * 2 + 1, "c": rng.normal(size=60), "y": a * 3 - 4})
    df = spark.createDataFrame(pdf)
    roles = column_roles(df, "y", without=["i"])
    row = one(dims.consistency_metrics(df, roles))
    assert row["collinear_pairs"] == 1 and row["leakage_cols"] == ["a", "b"]
    constant = df.withColumn("k", F.lit(1.0))
    r = {(x["feat_a"], x["feat_b"]): x["r"] for x in pair_correlations(constant, ["a", "k"]).collect()}
    assert r[("a", "k")] is None


def test_correlations_stay_exact_far_from_zero(spark):
    rng = np.random.default_rng(9)
    a = 1e12 + rng.normal(size=500)
    pdf = pd.DataFrame({"a": a, "b": (a - 1e12) * 0.5 + rng.normal(size=500)})
    got = pair_correlations(spark.createDataFrame(pdf), ["a", "b"]).first()["r"]
    assert got == pytest.approx(np.corrcoef(pdf["a"], pdf["b"])[0, 1], abs=1e-6)


def correlations(df, **options):
    return {(r["g"], r["feat_a"], r["feat_b"]): (r["n"], r["r"]) for r in profile.pair_correlations(df, by=["g"], **options).collect()}


def test_matrix_products_equal_pair_sums(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(1e6, 1, (300, 7))
    x[:, 1] = x[:, 0] * 2 + rng.normal(0, 0.1, 300)
    x[rng.random((300, 7)) < 0.1] = np.nan
    x[5, 3], x[:, 6] = np.inf, 4.0
    pdf = pd.DataFrame(x, columns=list("abcdefy")).assign(g=[None if i % 3 == 0 else f"g{i % 3}" for i in range(300)])
    df = spark.createDataFrame(pdf).repartition(3)
    forms = [dict(columns=list("abcdef")), dict(columns=list("abcdef"), target="y"),
             dict(columns=list("abcde"), target="f", only_target=True), dict(columns=list("abce"), listwise=True, target="y")]
    wanted = [correlations(df, **form) for form in forms]
    monkeypatch.setattr(profile, "PAIRS_PER_PASS", 0)
    monkeypatch.setattr(profile, "GRAM_BYTES", 3000)  # sums are sent on between batches
    monkeypatch.setattr(profile, "ROWS_PER_PRODUCT", 16)
    for form, want in zip(forms, wanted):
        got = correlations(df, **form)
        assert got.keys() == want.keys()
        for key, (n, r) in want.items():
            assert got[key][0] == n and (got[key][1] == pytest.approx(r, abs=1e-9) if r is not None else got[key][1] is None)


def test_a_thousand_columns_in_two_scans(spark, tmp_path):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(60, 1000))
    pd.DataFrame(x, columns=[f"c{i}" for i in range(1000)]).to_parquet(tmp_path / "wide.parquet")
    df = spark.read.parquet(str(tmp_path / "wide.parquet"))
    scans = []
    original = profile.column_centres
    profile_centres = lambda *a: scans.append("centres") or original(*a)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(profile, "column_centres", profile_centres)
        found = profile.pair_correlations(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and scans == ["centres"]
    rows = found.filter("feat_a in ('c0', 'c998') or feat_b = 'c500'").collect()
    want = np.corrcoef(x.T)
    assert len(rows) == 999 + 1 + 500 - 1
    assert all(r["r"] == pytest.approx(want[int(r["feat_a"][1:]), int(r["feat_b"][1:])], abs=1e-9) for r in rows)


def test_distinct_counts_copy_no_rows(spark):
    df = spark.createDataFrame([("a", 1, 2.0, "x"), ("a", 1, float("nan"), None), ("b", None, 3.0, "x"), (None, 4, 3.0, "y")],
                               "g string, i int, f double, t string")
    for by in ([], ["g"]):
        found = columns.distinct_counts(df, ["i", "f", "t"], by)
        assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
        got = {r["g"] if by else "all": (r["distinct_i"], r["distinct_f"], r["distinct_t"]) for r in found.collect()}
        assert got == ({"a": (1, 1, 1), "b": (0, 1, 1), None: (1, 1, 1)} if by else {"all": (2, 2, 2)})


@pytest.mark.parametrize("exact", [True, False])
def test_duplicate_rows_keep_null_positions_apart(spark, exact):
    rows = [(None, 1), (1, None), (1, None), (None, None), (2, 2), (2, 2), (2, 2)]
    df = spark.createDataFrame(rows, "a int, b int")
    assert duplicate_rows(df, exact=exact).first()["duplicate_rows"] == 3


def test_nan_counts_as_missing(spark):
    df = normalize_missing(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double"))
    row = column_profile(df).first()
    assert row["missing_count"] == 2 and row["unique_count"] == 1


def test_segments_get_the_same_answer_as_separate_tables(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"i": range(200), "g": ["a", "b"] * 100, "x": rng.normal(size=200),
                        "y": rng.lognormal(size=200), "z": rng.normal(size=200)})
    df = spark.createDataFrame(pdf)
    grouped = {r["g"]: r for r in evaluate(df, REGRESSION, "y", row_order="i", by=["g"], without=["i"]).rows.collect()}
    alone = evaluate(df.filter("g = 'a'").drop("g"), REGRESSION, "y", row_order="i", without=["i"]).rows.first()
    for c in ("raw_fitness", "cmp", "cns", "tim", "out", "bal", "cov"):
        assert grouped["a"][c] == pytest.approx(alone[c])


def test_small_tables_meet_their_guards(spark):
    df = spark.createDataFrame([(i, float(i), 1.0) for i in range(8)], "i long, x double, k double")
    row = one(evaluate(df, REGRESSION, "x", row_order="i", without=["i"]).rows)
    assert row["out"] == 95 and row["cns"] == 95 and row["margin"] == 3.5
