"""Repairs, splits, models, hashes, sources and the closed loop."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablefit.functions.lookups import CLASSIFICATION, REGRESSION, TIME_SERIES
from tablefit.functions.stats import scatter
from tablefit.operators import anomaly, audit, models, remediate, splits
from tablefit.operators.anomaly import forest_anomaly
from tablefit.operators.columns import lenient_timestamp
from tablefit.operators.portfolio import signed_rank_exact
from tablefit.plans.closed_loop import fraction_sweep, remediate_and_validate
from tablefit.plans.evaluate import evaluate
from tablefit.sources.readers import TableError, format_of, read_table, require_rows
from tablefit.sources.writers import write_csv, write_report


def test_only_requested_repairs_run(spark):
    pdf = pd.DataFrame({"i": range(25), "f1": [10.0] * 24 + [9999.0], "f2": np.arange(25.0), "y": np.arange(25.0)})
    pdf.loc[3, "f1"] = np.nan
    pdf.loc[4, "f2"] = np.nan
    done, log = remediate.repair(spark.createDataFrame(pdf), ["winsorize_outliers"], REGRESSION, "y", row_order="i")
    row = done.agg(F.max("f1"), F.count_if(F.isnan("f2") | F.col("f2").isNull())).first()
    assert row[0] < 9999 and row[1] == 1
    assert [f.action for f in log if f.executed] == ["winsorize_outliers"]
    assert {r["reason"] for r in remediate.action_log(spark, log).filter("not executed").collect()} == {"not requested"}


def test_sort_touches_train_only(spark):
    train = spark.createDataFrame(
        [(0, "2024-01-03", 3.0), (1, "2024-01-01", 1.0), (2, "2024-01-01", 9.0), (3, "2024-01-02", 2.0)],
        "i long, t string, y double")
    test = spark.createDataFrame([(100, "2024-01-05", 5.0), (101, "2024-01-05", 6.0), (102, "bad", 7.0)],
                                 "i long, t string, y double")
    a, b, _ = remediate.repair_split(train, test, ["sort_timestamps"], TIME_SERIES, "y", "t", "i")
    assert sorted(r["i"] for r in a.collect()) == [0, 1, 3]
    assert sorted(r["i"] for r in b.collect()) == [100, 101, 102]


@pytest.mark.parametrize("limit", [1, 10_000])
def test_resampling_is_exact_and_leaves_the_test_alone(spark, limit):
    pdf = pd.DataFrame({"i": range(100), "y": [1] * 5 + [0] * 95})
    df = spark.createDataFrame(pdf)
    counts = {r["y"]: r["count"] for r in remediate.resample_minority(
        df, "y", "i", rows_per_task=limit).groupBy("y").count().collect()}
    assert counts == {0: 95, 1: 38}
    test = spark.createDataFrame(pd.DataFrame({"i": range(100, 140), "y": [1] * 2 + [0] * 38}))
    _, kept, _ = remediate.repair_split(df, test, ["resample_imbalance"], CLASSIFICATION, "y", row_order="i")
    assert audit.immutability(test, kept, "i").first()["immutable"]


def test_sparse_and_unlabelled(spark):
    df = spark.createDataFrame([(1.0, None, 1.0), (2.0, 1.0, None), (3.0, None, 3.0), (4.0, None, None),
                                (5.0, 2.0, 5.0)], "dense double, sparse double, y double")
    done, _ = remediate.repair(df, ["drop_high_null_columns", "drop_unlabelled_target"], REGRESSION, "y")
    assert done.columns == ["dense", "y"] and done.count() == 3


def test_imputation_takes_the_smallest_mode(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", None), ("b", 3.0), ("a", 5.0), (None, 9.0)], "k string, x double")
    done, _ = remediate.repair(df, ["impute_median"], REGRESSION, "x")
    rows = {(r["k"], r["x"]) for r in done.collect()}
    assert ("a", 4.0) in rows and ("a", 9.0) in rows


def test_splits_are_exact_disjoint_and_repeatable(spark):
    df = spark.range(101).toDF("i").withColumn("c", F.col("i") % 3)
    first, second = splits.random_split(df, "i"), splits.random_split(df, "i", rows_per_task=3)
    assert first.filter("part = 'test'").count() == 31
    assert audit.compare_runs(first, second, ["i"], ["part"]).first()["mismatches"] == 0
    strat = splits.stratified_split(df, "i", "c").groupBy("c", "part").count().collect()
    assert {(r["c"], r["part"]): r["count"] for r in strat}[(0, "test")] == 11
    checks = splits.split_checks(first, "i").first()
    assert checks["shared_keys"] == 0 and checks["train_rows"] == 70


def test_lag_of_test_follows_time_and_starts_at_the_last_training_value(spark):
    rows = [(0, 0, 10.0, "train"), (1, 1, 20.0, "train"), (2, 5, 50.0, "test"), (3, 4, 40.0, "test")]
    df = spark.createDataFrame(rows, "i long, d int, y double, part string").withColumn(
        "t", F.timestamp_seconds(F.col("d") * 86400))
    got = {r["i"]: r["lag1"] for r in models.lag_features(df, "y", "i", "t").collect()}
    assert got == {0: 10.0, 1: 10.0, 3: 20.0, 2: 40.0}
    assert models.lag_features(df, "y", "i", "t", compat=False).filter("part = 'train'").count() == 1


def test_constant_series_is_forecast_without_error(spark):
    df = spark.createDataFrame(pd.DataFrame({
        "i": range(50), "t": pd.date_range("2024-01-01", periods=50), "temp": 25.0}))
    parts = splits.chronological_split(df, "t", "i")
    assert models.observed_metric(parts, TIME_SERIES, "temp", "t", "i", ["i"]) == pytest.approx(0.0, abs=1e-9)
    assert models.observed_metric(parts.limit(8), TIME_SERIES, "temp", "t", "i", ["i"]) is None


def test_ridge_penalty_does_not_depend_on_the_spread_of_the_label(spark):
    y = [0.3, -0.2, 0.5, 0.1, -0.4, 0.6, 0.2, -0.1, 0.4, 0.0]
    df = spark.createDataFrame(pd.DataFrame({"i": range(10), "y": y, "part": ["train"] * 7 + ["test"] * 3}))
    lag, label = np.array(y[:6]), np.array(y[1:7])
    x, z = lag - lag.mean(), label - label.mean()
    slope = (x @ z) / (x @ x + 1)
    got = {r["i"]: r["prediction"] for r in models.ridge_forecast(df, "y", "i").collect()}
    assert got == pytest.approx({i: label.mean() + slope * (y[i - 1] - lag.mean()) for i in (7, 8, 9)})
    none = models.ridge_forecast(df.filter("part = 'test'"), "y", "i").collect()
    assert {r["prediction"] for r in none} == {None}


def test_macro_and_weighted_f1(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "label string, prediction string")
    row = models.f1_scores(df).first()
    assert row["macro_f1"] == pytest.approx((2 / 3 + 4 / 5) / 2)


def test_forest_finds_the_odd_rows(spark):
    x = np.random.default_rng(0).normal(size=(500, 2))
    x[:5] = 30
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    pinned = forest_anomaly(df, ["a", "b"], mode="contamination").first()
    assert pinned["anomalies"] <= 25
    assert 5 <= forest_anomaly(df, ["a", "b"], mode="threshold", cutoff=0.65).first()["anomalies"] <= 15


def test_id_hash_ignores_order_and_width_but_not_values(spark):
    ids = [5, 900, 17, 3, 12345]
    a = spark.createDataFrame([(i,) for i in ids], "i long")
    b = spark.createDataFrame([(i,) for i in reversed(ids)], "i int")
    c = spark.createDataFrame([(i,) for i in [*ids[:-1], 12346]], "i long")
    digest = [audit.id_set_hash(d, "i", fan_in=2).first()["digest"] for d in (a, b, c)]
    assert digest[0] == digest[1] != digest[2]


def test_content_hash_counts_copies(spark):
    once = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    twice = once.unionByName(once.limit(1))
    assert audit.content_hash(once).first()["digest"] != audit.content_hash(twice).first()["digest"]
    assert audit.content_hash(once.orderBy(F.desc("a"))).first() == audit.content_hash(once).first()


def test_sources(spark, tmp_path):
    assert [format_of(p) for p in ("a.PARQUET", "b.csv", "c.dat")] == ["parquet", "csv", "csv"]
    df = spark.createDataFrame([(1, [1, 2]), (2, [])], "a int, b array<int>")
    write_csv(df, str(tmp_path / "t.csv"))
    assert read_table(spark, str(tmp_path / "t.csv")).count() == 2
    with pytest.raises(TableError):
        read_table(spark, str(tmp_path / "missing.parquet"))
    with pytest.raises(TableError):
        require_rows(df.limit(0))


def test_a_report_replaces_its_own_run(spark, tmp_path):
    place, df = str(tmp_path / "report"), spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")

    def rows():
        return sorted((r["dataset"], r["run_id"], r["a"]) for r in spark.read.parquet(place + "/scores").collect())

    for dataset, run in (("d", "r 1"), ("d", "r2"), ("é/1", "r 1"), ("d", "r 1")):
        write_report({"scores": df}, place, dataset, run)
    others = [("d", "r2", 1), ("d", "r2", 2), ("é/1", "r 1", 1), ("é/1", "r 1", 2)]
    assert rows() == sorted([("d", "r 1", 1), ("d", "r 1", 2), *others])
    write_report({"scores": df.filter("a = 2")}, place, "d", "r 1")
    assert rows() == sorted([("d", "r 1", 2), *others])
    write_report({"scores": df.filter("false")}, place, "d", "r 1")
    assert rows() == sorted(others)


def test_closed_loop_repairs_a_disordered_series(spark):
    rng = np.random.default_rng(7)
    n = 120
    pdf = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=n, freq="h"), "x": rng.normal(size=n)})
    pdf["y"] = pdf["x"] * 3 + 10 + rng.normal(0, 0.2, n)
    train = pdf.iloc[:84].sample(frac=1.0, random_state=1)
    pdf = pd.concat([train, pdf.iloc[84:]], ignore_index=True).assign(i=range(n))
    loop = remediate_and_validate(spark.createDataFrame(pdf), "time_series", "y", "i", "ts", ["sort_timestamps"])
    row = loop.result.first()
    assert row["train_tier"] == "GREEN" and row["fitness_before"] == 0.0
    assert row["fitness_after"] > 50 and row["decision"] in ("ACCEPTED", "REGRESSED", "NO_IMPROVEMENT")
    assert loop.unchanged_test.first()["immutable"]
    assert loop.cleansed().count() == n


def test_test_gaps_take_training_medians(spark):
    train = spark.createDataFrame([(float(x),) for x in range(100, 110)], "x double")
    test = spark.createDataFrame([(None,), (1.0,)], "x double")
    _, filled = models.train_filled(train, test, ["x"])
    assert sorted(r.x for r in filled.collect()) == [1.0, 104.5]


def test_equal_times_across_the_cut_are_not_in_order(spark):
    rows = [(1, "train", "2024-01-01"), (2, "train", "2024-01-02"), (3, "test", "2024-01-02")]
    parts = spark.createDataFrame(rows, "k int, part string, t string").withColumn("t", F.to_timestamp("t"))
    assert splits.split_checks(parts, "k", "t").first()["in_time_order"] is False


def test_forest_on_few_rows_and_any_partitioning(spark):
    rows = [(i, float((i * 7919) % 1009), float((i * 104729) % 997)) for i in range(30_000)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    few = forest_anomaly(df.filter("k < 20"), ["a", "b"], mode="threshold").first()
    assert few["n"] == 20 and few["anomalies"] <= 4
    assert forest_anomaly(df.filter("k < 1"), ["a", "b"], mode="threshold").first()["anomalies"] == 0
    one, three = (forest_anomaly(df.repartition(p), ["a", "b"], mode="threshold", cutoff=0.5, keys=["k"]).first()
                  for p in (1, 3))
    assert one == three and one["anomalies"] > 0


def spiked(spark):
    """A clean segment and one with two far rows in a hundred, as well as a segment of equal rows."""
    x = np.random.default_rng(3).normal([10, 5], [2, 1], (200, 2)).tolist()
    x[0], x[1] = [99999.0, 5.0], [-88888.0, 5.0]
    rows = [(i, "spiked" if i < 100 else "clean", a, b) for i, (a, b) in enumerate(x)]
    rows += [(200 + i, None, 1.0, 2.0) for i in range(40)]
    return spark.createDataFrame(rows, "k long, g string, a double, b double")


def test_a_forecast_reads_its_rows_a_few_times(spark):
    rows = [(i, float(i % 7), "train" if i < 240 else "test", i % 5) for i in range(300)]
    source = spark.createDataFrame(rows, "i long, y double, part string, x int").coalesce(1)
    scans = spark.sparkContext.accumulator(0)

    def counted(batches):
        for n, batch in enumerate(batches):
            scans.add(n == 0)
            yield batch

    tracked = source.mapInPandas(counted, source.schema)
    assert models.observed_metric(tracked, TIME_SERIES, "y", None, "i", ["i"]) > 0
    assert scans.value <= 12


def test_a_forest_trains_in_tasks_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "ROWS_PER_FIT", 40)
    df = spark.range(300).selectExpr("id AS i", "id % 7 AS x", "double(id % 7) AS y").coalesce(1)
    assert models.spread(df).rdd.getNumPartitions() == 8
    assert models.spread(df.limit(40)).rdd.getNumPartitions() == 1
    inputs = []
    fit = models.RandomForestRegressor.fit
    monkeypatch.setattr(models.RandomForestRegressor, "fit",
                        lambda self, data: (inputs.append(data.rdd.getNumPartitions()), fit(self, data))[1])
    done = models.fit_predict(df.filter("i < 200"), df.filter("i >= 200"), REGRESSION, "y", ["x"])
    assert done.count() == 100 and inputs == [5]


def test_the_share_sweep_equals_single_loops(spark):
    rng = np.random.default_rng(17)
    n = 160
    pdf = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=n, freq="h"), "x": rng.normal(size=n)})
    pdf["y"] = pdf["x"] * 3 + 10 + rng.normal(0, 0.2, n)
    pdf = pd.concat([pdf.iloc[:110].sample(frac=1.0, random_state=1), pdf.iloc[5:9], pdf.iloc[110:]]).reset_index(drop=True)
    df = spark.createDataFrame(pdf.assign(i=np.arange(len(pdf))))
    sweep = {r["train_share"]: r for r in fraction_sweep(df, "y", "ts", "i", (0.5, 0.8), anomaly="pinned").collect()}
    for share in (0.5, 0.8):
        loop = remediate_and_validate(df, "time_series", "y", "i", "ts", ["sort_timestamps"], share, anomaly="pinned")
        want, got = loop.result.first(), sweep[share]
        for name in ("train_fitness", "test_fitness", "metric_before", "metric_after"):
            assert got[name] == pytest.approx(want[name]), name
        assert got["fitness_after"] == pytest.approx(want["partition_fitness"])
        assert (got["train_rows"], got["test_rows"]) == (want["train_rows"], want["test_rows"])
        assert (got["train_tier"], got["test_tier"]) == (want["train_tier"], want["test_tier"])


def test_eight_repairs_scan_the_source_a_few_times(spark):
    rng = np.random.default_rng(8)
    n = 300
    pdf = pd.DataFrame({"k": np.arange(n), "t": pd.date_range("2024-01-01", periods=n, freq="h").astype(str), "y": np.arange(n) % 12 == 0,
                        "a": rng.normal(size=n), "b": np.where(rng.random(n) < 0.1, np.nan, rng.standard_cauchy(n)), "c": 1.0,
                        "d": np.where(rng.random(n) < 0.8, np.nan, 1.0), "e": [f"text {i}" for i in range(n)]})
    pdf["y"] = pdf["y"].astype(int)
    pdf["leak"] = pdf["y"] * 2 + 0.001 * pdf["a"]
    source = spark.createDataFrame(pdf).coalesce(1)
    scans = spark.sparkContext.accumulator(0)

    def counted(batches):
        scans.add(1)
        yield from batches

    df = source.mapInArrow(counted, source.schema)
    done, log = remediate.repair(df, None, CLASSIFICATION, "y", "t", "k")
    assert done.count() > 0 and scans.value <= 3
    executed = {f.action for f in log if f.executed}
    assert {"sort_timestamps", "drop_leakage_columns", "winsorize_outliers", "resample_imbalance", "impute_median"} <= executed
    plain, _ = remediate.repair(source, None, CLASSIFICATION, "y", "t", "k", written=True)
    assert sorted(map(str, done.collect())) == sorted(map(str, plain.collect()))


def test_signed_rank_of_two_thousand_pairs(spark):
    diffs = [(i + 1) * (-1 if i % 13 < 6 else 1) / 8 for i in range(2000)]
    began = time.monotonic()
    got = signed_rank_exact(spark.createDataFrame([(d,) for d in diffs], "d double")).first()
    assert time.monotonic() - began < 60
    # No ties: the chance of each rank sum up to the observed one, a rank at a time.
    w = int(got["w"])
    chance = np.zeros(w + 1)
    chance[0] = 1.0
    for rank in range(1, len(diffs) + 1):
        moved = np.concatenate([np.zeros(min(rank, w + 1)), chance[:max(w + 1 - rank, 0)]])
        chance = (chance + moved) / 2
    assert got["p_exact"] == pytest.approx(2 * chance.sum(), rel=1e-9)


def test_silhouette_equals_all_distances(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (40, 3)), rng.normal(6, 1, (30, 3)), [[50, 50, 50]]])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i long, a double, b double, c double")
    done = models.cluster_from(df, ["a", "b", "c"], [x[0], x[50], x[70]]).repartition(3)
    labels = np.array([r["cluster"] for r in done.orderBy("i").collect()])
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    scores = []
    for i, c in enumerate(labels):
        mine = labels == c
        a = far[i][mine].sum() / max(mine.sum() - 1, 1)
        b = min(far[i][labels == o].mean() for o in set(labels) - {c})
        scores.append((b - a) / max(a, b) if mine.sum() > 1 else 0.0)
    assert models.silhouette(done) == pytest.approx(np.mean(scores), rel=1e-12)
    assert models.silhouette(done, "i", rows=25) == pytest.approx(np.mean(scores[:25]), rel=1e-12)
    assert models.silhouette(models.cluster_from(df, ["a", "b", "c"], [x[0]])) is None


def test_forest_per_segment_from_the_data(spark):
    df = spiked(spark)
    one, three = ({r["g"]: r for r in forest_anomaly(df.repartition(p), ["a", "b"], ["g"], keys=["k"]).collect()}
                  for p in (1, 3))
    assert one == three
    assert one["spiked"]["anomalies"] == 5 and one[None]["anomalies"] == 0  # five in a hundred; none among equal rows
    assert one["spiked"]["extreme_ratio"] >= 0.02 and one["spiked"]["extreme_ratio"] != one["clean"]["extreme_ratio"]
    # A segment alone has the same forest as among others.
    alone = forest_anomaly(df.filter("g = 'clean'").drop("g"), ["a", "b"], keys=["k"]).first()
    assert (alone["anomalies"], alone["extreme_ratio"]) == (one["clean"]["anomalies"], one["clean"]["extreme_ratio"])


def test_forests_that_travel_or_are_joined(spark, monkeypatch):
    monkeypatch.setattr(anomaly, "ROWS_PER_CHUNK", 30)
    rows = anomaly.imputed(spiked(spark), ["a", "b"], ["g"], ["g", "k"])
    forests = anomaly.fit_forest(rows, ["a", "b"], ["g"], keys=["k"])
    travel, joined = (sorted((r["k"], r["anomaly_score"]) for r in anomaly.anomaly_scores(
        rows, ["a", "b"], forests, ["g"], ["k"], forest_bytes=size).collect()) for size in (1 << 30, 0))
    assert travel == joined and len(travel) == 240


def test_outlier_dimension_reads_the_cells(spark):
    rows = {r["g"]: r for r in evaluate(spiked(spark).filter("g is not null"), "clustering", row_order="k", by=["g"],
                                        without=["k"]).rows.collect()}
    assert rows["spiked"]["out"] < 95 and rows["spiked"]["heavy_tail_cols"] == ["a"]
    assert rows["spiked"]["extreme_ratio"] != rows["clean"]["extreme_ratio"]
    strict = {r["g"]: r for r in evaluate(spiked(spark).filter("g is not null"), "clustering", row_order="k", by=["g"],
                                          without=["k"], anomaly="threshold").rows.collect()}
    assert strict["spiked"]["anomaly_ratio"] != strict["clean"]["anomaly_ratio"]


def test_high_key_bits_count(spark):
    keys = spark.range(20).crossJoin(spark.range(100).withColumnRenamed("id", "row")).select(
        (F.col("id") * F.lit(1 << 40) + F.col("row")).alias("key"))
    assert keys.select(scatter(F.col("key"))).distinct().count() > 1500


def test_content_hash_keeps_cells_apart(spark):
    one = spark.createDataFrame([("a|=b", "c"), ("a", "1=b|1=c")], "x string, y string")
    two = spark.createDataFrame([("a", "b|=c"), ("a|1=b", "1=c")], "x string, y string")
    assert audit.content_hash(one).first()["digest"] != audit.content_hash(two).first()["digest"]


@pytest.mark.parametrize(("texts", "want"), [
    (["12/31/2020", "01/02/2021", None, "none"], ["2020-12-31", "2021-01-02", None, None]),
    (["31/12/2020", "01/02/2021"], ["2020-12-31", "2021-02-01"]),
    (["01/02/2021", "03-04-2021"], ["2021-01-02", "2021-03-04"]),
])
def test_one_order_of_day_and_month_per_column(spark, texts, want):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", lenient_timestamp(df, "t").cast("date").cast("string").alias("d")).orderBy("i").collect()
    assert [r["d"] for r in got] == want


def test_signed_rank_of_forty_pairs(spark):
    diffs = [(-1) ** (i % 3) * (i // 2 + 1) / 4 for i in range(40)]
    sizes = np.abs(diffs)
    ranks = [float((sizes < s).sum() + ((sizes == s).sum() + 1) / 2) for s in sizes]
    chances = {0.0: 1.0}
    for r in ranks:
        after = {}
        for s, p in chances.items():
            for t in (s, s + r):
                after[t] = after.get(t, 0.0) + p / 2
        chances = after
    w = min(sum(r for r, d in zip(ranks, diffs) if d > 0), sum(r for r, d in zip(ranks, diffs) if d < 0))
    want = sum(p for s, p in chances.items() if min(s, sum(ranks) - s) <= w)
    got = signed_rank_exact(spark.createDataFrame([(d,) for d in diffs], "d double")).first()
    assert got["n"] == 40 and got["w"] == w and got["p_exact"] == pytest.approx(want)
    none = signed_rank_exact(spark.createDataFrame([(0.0,)], "d double")).first()
    assert none["n"] == 0 and none["p_exact"] is None
