"""Order statistics and ordered windows against plain pandas, on both size paths."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablefit.functions.frames import materialize
from tablefit.operators import order, select
from tablefit.operators.order import with_average_rank, with_chunk, with_previous, with_range
from tablefit.operators.select import quantiles, with_tile


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 600
    return pd.DataFrame({
        # One segment holds most rows, and one value a third of them.
        "g": np.where(rng.random(n) < 0.7, "hot", "cold"),
        "i": rng.permutation(n),
        "t": np.where(rng.random(n) < 0.35, 50, rng.integers(0, 90, n)),
        "x": np.where(rng.random(n) < 0.1, np.nan, rng.lognormal(0, 3, n)),
    })


@pytest.mark.parametrize("limit", [5, 10_000])
def test_quantiles(spark, frame, limit):
    df = spark.createDataFrame(frame)
    got = quantiles(df, ["x", "t"], [0.0, 0.01, 0.5, 0.99, 1.0], ["g"], rows_per_task=limit).collect()
    for row in got:
        part = frame[frame.g == row["g"]]
        for c in ("x", "t"):
            want = np.quantile(part[c].dropna(), [0.0, 0.01, 0.5, 0.99, 1.0])
            np.testing.assert_allclose(row[c], want, rtol=1e-12)


def test_quantiles_with_infinities_and_empty_columns(spark):
    rows = [(float(v), None) for v in range(20)] + [(float("inf"), None), (float("-inf"), None)]
    df = spark.createDataFrame(rows, "x double, y double")
    got = quantiles(df, ["x", "y"], [0.0, 0.5, 1.0], rows_per_task=3).first()
    assert got["x"] == [float("-inf"), 9.5, float("inf")]
    assert got["y"] is None


def scans_of(spark, monkeypatch, cells):
    """(values at all ranks, scans of the cells)."""
    written = []
    monkeypatch.setattr(select, "materialize", lambda df, name="part": written.append(name) or materialize(df, name))
    n = cells.count()
    targets = spark.range(1, n + 1).select(F.col("id").alias("rank"), F.col("id").alias("rank_id"))
    found = select.values_at_ranks(cells, targets, [])
    assert written[0] == "cells" and written.count("cells") == 1
    rows = sorted((r["rank"], r["v"], r["less"]) for r in found.collect())
    assert [r[0] for r in rows] == list(range(1, n + 1))
    return rows, written.count("ranks") - 1  # the first writes the ranks that are asked for


def test_few_scans_whatever_the_spread(spark, monkeypatch):
    rng = np.random.default_rng(6)
    wide = np.exp(rng.uniform(-200, 200, 400)) * rng.choice([-1, 1], 400)
    close = np.nextafter(1.0, 2.0, dtype=float) ** np.arange(40)  # neighbours that differ in the last bits
    odd = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, math.inf, -math.inf, 3.0, 3.0, 3.0]
    values = [*wide.tolist(), *close.tolist(), *odd]
    rows, scans = scans_of(spark, monkeypatch, spark.createDataFrame([(v,) for v in values], "v double"))
    assert [r[1] for r in rows] == sorted(values) and scans <= 6
    assert all(less == sum(v < value for v in values) for _, value, less in rows[::40])


def test_few_scans_of_whole_numbers(spark, monkeypatch):
    rng = np.random.default_rng(7)
    values = [*rng.integers(-(1 << 63), (1 << 63) - 1, 300).tolist(), -(1 << 63), (1 << 63) - 1, 0, 1, 2, 2, 2, *range(90, 130)]
    rows, scans = scans_of(spark, monkeypatch, spark.createDataFrame([(int(v),) for v in values], "v long"))
    assert [r[1] for r in rows] == sorted(values) and scans <= 6


@pytest.mark.parametrize("limit", [5, 10_000])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_tiles_split_ties_by_the_second_key(spark, frame, limit, by):
    df = spark.createDataFrame(frame[["g", "i", "t"]])
    cuts = [lambda n: F.floor(n * F.lit(0.5)), lambda n: F.floor(n * F.lit(0.8))]
    got = with_tile(df, ["t", "i"], cuts, by, rows_per_task=limit).toPandas().sort_values("i")
    ordered = frame.sort_values(["t", "i"])
    groups = ordered.groupby(by) if by else [("all", ordered)]
    want = {}
    for _, part in groups:
        for k, i in enumerate(part["i"], 1):
            want[i] = int(k > int(len(part) * 0.5)) + int(k > int(len(part) * 0.8))
    assert [want[i] for i in got["i"]] == list(got["tile"])


def test_a_cut_before_the_first_row_leaves_all_rows_after_it(spark):
    df = spark.range(10).toDF("i")
    for limit in (1, 100):
        got = with_tile(df, ["i"], [lambda n: F.lit(0)], rows_per_task=limit)
        assert got.filter("tile = 1").count() == 10


def test_chunks_are_larger_first(spark):
    got = with_chunk(spark.range(11).toDF("i"), 3, ["i"]).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in got] == [4, 4, 3]


@pytest.mark.parametrize("per_range", [40, 10_000])
def test_previous_value_crosses_ranges_and_skips_gaps(spark, frame, per_range):
    df = spark.createDataFrame(frame)
    got = with_previous(df, ["x"], ["t", "i"], ["g"], rows_per_range=per_range).toPandas()
    merged = frame.sort_values(["t", "i"]).copy()
    merged["want"] = merged.groupby("g")["x"].transform(lambda s: s.ffill().shift(1).ffill())
    both = got.merge(merged[["i", "want"]], on="i")
    np.testing.assert_allclose(both["prev_x"].astype(float), both["want"], rtol=0)


def test_a_frequent_key_value_is_split_into_several_ranges(spark, frame):
    sizes = with_range(spark.createDataFrame(frame), ["t", "i"], 40).groupBy("__range").count()
    assert sizes.agg(F.max("count")).first()[0] < 120


@pytest.mark.parametrize("keys", [["i"], ["t", "i"]])
def test_nested_ranges_stay_small(spark, frame, monkeypatch, keys):
    monkeypatch.setattr(order, "FANOUT", 4)
    df = spark.createDataFrame(frame)
    sizes = with_range(df, keys, 12).groupBy("__range").count()
    assert sizes.count() > 4 * 4 and sizes.agg(F.max("count")).first()[0] < 40
    got = with_previous(df, ["x"], keys, ["g"], rows_per_range=12)
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    merged = frame.sort_values(keys).copy()
    merged["want"] = merged.groupby("g")["x"].transform(lambda s: s.ffill().shift(1).ffill())
    both = got.toPandas().merge(merged[["i", "want"]], on="i")
    np.testing.assert_allclose(both["prev_x"].astype(float), both["want"], rtol=0)


@pytest.mark.parametrize("limit", [10, 10_000])
def test_average_rank(spark, frame, limit, monkeypatch):
    monkeypatch.setattr("tablefit.operators.order.ROWS_PER_RANGE", 30)
    df = spark.createDataFrame(frame[["g", "i", "t"]])
    got = with_average_rank(df, "t", ["g"], rows_per_task=limit).toPandas().sort_values("i")
    want = frame.assign(r=frame.groupby("g")["t"].rank()).sort_values("i")["r"]
    np.testing.assert_allclose(got["rank"], want)
