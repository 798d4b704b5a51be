"""Target, time axis and task found on small tables with known answers."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablefit.functions.lookups import CLASSIFICATION, CLUSTERING, REGRESSION, TIME_SERIES
from tablefit.operators import columns
from tablefit.operators.discover import column_evidence, infer_task, infer_tasks, near_a_limit, timestamp_candidates

RNG = np.random.default_rng(42)


def numbered(spark, pdf):
    return spark.createDataFrame(pdf.assign(ro=range(len(pdf))))


def noise(n, *names):
    return {c: RNG.normal(50, 9, n) for c in names}


def house(outcome):
    return pd.DataFrame({**noise(100, "SquareFeet"), "Bedrooms": RNG.integers(1, 6, 100),
                         "Age": RNG.integers(0, 50, 100), **noise(100, outcome)})


FLOWERS = pd.DataFrame({"Id": range(1, 151), **noise(150, "SepalLength", "SepalWidth", "PetalLength", "PetalWidth"),
                        "Species": ["a", "b", "c"] * 50})
POINTS = pd.DataFrame(noise(100, "coord_x", "coord_y", "coord_z", "feature_1", "feature_2"))
SALES = pd.DataFrame({"transaction_date": pd.to_datetime("2024-01-01") + pd.to_timedelta(RNG.integers(0, 15, 200), "D"),
                      "store_id": ["s1", "s2", "s3", "s4"] * 50, "item_quantity": RNG.integers(1, 20, 200),
                      **noise(200, "revenue")})
DAILY = pd.DataFrame({"timestamp": pd.date_range("2024-01-01", periods=120), **noise(120, "energy_demand")})
EVENTS = pd.DataFrame({"event_time": pd.to_datetime("2024-01-01") + pd.to_timedelta(RNG.integers(0, 20, 200), "D"),
                       "user_id": [f"u{i % 17}" for i in range(200)], **noise(200, "amount"),
                       "is_fraud": RNG.integers(0, 2, 200)})

CASES = {
    "keyword outcome": (house("Price"), REGRESSION, "Price", 0.94),
    "unfamiliar outcome": (house("structural_numeric_outcome"), REGRESSION, "structural_numeric_outcome", 0.94),
    "flowers": (FLOWERS, CLASSIFICATION, "Species", 0.94),
    "coordinates": (POINTS, CLUSTERING, None, 0.55),
    "transactions": (SALES, REGRESSION, "revenue", 0.864),
    "daily series": (DAILY, TIME_SERIES, "energy_demand", 0.887),
}


def test_known_tables_in_one_run(spark):
    tables = {name: numbered(spark, pdf) for name, (pdf, *_) in CASES.items()}
    got = {r["dataset"]: r for r in infer_tasks(tables, dict.fromkeys(tables, "ro"), without=["ro"]).collect()}
    for name, (_, task, target, confidence) in CASES.items():
        row = got[name]
        assert (row["task"], row["target"]) == (task, target), name
        assert row["confidence"] == pytest.approx(confidence, abs=0.002), name
        assert sum(row[f"p_{t}"] for t in (REGRESSION, CLASSIFICATION, TIME_SERIES, CLUSTERING)) == pytest.approx(1.0)


def test_events_with_a_label(spark):
    row = infer_task(numbered(spark, EVENTS), "events", "ro", without=["ro"], override="time_series").first()
    assert row["inferred_task"] == CLASSIFICATION or row["target"] == "amount"
    assert row["task"] == TIME_SERIES and row["overridden"]


def test_only_real_dates_are_times(spark):
    pdf = pd.DataFrame({"reading": [1.5, 2.5, 3.5], "small": [1, 2, 3], "numbers": ["1.5", "3.2", "4"],
                        "when": ["2024-01-01", "2024-01-02", "2024-02-01"], "year": [1999, 2004, 2020]})
    evidence = column_evidence(spark.createDataFrame(pdf), "d")
    assert {r["column"] for r in timestamp_candidates(evidence).collect()} == {"when", "year"}


def test_running_numbers_are_no_targets(spark):
    pdf = pd.DataFrame({"step": range(0, 300, 3), **noise(100, "a", "b")})
    row = infer_task(numbered(spark, pdf), "t", "ro", without=["ro"]).first()
    assert row["target"] == "b"


def test_empty_tables_are_refused(spark):
    with pytest.raises(ValueError, match="empty"):
        infer_task(spark.createDataFrame([], "a int"), "none")


CELLS = ["2024-01-05", " 2024-1-5 ", "2024-01-05T10:11:12", "2024-01-05 10:11:12.5", "2024/01/05", "2024/01/05 10:11:12",
         "5 Jan 2024", "05 Jan 2024", "Jan 5, 2024", "Jan 05, 2024", "20240105", "01/31/2024", "31/01/2024", "01/31/2024 10:11:12",
         "31-01-2024", "01-31-2024", "2024", "2024-01", "+12024-01-05T10:11:12", "-0044-03-15T10:11:12", "12:30", "10:11:12",
         "2024-01-05T10:11:12Z", "2024-01-05 10:11:12+02:00", "2024-01-05 10:11:12 Europe/Berlin", "", " ", "text", "5", "5.5",
         "the 5 of May", "20241305", "99/99/9999", "2024-02-30", "5 January 2024", "31/12/2024 x", "x" * 200 + "5", "٢٠٢٤-٠١-٠٥",
         "Mai 5, 2024", "5 jan 2024", "JAN 5, 2024", "12345678901", "12024/01/05", "0/0/0"]


@pytest.mark.parametrize("days_first", [False, True])
def test_layouts_by_shape_read_what_all_layouts_read(spark, days_first):
    """Guarding each layout by its shape changes no answer."""
    df = spark.createDataFrame([(c,) for c in CELLS], "t string")
    cell = F.col("t")
    names = [*columns.TIME_LAYOUTS, *(columns.DAY_FIRST if days_first else columns.MONTH_FIRST)]
    plain = F.when(cell.rlike(r"\d"), F.coalesce(cell.try_cast("timestamp"), *[
        F.try_to_timestamp(cell, F.lit(name)) for name in names]))
    layouts = columns.fitting_layouts(df, ["t"])["t"]
    got = df.select("t", plain.cast("string").alias("want"), columns.read_time(cell, days_first).cast("string").alias("guarded"),
                    columns.read_time(cell, days_first, layouts).cast("string").alias("chosen")).collect()
    clock = re.compile(r"^\d+:\d+")  # a clock time alone is read on the day of the query
    for r in got:
        if r["t"].startswith("x"):
            assert r["chosen"] is None
        elif not clock.match(r["t"]):
            assert r["want"] == r["guarded"] == r["chosen"], r
    for text in CELLS:  # alone in a column, a text has no other layouts to lean on
        one = df.filter(cell == text)
        fits = columns.fitting_layouts(one, ["t"])["t"]
        want = next(r["guarded"] for r in got if r["t"] == text)
        found = one.select(columns.read_time(cell, days_first, fits).cast("string")).first()[0]
        assert found == want or clock.match(text) or len(text) > 100, text


def test_text_dates_are_datetimes(spark):
    rows = [(f"2024-{i % 12 + 1:02d}-03", f"{i % 28 + 1:02d}/{i % 12 + 1:02d}/2024", f"{i}.5", f"note {i} of 2024", i % 5,
             "x" if i % 4 else "2024-01-01") for i in range(60)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e int, f string")
    roles = columns.column_roles(df, identifiers=[])
    assert roles.datetime == ("a", "b") and roles.categorical == ("c", "d", "f") and roles.numeric == ("e",)
    assert columns.fitting_layouts(df, ["c", "d"]) == {"c": frozenset(), "d": frozenset()}
    assert columns.column_roles(df.filter("false"), identifiers=[]).datetime == ()


def test_sketches_decide_like_exact_counts(spark):
    rng = np.random.default_rng(5)
    n = 4000
    pdf = pd.DataFrame({"half": rng.permutation(n) % 2000, "nearly": np.where(rng.random(n) < 0.1, 0, np.arange(n)),
                        "few": np.arange(n) % 12, "all": rng.permutation(n), "x": rng.normal(size=n), "t": [f"v{i % 31}" for i in range(n)]})
    for got, want in zip(*(sorted(map(tuple, column_evidence(numbered(spark, pdf), "d", "ro", exact=e).drop("n_unique").collect()), key=str)
                           for e in (False, True))):
        assert got == want
    loose, exact = ({r["column"]: r["n_unique"] for r in column_evidence(numbered(spark, pdf), "d", "ro", exact=e).collect()}
                    for e in (False, True))
    for c in ("few", "all", "half", "nearly", "t"):
        share = abs(loose[c] - exact[c]) / exact[c]
        assert share < 0.1 and (share == 0 or not near_a_limit(exact[c], n, 0))
