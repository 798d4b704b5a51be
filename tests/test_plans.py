"""Physical plans keep the properties that large tables need."""

import re

import pytest

from tablefit.operators import audit, defects, dimensions, profile, remediate
from tablefit.operators.columns import column_roles
from tablefit.operators.models import f1_scores


def plan_of(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def lines(spark, folder):
    return spark.read.parquet(f"{folder}/lineitem.parquet")


def test_scans_read_only_what_they_need(lines):
    plan = plan_of(profile.shape_stats(lines, ["l_quantity"], ["l_returnflag"]))
    assert set(re.findall(r"ReadSchema: (\S+)", plan)) == {"struct<l_quantity:double,l_returnflag:string>"}


def test_filters_reach_the_scan(lines):
    plan = plan_of(profile.pair_correlations(lines.filter("l_quantity > 10"), ["l_quantity", "l_tax"], listwise=True))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "GreaterThan(l_quantity,10.0)" in pushed and "IsNotNull(l_tax)" in pushed


def test_cells_of_all_columns_take_one_scan_and_one_shuffle(lines):
    plan = plan_of(dimensions.cell_table(lines, column_roles(lines, "l_extendedprice", by=["l_returnflag"]),
                                         ["l_returnflag"]))
    tree = plan.split("\n\n")[0]
    assert tree.count("Scan parquet") == 1 and tree.count("Exchange") == 1
    assert "SortAggregate" not in tree


def test_duplicates_shuffle_fingerprints_not_rows(lines):
    plan = plan_of(profile.duplicate_rows(lines, ["l_returnflag"]))
    first = re.search(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]", plan).group(1)
    assert "__h0" in first and "l_quantity" not in first


@pytest.mark.parametrize("build", [
    lambda df: remediate.sort_timestamps(df, "l_shipdate", "l_orderkey"),
    lambda df: dimensions.duplicate_timestamps(df, "l_shipdate", ["l_returnflag"]),
    lambda df: f1_scores(df, "l_linestatus", "l_returnflag"),
    lambda df: audit.content_hash(df, ["l_orderkey", "l_linenumber"]),
    lambda df: dimensions.balance_metrics(df, column_roles(df, "l_linestatus"), ["l_returnflag"]),
    lambda df: defects.dirty_lineitem(df),
])
def test_no_python_no_pair_joins_and_partial_aggregates(lines, build):
    plan = plan_of(build(lines))
    tree = plan.split("\n\n")[0]
    assert "Python" not in tree and "CartesianProduct" not in tree
    # Every grouping merges rows before it shuffles them.
    assert tree.count("Aggregate") == 0 or "partial_" in plan
