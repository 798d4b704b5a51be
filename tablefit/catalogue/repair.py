"""Queries: the eight repairs, whole-table and learned on a training part."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablefit.catalogue.registry import (
    DIRTY_EVENTS,
    DIRTY_LINEITEM,
    PATCHY_ORDERS,
    events,
    lineitem,
    patchy_orders,
    query,
    rounded,
    table,
)
from tablefit.functions.lookups import CLASSIFICATION, REGRESSION, TIME_SERIES
from tablefit.operators import remediate, splits
from tablefit.operators.audit import immutability
from tablefit.operators.dimensions import duplicate_timestamps

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query("fix_sort_dedup", DIRTY_EVENTS, sql="""
SELECT event_id, epoch_us(ts) AS ts_us, event_type, value FROM (
 SELECT *, row_number() OVER (PARTITION BY ts ORDER BY event_id) AS i FROM dirty_events) WHERE i = 1""")
def fix_sort_dedup(spark, folder):
    done, _ = remediate.repair(events(spark, folder), ["sort_timestamps"], TIME_SERIES, "value", "ts", "event_id")
    return done.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_type", "value")


@query("fix_drop_leakage", DIRTY_LINEITEM, sql=f"""
SELECT {", ".join(LINE)}, l_quantity, l_discount FROM dirty_lineitem""")
def fix_drop_leakage(spark, folder):
    df = lineitem(spark, folder).select(*LINE, "l_quantity", "l_discount", "leak_discount")
    return remediate.repair(df, ["drop_leakage_columns"], REGRESSION, "l_discount")[0]


@query("fix_winsorize", DIRTY_LINEITEM, sql=f"""
WITH b AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi
 FROM dirty_lineitem)
SELECT {", ".join(LINE)}, l_quantity, round(least(greatest(l_extendedprice, lo), hi), 4) AS l_extendedprice
FROM dirty_lineitem, b""")
def fix_winsorize(spark, folder):
    df = lineitem(spark, folder).select(*LINE, "l_quantity", "l_extendedprice")
    done, _ = remediate.repair(df, ["winsorize_outliers"], REGRESSION, "l_extendedprice")
    return done.withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@query("fix_resample", PATCHY_ORDERS, sql="""
WITH c AS (SELECT flag, count(*) AS c FROM patchy_orders GROUP BY flag),
w AS (SELECT min(c) AS m, greatest(2 * min(c), floor(max(c) * 0.4)::BIGINT) AS t FROM c),
r AS (SELECT o_orderkey, flag, row_number() OVER (PARTITION BY flag
 ORDER BY ((xor(o_orderkey, o_orderkey >> 31) % 2147483648) * 2654435761 + 42) % 2147483648, o_orderkey) AS i FROM patchy_orders)
SELECT o_orderkey, flag, CASE WHEN flag = 1 THEN t // m + (i <= t % m)::INT ELSE 1 END::BIGINT AS copies FROM r, w""")
def fix_resample(spark, folder):
    df = patchy_orders(spark, folder).select("o_orderkey", "flag")
    done, _ = remediate.repair(df, ["resample_imbalance"], CLASSIFICATION, "flag", row_order="o_orderkey")
    return done.groupBy("o_orderkey", "flag").agg(F.count(F.lit(1)).alias("copies"))


@query("fix_impute", PATCHY_ORDERS, sql="""
WITH m AS (SELECT quantile_cont(o_totalprice, 0.5) AS price FROM patchy_orders),
p AS (SELECT o_orderpriority AS top FROM patchy_orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority
 ORDER BY count(*) DESC, o_orderpriority LIMIT 1)
SELECT o_orderkey, round(coalesce(o_totalprice, price), 4) AS o_totalprice,
 coalesce(o_orderpriority, top) AS o_orderpriority FROM patchy_orders, m, p""")
def fix_impute(spark, folder):
    df = patchy_orders(spark, folder).select("o_orderkey", "o_totalprice", "o_orderpriority")
    done, _ = remediate.repair(df, ["impute_median"], REGRESSION, "o_totalprice", row_order="o_orderkey")
    return done.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("fix_drop_redundant", sql="SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def fix_drop_redundant(spark, folder):
    df = table(spark, folder, "customer").withColumn("const_col", F.lit(1))
    return remediate.repair(df, ["drop_redundant_identifiers"], REGRESSION, "c_acctbal")[0]


@query("fix_drop_unlabelled", PATCHY_ORDERS, sql="""
SELECT o_orderkey, o_orderpriority FROM patchy_orders WHERE o_orderpriority IS NOT NULL""")
def fix_drop_unlabelled(spark, folder):
    df = patchy_orders(spark, folder).select("o_orderkey", "o_orderpriority")
    return remediate.repair(df, ["drop_unlabelled_target"], CLASSIFICATION, "o_orderpriority")[0]


@query("fix_drop_high_null", DIRTY_LINEITEM, sql=f"SELECT {', '.join(LINE)}, l_quantity FROM dirty_lineitem")
def fix_drop_high_null(spark, folder):
    df = lineitem(spark, folder).select(*LINE, "l_quantity", "l_tax", "empty_col")
    return remediate.repair(df, ["drop_high_null_columns"], REGRESSION, "l_quantity")[0]


SPLIT = """split AS (SELECT *, CASE WHEN row_number() OVER (
 ORDER BY ((xor(o_orderkey, o_orderkey >> 31) % 2147483648) * 2654435761 + 42) % 2147483648, o_orderkey)
 <= count(*) OVER () - ceil(round(count(*) OVER () * 0.3::DOUBLE, 9)) THEN 'train' ELSE 'test' END AS part
 FROM patchy_orders)"""


def _split(spark, folder):
    parts = splits.random_split(patchy_orders(spark, folder), "o_orderkey")
    return parts.filter("part = 'train'"), parts.filter("part = 'test'")


@query("train_fitted_impute", PATCHY_ORDERS, SPLIT, sql="""
WITH m AS (SELECT quantile_cont(o_totalprice, 0.5) AS price FROM split WHERE part = 'train')
SELECT o_orderkey, part, round(coalesce(o_totalprice, price), 4) AS o_totalprice FROM split, m""")
def train_fitted_impute(spark, folder):
    train, test = (d.select("o_orderkey", "part", "o_totalprice") for d in _split(spark, folder))
    train, test, _ = remediate.repair_split(train, test, ["impute_median"], REGRESSION, "o_totalprice",
                                            row_order="o_orderkey")
    return train.unionByName(test).withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("train_fitted_winsor", PATCHY_ORDERS, SPLIT, sql="""
WITH b AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM split
 WHERE part = 'train')
SELECT o_orderkey, part, round(CASE WHEN o_totalprice IS NOT NULL THEN least(greatest(o_totalprice, lo), hi) END, 4)
 AS o_totalprice FROM split, b""")
def train_fitted_winsor(spark, folder):
    train, test = (d.select("o_orderkey", "part", "o_totalprice") for d in _split(spark, folder))
    train, test, _ = remediate.repair_split(train, test, ["winsorize_outliers"], REGRESSION, "o_totalprice",
                                            row_order="o_orderkey")
    return train.unionByName(test).withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("test_immutability", PATCHY_ORDERS, SPLIT, sql="""
SELECT count(*) AS ids_before, count(*) AS ids_after, 0::BIGINT AS changed_keys, true AS immutable
FROM split WHERE part = 'test'""")
def test_immutability(spark, folder):
    train, test = _split(spark, folder)
    _, repaired, _ = remediate.repair_split(train, test, None, CLASSIFICATION, "flag", "o_orderdate", "o_orderkey")
    return immutability(test, repaired, "o_orderkey").select("ids_before", "ids_after", "changed_keys", "immutable")


@query("action_log", PATCHY_ORDERS, sql="""
WITH f AS (SELECT concat_ws(',', CASE WHEN count(o_totalprice) > 10 AND abs(kurtosis(o_totalprice)) > 5 THEN 'o_totalprice'
  END, CASE WHEN abs(kurtosis(flag)) > 5 THEN 'flag' END) AS tails,
 concat_ws(',', CASE WHEN count(o_totalprice) < count(*) THEN 'o_totalprice' END,
  CASE WHEN count(o_orderpriority) < count(*) THEN 'o_orderpriority' END) AS gaps,
 CASE WHEN count(o_orderpriority) < 0.6 * count(*) THEN 'o_orderpriority' ELSE '' END AS sparse FROM patchy_orders),
r AS (SELECT 2 AS step, 'winsorize_outliers' AS action, tails AS columns, 'no heavy tail' AS none FROM f
 UNION ALL SELECT 4, 'impute_median', gaps, 'no missing cell' FROM f
 UNION ALL SELECT 7, 'drop_high_null_columns', CASE WHEN gaps = '' THEN sparse ELSE '' END, 'no sparse column' FROM f)
SELECT step::INT AS step, action, columns <> '' AS executed, CASE WHEN columns = '' THEN none END AS reason, columns FROM r
UNION ALL SELECT * FROM (VALUES (0, 'sort_timestamps', false, 'not requested', ''),
 (1, 'drop_leakage_columns', false, 'not requested', ''), (3, 'resample_imbalance', false, 'not requested', ''),
 (5, 'drop_redundant_identifiers', false, 'not requested', ''), (6, 'drop_unlabelled_target', false, 'not requested', ''))""")
def action_log(spark, folder):
    _, log = remediate.repair(
        patchy_orders(spark, folder), ["impute_median", "winsorize_outliers", "drop_high_null_columns"], REGRESSION,
        "o_totalprice", "o_orderdate", "o_orderkey")
    return remediate.action_log(spark, log).withColumn("columns", F.array_join("columns", ","))


@query("duplicate_times_repaired", DIRTY_EVENTS, sql="""
WITH c AS (SELECT ts, count(*) AS c FROM dirty_events GROUP BY ts)
SELECT 'before' AS stage, sum(c)::BIGINT AS time_valid, count(*) AS time_distinct, count(*) FILTER (WHERE c > 1)
 AS duplicate_groups, (sum(c) - count(*))::BIGINT AS duplicate_timestamps FROM c
UNION ALL SELECT 'after', count(*), count(*), 0, 0 FROM c""")
def duplicate_times_repaired(spark, folder):
    df = events(spark, folder)
    done, _ = remediate.repair(df, ["sort_timestamps"], TIME_SERIES, "value", "ts", "event_id")
    before, after = (duplicate_timestamps(d, "ts").select(
        F.lit(stage).alias("stage"), "time_valid", "time_distinct", "duplicate_groups", "duplicate_timestamps")
        for stage, d in (("before", df), ("after", done)))
    return before.unionByName(after)


@query("repair_spread", PATCHY_ORDERS, sql="""
WITH b AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM patchy_orders)
SELECT o_orderstatus, count(*) AS n, round(max(least(greatest(o_totalprice, lo), hi)) FILTER (
 WHERE o_totalprice IS NOT NULL), 4) AS top FROM patchy_orders, b GROUP BY o_orderstatus""")
def repair_spread(spark, folder):
    done, _ = remediate.repair(patchy_orders(spark, folder), ["winsorize_outliers"], REGRESSION, "o_totalprice",
                               row_order="o_orderkey")
    return rounded(done.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top")), 4)
