"""Queries: time axis, target and task of several tables in one run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.catalogue.registry import DIRTY_EVENTS, events, query, rounded, table
from tablefit.operators import discover

ROW_ORDERS = {"orders": "o_orderkey", "events": "event_id", "customer": "c_custkey", "labels": "doc_id",
              "supplier": "s_suppkey", "lineitem": None, "part": "p_partkey"}

# Fixed by the schemas of the tables: kinds and places of the columns that the name rules look at.
COLUMN_FACTS = """SELECT 'orders' AS dataset, 6 AS p, 3 AS numbers, true AS has_time, 'o_totalprice' AS c, 3 AS i,
 'float' AS kind, count(*) AS n, count(DISTINCT o_totalprice) AS u, stddev_samp(o_totalprice) AS s FROM orders
UNION ALL SELECT 'orders', 6, 3, true, 'o_custkey', 1, 'int', count(*), count(DISTINCT o_custkey),
 stddev_samp(o_custkey) FROM orders
UNION ALL SELECT 'events', 6, 3, true, 'value', 4, 'float', count(*), count(DISTINCT value), stddev_samp(value)
 FROM events
UNION ALL SELECT 'customer', 5, 3, false, 'c_acctbal', 3, 'float', count(*), count(DISTINCT c_acctbal),
 stddev_samp(c_acctbal) FROM customer
UNION ALL SELECT 'customer', 5, 3, false, 'c_nationkey', 2, 'int', count(*), count(DISTINCT c_nationkey),
 stddev_samp(c_nationkey) FROM customer"""


def inferred(spark, folder):
    names = ["orders", "events", "customer", "labels", "supplier", "part"]
    tables = {n: table(spark, folder, n) for n in names}
    return discover.infer_tasks(tables, ROW_ORDERS)


def evidence(spark, folder):
    parts = [discover.column_evidence(table(spark, folder, n), n, ROW_ORDERS[n])
             for n in ("orders", "events", "customer")]
    parts.append(discover.column_evidence(events(spark, folder), "dirty_events", "event_id"))
    return reduce(DataFrame.unionByName, parts)


@query("column_evidence", sql="""
SELECT 'orders' AS dataset, 'o_totalprice' AS "column", 3 AS position, count(*) AS n, count(o_totalprice) AS given,
 count(DISTINCT o_totalprice) AS n_unique, round(stddev_samp(o_totalprice), 4) AS std, false AS likely_time FROM orders
UNION ALL SELECT 'orders', 'o_orderdate', 4, count(*), count(o_orderdate), count(DISTINCT o_orderdate), NULL, true
 FROM orders
UNION ALL SELECT 'orders', 'o_orderkey', 0, count(*), count(o_orderkey), count(DISTINCT o_orderkey),
 round(stddev_samp(o_orderkey), 4), false FROM orders
UNION ALL SELECT 'orders', 'o_custkey', 1, count(*), count(o_custkey), count(DISTINCT o_custkey),
 round(stddev_samp(o_custkey), 4), false FROM orders
UNION ALL SELECT 'orders', 'o_orderstatus', 2, count(*), count(o_orderstatus), count(DISTINCT o_orderstatus), NULL,
 false FROM orders
UNION ALL SELECT 'orders', 'o_orderpriority', 5, count(*), count(o_orderpriority), count(DISTINCT o_orderpriority),
 NULL, false FROM orders""")
def column_evidence(spark, folder):
    rows = discover.column_evidence(table(spark, folder, "orders"), "orders", ROW_ORDERS["orders"], exact=True)
    return rows.select("dataset", "column", "position", "n", "given", "n_unique", F.round("std", 4).alias("std"),
                       "likely_time")


@query("timestamp_candidates", DIRTY_EVENTS, sql="""
SELECT 'orders' AS dataset, 'o_orderdate' AS "column", 4 AS position WHERE EXISTS (SELECT 1 FROM orders)
UNION ALL SELECT 'events', 'ts', 1 WHERE EXISTS (SELECT 1 FROM events)
UNION ALL SELECT 'dirty_events', 'ts', 4 WHERE EXISTS (SELECT 1 FROM dirty_events)
UNION ALL SELECT 'dirty_events', 'ts_text', 5 FROM (SELECT avg((TRY_CAST(ts_text AS TIMESTAMP) IS NOT NULL)::INT) AS ok
 FROM dirty_events) WHERE ok >= 0.8""")
def timestamp_candidates(spark, folder):
    return discover.timestamp_candidates(evidence(spark, folder))


@query("target_candidates", sql=f"""
WITH f AS ({COLUMN_FACTS}),
g AS (SELECT *, regexp_matches(c, '(?i)(^|[_\\s-])(price|sales|revenue|demand|salary|cost|loss|profit|yield|amount|score|count|value|target|outcome|response|measurement)([_\\s-]|$)|^y$') AS word FROM f),
s AS (SELECT *, CASE WHEN u >= 20 OR (u >= 12 AND u / n::DOUBLE >= 0.05) THEN 25 WHEN u >= 10 THEN 15 ELSE 0 END
 + has_time::INT * 15 + (kind = 'float')::INT * 15 + (kind = 'int' AND u >= 20)::INT * 10 + 10 + word::INT * 40
 + (i = p - 1)::INT * 20 + (i = p - 2 AND p >= 4)::INT * 5 + (p >= 3 AND numbers >= 3)::INT * 10 AS score FROM g),
a AS (SELECT dataset, c, i, 'regression' AS target_type, score::DOUBLE AS score FROM s
 UNION ALL SELECT 'events', 'event_type', 3, 'classification', 60 + (count(DISTINCT event_type) BETWEEN 2 AND 10)::INT * 15
 FROM events
 UNION ALL SELECT 'orders', 'o_orderpriority', 5, 'classification',
  (count(DISTINCT o_orderpriority) BETWEEN 2 AND 10)::INT * 70 FROM orders
 UNION ALL SELECT 'customer', 'c_mktsegment', 4, 'classification',
  (count(DISTINCT c_mktsegment) BETWEEN 2 AND 10)::INT * 70 FROM customer)
SELECT dataset, c AS "column", target_type, score,
 row_number() OVER (PARTITION BY dataset ORDER BY score DESC, i)::INT AS rank FROM a WHERE score >= 45""")
def target_candidates(spark, folder):
    rows = discover.target_candidates(evidence(spark, folder)).filter("dataset in ('orders', 'events', 'customer')")
    return rows.select("dataset", "column", "target_type", "score", "rank")


@query("time_evidence", DIRTY_EVENTS, sql="""
WITH e AS (SELECT 'events' AS dataset, 'ts' AS "column", count(*) AS n, count(ts) AS valid,
 count(DISTINCT ts) AS distinct_times FROM events
 UNION ALL SELECT 'dirty_events', 'ts_text', count(*), count(TRY_CAST(ts_text AS TIMESTAMP)),
 count(DISTINCT TRY_CAST(ts_text AS TIMESTAMP)) FROM dirty_events
 UNION ALL SELECT 'dirty_events', 'ts', count(*), count(ts), count(DISTINCT ts) FROM dirty_events
 UNION ALL SELECT 'orders', 'o_orderdate', count(*), count(o_orderdate), count(DISTINCT o_orderdate) FROM orders
 UNION ALL SELECT 'lineitem', 'l_shipdate', count(*), count(l_shipdate), count(DISTINCT l_shipdate) FROM lineitem)
SELECT *, round(distinct_times / valid::DOUBLE, 6) AS uniqueness, CASE WHEN valid <= 0.3 * n THEN 'unreadable'
 WHEN distinct_times / valid::DOUBLE >= 0.85 AND 1 - distinct_times / valid::DOUBLE <= 0.10 THEN 'series'
 WHEN distinct_times / valid::DOUBLE < 0.70 OR 1 - distinct_times / valid::DOUBLE > 0.15 THEN 'transactional'
 ELSE 'ambiguous' END AS structure FROM e""")
def time_evidence(spark, folder):
    parts = [
        discover.time_evidence(table(spark, folder, "events"), "events", ["ts"]),
        discover.time_evidence(events(spark, folder), "dirty_events", ["ts", "ts_text"]),
        discover.time_evidence(table(spark, folder, "orders"), "orders", ["o_orderdate"]),
        discover.time_evidence(table(spark, folder, "lineitem"), "lineitem", ["l_shipdate"]),
    ]
    return rounded(reduce(DataFrame.unionByName, parts).drop("place", "duplicate_share"))


@query("time_axis", DIRTY_EVENTS, sql="""
WITH e AS (SELECT 'ts' AS c, count(DISTINCT ts) / count(ts)::DOUBLE AS u, 0 AS i FROM dirty_events
 UNION ALL SELECT 'ts_text', count(DISTINCT TRY_CAST(ts_text AS TIMESTAMP))
  / count(TRY_CAST(ts_text AS TIMESTAMP))::DOUBLE, 1 FROM dirty_events)
SELECT 'dirty_events' AS dataset, c AS time, round(u, 6) AS uniqueness FROM e ORDER BY u DESC, i LIMIT 1""")
def time_axis(spark, folder):
    found = discover.time_evidence(events(spark, folder), "dirty_events", ["ts", "ts_text"])
    return rounded(discover.time_axis(found).drop("structure"))


@query("task_probabilities", sql="""
WITH facts AS (
 SELECT 'orders' AS dataset, 'o_totalprice' AS target, 'o_orderdate' AS time,
  count(DISTINCT o_orderdate) / count(*)::DOUBLE AS u FROM orders
 UNION ALL SELECT 'events', 'value', 'ts', count(DISTINCT ts) / count(*)::DOUBLE FROM events
 UNION ALL SELECT 'customer', 'c_mktsegment', NULL, NULL FROM (SELECT 1 FROM customer LIMIT 1)
 UNION ALL SELECT 'supplier', 's_acctbal', NULL, NULL FROM (SELECT 1 FROM supplier LIMIT 1)
 UNION ALL SELECT 'part', 'p_retailprice', NULL, NULL FROM (SELECT 1 FROM part LIMIT 1)),
s AS (SELECT *, u IS NOT NULL AND u >= 0.85 AND 1 - u <= 0.10 AS series,
 u IS NOT NULL AND (u < 0.70 OR 1 - u > 0.15) AS trans FROM facts),
t AS (SELECT *, 0.02 + CASE WHEN dataset = 'customer' THEN 0 WHEN series THEN 0.12 WHEN u IS NULL OR trans THEN 1.25
 ELSE 0.85 END AS reg, 0.02 + CASE WHEN dataset = 'customer' THEN 1.25 ELSE 0 END AS clf, 0.02 + CASE WHEN series THEN 1.55 WHEN trans THEN 0.12 WHEN u IS NULL THEN 0 ELSE 0.40 END AS ts,
 0.04 AS clu FROM s),
p AS (SELECT *, round(reg / (reg + clf + ts + clu)::DOUBLE, 3) AS a, round(clf / (reg + clf + ts + clu)::DOUBLE, 3) AS b,
 round(ts / (reg + clf + ts + clu)::DOUBLE, 3) AS c, round(clu / (reg + clf + ts + clu)::DOUBLE, 3) AS d FROM t)
SELECT dataset, target, time, CASE WHEN clf > 1 THEN 'supervised_classification' WHEN reg >= ts
  THEN 'supervised_regression' ELSE 'time_series_forecasting' END AS task,
 round(CASE WHEN clf < 1 AND reg >= ts THEN a + (1 - a - b - c - d) ELSE a END, 3) AS p_supervised_regression,
 round(CASE WHEN clf > 1 THEN b + (1 - a - b - c - d) ELSE b END, 3) AS p_supervised_classification,
 round(CASE WHEN clf < 1 AND reg < ts THEN c + (1 - a - b - c - d) ELSE c END, 3) AS p_time_series_forecasting,
 d AS p_clustering FROM p""")
def task_probabilities(spark, folder):
    rows = inferred(spark, folder).filter("dataset <> 'labels'")
    return rows.select("dataset", "target", "time", "task", "p_supervised_regression", "p_supervised_classification",
                       "p_time_series_forecasting", "p_clustering")


@query("infer_all_tables")
def infer_all_tables(spark, folder):
    return inferred(spark, folder)


@query("role_resolution", sql="""
SELECT * FROM (VALUES ('orders', 'time_series_forecasting', 'o_totalprice', 'o_orderdate'),
 ('events', 'time_series_forecasting', 'value', 'ts')) t(dataset, task, target, time)
WHERE EXISTS (SELECT 1 FROM orders) AND EXISTS (SELECT 1 FROM events)""")
def role_resolution(spark, folder):
    tables = {n: table(spark, folder, n) for n in ("orders", "events")}
    found = discover.infer_tasks(tables, ROW_ORDERS, override="time_series")
    columns = evidence(spark, folder).select("dataset", "column", "position", "kind")
    return discover.resolve_roles(found, columns)
