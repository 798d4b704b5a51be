"""Registry of named queries and the views they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefit.operators import defects

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The dirty views of operators/defects.py, as SQL.
DIRTY_LINEITEM = """dirty_lineitem AS (
 SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN (l_orderkey*7 + l_linenumber*13) % 100 < 12 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN (l_orderkey*11 + l_linenumber) % 100 < 55 THEN NULL ELSE l_tax END AS l_tax,
  CASE WHEN (l_orderkey*31 + l_linenumber*3) % 500 = 0 THEN l_extendedprice*1000 ELSE l_extendedprice END
   AS l_extendedprice,
  l_discount, l_discount*100 + l_linenumber*1e-4 AS leak_discount,
  CASE WHEN l_orderkey % 97 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_discount END AS inf_col,
  1 AS const_col, CAST(NULL AS DOUBLE) AS empty_col,
  CASE WHEN (l_orderkey*17 + l_linenumber) % 1000 < 15 THEN 1 ELSE 0 END AS rare_label,
  CASE WHEN (l_orderkey*17 + l_linenumber) % 1000 < 60 THEN 1 ELSE 0 END AS uneven_label,
  l_returnflag, l_linestatus, l_shipdate FROM lineitem)"""
DIRTY_ORDERS = """dirty_orders AS (
 SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 20 = 0)"""
DIRTY_EVENTS = """dirty_events AS (
 SELECT event_id, user_id, event_type, value,
  CASE WHEN event_id % 15 = 0 THEN ts - INTERVAL 2 HOURS
       WHEN event_id % 10 = 1 THEN date_trunc('hour', ts) ELSE ts END AS ts,
  CASE WHEN event_id % 50 = 0 THEN 'INVALID_DATE' ELSE CAST(ts AS VARCHAR) END AS ts_text FROM events)"""
# Orders with gaps, spikes and a rare flag; one unique key, so splits are exact.
PATCHY_ORDERS = """patchy_orders AS (
 SELECT o_orderkey, o_orderstatus, o_orderdate,
  CASE WHEN (o_orderkey*7) % 100 < 12 THEN NULL
       WHEN (o_orderkey*31 + 7) % 500 = 0 THEN o_totalprice*1000 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN (o_orderkey*11) % 100 < 20 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN (o_orderkey*17) % 1000 < 60 THEN 1 ELSE 0 END AS flag FROM orders)"""


def query(name: str, *ctes: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` (after the given views) is what it must equal."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            prefix = f"WITH {', '.join(ctes)} " if ctes else ""
            joined = sql.lstrip()
            if ctes and joined.upper().startswith("WITH "):
                prefix, joined = prefix.rstrip() + ", ", joined[5:]
            SQL[name] = prefix + joined
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return defects.dirty_lineitem(table(spark, folder, "lineitem"))


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return defects.dirty_orders(table(spark, folder, "orders"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return defects.dirty_events(table(spark, folder, "events"))


def patchy_orders(spark: SparkSession, folder: str) -> DataFrame:
    df, key = table(spark, folder, "orders"), F.col("o_orderkey")
    df = defects.spike(df, "o_totalprice", defects.hit(key, 31, 500, 1, 7), 1000)
    df = defects.blank(df, "o_totalprice", defects.hit(key, 7, 100, 12))
    df = defects.blank(df, "o_orderpriority", defects.hit(key, 11, 100, 20))
    df = df.withColumn("flag", defects.hit(key, 17, 1000, 60).cast("int"))
    return df.select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderpriority", "flag")


def r6(column: str | Column, digits: int = 6) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    rounded = F.round(value.cast("double"), digits)
    return rounded.alias(column) if isinstance(column, str) else rounded


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, as the last step of a query."""
    return df.select(*[
        r6(f.name, digits) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema
    ])
