"""Queries: sources, column filters, profiles."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import functions as F

from tablefit.catalogue.registry import (
    DIRTY_EVENTS,
    DIRTY_LINEITEM,
    DIRTY_ORDERS,
    events,
    lineitem,
    orders,
    query,
    rounded,
    table,
)
from tablefit.functions.frames import shared_folder
from tablefit.functions.stats import clip
from tablefit.operators import columns as cols
from tablefit.operators import order, profile
from tablefit.operators.select import quantiles
from tablefit.sources import readers, writers

NUMBERS = ["l_quantity", "l_tax", "l_extendedprice", "l_discount", "const_col", "empty_col"]
TEXTS = ["l_returnflag", "l_linestatus"]


def _number_profile(c: str, i: int) -> str:
    return f"""SELECT '{c}' AS "column", {i} AS position, count(*) - count({c}) AS missing_count,
      round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS missing_rate,
      count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) / count(*)::DOUBLE, 6) AS cardinality_ratio,
      CASE WHEN count({c}) > 1 THEN round(avg({c}), 4) END AS mean,
      CASE WHEN count({c}) > 1 THEN round(coalesce(stddev_samp({c}), 0), 4) END AS std,
      CASE WHEN count({c}) > 1 THEN round(min({c})::DOUBLE, 4) END AS min,
      CASE WHEN count({c}) > 1 THEN round(max({c})::DOUBLE, 4) END AS max,
      CASE WHEN count({c}) > 1 THEN round(quantile_cont({c}, 0.5)::DOUBLE, 4) END AS median,
      CASE WHEN count({c}) > 1 THEN round(coalesce(skewness({c}), 0), 4) END AS skewness,
      CASE WHEN count({c}) > 1 THEN round(coalesce(kurtosis({c}), 0), 4) END AS kurtosis FROM dirty_lineitem"""


def _text_profile(c: str, i: int) -> str:
    nothing = ", ".join(f"CAST(NULL AS DOUBLE) AS {s}" for s in (
        "mean", "std", "min", "max", "median", "skewness", "kurtosis"))
    return f"""SELECT '{c}' AS "column", {i} AS position, count(*) - count({c}) AS missing_count,
      round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS missing_rate, count(DISTINCT {c}) AS unique_count,
      round(count(DISTINCT {c}) / count(*)::DOUBLE, 6) AS cardinality_ratio, {nothing} FROM dirty_lineitem"""


@query("profile_columns", DIRTY_LINEITEM, sql=" UNION ALL ".join(
    [_number_profile(c, i) for i, c in enumerate(NUMBERS)]
    + [_text_profile(c, i + len(NUMBERS)) for i, c in enumerate(TEXTS)]))
def profile_columns(spark, folder):
    wide = profile.column_profile(lineitem(spark, folder), columns=[*NUMBERS, *TEXTS]).drop("type", "kind")
    return rounded(rounded(wide.select("*"), 6).withColumns(
        {c: F.round(c, 4) for c in ("mean", "std", "min", "max", "median", "skewness", "kurtosis")}))


@query("profile_table", DIRTY_ORDERS, sql="""
SELECT o_orderstatus, count(*) AS num_rows, 5::BIGINT AS num_columns, 0::BIGINT AS missing_cells,
 0.0::DOUBLE AS missing_pct,
 count(*) - count(DISTINCT (o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority)) AS duplicate_rows,
 (count(*) * 32 + sum(strlen(o_orderpriority)))::BIGINT AS bytes, 100.0::DOUBLE AS static_score
FROM dirty_orders GROUP BY o_orderstatus""")
def profile_table(spark, folder):
    return rounded(profile.table_profile(orders(spark, folder), ["o_orderstatus"]))


@query("profile_missing", DIRTY_LINEITEM, sql="""
SELECT l_returnflag, l_linestatus, count(*) AS num_rows,
 (5 * count(*) - count(l_quantity) - count(l_tax) - count(l_extendedprice) - count(l_discount) - count(empty_col))
  AS missing_cells,
 round((5 * count(*) - count(l_quantity) - count(l_tax) - count(l_extendedprice) - count(l_discount)
  - count(empty_col)) / (5.0 * count(*))::DOUBLE * 100, 6) AS missing_pct,
 round(greatest(0, 100 - 200 * (5 * count(*) - count(l_quantity) - count(l_tax) - count(l_extendedprice)
  - count(l_discount) - count(empty_col)) / (5.0 * count(*))::DOUBLE), 6) AS static_score
FROM dirty_lineitem GROUP BY ALL""")
def profile_missing(spark, folder):
    columns = ["l_quantity", "l_tax", "l_extendedprice", "l_discount", "empty_col"]
    wide = profile.table_profile(lineitem(spark, folder), ["l_returnflag", "l_linestatus"], columns)
    return rounded(wide.drop("num_columns", "duplicate_rows", "bytes"))


@query("profile_shape_stats", sql="""
SELECT event_type, 'value' AS "column", count(value) AS n, round(skewness(value), 6) AS skewness,
 round(kurtosis(value), 6) AS kurtosis FROM events GROUP BY event_type
UNION ALL SELECT event_type, 'user_id', count(user_id), round(skewness(user_id), 6), round(kurtosis(user_id), 6)
FROM events GROUP BY event_type""")
def profile_shape_stats(spark, folder):
    return rounded(profile.shape_stats(table(spark, folder, "events"), ["value", "user_id"], ["event_type"]))


PAIRED = ["l_quantity", "l_tax", "l_extendedprice", "l_discount", "leak_discount", "const_col"]
PAIR_LIST = [(a, b) for i, a in enumerate(PAIRED) for b in PAIRED[i + 1:]]


def _pair_sql(a: str, b: str) -> str:
    r = f"corr({a}, {b}) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"""SELECT l_returnflag, '{a}' AS feat_a, '{b}' AS feat_b,
     count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n,
     round(CASE WHEN NOT isnan({r}) THEN {r} END, 6) AS r FROM dirty_lineitem GROUP BY l_returnflag"""


@query("profile_correlations", DIRTY_LINEITEM, sql=" UNION ALL ".join(_pair_sql(a, b) for a, b in PAIR_LIST))
def profile_correlations(spark, folder):
    return rounded(profile.pair_correlations(lineitem(spark, folder), PAIRED, ["l_returnflag"]))


@query("correlation_matrix", DIRTY_LINEITEM, sql="""
WITH half AS (""" + " UNION ALL ".join(_pair_sql(a, b) for a, b in PAIR_LIST) + """)
SELECT l_returnflag, feat_a, feat_b, round(coalesce(r, 0), 3) AS r FROM half
UNION ALL SELECT l_returnflag, feat_b, feat_a, round(coalesce(r, 0), 3) FROM half
UNION ALL SELECT l_returnflag, c, c, CASE WHEN c = 'const_col' THEN 0.0 ELSE 1.0 END::DOUBLE
FROM (SELECT DISTINCT l_returnflag FROM dirty_lineitem),
 (VALUES ('l_quantity'), ('l_tax'), ('l_extendedprice'), ('l_discount'), ('leak_discount'), ('const_col')) t(c)""")
def correlation_matrix(spark, folder):
    return profile.correlation_matrix(lineitem(spark, folder), PAIRED, ["l_returnflag"])


@query("class_shares", sql="""
SELECT lang, quality, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang)::DOUBLE, 6) AS share
FROM labels JOIN documents USING (doc_id) GROUP BY lang, quality""")
def class_shares(spark, folder):
    joined = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(profile.class_shares(joined, "quality", ["lang"]))


@query("column_quantiles", DIRTY_LINEITEM, sql=" UNION ALL ".join(
    f"""SELECT l_returnflag, '{c}' AS "column", round(quantile_cont({c}, 0.01)::DOUBLE, 4) AS q01,
    round(quantile_cont({c}, 0.5)::DOUBLE, 4) AS q50, round(quantile_cont({c}, 0.99)::DOUBLE, 4) AS q99
    FROM dirty_lineitem GROUP BY l_returnflag""" for c in ("l_quantity", "l_tax", "l_extendedprice")))
def column_quantiles(spark, folder):
    names = ["l_quantity", "l_tax", "l_extendedprice"]
    # A low limit sends the query down the path that large segments take.
    wide = quantiles(lineitem(spark, folder), names, [0.01, 0.5, 0.99], ["l_returnflag"], rows_per_task=1000)
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.get(c, F.lit(i)).alias(q) for i, q in enumerate(("q01", "q50", "q99"))])
        for c in names
    ])
    return rounded(wide.select("l_returnflag", F.inline(entries)), 4)


# ---------------------------------------------------------------- sources, projections, filters


@query("csv_round_trip", sql="SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, folder):
    path = posixpath.join(shared_folder(spark), f"nation-{uuid.uuid4().hex}.csv")
    writers.write_csv(readers.read_table(spark, f"{folder}/nation.parquet"), path)
    return readers.read_table(spark, path)


@query("json_round_trip", DIRTY_EVENTS, sql="""
SELECT event_type, count(*) AS n, count(ts_text) AS texts, round(sum(value), 4) AS total FROM dirty_events
GROUP BY event_type""")
def json_round_trip(spark, folder):
    path = posixpath.join(shared_folder(spark), f"events-{uuid.uuid4().hex}")
    writers.write_json(events(spark, folder).select("event_id", "event_type", "value", "ts_text"), path)
    written = spark.read.schema("event_id long, event_type string, value double, ts_text string").json(path)
    return rounded(written.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("ts_text").alias("texts"), F.sum("value").alias("total")), 4)


@query("guarded_tables", sql="""
SELECT 'events' AS name, (SELECT count(*) FROM events) AS n, true AS accepted
UNION ALL SELECT 'no rows', (SELECT count(*) FROM events WHERE event_id IS NULL), false""")
def guarded_tables(spark, folder):
    df, rows = table(spark, folder, "events"), []
    for name, part in (("events", df), ("no rows", df.filter("event_id is null"))):
        try:
            readers.require_rows(part)
            accepted = True
        except readers.TableError:
            accepted = False
        rows.append(part.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.lit(accepted).alias("accepted")))
    return rows[0].unionByName(rows[1])


@query("numeric_texts", DIRTY_EVENTS, sql="""
SELECT event_type, bool_and(TRY_CAST(ts_text AS DOUBLE) IS NOT NULL) AS times,
 bool_and(TRY_CAST(event_id::VARCHAR AS DOUBLE) IS NOT NULL) AS codes,
 bool_and(TRY_CAST(CASE WHEN event_id % 100 = 1 THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE) IS NOT NULL) AS patchy
FROM dirty_events GROUP BY event_type""")
def numeric_texts(spark, folder):
    df = events(spark, folder).withColumns({
        "code": F.col("event_id").cast("string"),
        "patchy": F.when(F.pmod("event_id", F.lit(100)) == 1, "n/a").otherwise(F.col("value").cast("string"))})
    return df.groupBy("event_type").agg(
        cols.numeric_text("ts_text").alias("times"), cols.numeric_text("code").alias("codes"),
        cols.numeric_text("patchy").alias("patchy"))


@query("shared_features", DIRTY_LINEITEM, sql="""
WITH t AS (SELECT l_quantity, l_tax, l_discount, l_linenumber FROM dirty_lineitem WHERE l_orderkey % 3 = 0)
SELECT 'l_quantity' AS feature, round(avg(l_quantity), 6) AS mean FROM t
UNION ALL SELECT 'l_discount', round(avg(l_discount), 6) FROM t""")
def shared_features(spark, folder):
    """Numeric columns of the training part that the test part has too, without the target, and their test means."""
    df = lineitem(spark, folder)
    train = df.select("l_quantity", "l_tax", "l_extendedprice", "l_discount", "l_returnflag")
    test = df.filter(F.pmod("l_orderkey", F.lit(3)) == 0).select("l_quantity", "l_tax", "l_discount", "l_linenumber")
    shared = cols.shared_features(train, test, "l_tax")
    means = test.agg(*[F.avg(c).alias(c) for c in shared])
    return rounded(means.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean")) for c in shared]))))


@query("first_rows", sql="SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 1500")
def first_rows(spark, folder):
    return order.first_rows(table(spark, folder, "events"), 1500, ["event_id"]).select(
        "event_id", "user_id", "event_type")


@query("slice_rows", sql="""
SELECT event_id, event_type, user_id FROM (
 SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events)
WHERE i >= 50 AND i < 150""")
def slice_rows(spark, folder):
    rows = order.slice_rows(table(spark, folder, "events"), 50, 150, "event_id", ["event_type"])
    return rows.select("event_id", "event_type", "user_id")


@query("contiguous_chunks", sql="""
SELECT event_type, chunk, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id,
 round(avg(value), 6) AS mean FROM (
 SELECT *, ntile(3) OVER (PARTITION BY event_type ORDER BY event_id)::INTEGER AS chunk FROM events)
GROUP BY event_type, chunk""")
def contiguous_chunks(spark, folder):
    tiled = order.with_chunk(table(spark, folder, "events"), 3, ["event_id"], ["event_type"])
    return rounded(tiled.groupBy("event_type", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"),
        F.avg("value").alias("mean")))


@query("lenient_times", DIRTY_EVENTS, sql="""
SELECT event_type, count(*) AS n, count(TRY_CAST(ts_text AS TIMESTAMP)) AS readable,
 epoch_us(min(TRY_CAST(ts_text AS TIMESTAMP))) AS first_us, epoch_us(max(TRY_CAST(ts_text AS TIMESTAMP))) AS last_us
FROM dirty_events GROUP BY event_type""")
def lenient_times(spark, folder):
    df = events(spark, folder)
    at = cols.lenient_timestamp(df, "ts_text")
    return df.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count(at).alias("readable"), F.unix_micros(F.min(at)).alias("first_us"),
        F.unix_micros(F.max(at)).alias("last_us"))


@query("column_roles", DIRTY_EVENTS, sql="""
WITH t AS (SELECT ts_text, strftime(ts, '%m/%d/%Y') AS us_date, CASE WHEN event_id % 2 = 0 THEN 'none'
  ELSE strftime(ts, '%Y-%m-%d') END AS half, event_id::VARCHAR AS code FROM dirty_events),
s AS (SELECT avg((TRY_CAST(ts_text AS TIMESTAMP) IS NOT NULL)::INT) AS ts_text,
 avg((try_strptime(us_date, '%m/%d/%Y') IS NOT NULL)::INT) AS us_date,
 avg((TRY_CAST(half AS TIMESTAMP) IS NOT NULL)::INT) AS half,
 avg((TRY_CAST(code AS DOUBLE) IS NULL)::INT) AS code FROM t)
SELECT 0::INT AS position, 'event_type' AS "column", 'categorical' AS role UNION ALL SELECT 1, 'value', 'numeric'
UNION ALL SELECT 2, 'ts', 'datetime'
UNION ALL SELECT 3, 'ts_text', CASE WHEN ts_text >= 0.8 THEN 'datetime' ELSE 'categorical' END FROM s
UNION ALL SELECT 4, 'us_date', CASE WHEN us_date >= 0.8 THEN 'datetime' ELSE 'categorical' END FROM s
UNION ALL SELECT 5, 'half', CASE WHEN half >= 0.8 THEN 'datetime' ELSE 'categorical' END FROM s
UNION ALL SELECT 6, 'code', CASE WHEN code > 0 THEN 'datetime' ELSE 'categorical' END FROM s""")
def column_roles(spark, folder):
    df, day = events(spark, folder), F.date_format("ts", "yyyy-MM-dd")
    return cols.role_table(df.select(
        "event_type", "value", "ts", "ts_text", F.date_format("ts", "MM/dd/yyyy").alias("us_date"),
        F.when(F.pmod("event_id", F.lit(2)) == 0, "none").otherwise(day).alias("half"),
        F.col("event_id").cast("string").alias("code")))


@query("complete_rows", DIRTY_LINEITEM, sql="""
SELECT l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_quantity IS NOT NULL) AS with_quantity,
 count(*) FILTER (WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL) AS complete
FROM dirty_lineitem GROUP BY l_linestatus""")
def complete_rows(spark, folder):
    df = lineitem(spark, folder).withColumns({
        "has_quantity": F.col("l_quantity").isNotNull(),
        "whole": F.col("l_quantity").isNotNull() & F.col("l_tax").isNotNull()})
    listwise = cols.drop_incomplete(df, ["l_quantity", "l_tax"]).groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("complete"))
    return df.groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("has_quantity").alias("with_quantity")).join(listwise, "l_linestatus")


@query("class_filter", sql="""
SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'A') AS chosen,
 count(*) FILTER (WHERE l_returnflag <> 'A') AS others,
 count(*) FILTER (WHERE year(l_shipdate) BETWEEN 1995 AND 1997) AS in_range FROM lineitem GROUP BY l_linestatus""")
def class_filter(spark, folder):
    chosen = F.col("l_returnflag") == "A"
    return table(spark, folder, "lineitem").groupBy("l_linestatus").agg(
        F.count_if(chosen).alias("chosen"), F.count_if(~chosen).alias("others"),
        F.count_if(F.year("l_shipdate").between(1995, 1997)).alias("in_range"))


@query("clip_and_fill", DIRTY_LINEITEM, sql="""
SELECT l_returnflag, round(avg(least(greatest(l_quantity, 5), 45)), 6) AS clipped_mean,
 count(least(greatest(l_quantity, 5), 45)) FILTER (WHERE l_quantity IS NOT NULL) AS given,
 round(avg(coalesce(l_tax, 0.02)), 6) AS filled_mean
FROM (SELECT * REPLACE (CASE WHEN l_quantity IS NULL THEN NULL ELSE l_quantity END AS l_quantity) FROM dirty_lineitem)
GROUP BY l_returnflag""".replace("avg(least(greatest(l_quantity, 5), 45))",
                                 "avg(least(greatest(l_quantity, 5), 45)) FILTER (WHERE l_quantity IS NOT NULL)"))
def clip_and_fill(spark, folder):
    df = cols.fill_missing(lineitem(spark, folder), {"l_tax": 0.02})
    bounded = clip(F.col("l_quantity"), 5.0, 45.0)
    return rounded(df.groupBy("l_returnflag").agg(
        F.avg(bounded).alias("clipped_mean"), F.count(bounded).alias("given"), F.avg("l_tax").alias("filled_mean")))
