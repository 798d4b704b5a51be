"""Queries: the eight dimensions one by one, per segment."""

from __future__ import annotations

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
from tablefit.functions.lookups import CLASSIFICATION, REGRESSION, TASKS
from tablefit.operators import dimensions as dims
from tablefit.operators.anomaly import forest_anomaly
from tablefit.operators.columns import column_roles, numeric_columns

SEGMENT = ["l_returnflag"]
CELLS = ["l_quantity", "l_tax", "l_extendedprice", "l_discount", "inf_col", "const_col", "empty_col", "rare_label"]
FEATURES = ["l_quantity", "l_extendedprice", "leak_discount"]
PRESENT = " + ".join(f"({c} IS NULL)::INT" for c in CELLS)


def cell_rows(spark, folder, target=None):
    df = lineitem(spark, folder).select(*SEGMENT, *CELLS)
    return dims.cell_metrics(df, column_roles(df, target, by=SEGMENT, identifiers=[]), SEGMENT)


@query("completeness_score", DIRTY_LINEITEM, sql=f"""
WITH r AS (SELECT l_returnflag, count(*) AS n, sum({PRESENT})::BIGINT AS missing_cells,
 {", ".join(f"1 - count({c}) / count(*)::DOUBLE AS r_{c}" for c in CELLS)} FROM dirty_lineitem GROUP BY l_returnflag),
h AS (SELECT *, ({" + ".join(f"(r_{c} > 0.4)::INT" for c in CELLS)}) AS high_columns,
 ({" + ".join(f"(r_{c} = 1)::INT" for c in CELLS)}) AS empty_columns FROM r)
SELECT l_returnflag, n, missing_cells, round(missing_cells / (8.0 * n)::DOUBLE, 6) AS missing_rate,
 high_columns, empty_columns,
 round(greatest(0, 100 - 80 * missing_cells / (8.0 * n)::DOUBLE - 5 * high_columns - 15 * empty_columns), 6) AS score
FROM h""")
def completeness_score(spark, folder):
    rows = cell_rows(spark, folder)
    score = dims.completeness_score(F.col("missing_rate"), F.size("high_missing_cols"), F.size("empty_cols"))
    return rounded(rows.select(
        *SEGMENT, "n", "missing_cells", "missing_rate", F.size("high_missing_cols").alias("high_columns"),
        F.size("empty_cols").alias("empty_columns"), score.alias("score")))


@query("severely_empty_rows", DIRTY_LINEITEM, sql="""
SELECT l_returnflag, count(*) FILTER (WHERE (l_quantity IS NULL)::INT + (l_tax IS NULL)::INT
 + (empty_col IS NULL)::INT + (l_discount IS NULL)::INT > 2) AS severely_empty_rows
FROM dirty_lineitem GROUP BY l_returnflag""")
def severely_empty_rows(spark, folder):
    df = lineitem(spark, folder).select(*SEGMENT, "l_quantity", "l_tax", "empty_col", "l_discount")
    rows = dims.cell_metrics(df, column_roles(df, by=SEGMENT, identifiers=[]), SEGMENT)
    return rows.select(*SEGMENT, "severely_empty_rows")


@query("validity_score", DIRTY_LINEITEM, sql="""
WITH r AS (SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE isinf(inf_col)) AS infinite_cells
 FROM dirty_lineitem GROUP BY l_returnflag)
SELECT l_returnflag, 2 AS constant_columns, infinite_cells, (infinite_cells > 0)::INT AS infinite_columns,
 round(greatest(10, 100 - 20 - 100 * infinite_cells / (8.0 * n)::DOUBLE - 5 * (infinite_cells > 0)::INT), 6) AS score
FROM r""")
def validity_score(spark, folder):
    rows = cell_rows(spark, folder, "l_extendedprice")
    score = dims.validity_score(
        F.size("constant_cols"), F.col("infinite_cells") / (F.col("n") * F.col("n_numeric")), F.size("infinite_cols"),
        dims.target_penalty(F.lit(REGRESSION), F.col("target_given"), F.col("target_constant"),
                            F.col("target_numeric")))
    return rounded(rows.select(
        *SEGMENT, F.size("constant_cols").alias("constant_columns"), "infinite_cells",
        F.size("infinite_cols").alias("infinite_columns"), score.alias("score")))


@query("target_validity", DIRTY_LINEITEM, sql="""
WITH t AS (
 SELECT l_returnflag, 'const_col' AS target, count(DISTINCT const_col) AS k, true AS numeric FROM dirty_lineitem
 GROUP BY ALL
 UNION ALL SELECT l_returnflag, 'l_linestatus', count(DISTINCT l_linestatus), false FROM dirty_lineitem GROUP BY ALL
 UNION ALL SELECT l_returnflag, 'l_quantity', count(DISTINCT l_quantity), true FROM dirty_lineitem GROUP BY ALL)
SELECT l_returnflag, target, task, CASE
 WHEN task NOT LIKE 'supervised%' THEN 0 WHEN k <= 1 THEN 70
 WHEN task = 'supervised_regression' AND NOT numeric THEN 60 ELSE 0 END::DOUBLE AS penalty
FROM t, (VALUES ('supervised_classification'), ('supervised_regression'), ('clustering'),
 ('time_series_forecasting')) x(task)""")
def target_validity(spark, folder):
    df = lineitem(spark, folder)
    parts = []
    for target in ("const_col", "l_linestatus", "l_quantity"):
        one = df.select(*SEGMENT, target)
        rows = dims.cell_metrics(one, column_roles(one, target, by=SEGMENT, identifiers=[]), SEGMENT)
        rows = rows.withColumn("task", F.explode(F.array(*map(F.lit, TASKS))))
        parts.append(rows.select(*SEGMENT, F.lit(target).alias("target"), "task", dims.target_penalty(
            F.col("task"), F.col("target_given"), F.col("target_constant"), F.col("target_numeric")).alias("penalty")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


COMPLETE = "l_quantity IS NOT NULL"


@query("collinear_pairs", DIRTY_LINEITEM, sql="""
WITH c AS (SELECT * FROM dirty_lineitem WHERE l_quantity IS NOT NULL),
p AS (SELECT l_returnflag, 'l_discount' AS feat_a, 'leak_discount' AS feat_b, count(*) AS n,
 corr(l_discount, leak_discount) AS r FROM c GROUP BY l_returnflag
 UNION ALL SELECT l_returnflag, 'l_quantity', 'l_discount', count(*), corr(l_quantity, l_discount) FROM c GROUP BY ALL
 UNION ALL SELECT l_returnflag, 'l_quantity', 'leak_discount', count(*), corr(l_quantity, leak_discount) FROM c
 GROUP BY ALL)
SELECT l_returnflag, feat_a, feat_b, n, round(r, 6) AS r FROM p WHERE n >= 10 AND abs(r) > 0.92""")
def collinear_pairs(spark, folder):
    df = lineitem(spark, folder).select(*SEGMENT, "l_quantity", "l_discount", "leak_discount")
    return rounded(dims.collinear_pairs(df, column_roles(df, by=SEGMENT, identifiers=[]), SEGMENT))


@query("leakage_suspects", DIRTY_LINEITEM, sql="""
WITH c AS (SELECT * FROM dirty_lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
p AS (SELECT l_returnflag, 'leak_discount' AS feature, count(*) AS n, corr(l_discount, leak_discount) AS r
 FROM c GROUP BY l_returnflag
 UNION ALL SELECT l_returnflag, 'l_quantity', count(*), corr(l_discount, l_quantity) FROM c GROUP BY ALL
 UNION ALL SELECT l_returnflag, 'l_extendedprice', count(*), corr(l_discount, l_extendedprice) FROM c GROUP BY ALL)
SELECT l_returnflag, feature, n, round(r, 6) AS r FROM p WHERE n > 10 AND abs(r) > 0.98""")
def leakage_suspects(spark, folder):
    df = lineitem(spark, folder).select(*SEGMENT, *FEATURES, "l_discount")
    return rounded(dims.leakage_suspects(df, column_roles(df, "l_discount", by=SEGMENT, identifiers=[]), SEGMENT))


@query("consistency_score", DIRTY_LINEITEM, sql="""
WITH c AS (SELECT l_returnflag, count(*) AS clean_rows,
 (abs(corr(l_quantity, l_extendedprice)) > 0.92)::INT + (abs(corr(l_quantity, leak_discount)) > 0.92)::INT
  + (abs(corr(l_extendedprice, leak_discount)) > 0.92)::INT AS collinear_pairs,
 (abs(corr(l_discount, l_quantity)) > 0.98)::INT + (abs(corr(l_discount, l_extendedprice)) > 0.98)::INT
  + (abs(corr(l_discount, leak_discount)) > 0.98)::INT AS leaks
 FROM dirty_lineitem WHERE l_quantity IS NOT NULL GROUP BY l_returnflag)
SELECT l_returnflag, clean_rows, collinear_pairs::BIGINT AS collinear_pairs, leaks,
 round(greatest(15, 100 - 6 * collinear_pairs - 25 * leaks)::DOUBLE, 6) AS score FROM c""")
def consistency_score(spark, folder):
    df = lineitem(spark, folder).select(*SEGMENT, *FEATURES, "l_discount")
    rows = dims.consistency_metrics(df, column_roles(df, "l_discount", by=SEGMENT, identifiers=[]), SEGMENT)
    leaks = F.size("leakage_cols")
    return rounded(rows.select(
        *SEGMENT, "clean_rows", F.col("collinear_pairs").cast("long"), leaks.alias("leaks"),
        dims.consistency_score(F.lit(3), F.col("clean_rows"), F.col("collinear_pairs"), leaks)
        .cast("double").alias("score")))


@query("duplicate_rows", DIRTY_ORDERS, sql="""
SELECT o_orderstatus, count(*) AS n,
 count(*) - count(DISTINCT (o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority)) AS duplicate_rows,
 round((count(*) - count(DISTINCT (o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority)))
  / count(*)::DOUBLE, 6) AS duplicate_rate
FROM dirty_orders GROUP BY o_orderstatus""")
def duplicate_rows(spark, folder):
    from tablefit.operators.profile import duplicate_rows as count

    return rounded(count(orders(spark, folder), ["o_orderstatus"]))


@query("key_collisions", DIRTY_ORDERS, sql="""
SELECT count(*) - count(DISTINCT o_orderkey) AS key_collisions, 1 AS id_columns FROM dirty_orders""")
def key_collisions(spark, folder):
    df = orders(spark, folder)
    return dims.key_collisions(df, column_roles(df))


@query("uniqueness_score", DIRTY_ORDERS, sql="""
WITH u AS (SELECT o_orderstatus, count(*) AS n, count(*) - count(DISTINCT o_orderkey) AS c,
 count(*) - count(DISTINCT (o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority)) AS d
 FROM dirty_orders GROUP BY o_orderstatus)
SELECT o_orderstatus, d AS duplicate_rows, c AS key_collisions,
 round(greatest(0, 100 - 100 * d / n::DOUBLE - 40 * c / n::DOUBLE), 6) AS score FROM u""")
def uniqueness_score(spark, folder):
    df = orders(spark, folder)
    by = ["o_orderstatus"]
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    rows = dims.uniqueness_metrics(df, column_roles(df, by=by), by).join(sizes, by)
    score = dims.uniqueness_score(F.col("duplicate_rate"), F.col("key_collisions"), F.col("n"), F.col("id_columns"))
    return rounded(rows.select(*by, "duplicate_rows", "key_collisions", score.alias("score")))


STAMPS = """stamps AS (SELECT event_type, ts, count(*) AS c FROM dirty_events GROUP BY ALL)"""
GAPS = """gaps AS (SELECT event_type, event_id,
 (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id)) / 1e6 AS gap FROM dirty_events)"""


@query("duplicate_timestamps", DIRTY_EVENTS, STAMPS, sql="""
SELECT event_type, 0::BIGINT AS time_invalid, sum(c)::BIGINT AS time_valid, count(*) AS time_distinct,
 count(*) FILTER (WHERE c > 1) AS duplicate_groups, (sum(c) - count(*))::BIGINT AS duplicate_timestamps,
 round((sum(c) - count(*)) / sum(c)::DOUBLE * 100, 6) AS duplicate_rate FROM stamps GROUP BY event_type""")
def duplicate_timestamps(spark, folder):
    return rounded(dims.duplicate_timestamps(events(spark, folder), "ts", ["event_type"]))


@query("temporal_order", DIRTY_EVENTS, GAPS, sql="""
SELECT event_type, count(gap) AS gaps, count(*) FILTER (WHERE gap < 0) AS backward_jumps,
 count(*) FILTER (WHERE gap < 0) = 0 AS in_order FROM gaps GROUP BY event_type""")
def temporal_order(spark, folder):
    rows = dims.temporal_order(events(spark, folder), "ts", "event_id", ["event_type"])
    return rows.select("event_type", "gaps", "backward_jumps", "in_order")


@query("cadence_stats", DIRTY_EVENTS, GAPS, sql="""
SELECT event_type, round(avg(gap), 4) AS cadence_mean, round(stddev_samp(gap), 4) AS cadence_std,
 round(stddev_samp(gap) / avg(gap), 4) AS cadence_cv FROM gaps GROUP BY event_type""")
def cadence_stats(spark, folder):
    # Small ranges send the query down the stitched path that large tables take.
    rows = dims.temporal_order(events(spark, folder), "ts", "event_id", ["event_type"], rows_per_range=2000)
    return rounded(rows.select("event_type", "cadence_mean", "cadence_std", "cadence_cv"), 4)


@query("half_split_drift", sql="""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i,
 count(*) OVER (PARTITION BY event_type) AS n FROM events),
s AS (SELECT event_type, v.* FROM o, LATERAL (VALUES ('value', value, i <= n // 2),
 ('user_id', user_id::DOUBLE, i <= n // 2)) v("column", x, first))
SELECT event_type, "column", round(CASE WHEN sqrt((var_samp(x) FILTER (WHERE first)
 + var_samp(x) FILTER (WHERE NOT first)) / 2) > 1e-6 THEN abs(avg(x) FILTER (WHERE first)
 - avg(x) FILTER (WHERE NOT first)) / sqrt((var_samp(x) FILTER (WHERE first)
 + var_samp(x) FILTER (WHERE NOT first)) / 2) ELSE 0 END, 6) AS shift,
 abs(avg(x) FILTER (WHERE first) - avg(x) FILTER (WHERE NOT first)) / sqrt((var_samp(x) FILTER (WHERE first)
 + var_samp(x) FILTER (WHERE NOT first)) / 2) > 0.5 AS drifted
FROM s GROUP BY event_type, "column" """)
def half_split_drift(spark, folder):
    return rounded(dims.half_split_drift(
        table(spark, folder, "events"), ["value", "user_id"], "event_id", ["event_type"]))


@query("timeliness_score", DIRTY_EVENTS, STAMPS, GAPS, sql="""
WITH s AS (SELECT event_type, sum(c)::BIGINT AS n, (sum(c) - count(*))::BIGINT AS dup FROM stamps GROUP BY event_type),
g AS (SELECT event_type, count(*) FILTER (WHERE gap < 0) AS back, stddev_samp(gap) / avg(gap) AS cv FROM gaps
 GROUP BY event_type)
SELECT event_type, dup AS duplicate_timestamps, back AS backward_jumps, round(greatest(0, 100
 - (back > 0)::INT * 45 - CASE WHEN dup > 0 THEN least(40, 150 * dup / n::DOUBLE) ELSE 0 END
 - (cv > 1.5)::INT * 15), 6) AS score, back > 0 OR dup > 0 AS veto FROM s JOIN g USING (event_type)""")
def timeliness_score(spark, folder):
    by = ["event_type"]
    df = events(spark, folder).select("event_type", "event_id", "ts")
    roles = column_roles(df, time="ts", by=by, without=["event_id"])
    rows = dims.timeliness_metrics(df, roles, "event_id", by)
    rows = rows.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)
    series, c = F.lit("time_series_forecasting"), F.col
    score = dims.timeliness_score(series, c("time_given"), c("time_found"), c("n"), c("time_invalid"),
                                  c("backward_jumps"), c("duplicate_timestamps"), c("cadence_cv"), F.lit(0.0))
    veto = dims.timeliness_veto(series, c("time_found"), c("n"), c("time_invalid"), c("backward_jumps"),
                                c("duplicate_timestamps"))
    return rounded(rows.select(*by, "duplicate_timestamps", "backward_jumps", score.alias("score"),
                               veto.alias("veto")))


@query("unreadable_times", DIRTY_EVENTS, sql="""
WITH t AS (SELECT event_type, CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'soon' ELSE ts_text END AS said
 FROM dirty_events),
s AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE TRY_CAST(said AS TIMESTAMP) IS NULL) AS bad,
 count(TRY_CAST(said AS TIMESTAMP)) - count(DISTINCT TRY_CAST(said AS TIMESTAMP)) AS dup FROM t GROUP BY event_type)
SELECT event_type, n, bad AS time_invalid, CASE WHEN bad / n::DOUBLE > 0.2 THEN 25
 ELSE 100 - CASE WHEN dup > 0 THEN least(40, 150 * dup / n::DOUBLE) ELSE 0 END END::DOUBLE AS score,
 bad / n::DOUBLE > 0.2 OR dup > 0 AS veto FROM s""")
def unreadable_times(spark, folder):
    by, c = ["event_type"], F.col
    df = events(spark, folder).withColumn("at", F.when(
        (c("event_type") == "click") & (F.pmod("event_id", F.lit(3)) == 0), "soon").otherwise(c("ts_text")))
    rows = dims.duplicate_timestamps(df, "at", by)
    rows = rows.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)
    series, none = F.lit("time_series_forecasting"), F.lit(0)
    score = dims.timeliness_score(series, F.lit(True), F.lit(True), c("n"), c("time_invalid"), none,
                                  c("duplicate_timestamps"), F.lit(0.0), F.lit(0.0))
    veto = dims.timeliness_veto(series, F.lit(True), c("n"), c("time_invalid"), none, c("duplicate_timestamps"))
    return rounded(rows.select(*by, "n", "time_invalid", score.cast("double").alias("score"), veto.alias("veto")))


@query("timeliness_without_axis", sql="""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey)
 <= count(*) OVER (PARTITION BY o_orderstatus) // 2 AS h FROM orders),
d AS (SELECT o_orderstatus, (abs(avg(x) FILTER (WHERE h) - avg(x) FILTER (WHERE NOT h)) / sqrt((var_samp(x)
 FILTER (WHERE h) + var_samp(x) FILTER (WHERE NOT h)) / 2) > 0.5)::INT AS drifted
 FROM (SELECT o_orderstatus, h, o_orderkey AS x, 'k' AS c FROM o UNION ALL
  SELECT o_orderstatus, h, o_totalprice, 'p' FROM o UNION ALL SELECT o_orderstatus, h, o_custkey, 'c' FROM o)
 GROUP BY o_orderstatus, c),
s AS (SELECT o_orderstatus, sum(drifted)::INT AS drifted FROM d GROUP BY o_orderstatus)
SELECT o_orderstatus, task, drifted, round(CASE WHEN task = 'time_series_forecasting' THEN 15
 ELSE greatest(50, 100 - 40 * drifted / 3.0::DOUBLE - 2 * drifted) END, 6) AS score,
 task = 'time_series_forecasting' AS veto
FROM s, (VALUES ('supervised_regression'), ('clustering'), ('time_series_forecasting')) t(task)""")
def timeliness_without_axis(spark, folder):
    by = ["o_orderstatus"]
    df = table(spark, folder, "orders").select("o_orderstatus", "o_orderkey", "o_custkey", "o_totalprice")
    roles = column_roles(df, by=by, identifiers=[])
    rows = dims.timeliness_metrics(df, roles, "o_orderkey", by)
    rows = rows.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)
    tasks = ["supervised_regression", "clustering", "time_series_forecasting"]
    rows = rows.withColumn("task", F.explode(F.array(*map(F.lit, tasks))))
    c, drifted = F.col, F.size("drifted_cols")
    score = dims.timeliness_score(c("task"), c("time_given"), c("time_found"), c("n"), c("time_invalid"),
                                  c("backward_jumps"), c("duplicate_timestamps"), c("cadence_cv"),
                                  dims.drift_penalty(drifted, F.lit(3)))
    veto = dims.timeliness_veto(c("task"), c("time_found"), c("n"), c("time_invalid"), c("backward_jumps"),
                                c("duplicate_timestamps"))
    return rounded(rows.select(*by, "task", drifted.alias("drifted"), score.alias("score"), veto.alias("veto")))


@query("heavy_tail_columns", DIRTY_LINEITEM, sql="""
WITH m AS (SELECT l_linestatus, quantile_cont(l_quantity, 0.5) AS q, quantile_cont(l_tax, 0.5) AS t
 FROM dirty_lineitem GROUP BY l_linestatus),
f AS (SELECT l_linestatus, coalesce(l_quantity, q) AS q, coalesce(l_tax, t) AS t, l_extendedprice AS p
 FROM dirty_lineitem JOIN m USING (l_linestatus)),
k AS (SELECT l_linestatus, 'l_quantity' AS "column", kurtosis(q) AS kurtosis FROM f GROUP BY l_linestatus
 UNION ALL SELECT l_linestatus, 'l_tax', kurtosis(t) FROM f GROUP BY l_linestatus
 UNION ALL SELECT l_linestatus, 'l_extendedprice', kurtosis(p) FROM f GROUP BY l_linestatus)
SELECT l_linestatus, "column", round(kurtosis, 4) AS kurtosis, abs(kurtosis) > 5 AS heavy FROM k""")
def heavy_tail_columns(spark, folder):
    return rounded(dims.heavy_tails(
        lineitem(spark, folder), ["l_quantity", "l_tax", "l_extendedprice"], ["l_linestatus"]), 4)


@query("anomaly_score")
def anomaly_score(spark, folder):
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    return rounded(forest_anomaly(lineitem(spark, folder), columns, SEGMENT, "threshold",
                                  keys=["l_orderkey", "l_linenumber"]))


# Rows far off in three columns, in one segment only; the forests must find these and no others.
PLANTED = "l_returnflag = 'R' AND l_orderkey % 97 = 0"


@query("planted_anomalies", sql=f"""
WITH c AS (SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE {PLANTED}) AS anomalies FROM lineitem
 GROUP BY l_returnflag), s AS (SELECT *, anomalies / n::DOUBLE AS share FROM c)
SELECT l_returnflag, n, anomalies, round(share, 6) AS anomaly_ratio, round(CASE WHEN n < 15 THEN 95 ELSE
 greatest(10, 100 - 300 * greatest(0, share - 0.02::DOUBLE) - 80 * share) END, 6)::DOUBLE AS score FROM s""")
def planted_anomalies(spark, folder):
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    df = table(spark, folder, "lineitem").select(*SEGMENT, "l_orderkey", "l_linenumber", *columns)
    far = F.when(F.expr(PLANTED), F.lit(1e7)).otherwise(F.lit(0.0))
    df = df.withColumns({c: F.col(c) + far for c in columns})
    found = forest_anomaly(df, columns, SEGMENT, "threshold", cutoff=0.72, keys=["l_orderkey", "l_linenumber"])
    score = dims.outlier_score(F.lit(len(columns)), F.col("n"), F.col("anomaly_ratio"))
    return rounded(found.select(*SEGMENT, "n", "anomalies", "anomaly_ratio", score.cast("double").alias("score")))


@query("outlier_score", sql="""
WITH m AS (SELECT event_type, count(*) AS n, least(count(*), 2000) AS m FROM events GROUP BY event_type),
c AS (SELECT event_type, n, CASE WHEN n < 15 THEN 0 ELSE ceil(round(0.05 * (m - 1), 9)) / m::DOUBLE END AS share FROM m)
SELECT event_type, round(share, 6) AS anomaly_ratio, round(CASE WHEN n < 15 THEN 95 ELSE
 greatest(10, 100 - 300 * greatest(0, share - 0.02) - 80 * share) END, 6) AS score FROM c""")
def outlier_score(spark, folder):
    df = table(spark, folder, "events").select("event_type", "value", "user_id")
    rows = dims.outlier_metrics(df, column_roles(df, by=["event_type"], identifiers=[]), ["event_type"])
    rows = rows.join(df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "event_type")
    return rounded(rows.select("event_type", "anomaly_ratio", dims.outlier_score(
        F.lit(2), F.col("n"), F.col("anomaly_ratio")).alias("score")))


@query("balance_classification", DIRTY_LINEITEM, sql="""
WITH c AS (SELECT l_returnflag, uneven_label, count(*) AS c FROM dirty_lineitem GROUP BY ALL),
s AS (SELECT l_returnflag, min(c) / sum(c)::DOUBLE AS lo, max(c) / sum(c)::DOUBLE AS hi FROM c GROUP BY l_returnflag)
SELECT l_returnflag, round(lo * 100, 6) AS minority_pct, round(hi * 100, 6) AS majority_pct,
 round(hi / greatest(0.001, lo), 6) AS imbalance_ratio,
 (100 - CASE WHEN lo * 100 < 2 THEN 80 WHEN lo * 100 < 10 THEN 45 WHEN lo * 100 < 25 THEN 20 ELSE 0 END)::DOUBLE
  AS score FROM s""")
def balance_classification(spark, folder):
    df = lineitem(spark, folder).select(*SEGMENT, "uneven_label")
    rows = dims.balance_metrics(df, column_roles(df, "uneven_label", by=SEGMENT, identifiers=[]), SEGMENT)
    score = dims.balance_score(F.lit(CLASSIFICATION), F.col("minority_pct"), F.lit(True), F.lit(None).cast("double"),
                               F.lit(2))
    return rounded(rows.withColumn("score", score.cast("double")))


@query("balance_regression", sql="""
SELECT event_type, round(skewness(value), 6) AS target_skewness, round(stddev_samp(value), 6) AS target_std,
 round(greatest(15, 100 - least(50, 8 * abs(skewness(value)))), 6) AS score FROM events GROUP BY event_type""")
def balance_regression(spark, folder):
    df = table(spark, folder, "events").select("event_type", "value")
    rows = dims.cell_metrics(df, column_roles(df, "value", by=["event_type"], identifiers=[]), ["event_type"])
    score = dims.balance_score(F.lit(REGRESSION), F.lit(None).cast("double"), F.lit(True), F.col("target_skewness"),
                               F.col("n"))
    return rounded(rows.select("event_type", "target_skewness", "target_std", score.alias("score")))


@query("coverage_score", sql="""
WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT o_custkey, n, round(n / 2.0::DOUBLE, 6) AS ratio,
 round(greatest(20, 50 + 50 * least(1, n / 2.0::DOUBLE / 10)), 6) AS score FROM c""")
def coverage_score(spark, folder):
    df = table(spark, folder, "orders")
    features = len(numeric_columns(df, ("o_custkey",)))  # o_orderkey and o_totalprice
    sizes = df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return rounded(sizes.withColumns({
        "ratio": F.col("n") / features, "score": dims.coverage_score(F.lit(features), F.col("n"))}))
