"""Queries: splits, lag features, reference models, metrics, audit."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import functions as F

from tablefit.catalogue.registry import (
    DIRTY_EVENTS,
    PATCHY_ORDERS,
    events,
    patchy_orders,
    query,
    rounded,
    table,
)
from tablefit.functions.frames import shared_folder
from tablefit.functions.lookups import CLASSIFICATION, REGRESSION, TIME_SERIES
from tablefit.operators import audit, compare, models, remediate, splits
from tablefit.operators.columns import fill_missing
from tablefit.plans.closed_loop import SWEEP, fraction_sweep, remediate_and_validate, sweep_split
from tablefit.sources.writers import write_cleansed

SCATTER = "((xor(o_orderkey, o_orderkey >> 31) % 2147483648) * 2654435761 + 42) % 2147483648"
N_TRAIN = "{n} - ceil(round({n} * 0.3::DOUBLE, 9))"


@query("split_random", sql=f"""
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {SCATTER}, o_orderkey)
 <= {N_TRAIN.format(n="count(*) OVER ()")} THEN 'train' ELSE 'test' END AS part FROM orders""")
def split_random(spark, folder):
    # A low limit sends the query down the path that large tables take.
    return splits.random_split(table(spark, folder, "orders"), "o_orderkey", rows_per_task=1000).select(
        "o_orderkey", "part")


@query("split_stratified", sql=f"""
SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY {SCATTER}, o_orderkey)
 <= {N_TRAIN.format(n="count(*) OVER (PARTITION BY o_orderstatus)")} THEN 'train' ELSE 'test' END AS part FROM orders""")
def split_stratified(spark, folder):
    return splits.stratified_split(table(spark, folder, "orders"), "o_orderkey", "o_orderstatus").select(
        "o_orderkey", "o_orderstatus", "part")


@query("split_chronological", sql="""
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey)
 <= floor(count(*) OVER () * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM orders""")
def split_chronological(spark, folder):
    return splits.chronological_split(table(spark, folder, "orders"), "o_orderdate", "o_orderkey").select(
        "o_orderkey", "part")


@query("split_three_way", sql=f"""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {SCATTER}, o_orderkey) AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN i <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.8::DOUBLE)
 THEN 'calibration' ELSE 'test' END AS part FROM r""")
def split_three_way(spark, folder):
    return splits.three_way_random(table(spark, folder, "orders"), "o_orderkey").select("o_orderkey", "part")


@query("split_checks", sql="""
WITH r AS (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey)
 <= floor(count(*) OVER () * 0.7::DOUBLE) AS train FROM orders)
SELECT count(*) FILTER (WHERE train) AS train_rows, count(*) FILTER (WHERE NOT train) AS test_rows,
 max(o_orderdate) FILTER (WHERE train) < min(o_orderdate) FILTER (WHERE NOT train) AS in_time_order,
 0::BIGINT AS shared_keys FROM r""")
def split_checks(spark, folder):
    parts = splits.chronological_split(table(spark, folder, "orders"), "o_orderdate", "o_orderkey")
    return splits.split_checks(parts, "o_orderkey", "o_orderdate")


@query("shuffled_rows", sql=f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {SCATTER}, o_orderkey")
def shuffled_rows(spark, folder):
    return splits.shuffled(table(spark, folder, "orders"), "o_orderkey").select("o_orderkey", "o_custkey")


@query("lag_features", DIRTY_EVENTS, sql="""
WITH r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) <= floor(count(*) OVER () * 0.7::DOUBLE) AS train
 FROM dirty_events),
a AS (SELECT event_id, 'train' AS part, value, coalesce(lag(value) OVER (ORDER BY event_id), value) AS lag1 FROM r
 WHERE train),
l AS (SELECT value AS last FROM r WHERE train ORDER BY event_id DESC LIMIT 1),
b AS (SELECT event_id, 'test' AS part, value, coalesce(lag(value) OVER (ORDER BY ts, event_id), last) AS lag1
 FROM r, l WHERE NOT train)
SELECT event_id, part, lag1 FROM a UNION ALL SELECT event_id, part, lag1 FROM b""")
def lag_features(spark, folder):
    parts = splits.chronological_split(events(spark, folder), "ts", "event_id")
    return models.lag_features(parts, "value", "event_id", "ts", rows_per_range=2000).select("event_id", "part", "lag1")


def _classes(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", "lang", "n_chars", F.size(F.split("text", r"\s+")).alias("words"))
    return docs.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")


@query("train_filled", PATCHY_ORDERS, sql=f"""
WITH s AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE flag END AS mark, row_number() OVER (
  ORDER BY {SCATTER}, o_orderkey) <= {N_TRAIN.format(n="count(*) OVER ()")} AS train FROM patchy_orders),
m AS (SELECT quantile_cont(o_totalprice, 0.5) AS price, quantile_cont(mark, 0.5) AS mark FROM s WHERE train)
SELECT CASE WHEN train THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(sum(coalesce(o_totalprice, m.price)), 4)
 AS price, sum(coalesce(s.mark, m.mark))::DOUBLE AS mark FROM s, m GROUP BY train""")
def train_filled(spark, folder):
    df = patchy_orders(spark, folder).withColumn("mark", F.when(F.pmod("o_orderkey", F.lit(4)) != 0, F.col("flag")))
    parts = splits.random_split(df, "o_orderkey")
    both = models.train_filled(parts.filter("part = 'train'"), parts.filter("part = 'test'"), ["o_totalprice", "mark"])
    sums = [d.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("price"), F.sum("mark").alias("mark"))
            for d in both]
    return rounded(sums[0].unionByName(sums[1]), 4)


@query("cleansed_export", PATCHY_ORDERS, sql=f"""
WITH s AS (SELECT *, row_number() OVER (ORDER BY {SCATTER}, o_orderkey) <= {N_TRAIN.format(n="count(*) OVER ()")} AS train
 FROM patchy_orders),
m AS (SELECT quantile_cont(o_totalprice, 0.5) AS price FROM s WHERE train)
SELECT CASE WHEN train THEN 'train' ELSE 'test' END AS part, count(*) AS n, count(DISTINCT o_orderkey) AS keys,
 round(sum(CASE WHEN train THEN coalesce(o_totalprice, price) ELSE o_totalprice END), 4) AS price FROM s, m GROUP BY train""")
def cleansed_export(spark, folder):
    """Repaired training rows and untouched test rows, written as one table in time order and read again."""
    parts = splits.random_split(patchy_orders(spark, folder), "o_orderkey")
    train, test = parts.filter("part = 'train'"), parts.filter("part = 'test'")
    fills = remediate.fill_values(train.select("o_totalprice"))
    path = posixpath.join(shared_folder(spark), f"cleansed-{uuid.uuid4().hex}")
    write_cleansed(fill_missing(train, fills), test, path, "o_orderdate")
    return rounded(spark.read.parquet(path).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.sum("o_totalprice").alias("price")), 4)


@query("model_classifier")
def model_classifier(spark, folder):
    parts = splits.stratified_split(_classes(spark, folder), "doc_id", "quality")
    train, test = parts.filter("part = 'train'"), parts.filter("part = 'test'")
    done = models.fit_predict(train, test, CLASSIFICATION, "quality", ["n_chars", "words"])
    return rounded(models.f1_scores(done))


@query("model_regressor")
def model_regressor(spark, folder):
    parts = splits.random_split(patchy_orders(spark, folder), "o_orderkey", exact=False)
    train, test = parts.filter("part = 'train'"), parts.filter("part = 'test'")
    done = models.fit_predict(train, test, REGRESSION, "o_totalprice", ["o_orderkey", "flag"])
    return rounded(done.agg(F.count(F.lit(1)).alias("n"), models.rmse(F.col("label"), F.col("prediction")).alias("rmse")))


@query("model_forecast")
def model_forecast(spark, folder):
    parts = splits.chronological_split(table(spark, folder, "events"), "ts", "event_id")
    lagged = models.lag_features(parts, "value", "event_id", "ts")
    done = models.fit_predict(lagged.filter("part = 'train'"), lagged.filter("part = 'test'"), TIME_SERIES, "value",
                              ["user_id", "lag1"])
    return rounded(done.agg(F.count(F.lit(1)).alias("n"), models.rmse(F.col("label"), F.col("prediction")).alias("rmse")))


@query("model_ridge", sql="""
WITH r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) <= floor(count(*) OVER () * 0.7::DOUBLE) AS train
 FROM events WHERE ts IS NOT NULL),
a AS (SELECT value, lag(value) OVER (ORDER BY event_id) AS lag1 FROM r WHERE train AND value IS NOT NULL),
m AS (SELECT count(*) * covar_pop(lag1, value) / (count(*) * var_pop(lag1) + 1) AS slope, avg(value) AS y, avg(lag1) AS x
 FROM a WHERE lag1 IS NOT NULL),
l AS (SELECT value AS last FROM r WHERE train AND value IS NOT NULL ORDER BY event_id DESC LIMIT 1),
b AS (SELECT value, coalesce(lag(value) OVER (ORDER BY ts, event_id), last) AS lag1 FROM r, l
 WHERE NOT train AND value IS NOT NULL)
SELECT count(*) AS n, round(sqrt(avg(pow(value - (y + slope * (lag1 - x)), 2))), 6) AS rmse FROM b, m""")
def model_ridge(spark, folder):
    parts = splits.chronological_split(table(spark, folder, "events"), "ts", "event_id")
    done = models.ridge_forecast(parts, "value", "event_id", "ts")
    return rounded(done.agg(F.count(F.lit(1)).alias("n"), models.rmse(F.col("label"), F.col("prediction")).alias("rmse")))


@query("model_kmeans")
def model_kmeans(spark, folder):
    df = table(spark, folder, "embeddings")
    columns = [f"x{i}" for i in range(df.agg(F.max(F.size("embedding"))).first()[0])]
    wide = df.select("vec_id", *[F.col("embedding")[i].alias(c) for i, c in enumerate(columns)])
    clustered = models.cluster_rows(wide, columns, k=3)
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("silhouette", F.round(F.lit(models.silhouette(clustered)), 6))


# Starting centres in (c_acctbal, c_nationkey * 300).
CENTRES = [(0.0, 1000.0), (4000.0, 6000.0), (9000.0, 2000.0)]


def _clusters_sql(rounds: int) -> str:
    """Assigning and means, round by round; then the silhouette of the first 1,000 rows against all."""
    near = "min(struct_pack(d := pow(r.x - c.x, 2) + pow(r.y - c.y, 2), i := c.i)).i"
    text = "WITH r AS (SELECT c_custkey AS k, c_acctbal::DOUBLE AS x, c_nationkey * 300::DOUBLE AS y FROM customer),\n"
    text += "c0 AS (SELECT * FROM (VALUES " + ", ".join(
        f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(CENTRES)) + ") AS v(i, x, y)),\n"
    for n in range(rounds):
        text += f"""a{n} AS (SELECT k, {near} AS i FROM r, c{n} c GROUP BY k),
m{n} AS (SELECT i, avg(x) AS x, avg(y) AS y FROM a{n} JOIN r USING (k) GROUP BY i),
c{n + 1} AS (SELECT c.i, coalesce(m.x, c.x) AS x, coalesce(m.y, c.y) AS y FROM c{n} c LEFT JOIN m{n} m USING (i)),
"""
    return text + f"""l AS (SELECT k, {near} AS i FROM r, c{rounds} c GROUP BY k),
p AS (SELECT k, x, y, i FROM r JOIN l USING (k)), n AS (SELECT i, count(*) AS n FROM p GROUP BY i),
d AS (SELECT q.k, q.i AS own, p.i, sum(sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2))) AS d
 FROM (SELECT * FROM p ORDER BY k LIMIT 1000) q, p GROUP BY ALL),
s AS (SELECT k, own, max(CASE WHEN d.i = own THEN d / greatest(n.n - 1, 1) END) AS a,
 max(CASE WHEN d.i = own THEN n.n END) AS size, min(CASE WHEN d.i <> own THEN d / n.n END) AS b
 FROM d JOIN n USING (i) GROUP BY k, own)
SELECT n.i::INT AS cluster, n.n, (SELECT round(avg(CASE WHEN size > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) FROM s)
 AS silhouette FROM n"""


@query("cluster_silhouette", sql=_clusters_sql(2))
def cluster_silhouette(spark, folder):
    df = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_acctbal").cast("double").alias("x"), (F.col("c_nationkey") * 300.0).alias("y"))
    clustered = models.cluster_from(df, ["x", "y"], CENTRES, rounds=2)
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("silhouette", F.round(F.lit(models.silhouette(clustered, "c_custkey")), 6))


@query("metric_rmse", PATCHY_ORDERS, sql=f"""
WITH s AS (SELECT *, row_number() OVER (ORDER BY {SCATTER}, o_orderkey)
 <= {N_TRAIN.format(n="count(*) OVER ()")} AS train FROM patchy_orders),
m AS (SELECT o_orderstatus, avg(o_totalprice) AS prediction FROM s WHERE train GROUP BY o_orderstatus)
SELECT o_orderstatus, round(sqrt(avg(pow(o_totalprice - prediction, 2))), 4) AS rmse,
 round(sqrt(avg(pow(o_totalprice - prediction, 2))) / stddev_samp(o_totalprice), 6) AS normalised_error
FROM s JOIN m USING (o_orderstatus) WHERE NOT train GROUP BY o_orderstatus""")
def metric_rmse(spark, folder):
    parts = splits.random_split(patchy_orders(spark, folder), "o_orderkey")
    done = models.segment_mean_predictor(parts.filter("part = 'train'"), parts.filter("part = 'test'"), "o_totalprice",
                                         ["o_orderstatus"])
    scored = done.groupBy("o_orderstatus").agg(
        models.rmse(F.col("label"), F.col("prediction")).alias("rmse"), F.stddev_samp("label").alias("s"))
    return scored.select("o_orderstatus", F.round("rmse", 4).alias("rmse"), F.round(
        models.normalised_error(F.col("rmse"), F.col("s")), 6).alias("normalised_error"))


@query("metric_f1", sql="""
WITH p AS (SELECT l_returnflag, l_linestatus AS l, CASE WHEN l_quantity > 25 THEN 'F' ELSE 'O' END AS p FROM lineitem),
k AS (SELECT l_returnflag, c, count(*) FILTER (WHERE l = c) AS s, count(*) FILTER (WHERE p = c) AS q,
 count(*) FILTER (WHERE l = c AND p = c) AS h FROM p, (VALUES ('F'), ('O')) t(c) GROUP BY l_returnflag, c)
SELECT l_returnflag, count(*) AS classes, round(avg(2.0 * h / (s + q))::DOUBLE, 6) AS macro_f1,
 round((sum(2.0::DOUBLE * h / (s + q) * s) / sum(s))::DOUBLE, 6) AS weighted_f1
FROM k WHERE s + q > 0 GROUP BY l_returnflag""")
def metric_f1(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("p", F.when(F.col("l_quantity") > 25, "F").otherwise("O"))
    return rounded(models.f1_scores(rows, "l_linestatus", "p", ["l_returnflag"]))


@query("target_spread", sql="""
SELECT event_type, round(coalesce(stddev_samp(value), 10), 6) AS target_spread FROM events GROUP BY event_type""")
def target_spread(spark, folder):
    return rounded(models.target_spread(table(spark, folder, "events"), "value", ["event_type"]))


RUNS = """runs AS (SELECT c_nationkey, CASE WHEN c_nationkey % 3 = 0 THEN 'F1' ELSE 'RMSE' END AS metric_name,
 round(avg(c_acctbal) / 1e3, 4) AS metric_before,
 round(avg(CASE WHEN c_nationkey % 5 = 0 THEN c_acctbal WHEN c_nationkey % 2 = 0 THEN c_acctbal * 0.9::DOUBLE
  ELSE c_acctbal * 1.1::DOUBLE END) / 1e3, 4) AS metric_after,
 60.0::DOUBLE AS fitness_before, 60 + count(*) % 11::DOUBLE AS fitness_after,
 CASE WHEN count(*) % 7 = 0 THEN 'RED' ELSE 'GREEN' END AS train_tier,
 CASE WHEN count(*) % 4 = 0 THEN 'RED' ELSE 'YELLOW' END AS test_tier FROM customer GROUP BY c_nationkey)"""


def runs(spark, folder):
    key, count = F.col("c_nationkey"), F.count(F.lit(1))
    after = F.when(key % 5 == 0, F.col("c_acctbal")).when(key % 2 == 0, F.col("c_acctbal") * 0.9).otherwise(
        F.col("c_acctbal") * 1.1)
    rows = table(spark, folder, "customer").withColumn("after", after)
    return rows.groupBy("c_nationkey").agg(
        F.round(F.avg("c_acctbal") / 1e3, 4).alias("metric_before"), F.round(F.avg("after") / 1e3, 4).alias("metric_after"),
        (60 + (count % 11)).cast("double").alias("fitness_after"),
        F.when(count % 7 == 0, "RED").otherwise("GREEN").alias("train_tier"),
        F.when(count % 4 == 0, "RED").otherwise("YELLOW").alias("test_tier"),
    ).withColumns({
        "metric_name": F.when(key % 3 == 0, "F1").otherwise("RMSE"), "fitness_before": F.lit(60.0)})


@query("decision", RUNS, sql="""
WITH g AS (SELECT *, CASE WHEN metric_name = 'RMSE' THEN metric_before - metric_after
 ELSE metric_after - metric_before END AS gain FROM runs)
SELECT c_nationkey, metric_name, metric_before, metric_after, CASE WHEN train_tier = 'RED' THEN 'BLOCKED'
 WHEN test_tier = 'RED' AND gain <= 1e-4 THEN 'BLOCKED' WHEN gain < -1e-4 THEN 'REGRESSED'
 WHEN gain > 1e-4 AND test_tier = 'RED' THEN 'REVIEW_REQUIRED' WHEN gain > 1e-4 THEN 'ACCEPTED'
 WHEN fitness_after - fitness_before > 5 THEN 'ACCEPTED' ELSE 'NO_IMPROVEMENT' END AS decision FROM g""")
def decision(spark, folder):
    return compare.with_decision(runs(spark, folder)).select(
        "c_nationkey", "metric_name", "metric_before", "metric_after", "decision")


@query("metric_change", RUNS, sql="""
WITH g AS (SELECT *, round((metric_after - metric_before) / metric_before * 100, 2) AS change FROM runs),
h AS (SELECT *, CASE WHEN metric_name = 'RMSE' THEN -change ELSE change END AS better FROM g)
SELECT c_nationkey, change AS metric_change_pct, CASE WHEN better = 0 THEN 0 ELSE better END AS metric_improvement_pct,
 CASE WHEN better > 0 THEN 'improved' WHEN better < 0 THEN 'deteriorated' ELSE 'neutral' END AS performance,
 round(fitness_after - fitness_before, 1) AS fitness_gain FROM h""")
def metric_change(spark, folder):
    return compare.with_change(runs(spark, folder)).select(
        "c_nationkey", "metric_change_pct", "metric_improvement_pct", "performance", "fitness_gain")


@query("combined_fitness", RUNS, sql="""
SELECT c_nationkey, round(0.7::DOUBLE * fitness_after + 0.3::DOUBLE * fitness_before, 1) AS partition_fitness,
 CASE WHEN test_tier = 'RED' AND train_tier <> 'RED'
  THEN round(0.7::DOUBLE * fitness_after + 0.3::DOUBLE * fitness_before, 1) ELSE 0.0 END::DOUBLE AS fitness_after,
 CASE WHEN test_tier = 'RED' AND train_tier <> 'RED' THEN 'YELLOW' ELSE test_tier END AS tier_after FROM runs""")
def combined_fitness(spark, folder):
    rows = runs(spark, folder).select(
        "c_nationkey", "train_tier", F.col("test_tier").alias("full_tier"), F.lit(70).alias("train_rows"),
        F.lit(30).alias("test_rows"), F.col("fitness_after").alias("train_fitness"),
        F.col("fitness_before").alias("test_fitness"), F.lit(0.0).alias("full_fitness"))
    return compare.combined_fitness(rows).select("c_nationkey", "partition_fitness", "fitness_after", "tier_after")


@query("gain_comparison", RUNS, sql="""
SELECT c_nationkey, round(fitness_after - fitness_before, 1) AS fitness_gain, metric_before AS predicted_gain,
 round(abs(metric_before - round(fitness_after - fitness_before, 1)), 2) AS gain_gap,
 abs(metric_before - round(fitness_after - fitness_before, 1)) <= 10 AS within_10_points FROM runs""")
def gain_comparison(spark, folder):
    rows = compare.with_change(runs(spark, folder)).withColumn("predicted_gain", F.col("metric_before"))
    return compare.gain_comparison(rows).select(
        "c_nationkey", "fitness_gain", "predicted_gain", "gain_gap", "within_10_points")


@query("error_ratio", PATCHY_ORDERS, sql="""
SELECT o_orderstatus, round(stddev_samp(o_totalprice) / greatest(1e-5, avg(o_totalprice)), 6) AS error_ratio
FROM patchy_orders GROUP BY o_orderstatus""")
def error_ratio(spark, folder):
    rows = patchy_orders(spark, folder).groupBy("o_orderstatus").agg(
        F.stddev_samp("o_totalprice").alias("s"), F.avg("o_totalprice").alias("m"))
    return rounded(rows.select("o_orderstatus", models.error_ratio(F.col("s"), F.col("m")).alias("error_ratio")))


@query("before_after")
def before_after(spark, folder):
    df = patchy_orders(spark, folder).select("o_orderkey", "o_totalprice", "flag", "o_orderstatus")
    loop = remediate_and_validate(df, CLASSIFICATION, "flag", "o_orderkey", actions=[
        "winsorize_outliers", "impute_median"])
    return rounded(loop.result)


@query("fraction_sweep")
def sweep(spark, folder):
    df = events(spark, folder).select("event_id", "user_id", "value", "ts")
    return rounded(fraction_sweep(df, "value", "ts", "event_id", anomaly="pinned"))


@query("sweep_parts", DIRTY_EVENTS, sql="""
WITH s AS (SELECT * FROM (VALUES (0, 0.5::DOUBLE), (1, 0.6::DOUBLE), (2, 0.7::DOUBLE), (3, 0.8::DOUBLE), (4, 0.85::DOUBLE)) v(i, share)),
r AS (SELECT ts, value, event_id, row_number() OVER (ORDER BY event_id) AS k, count(*) OVER () AS n FROM dirty_events),
p AS (SELECT i, share, ts, value, event_id, k <= floor(n * share) AS train FROM r, s),
t AS (SELECT i, ts, arg_min(value, event_id) AS value FROM p WHERE train GROUP BY i, ts)
SELECT i::INT AS share, 'train' AS part, count(*) AS rows, round(sum(value), 4) AS total FROM t GROUP BY i
UNION ALL SELECT i, 'test', count(*), round(sum(value), 4) FROM p WHERE NOT train GROUP BY i""")
def sweep_parts(spark, folder):
    """The parts of the share sweep after its one repair."""
    parts = sweep_split(events(spark, folder), (0.5, 0.6, 0.7, 0.8, 0.85), "event_id")
    train = remediate.sort_timestamps(parts.filter("part = 'train'"), "ts", "event_id", [SWEEP])
    done = train.unionByName(parts.filter("part = 'test'"))
    return rounded(done.groupBy(F.col(SWEEP).alias("share"), "part").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total")), 4)


# ---------------------------------------------------------------- audit

HASHED = """WITH b AS (SELECT {key} AS id, (((xor({key}, {key} >> 31) % 2147483648) * 2654435761) % 2147483647)
  % greatest(1, ceil((SELECT count(*) FROM {table}) / 4096.0)::BIGINT) AS bucket FROM {table}),
l AS (SELECT bucket, sha256(string_agg(id::VARCHAR, ',' ORDER BY id)) AS digest, count(*) AS c FROM b GROUP BY bucket)
SELECT sum(c)::BIGINT AS ids, sha256(string_agg(digest, ',' ORDER BY bucket)) AS digest FROM l"""


@query("id_set_hash", sql=HASHED.format(key="o_orderkey", table="orders"))
def id_set_hash(spark, folder):
    return audit.id_set_hash(table(spark, folder, "orders"), "o_orderkey")


@query("content_hash", sql="""
WITH r AS (SELECT sha256(length(o_orderkey::VARCHAR) || '=' || o_orderkey || '|' || length(o_custkey::VARCHAR) || '='
 || o_custkey || '|' || length(o_orderstatus) || '=' || o_orderstatus || '|' || length(o_orderpriority) || '='
 || o_orderpriority) AS row FROM orders),
c AS (SELECT row, count(*) AS c FROM r GROUP BY row),
b AS (SELECT row || ':' || c AS e, c, ('0x' || substr(row, 1, 12))::BIGINT
 % greatest(1, ceil((SELECT count(*) FROM orders) / 4096.0)::BIGINT) AS bucket FROM c),
l AS (SELECT bucket, sha256(string_agg(e, ',' ORDER BY e)) AS digest, sum(c) AS c FROM b GROUP BY bucket)
SELECT sum(c)::BIGINT AS rows, sha256(string_agg(digest, ',' ORDER BY bucket)) AS digest FROM l""")
def content_hash(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return audit.content_hash(df)


@query("double_run_diff", PATCHY_ORDERS, sql="""
SELECT count(*) FILTER (WHERE o.o_orderkey % 50 <> 1) AS paired, count(*) FILTER (WHERE o.o_orderkey % 50 = 1) AS only_first,
 0::BIGINT AS only_second, count(*) FILTER (WHERE o.o_orderkey % 50 <> 1 AND (
  o.o_totalprice IS DISTINCT FROM p.o_totalprice OR o.o_orderpriority IS DISTINCT FROM p.o_orderpriority)) AS mismatches
FROM orders o JOIN patchy_orders p USING (o_orderkey)""")
def double_run_diff(spark, folder):
    second = patchy_orders(spark, folder).filter("o_orderkey % 50 <> 1")
    done = audit.compare_runs(table(spark, folder, "orders"), second, ["o_orderkey"], ["o_totalprice", "o_orderpriority"])
    return done.select("paired", "only_first", "only_second", "mismatches")


@query("split_receipt", sql=f"""
WITH s AS (SELECT o_orderkey AS id, CASE WHEN row_number() OVER (ORDER BY {SCATTER}, o_orderkey)
 <= {N_TRAIN.format(n="count(*) OVER ()")} THEN 'train' ELSE 'test' END AS part FROM orders),
b AS (SELECT part, id, (((xor(id, id >> 31) % 2147483648) * 2654435761) % 2147483647)
  % greatest(1, ceil((SELECT count(*) FROM orders) / 4096.0)::BIGINT) AS bucket FROM s),
l AS (SELECT part, bucket, sha256(string_agg(id::VARCHAR, ',' ORDER BY id)) AS digest, count(*) AS c FROM b
 GROUP BY part, bucket)
SELECT part, sum(c)::BIGINT AS rows, sha256(string_agg(digest, ',' ORDER BY bucket)) AS key_hash,
 'o_custkey,o_totalprice' AS features, 'o_orderstatus' AS target, 'random' AS split, '0.7' AS train_share,
 'sort_timestamps,impute_median' AS log, 61.5::DOUBLE AS fitness_after FROM l GROUP BY part""")
def split_receipt(spark, folder):
    parts = splits.random_split(table(spark, folder, "orders"), "o_orderkey")
    found = audit.split_receipt(parts, "o_orderkey", ["o_custkey", "o_totalprice"], "o_orderstatus",
                                {"split": "random", "train_share": 0.7}, ["sort_timestamps", "impute_median"],
                                {"fitness_after": 61.5})
    return found.select(
        "part", "rows", "key_hash", "features", "target", F.col("parameters")["split"].alias("split"),
        F.col("parameters")["train_share"].alias("train_share"), F.concat_ws(",", "log").alias("log"),
        F.col("metrics")["fitness_after"].alias("fitness_after"))


@query("model_ready_rows", PATCHY_ORDERS, sql="""
SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice IS NOT NULL) AS labelled, count(*) AS n
FROM patchy_orders GROUP BY o_orderstatus""")
def model_ready_rows(spark, folder):
    rows = patchy_orders(spark, folder)
    labelled, _ = remediate.repair(rows, ["drop_unlabelled_target"], REGRESSION, "o_totalprice")
    sizes = [d.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias(n)) for d, n in ((rows, "n"), (labelled, "labelled"))]
    return sizes[0].join(sizes[1], "o_orderstatus", "left").withColumn("labelled", F.coalesce("labelled", F.lit(0)))
