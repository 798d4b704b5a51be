"""Reference models on Spark ML, their features, and their metrics as aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefit.functions.frames import join_on, materialize
from tablefit.functions.lookups import CLASSIFICATION, CLUSTERING, REGRESSION, TIME_SERIES
from tablefit.functions.stats import as_number, dtype_of, infinite, is_numeric, missing, total
from tablefit.operators.columns import drop_incomplete, lenient_timestamp, shared_features
from tablefit.operators.order import with_previous
from tablefit.operators.select import medians

TREES, DEPTH = 40, 6
# Rows that one task trains a forest on.
ROWS_PER_FIT = 25_000
# Rows whose silhouette is taken, and rows that a task compares with them at a time.
SILHOUETTE_ROWS, ROWS_PER_TILE = 1000, 512


def train_filled(train: DataFrame, test: DataFrame, columns: Sequence[str], exact: bool = True):
    """Both parts with gaps filled by the training medians; infinite cells count as gaps."""
    train, test = (
        d.withColumns({c: F.when(~infinite(d, c), as_number(d, c)) for c in columns}) for d in (train, test))
    # A column that is complete in training may have gaps in the test part.
    gaps = [d.agg(*[F.max(F.col(c).isNull()).alias(c) for c in columns]).first() for d in (train, test) if columns]
    gappy = [c for c in columns if any(row[c] for row in gaps)]
    fills = medians(train.select(*gappy), gappy, exact=exact).first() if gappy else {}
    filled = {c: F.coalesce(F.col(c), F.lit(float(fills[c] or 0.0))) for c in gappy}
    return train.withColumns(filled), test.withColumns(filled)


def lag_features(parts: DataFrame, target: str, row_order: str, time: str | None = None, compat: bool = True,
                 **options) -> DataFrame:
    """Add ``lag1``: the previous target, in arrival order for train and time order for test.

    The first test row takes the last training target. In ``compat`` mode the
    first training row keeps its own target as lag, otherwise it is dropped.
    """
    rows = parts.filter(~missing(parts, target)).withColumn("__y", as_number(parts, target))
    train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    last = train.agg(F.max_by("__y", row_order).alias("__last"))
    train = with_previous(train, ["__y"], [row_order], **options)
    own = F.col("__y") if compat else F.lit(None).cast("double")
    train = train.withColumn("lag1", F.coalesce("prev___y", own))
    if not compat:
        train = train.filter("lag1 is not null")
    if time:
        test = test.withColumn("__at", lenient_timestamp(test, time)).filter("__at is not null")
        test = with_previous(test, ["__y"], ["__at", row_order], **options).drop("__at")
    else:
        test = with_previous(test, ["__y"], [row_order], **options)
    test = test.crossJoin(F.broadcast(last)).withColumn("lag1", F.coalesce("prev___y", "__last")).drop("__last")
    return train.unionByName(test).drop("__y", "prev___y")


def _assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="__features", handleInvalid="skip").transform(df)


def spread(df: DataFrame) -> DataFrame:
    """Rows in tasks of about ``ROWS_PER_FIT``: a forest passes over them level by level, in as many tasks as they come."""
    tasks = math.ceil(df.count() / ROWS_PER_FIT)
    return df.repartition(tasks) if tasks > 1 else df


def fit_predict(train: DataFrame, test: DataFrame, task: str, target: str, features: Sequence[str] | None = None,
                trees: int = TREES, depth: int = DEPTH, seed: int = 42) -> DataFrame:
    """Test rows with ``label`` and ``prediction`` of the task's reference forest."""
    features = list(features or shared_features(train, test, target))
    train, test = train_filled(train, test, features)
    if task == CLASSIFICATION:
        indexer = StringIndexer(inputCol="__class", outputCol="label", handleInvalid="keep").fit(
            train.select(F.col(target).cast("string").alias("__class")).filter("__class is not null"))
        train = indexer.transform(train.withColumn("__class", F.col(target).cast("string"))
                                  .filter("__class is not null"))
        test = indexer.transform(test.withColumn("__class", F.col(target).cast("string"))
                                 .filter("__class is not null"))
        model = RandomForestClassifier(labelCol="label", featuresCol="__features", numTrees=trees, maxDepth=depth,
                                       seed=seed)
    else:
        train, test = (d.withColumn("label", as_number(d, target)).filter("label is not null") for d in (train, test))
        model = RandomForestRegressor(labelCol="label", featuresCol="__features", numTrees=trees, maxDepth=depth,
                                      seed=seed)
    fitted = model.fit(_assemble(spread(train.select("label", *features)), features))
    return fitted.transform(_assemble(test, features)).drop(
        "__features", "__class", "rawPrediction", "probability")


def ridge_forecast(parts: DataFrame, target: str, row_order: str, time: str | None = None,
                   alpha: float = 1.0) -> DataFrame:
    """Test rows predicted by a ridge regression on the previous value alone.

    Minimises the squared errors plus ``alpha`` times the squared slope; the penalty of Spark ML is scaled by the spread
    of the label, so the one slope is taken from sums. Without training rows the prediction is NULL.
    """
    rows = lag_features(parts, target, row_order, time, compat=False).withColumn("label", as_number(parts, target))
    test = rows.filter("part = 'test' AND lag1 IS NOT NULL")
    n, x, y = F.count(F.lit(1)), F.avg("lag1"), F.avg("label")
    slope = n * F.covar_pop("lag1", "label") / (n * F.var_pop("lag1") + F.lit(alpha))
    line = rows.filter("part = 'train'").agg(slope.alias("__slope"), (y - slope * x).alias("__start"))
    predicted = F.col("__start") + F.col("__slope") * F.col("lag1")
    return test.crossJoin(F.broadcast(line)).withColumn("prediction", predicted).drop("__slope", "__start")


def cluster_rows(df: DataFrame, columns: Sequence[str], k: int | None = None, seed: int = 42) -> DataFrame:
    """k-means over all complete rows; adds ``cluster``."""
    rows = _assemble(drop_incomplete(df, columns).withColumns({c: as_number(df, c) for c in columns}), columns)
    k = k or min(3, max(2, rows.count() // 5))
    model = KMeans(k=k, seed=seed, featuresCol="__features", predictionCol="cluster").fit(rows)
    return model.transform(rows)


def cluster_from(df: DataFrame, columns: Sequence[str], centres: Sequence[Sequence[float]], rounds: int = 2) -> DataFrame:
    """Clusters over all complete rows from given starting centres: ``rounds`` of assigning (the first on ties) and
    means, then a last assignment. An empty cluster keeps its centre."""
    rows = drop_incomplete(df, columns).withColumns({c: as_number(df, c) for c in columns})

    def assigned() -> DataFrame:
        far = [F.struct(total([F.pow(F.col(c) - F.lit(float(x)), 2) for c, x in zip(columns, centre)]).alias("d"),
                        F.lit(i).alias("i")) for i, centre in enumerate(centres)]
        return rows.withColumn("cluster", F.array_min(F.array(*far))["i"])

    for _ in range(rounds):
        means = {r["cluster"]: [r[c] for c in columns] for r in assigned().groupBy("cluster").agg(
            *[F.avg(c).alias(c) for c in columns]).collect()}
        centres = [means.get(i, centre) for i, centre in enumerate(centres)]
    return _assemble(assigned(), columns)


def silhouette(clustered: DataFrame, order: str | None = None, rows: int = SILHOUETTE_ROWS) -> float | None:
    """Mean silhouette by Euclidean distance of ``rows`` rows (all, if there are fewer) to all rows.

    The rows are the first ones in ``order``, or else by a hash of their features. They are the only ones that travel;
    each task adds up the distances of its rows to them, tile by tile, and sends one sum for each of them and cluster.
    """
    cells = clustered.select(F.col("cluster").cast("int").alias("cluster"), vector_to_array("__features").alias("x"),
                             *([F.col(order).alias("__order")] if order else []))
    place = [F.col("__order")] if order else [F.xxhash64("x"), F.col("x")]
    picked = cells.orderBy(*place).limit(rows).select("cluster", "x").toArrow()
    sizes = {r["cluster"]: r["count"] for r in cells.groupBy("cluster").count().collect()}
    if len(sizes) < 2:
        return None
    own = picked.column("cluster").to_numpy()
    points = np.array(picked.column("x").to_pylist(), float)
    shared = clustered.sparkSession.sparkContext.broadcast(points)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = {}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cluster = batch.column("cluster").to_numpy()
            for a in range(0, len(x), ROWS_PER_TILE):
                square = np.zeros((len(points), len(x[a:a + ROWS_PER_TILE])))
                for j in range(x.shape[1]):
                    square += (shared.value[:, j, None] - x[None, a:a + ROWS_PER_TILE, j]) ** 2
                distance = np.sqrt(square)
                for c in np.unique(cluster[a:a + ROWS_PER_TILE]).tolist():
                    mine = distance[:, cluster[a:a + ROWS_PER_TILE] == c].sum(axis=1)
                    added[c] = added[c] + mine if c in added else mine
        for c, value in added.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value))), pa.array([c] * len(value), pa.int32()),
                                              pa.array(value)], names=["point", "cluster", "distance"])

    found = cells.select("cluster", "x").mapInArrow(sums, "point long, cluster int, distance double")
    found = found.groupBy("point", "cluster").agg(F.sum("distance").alias("distance")).toArrow()
    names = sorted(sizes)
    sum_of = np.zeros((len(points), len(names)))
    sum_of[found.column("point").to_numpy(), np.searchsorted(names, found.column("cluster").to_numpy())] = found.column(
        "distance").to_numpy()
    size = np.array([sizes[c] for c in names], float)
    at, line = np.searchsorted(names, own), np.arange(len(points))
    inside = sum_of[line, at] / np.maximum(size[at] - 1, 1)
    others = sum_of / size
    others[line, at] = np.inf
    outside = others.min(axis=1)
    widest = np.maximum(np.maximum(inside, outside), np.finfo(float).tiny)
    # A row that is alone in its cluster has 0.
    return float(np.where(size[at] > 1, (outside - inside) / widest, 0.0).mean())


def squared_silhouette(clustered: DataFrame) -> float:
    """Silhouette by squared Euclidean distance of all rows (one pass over cluster sums)."""
    evaluator = ClusteringEvaluator(featuresCol="__features", predictionCol="cluster")
    return float(evaluator.evaluate(clustered))


# ---------------------------------------------------------------- metrics


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg(F.pow(actual - predicted, 2)))


def f1_scores(predictions: DataFrame, label: str = "label", prediction: str = "prediction",
              by: Sequence[str] = ()) -> DataFrame:
    """Macro and support-weighted F1 from confusion counts."""
    by = list(by)
    counts = predictions.groupBy(*by, F.col(label).alias("l"), F.col(prediction).alias("p")).agg(
        F.count(F.lit(1)).alias("c"))
    sides = F.array(
        F.struct(F.col("l").alias("class"), F.col("c").alias("support"), F.lit(0).cast("long").alias("claimed"),
                 F.when(F.col("l") == F.col("p"), F.col("c")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("c").alias("claimed"),
                 F.lit(0).cast("long").alias("hit")),
    )
    classes = counts.select(*by, F.inline(sides)).groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hit").alias("hit"))
    f1 = 2.0 * F.col("hit") / (F.col("support") + F.col("claimed"))
    return classes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("classes"), F.avg(f1).alias("macro_f1"),
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )


def target_spread(df: DataFrame, target: str, by: Sequence[str] = (), fallback: float = 10.0) -> DataFrame:
    """Sample deviation of the target; the fallback where it is undefined or zero."""
    std = F.stddev_samp(as_number(df, target))
    return df.groupBy(*by).agg(F.when(std > 0, std).otherwise(fallback).alias("target_spread"))


def normalised_error(error: Column, spread: Column) -> Column:
    return error / spread


def utility(error: Column, spread: Column) -> Column:
    return -normalised_error(error, spread)


def error_ratio(observed: Column, predicted: Column) -> Column:
    return F.when(predicted.isNotNull(), observed / F.greatest(F.lit(1e-5), predicted))


def observed_metric(parts: DataFrame, task: str, target: str | None, time: str | None = None,
                    row_order: str | None = None, without: Sequence[str] = ()) -> float | None:
    """Metric of the reference model on the test part, or None where it cannot be trained."""
    train, test = parts.filter("part = 'train'"), parts.filter("part = 'test'")
    if task == CLUSTERING:
        columns = [c for c in shared_features(train, test, None) if c not in without]
        return silhouette(cluster_rows(parts, columns)) if len(columns) >= 2 else None
    if target not in train.columns or target not in test.columns:
        return None
    features = [c for c in shared_features(train, test, target) if c not in without]
    if task == CLASSIFICATION:
        classes = train.filter(~missing(train, target)).select(target).distinct().limit(2).count()
        if not features or classes == 0:
            return None
        if classes == 1:
            return 0.0
        return f1_scores(fit_predict(train, test, task, target, features)).first()["weighted_f1"]
    if not is_numeric(dtype_of(train, target)):
        return None
    if task == TIME_SERIES:
        given = parts.filter(~missing(parts, target)).groupBy("part").count()
        sizes = {r["part"]: r["count"] for r in given.collect()}
        if sizes.get("train", 0) < 10 or sizes.get("test", 0) < 2:
            return None
        features = [*features, "lag1"]
        # The forest reads its rows several times, but not the windows behind them.
        lagged = materialize(lag_features(parts, target, row_order, time).select("part", target, *features), "lagged",
                             ["part"])
        train, test = lagged.filter("part = 'train'"), lagged.filter("part = 'test'")
    elif task != REGRESSION or not features:
        return None
    predictions = fit_predict(train, test, task, target, features)
    return predictions.agg(rmse(F.col("label"), F.col("prediction")).alias("m")).first()["m"]


def segment_mean_predictor(train: DataFrame, test: DataFrame, target: str, by: Sequence[str]) -> DataFrame:
    """Predict the training mean of the row's segment: a baseline any engine reproduces."""
    means = train.groupBy(*by).agg(F.avg(as_number(train, target)).alias("prediction"))
    return join_on(test.withColumn("label", as_number(test, target)), means, by)
