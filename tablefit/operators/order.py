"""Row order as data: previous values and differences without a one-task window.

The order key is cut into ranges of bounded size; each range is windowed on
its own, and its first rows take the last value of the ranges before it from
an edge table of one row per segment and range. Where one sketch would have to
tell too many ranges apart, ranges of ranges are cut first and each of them is
cut again, so no range grows with the table: the driver holds one number for
each range (16 MB for 10^12 rows).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablefit.functions.frames import ROWS_PER_TASK, join_on, segment_sizes
from tablefit.functions.stats import missing
from tablefit.operators.select import sortable, with_tile

ROWS_PER_RANGE = 500_000
# Ranges that one sketch tells apart.
FANOUT = 2_000
SAMPLE_PER_RANGE = 200
EXACT_DOUBLE = 2.0**53


def with_file_order(df: DataFrame, name: str = "row_order") -> DataFrame:
    """Arrival key of a file-based table: files in path order, rows in file order."""
    files = sorted(df.inputFiles())
    places = df.sparkSession.createDataFrame(
        [(path.rsplit("/", 1)[-1], i) for i, path in enumerate(files)], "__file string, __place long"
    )
    rows = df.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    rows = rows.join(places, "__file")
    return rows.withColumn(name, F.col("__place") * F.lit(1 << 40) + F.col("__row")).drop("__file", "__place", "__row")


def _splits(df: DataFrame, key: Column, rows: int, ranges: int) -> tuple[list[float], list[float]]:
    """Range ends from a sample, and the values so frequent that they fill whole ranges."""
    share = min(1.0, SAMPLE_PER_RANGE * ranges / rows)
    sample = df.select(key.cast("double").alias("k"))
    if share < 1.0:
        sample = sample.sample(fraction=share, seed=7)
    outer, inner = math.ceil(ranges / FANOUT), min(ranges, FANOUT)
    wide = _splits(df, key, rows, outer)[0] if outer > 1 else []
    parts = _bucket(sample, F.col("k"), wide, "__outer") if wide else sample.withColumn("__outer", F.lit(0))
    probs = [i / inner for i in range(1, inner)]
    found = parts.groupBy("__outer").agg(F.approx_percentile("k", probs, 20 * inner).alias("q")).collect()
    ends = [v for r in found for v in r["q"] or [] if math.isfinite(v)]
    hot = [v for v, times in Counter(ends).items() if times > 1 and abs(v) < EXACT_DOUBLE]
    return sorted({*wide, *ends, *(math.nextafter(v, math.inf) for v in hot)}), hot


def _bucket(df: DataFrame, key: Column, ends: list[float], name: str) -> DataFrame:
    keyed = df.withColumn("__key", key.cast("double"))
    bucketizer = Bucketizer(splits=[-math.inf, *ends, math.inf], inputCol="__key", outputCol=name,
                            handleInvalid="keep")
    return bucketizer.transform(keyed).drop("__key")


def with_range(df: DataFrame, keys: Sequence[str], rows_per_range: int = ROWS_PER_RANGE,
               rows: int | None = None) -> DataFrame:
    """Add ``__range``: ascending with the order keys, and of bounded size.

    Keys are one unique column, or a column plus a unique tie-break. A value of
    the first key that fills whole ranges gets its own range, split further by
    the tie-break. ``rows`` is an upper bound of the row count, where known.
    """
    rows = df.count() if rows is None else rows
    ranges = math.ceil(rows / rows_per_range)
    if ranges <= 1:
        return df.withColumn("__range", F.lit(0).cast("long"))
    first = sortable(df, keys[0])
    ends, hot = _splits(df, first, rows, ranges)
    marked = _bucket(df, first, ends, "__r1")
    if not hot or len(keys) < 2:
        return marked.withColumn("__range", F.col("__r1").cast("long")).drop("__r1")
    second = sortable(df, keys[1])
    tie_ends, _ = _splits(df, second, rows, ranges)
    marked = _bucket(marked, second, tie_ends, "__r2")
    tied = F.when(first.cast("double").isin(hot), F.col("__r2")).otherwise(0)
    width = len(tie_ends) + 2
    return marked.withColumn("__range", (F.col("__r1") * width + tied).cast("long")).drop("__r1", "__r2")


def _last_given(ranged: DataFrame, given: dict[str, Column], spot: list[str], keys: list[str]) -> DataFrame:
    """``__last_<value>``: the given value with the greatest keys, by aggregates over plain numbers alone.

    Of two keys, the greatest first one is found first; only its rows compete by the second.
    """
    place = {k: sortable(ranged, k) for k in keys}
    if len(keys) == 2:
        firsts = ranged.groupBy(*spot).agg(*[F.max(F.when(x.isNotNull(), place[keys[0]])).alias(f"__first_{v}")
                                             for v, x in given.items()])
        tied = join_on(ranged, firsts, spot)
        best = {v: F.when(x.isNotNull() & (place[keys[0]] == F.col(f"__first_{v}")), place[keys[1]])
                for v, x in given.items()}
    else:
        tied, best = ranged, {v: F.when(x.isNotNull(), place[keys[0]]) for v, x in given.items()}
    return tied.groupBy(*spot).agg(*[F.max_by(v, best[v]).alias(f"__last_{v}") for v in given])


def with_previous(df: DataFrame, values: Sequence[str], keys: Sequence[str], by: Sequence[str] = (),
                  rows_per_range: int = ROWS_PER_RANGE, rows: int | None = None) -> DataFrame:
    """Add ``prev_<value>``: the last given value of an earlier row in key order."""
    by, keys, values = list(by), list(keys), list(values)
    ranged = with_range(df, keys, rows_per_range, rows)
    given = {v: F.when(~missing(df, v), F.col(v)) for v in values}
    edges = _last_given(ranged, given, [*by, "__range"], keys)
    before = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    edges = edges.select(
        *by, "__range", *[F.last(f"__last_{v}", ignorenulls=True).over(before).alias(f"__edge_{v}") for v in values]
    )
    inside = W.partitionBy(*by, "__range").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    looked = ranged.withColumns({f"prev_{v}": F.last(given[v], ignorenulls=True).over(inside) for v in values})
    looked = join_on(looked, edges, [*by, "__range"])
    return looked.withColumns(
        {f"prev_{v}": F.coalesce(f"prev_{v}", f"__edge_{v}") for v in values}
    ).drop("__range", *[f"__edge_{v}" for v in values])


def slice_rows(df: DataFrame, start: int, stop: int, row_order: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows [start, stop) of each segment in arrival order."""
    cuts = [lambda n: F.least(F.lit(start), n), lambda n: F.least(F.lit(stop), n)]
    return with_tile(df, [row_order], cuts, by, "__slice").filter("__slice = 1").drop("__slice")


def with_chunk(df: DataFrame, chunks: int, keys: Sequence[str], by: Sequence[str] = (),
               name: str = "chunk", **options) -> DataFrame:
    """Contiguous chunks 1..k of nearly equal size, larger ones first."""

    def cut(i: int):
        return lambda n: F.floor(n / chunks) * i + F.least(n % chunks, F.lit(i))

    tiled = with_tile(df, keys, [cut(i) for i in range(1, chunks)], by, name, **options)
    return tiled.withColumn(name, F.col(name) + 1)


def first_rows(df: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """The first k rows in key order (a top-k, kept small in every task)."""
    return df.orderBy(*keys).limit(k)


def with_average_rank(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank",
                      rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Ascending rank of a number within its segment, ties sharing their mean rank."""
    by = list(by)
    distinct = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    segments, largest = segment_sizes(distinct, by)
    if largest <= rows_per_task:
        below = F.sum("__c").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
        ranked = distinct.withColumn(name, below - F.col("__c") + (F.col("__c") + 1) / 2)
    else:
        ranged = with_range(distinct, [value])
        inside = W.partitionBy(*by, "__range").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
        before = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
        starts = ranged.groupBy(*by, "__range").agg(F.sum("__c").alias("__s")).withColumn(
            "__start", F.coalesce(F.sum("__s").over(before), F.lit(0))
        ).drop("__s")
        rows = join_on(ranged.withColumn("__upto", F.sum("__c").over(inside)), starts, [*by, "__range"])
        ranked = rows.withColumn(name, F.col("__start") + F.col("__upto") - F.col("__c") + (F.col("__c") + 1) / 2)
    return join_on(df, ranked.select(*by, value, name), [*by, value])
