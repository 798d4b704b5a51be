"""Exact order statistics without sorting the table.

A rank is narrowed down through histograms: one scan counts the cells per bin,
the bin that holds the rank becomes the next range, until a single value is
left. Bins follow the bits of the numbers, so the number of scans is bounded
whatever the spread of the data. Each scan is a map-side combined aggregate of
at most 4,400 rows per range, so neither a task nor the driver ever holds a
group. Groups that are known to be small take Spark's own ``percentile`` or
``row_number``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablefit.functions.frames import (
    ROWS_PER_TASK,
    ROWS_TO_BROADCAST,
    join_on,
    map_rows,
    materialize,
    rows_per_segment,
    segment_sizes,
)
from tablefit.functions.stats import INFINITIES, as_number, dtype_of, is_float, is_numeric, is_temporal

# Bits that one scan takes off a range, and a number above the powers of two of all doubles.
BITS = 12
POWERS = 1100


def sortable(df: DataFrame, column: str) -> Column:
    """The column as a number with the same order (times as microseconds)."""
    dtype = dtype_of(df, column)
    if is_temporal(dtype):
        return F.unix_micros(F.col(column).cast("timestamp"))
    if is_float(dtype):
        return as_number(df, column)
    if is_numeric(dtype):
        return F.col(column).cast("double" if dtype.typeName() == "decimal" else "long")
    raise TypeError(f"order key {column!r} must be a number or a time")


def _bin(value: Column, low: Column, high: Column, floating: bool) -> Column:
    """Bin of a value within its range, in the order of the values. The first range is open: NULL to NULL.

    Fractions: bins of powers of two first, then equal parts of a range that spans a factor of four at most. Whole
    numbers: the highest bits in which the range's ends differ.
    """
    if not floating:
        differ = F.coalesce(F.length(F.bin(low.bitwiseXOR(high))), F.lit(64))
        shift = F.greatest(differ - BITS, F.lit(0)).cast("int")
        place = F.call_function("shiftright", value, shift)
        return (place - F.coalesce(F.call_function("shiftright", low, shift), F.lit(0))).cast("int")
    narrow = F.coalesce(((low > 0) & (high <= low * 4)) | ((high < 0) & (low >= high * 4)), F.lit(False))
    equal_parts = F.least(F.floor((value - low) / (high - low) * (1 << BITS)), F.lit((1 << BITS) - 1))
    power = F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * (F.floor(F.log2(F.abs(value))) + POWERS))
    return (F.when(value == INFINITIES[0], 2 * POWERS + 1).when(value == INFINITIES[1], -2 * POWERS - 1)
            .when(narrow, equal_parts).otherwise(power).cast("int"))


def values_at_ranks(cells: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Value at each ascending 1-based rank.

    ``cells`` has ``keys`` and a number ``v``; ``targets`` has ``keys``,
    ``rank_id`` and ``rank``. The result adds ``v`` and ``less``, the number of
    cells strictly below it. Ranks outside 1..n give no row.

    The cells are written once and read in at most six scans: the first bins by
    power of two (whole numbers: by the highest twelve bits), and each further
    one takes twelve bits off what is left.
    """
    keys = list(keys)
    floating = is_float(dtype_of(cells, "v"))
    cells = materialize(cells.select(*keys, "v").filter(F.col("v").isNotNull()), "cells")
    none = F.lit(None).cast(dtype_of(cells, "v"))
    state = targets.select(*keys, "rank_id", "rank", none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("less"))
    state = materialize(state, "ranks")
    small = state.count() <= ROWS_TO_BROADCAST
    done, first = None, True
    while True:
        ranges = state.select(*keys, "lo", "hi").distinct()
        rows = join_on(cells, ranges, keys, "inner", small=small)
        if not first:
            rows = rows.filter(F.col("v").between(F.col("lo"), F.col("hi")))
        spot = [*keys, "lo", "hi"]
        bins = rows.groupBy(*spot, _bin(F.col("v"), F.col("lo"), F.col("hi"), floating).alias("bin")).agg(
            F.count(F.lit(1)).alias("c"), F.min("v").alias("bin_lo"), F.max("v").alias("bin_hi")
        )
        running = F.sum("c").over(W.partitionBy(*spot).orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
        bins = bins.withColumn("upto", running)
        picked = (
            join_on(state, bins, spot, "inner")
            .filter((F.col("less") + F.col("upto") - F.col("c") < F.col("rank"))
                    & (F.col("rank") <= F.col("less") + F.col("upto")))
            .select(*keys, "rank_id", "rank", F.col("bin_lo").alias("lo"), F.col("bin_hi").alias("hi"),
                    (F.col("less") + F.col("upto") - F.col("c")).alias("less"))
        )
        picked = materialize(picked, "ranks")
        closed = picked.filter("lo = hi")
        done = closed if done is None else done.unionByName(closed)
        state, first = picked.filter("lo < hi"), False
        if state.isEmpty():
            return done.select(*keys, "rank_id", "rank", F.col("lo").alias("v"), "less")


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
              exact: bool = True, rows_per_task: int = ROWS_PER_TASK, largest: int | None = None) -> DataFrame:
    """Per segment one array of linearly interpolated quantiles for each column, under its name."""
    by, columns = list(by), list(columns)
    numbers = {c: as_number(df, c) for c in columns}
    if not exact:
        return df.groupBy(*by).agg(
            *[F.transform(F.approx_percentile(numbers[c], list(probs), 10000), lambda x: x.cast("double")).alias(c)
              for c in columns]
        )
    if largest is None:
        largest = segment_sizes(df, by)[1]
    # One task may hold the distinct values of all columns of a segment.
    if largest * len(columns) <= 4 * rows_per_task:
        return df.groupBy(*by).agg(
            *[F.percentile(numbers[c], F.array(*map(F.lit, probs))).alias(c) for c in columns]
        )
    cells = df.select(*by, F.inline(map_rows(numbers))).filter(F.col("v").isNotNull())
    keys = [*by, "name"]
    place = (F.col("n") - 1) * F.col("p")
    ranked = (
        rows_per_segment(cells, keys)
        .withColumn("p", F.explode(F.array(*map(F.lit, probs))))
        .withColumn("below", F.floor(place).cast("long"))
        .withColumn("weight", place - F.col("below"))
    )
    targets = ranked.select(
        *keys, F.explode(F.array(F.col("below") + 1, F.least(F.col("below") + 2, F.col("n")))).alias("rank")
    ).distinct().withColumn("rank_id", F.col("rank"))
    found = values_at_ranks(cells, targets, keys).select(*keys, "rank", "v")
    ranked = ranked.withColumn("rank", F.col("below") + 1)
    ranked = join_on(ranked, found.withColumnRenamed("v", "low"), [*keys, "rank"], "inner")
    ranked = ranked.withColumn("rank", F.least(F.col("rank") + 1, F.col("n")))
    ranked = join_on(ranked, found.withColumnRenamed("v", "high"), [*keys, "rank"], "inner")
    value = F.when(F.col("weight") == 0, F.col("low")).otherwise(
        F.col("low") * (1 - F.col("weight")) + F.col("high") * F.col("weight")
    )
    per_name = ranked.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("p", value.alias("q")))).alias("q")
    )
    # An all-NULL column has no rows above; the pivot over the known names restores it.
    wide = df.select(*by).distinct() if by else df.sparkSession.range(1).drop("id")
    picked = per_name.groupBy(*by).agg(*[
        F.first(F.when(F.col("name") == c, F.array(*[F.element_at("q", F.lit(float(p))) for p in probs])),
                ignorenulls=True).alias(c)
        for c in columns
    ])
    return join_on(wide, picked, by) if by else picked


def medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), **options) -> DataFrame:
    wide = quantiles(df, columns, [0.5], by, **options)
    return wide.select(*by, *[F.get(F.col(c), F.lit(0)).alias(c) for c in columns])


def cut_keys(df: DataFrame, keys: Sequence[str], targets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Order keys (one or two columns) of the rows at given ranks: ``by, rank_id, k1[, k2]``."""
    by = list(by)
    cells = df.select(*by, sortable(df, keys[0]).alias("v"))
    first = values_at_ranks(cells, targets, by)
    if len(keys) == 1:
        return first.select(*by, "rank_id", F.col("v").alias("k1"))
    first = first.select(*by, F.col("v").alias("k1"), "rank_id", (F.col("rank") - F.col("less")).alias("rank"))
    tied = df.select(*by, sortable(df, keys[0]).alias("k1"), sortable(df, keys[1]).alias("v"))
    spots = [*by, "k1"]
    tied = join_on(tied, first.select(*spots).distinct(), spots, "inner")
    second = values_at_ranks(tied, first, spots)
    return second.select(*by, "rank_id", "k1", F.col("v").alias("k2"))


def ranked_keys(df: DataFrame, keys: Sequence[str], targets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Same as ``cut_keys`` by a window over the keys alone; for segments of checked size."""
    by, names = list(by), ["k1", "k2"][: len(keys)]
    cells = df.select(*by, *[sortable(df, k).alias(n) for k, n in zip(keys, names)])
    place = F.row_number().over(W.partitionBy(*by).orderBy(*names)).cast("long")
    found = join_on(cells.withColumn("rank", place), targets, [*by, "rank"], "inner")
    return found.select(*by, "rank_id", *names)


def with_tile(df: DataFrame, keys: Sequence[str], cuts: Sequence[Callable[[Column], Column]],
              by: Sequence[str] = (), name: str = "tile", rows_per_task: int = ROWS_PER_TASK,
              counted: tuple[int, int] | None = None) -> DataFrame:
    """Number the contiguous parts that cuts make of each segment in key order.

    Every cut maps the segment's row count to the number of rows before it.
    Rows get 0 before the first cut, 1 after it, and so on. The keys together
    must be unique. ``counted`` gives (segments, rows of the largest one) where
    they are already known.
    """
    by, keys = list(by), list(keys)
    sizes = rows_per_segment(df, by)
    segments, largest = counted or segment_sizes(df, by)
    small = segments <= ROWS_TO_BROADCAST
    targets = sizes.select(
        *by,
        F.posexplode(F.array(*[cut(F.col("n")).cast("long") for cut in cuts])).alias("rank_id", "rank"),
    )
    find = ranked_keys if largest <= rows_per_task else cut_keys
    found = find(df, keys, targets, by)
    fields = ["k1", "k2"][: len(keys)]
    wide = found.groupBy(*by).agg(*[
        F.first(F.when(F.col("rank_id") == i, F.col(k)), ignorenulls=True).alias(f"__{k}_{i}")
        for i in range(len(cuts)) for k in fields
    ])
    marked = join_on(df, wide, by, small=small)
    first_key = sortable(df, keys[0])
    passed = []
    for i in range(len(cuts)):
        cut1 = F.col(f"__k1_{i}")
        beyond = first_key > cut1
        if len(keys) == 2:
            beyond = beyond | ((first_key == cut1) & (sortable(df, keys[1]) > F.col(f"__k2_{i}")))
        passed.append(F.coalesce(beyond, F.lit(True)).cast("int"))
    tile = sum(passed[1:], passed[0])
    return marked.withColumn(name, tile).drop(*[f"__{k}_{i}" for i in range(len(cuts)) for k in fields])
