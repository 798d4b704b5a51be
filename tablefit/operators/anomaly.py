"""Isolation forests, one per segment: trees grown on small random samples, all rows scored.

A tree belongs to a segment and a number. One grouped pass grows all trees of
all segments, each on at most 256 rows that are drawn by a hash of the row's
key. A tree is three arrays (feature and cut of the inner nodes, path lengths
below), as a complete binary tree of nine levels, so a batch of rows walks down
all trees of a forest at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefit.functions.frames import ROWS_TO_BROADCAST, join_on, materialize, rows_per_segment, segment_sizes
from tablefit.functions.stats import as_number, count_true
from tablefit.operators.select import medians, quantiles

TREES = 50
ROWS_PER_TREE = 256
LEVELS = int(math.log2(ROWS_PER_TREE))
INNER = (1 << LEVELS) - 1
CUTOFF = 0.6
DRAWS = 1 << 40
# Forests up to this size together travel with the scoring function; more are joined to chunks of their segment's rows.
FOREST_BYTES = 32 << 20
ROWS_PER_CHUNK = 100_000


def mean_depth(rows: np.ndarray | float) -> np.ndarray | float:
    """Average path length of a binary search tree over that many rows."""
    n = np.asarray(rows, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_tree(sample: np.ndarray, tree: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature and cut of the inner nodes, path length of the leaves) of one isolation tree.

    Below a node that isn't split further, rows keep to the left.
    """
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(2, len(sample))))
    feature, cut, length = np.zeros(INNER, np.int32), np.full(INNER, np.inf), np.zeros(INNER + 1)
    pending = [(np.arange(len(sample)), 0, 0)]
    while pending:
        rows, depth, node = pending.pop()
        part = sample[rows]
        varied = np.flatnonzero(part.min(axis=0) < part.max(axis=0)) if len(rows) > 1 else np.empty(0, int)
        if depth >= limit or not len(varied):
            leaf = ((node + 1) << LEVELS - depth) - 1 - INNER
            length[leaf] = depth + float(mean_depth(len(rows)))
            continue
        feature[node] = rng.choice(varied)
        values = part[:, feature[node]]
        cut[node] = rng.uniform(values.min(), values.max())
        left = values <= cut[node]
        pending.append((rows[~left], depth + 1, 2 * node + 2))
        pending.append((rows[left], depth + 1, 2 * node + 1))
    return feature, cut, length


def imputed(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """The columns as doubles, gaps and infinities replaced by the column's median."""
    segments, largest = segment_sizes(df, by)
    fills = medians(df, columns, by, largest=largest).withColumnsRenamed({c: f"__fill_{c}" for c in columns})
    rows = join_on(df, fills, by, small=segments <= ROWS_TO_BROADCAST)
    cells = {c: as_number(df, c) for c in columns}
    return rows.select(*keep, *[
        F.coalesce(F.when(~x.isin(math.inf, -math.inf), x), F.col(f"__fill_{c}"), F.lit(0.0)).alias(c)
        for c, x in cells.items()
    ])


def _dealt(rows: DataFrame, by: Sequence[str], keys: Sequence[str], columns: Sequence[str], trees: int, seed: int) -> DataFrame:
    """(by, tree, columns) of the rows that each tree may see: one and a half times what it takes, or all of a short segment.

    A row of a long segment is dealt to one tree at most; in a shorter one each tree draws for itself.
    """
    sizes = rows_per_segment(rows, by).withColumnRenamed("n", "__n")
    segments = sizes.count()
    rows = join_on(rows, sizes, by, "inner", small=segments <= ROWS_TO_BROADCAST)
    # Without a key, equal rows are told apart by their place, so the draw depends on the partitioning.
    own = list(keys) or [*columns, F.monotonically_increasing_id()]
    rows = rows.withColumn("__draw", F.xxhash64(F.lit(seed), *own))
    share = 1.5 * ROWS_PER_TREE / F.col("__n")
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))

    def drawn(draw: Column, part: Column) -> Column:
        return F.pmod(draw, F.lit(DRAWS)) < F.ceil(part * DRAWS)

    each = F.filter(numbers, lambda t: drawn(F.xxhash64(t, F.col("__draw")), share))
    single = F.when(drawn(F.col("__draw"), share * trees),
                    F.array(F.pmod(F.xxhash64("__draw"), F.lit(trees)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return rows.select(*by, F.explode(F.when(share * trees < 1, single).otherwise(each)).alias("__tree"), *columns)


def fit_forest(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = (), trees: int = TREES, seed: int = 42,
               keys: Sequence[str] = ()) -> DataFrame:
    """One row per segment: feature, cut and length of all its trees end to end, and norm (the usual path length).

    With unique ``keys`` the rows of each tree follow from their hash, whatever the partitioning.
    """
    columns, by = list(columns), list(by)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    types = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "__tree int", "feature array<int>", "cut array<double>",
                       "length array<double>", "size int"])

    def grow(part: pa.Table) -> pa.Table:
        tree = part.column("__tree")[0].as_py()
        values = np.column_stack([part.column(c).to_numpy() for c in columns])
        values = values[np.lexsort(values.T[::-1])]
        picked = np.random.default_rng([seed, tree, 1]).permutation(len(values))[:ROWS_PER_TREE]
        grown = grow_tree(values[picked], tree, seed)
        head = part.slice(0, 1).select([*by, "__tree"])
        for name, value in zip(("feature", "cut", "length"), grown):
            head = head.append_column(name, pa.array([value]))
        return head.append_column("size", pa.array([len(picked)], pa.int32()))

    grown = _dealt(rows, by, keys, columns, trees, seed).groupBy(*by, "__tree").applyInArrow(grow, types)
    depth = 2 * (F.log(F.greatest(F.col("size") - 1, F.lit(1))) + 0.5772156649) - 2 * (F.col("size") - 1) / F.col("size")
    grown = grown.withColumn("norm", F.when(F.col("size") > 2, depth).when(F.col("size") == 2, 1.0).otherwise(0.0))
    # A segment has as many rows here as a forest has trees.
    found = grown.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__tree", "feature", "cut", "length"))).alias("t"),
                                   F.avg("norm").alias("norm"))
    return found.select(*by, *[F.flatten(f"t.{c}").alias(c) for c in ("feature", "cut", "length")], "norm")


def path_lengths(values: np.ndarray, feature: np.ndarray, cut: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Mean path length of each row over all trees of a forest."""
    trees = len(feature) // INNER
    inner, leaves = np.arange(trees)[:, None] * INNER, np.arange(trees)[:, None] * (INNER + 1)
    rows, at = np.arange(len(values)), np.zeros((trees, len(values)), np.int64)
    for _ in range(LEVELS):
        node = inner + at
        at = 2 * at + 1 + (values[rows, feature[node]] > cut[node])
    return length[leaves + at - INNER].mean(axis=0)


def _segment(by: Sequence[str]) -> Column:
    """One number for a segment; keys may be NULL."""
    return F.xxhash64(F.lit(1), *[x for c in by for x in (F.col(c).isNull(), F.col(c))])


def _scores(values: np.ndarray, forest: tuple) -> np.ndarray:
    feature, cut, length, norm = forest
    # Where all trees see one row, nothing is odd.
    return np.exp2(-path_lengths(values, feature, cut, length) / norm) if norm else np.full(len(values), 0.5)


def anomaly_scores(rows: DataFrame, columns: Sequence[str], forests: DataFrame, by: Sequence[str] = (),
                   keep: Sequence[str] = (), forest_bytes: int = FOREST_BYTES) -> DataFrame:
    """Add ``anomaly_score`` in (0, 1] by the forest of each row's segment; rows near 1 are isolated early."""
    columns, by, keep = list(columns), list(by), list(keep)
    forests = materialize(forests, "forests")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in dict.fromkeys([*by, *keep])), "anomaly_score double"])
    names = list(dict.fromkeys([*by, *keep]))
    numbered = forests.select(*by, _segment(by).alias("__segment"), "feature", "cut", "length", "norm")
    rows = rows.select(*names, *[c for c in columns if c not in names], _segment(by).alias("__segment"))

    def scored(part: pa.RecordBatch | pa.Table, forest_of: Callable[[int], tuple]) -> pa.Array:
        segment = part.column("__segment").to_numpy()
        values = np.column_stack([part.column(c).to_numpy() for c in columns])
        out = np.empty(len(values))
        for one in np.unique(segment):
            at = np.flatnonzero(segment == one)
            for a in range(0, len(at), 2048):
                out[at[a:a + 2048]] = _scores(values[at[a:a + 2048]], forest_of(one))
        return pa.array(out)

    segments = forests.count()
    if segments * TREES * (INNER * 12 + (INNER + 1) * 8) <= forest_bytes:
        known = {r["__segment"]: (np.array(r["feature"]), np.array(r["cut"]), np.array(r["length"]), r["norm"])
                 for r in numbered.drop(*by).collect()}
        shared = rows.sparkSession.sparkContext.broadcast(known)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    out = scored(batch, shared.value.__getitem__)
                    yield pa.RecordBatch.from_arrays([*map(batch.column, names), out], names=[*names, "anomaly_score"])

        return rows.mapInArrow(score, schema)

    # Chunks of a segment's rows, so that neither a hot segment nor many forests meet in one task.
    sizes = rows.groupBy("__segment").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_CHUNK).alias("__chunks"))
    sizes = materialize(sizes, "segment-chunks")
    known = F.broadcast(sizes) if segments <= ROWS_TO_BROADCAST else sizes
    chunked = rows.join(known, "__segment").withColumn("__chunk", F.pmod(F.xxhash64(
        F.monotonically_increasing_id()), F.col("__chunks"))).drop("__chunks")
    spread = numbered.drop(*by).join(sizes, "__segment").withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__chunks") - 1))).drop("__chunks")

    def score_chunk(part: pa.Table, forest: pa.Table) -> pa.Table:
        if not part.num_rows:
            return part.select(names).append_column("anomaly_score", pa.array([], pa.float64()))
        row = forest.to_pylist()[0]
        own = np.array(row["feature"]), np.array(row["cut"]), np.array(row["length"]), row["norm"]
        return part.select(names).append_column("anomaly_score", scored(part, lambda _: own))

    keys = ["__segment", "__chunk"]
    return chunked.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(score_chunk, schema)


def forest_anomaly(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), mode: str = "contamination",
                   contamination: float = 0.05, cutoff: float = CUTOFF, seed: int = 42,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Per segment: rows, the share of anomalous ones and of extreme ones, from the segment's own forest.

    ``contamination`` counts rows beyond the segment's own score quantile;
    ``threshold`` counts scores above a fixed cutoff. ``extreme_ratio`` always
    counts the latter, and so tells a spiked segment from a clean one. With
    unique ``keys`` the result does not depend on the partitioning.
    """
    by, columns, keys = list(by), list(columns), list(keys)
    rows = imputed(df, columns, by, keep=[c for c in dict.fromkeys([*by, *keys]) if c not in columns])
    # Read three times: for the sizes, the trees and the scores.
    rows = materialize(rows, "imputed")
    forests = fit_forest(rows, columns, by, seed=seed, keys=keys)
    scored = anomaly_scores(rows, columns, forests, by).withColumn("extreme", F.col("anomaly_score") > cutoff)
    if mode == "threshold":
        flagged = scored.withColumn("odd", F.col("extreme"))
    else:
        # Scores are read twice, and the Python pass behind them is the expensive part.
        scored = materialize(scored, "anomaly")
        segments, largest = segment_sizes(scored, by)
        limits = quantiles(scored, ["anomaly_score"], [1 - contamination], by, largest=largest).select(
            *by, F.get("anomaly_score", F.lit(0)).alias("__limit")
        )
        flagged = join_on(scored, limits, by, small=segments <= ROWS_TO_BROADCAST).withColumn("odd", F.col("anomaly_score") > F.col("__limit"))
    counts = flagged.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), count_true(F.col("odd")).alias("anomalies"),
                                      count_true(F.col("extreme")).alias("__extreme"))
    return counts.withColumns({"anomaly_ratio": F.col("anomalies") / F.col("n"),
                               "extreme_ratio": F.col("__extreme") / F.col("n")}).drop("__extreme")
