"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefit.functions.frames import materialize

__all__ = ["blocks_of", "broadcastable", "finite_vectors", "map_batches", "materialize", "matrix_of", "read",
           "small_batches", "texts"]

# Most bytes of a lookup side that may be broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 8 << 20
# Bytes of text that a task turns into arrays at a time.
BLOCK_BYTES = 2 << 20
ROWS_PER_BATCH = 500


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of few rows: ten thousand long texts at a time would fill an executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > ROWS_PER_BATCH:
        spark.conf.set(name, str(ROWS_PER_BATCH))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text) alone: other columns, whatever their names, never meet the columns that operators add."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_column), F.lit("")).alias("text"))


def finite_vectors(df: DataFrame, id_column: str, vector_column: str, *others: Column) -> DataFrame:
    """(id, v, others) of the rows whose vector is there and holds neither NULL nor non-finite components."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"),
                     *others)
    return rows.filter(F.col("v").isNotNull() & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def matrix_of(column: pa.ListArray, width: int) -> np.ndarray:
    """The rows of a list column as a matrix of doubles or longs; shorter rows are filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply a function to each Arrow batch of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(run, schema)


def blocks_of(sizes: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows of the given sizes into runs [a, b) of at most ``limit`` units (a longer row is a run of its own)."""
    a, total = 0, 0
    for b, size in enumerate(sizes.tolist()):
        if b > a and total + size > limit:
            yield a, b
            a, total = b, 0
        total += size
    if len(sizes):
        yield a, len(sizes)


def broadcastable(df: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """Mark a side for broadcasting when its counted size is within the bound, else leave it to a shuffle join."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_BYTES else df


def literal_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small constant table, without Python workers."""
    structs: list[Column] = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
