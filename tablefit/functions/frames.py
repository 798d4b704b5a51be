"""Small DataFrame helpers: null-safe joins, shared tables, size checks."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows that one task may sort or keep; larger groups take the distributed path.
ROWS_PER_TASK = 1_000_000
# Rows of a lookup side that may be broadcast; larger sides are joined by shuffle.
ROWS_TO_BROADCAST = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, else one in the warehouse: both are shared by all executors."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or posixpath.join(spark.conf.get("spark.sql.warehouse.dir"), "_tablefit")


def materialize(df: DataFrame, name: str = "part", by: Sequence[str] = ()) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors.

    ``by`` names columns of few values that get folders of their own: who reads one value leaves the others out.
    """
    spark = df.sparkSession
    path = posixpath.join(shared_folder(spark), f"tablefit-{name}-{uuid.uuid4().hex}")
    if not by:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])


def join_on(left: DataFrame, right: DataFrame, keys: list[str] | tuple[str, ...], how: str = "left",
            small: bool = False) -> DataFrame:
    """Join on keys that may be NULL, keeping each key once. No keys: the right side is one row."""
    keys = list(keys)
    if not keys:
        return left.crossJoin(F.broadcast(right))
    names = {k: f"__right_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    if small:
        right = F.broadcast(right)
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(names[k])) for k in keys])
    return left.join(right, condition, how).drop(*names.values())


def rows_per_segment(df: DataFrame, by: list[str] | tuple[str, ...]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def segment_sizes(df: DataFrame, by: list[str] | tuple[str, ...]) -> tuple[int, int]:
    """(number of segments, rows of the largest one): the size check before a bounded shortcut."""
    row = rows_per_segment(df, by).agg(F.count("n").alias("segments"), F.max("n").alias("largest")).first()
    return int(row["segments"]), int(row["largest"] or 0)


def map_rows(columns: dict[str, Column]) -> Column:
    """Array of (name, value) structs, to unpivot columns in one pass."""
    return F.array(*[F.struct(F.lit(n).alias("name"), c.alias("v")) for n, c in columns.items()])
