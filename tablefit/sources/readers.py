"""Read tables: format by suffix, a guard against empty tables, row-limited reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablefit.operators.order import first_rows

FORMATS = {".parquet": "parquet", ".pq": "parquet", ".csv": "csv"}


class TableError(ValueError):
    """The table cannot be read or holds nothing."""


def format_of(path: str) -> str:
    """Format by lower-cased suffix; CSV where the suffix says nothing."""
    name = path.lower().rstrip("/")
    return next((fmt for suffix, fmt in FORMATS.items() if name.endswith(suffix)), "csv")


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: T.StructType | str | None = None) -> DataFrame:
    """A table from files. Give ``schema`` for large CSV files: inferring it scans them once more."""
    fmt = fmt or format_of(path)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.options(header=True, inferSchema=schema is None)
    try:
        return reader.load(path)
    except AnalysisException as error:
        raise TableError(f"cannot read {path!r} as {fmt}: {error}") from error


def require_rows(df: DataFrame) -> DataFrame:
    """The table itself, or an error when it has no columns or no rows."""
    if not df.columns or df.isEmpty():
        raise TableError("the table is empty")
    return df


def read_first_rows(spark: SparkSession, path: str, rows: int, keys: Sequence[str], fmt: str | None = None) -> DataFrame:
    """The first rows in key order."""
    return first_rows(read_table(spark, path, fmt), rows, keys)
