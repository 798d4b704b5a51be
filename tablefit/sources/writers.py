"""Write results: CSV and JSON tables, the report star, cleansed exports."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablefit.operators.remediate import in_time_order


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema
    ])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    flat(df).write.mode(mode).csv(path, header=True)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def _folder(value: str) -> str:
    """A partition value as Spark names its folder."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\\x7f{[]^" or c < " " else c for c in value)


def write_report(tables: dict[str, DataFrame], path: str, dataset: str, run_id: str) -> None:
    """Every table of a report below its own folder, partitioned by dataset and run.

    A run that is written again replaces its own partitions; other runs stay. A table that has no rows any more leaves
    none of the earlier ones: its partition is written empty.
    """
    for name, table in tables.items():
        keyed = table.withColumns({"dataset": F.lit(dataset), "run_id": F.lit(run_id)})
        place = posixpath.join(path, name)
        if keyed.isEmpty():
            # Without rows, no partition would be replaced.
            part = posixpath.join(place, f"dataset={_folder(dataset)}", f"run_id={_folder(run_id)}")
            table.write.mode("overwrite").parquet(part)
        else:
            keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "dataset", "run_id").parquet(place)


def cleansed(train: DataFrame, test: DataFrame) -> DataFrame:
    """Repaired train and untouched test rows as one table."""
    return train.unionByName(test, allowMissingColumns=True)


def write_cleansed(train: DataFrame, test: DataFrame, path: str, time: str | None = None,
                   mode: str = "errorifexists") -> None:
    whole = cleansed(train, test)
    if time:
        whole = in_time_order(whole, time)
    whole.write.mode(mode).parquet(path)
