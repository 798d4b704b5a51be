"""Deterministic defect injection: arithmetic on keys, the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit(key: Column, factor: int, modulus: int, below: int, offset: Column | int = 0) -> Column:
    """True for a fixed pseudo-random share ``below / modulus`` of the keys."""
    offset = offset if isinstance(offset, Column) else F.lit(offset)
    return F.pmod(key * factor + offset, F.lit(modulus)) < below


def blank(df: DataFrame, column: str, where: Column) -> DataFrame:
    return df.withColumn(column, F.when(~where, F.col(column)))


def spike(df: DataFrame, column: str, where: Column, factor: float) -> DataFrame:
    return df.withColumn(column, F.when(where, F.col(column) * factor).otherwise(F.col(column)))


def repeat_rows(df: DataFrame, where: Column) -> DataFrame:
    return df.unionByName(df.filter(where))


def dirty_lineitem(df: DataFrame) -> DataFrame:
    """Gaps, spikes, infinities, a leaking copy, constant and empty columns, rare labels."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    df = blank(df, "l_quantity", hit(key, 7, 100, 12, line * 13))
    df = blank(df, "l_tax", hit(key, 11, 100, 55, line))
    df = spike(df, "l_extendedprice", hit(key, 31, 500, 1, line * 3), 1000)
    draw = F.pmod(key * 17 + line, F.lit(1000))
    df = df.withColumns({
        "leak_discount": F.col("l_discount") * 100 + line * F.lit(0.0001),
        "inf_col": F.when(F.pmod(key, F.lit(97)) == 0, float("inf")).otherwise(F.col("l_discount")),
        "const_col": F.lit(1),
        "empty_col": F.lit(None).cast("double"),
        "rare_label": (draw < 15).cast("int"),
        "uneven_label": (draw < 60).cast("int"),
    })
    return df.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax", "l_extendedprice", "l_discount",
        "leak_discount", "inf_col", "const_col", "empty_col", "rare_label", "uneven_label", "l_returnflag",
        "l_linestatus", "l_shipdate",
    )


def dirty_orders(df: DataFrame) -> DataFrame:
    return repeat_rows(df, F.pmod("o_orderkey", F.lit(20)) == 0)


def dirty_events(df: DataFrame) -> DataFrame:
    """Backward jumps, repeated times, and a text time column with unreadable cells."""
    event = F.col("event_id")
    ts = (
        F.when(F.pmod(event, F.lit(15)) == 0, F.col("ts") - F.expr("INTERVAL 2 HOURS"))
        .when(F.pmod(event, F.lit(10)) == 1, F.date_trunc("hour", "ts").cast(df.schema["ts"].dataType))
        .otherwise(F.col("ts"))
    )
    text = F.when(F.pmod(event, F.lit(50)) == 0, "INVALID_DATE").otherwise(F.col("ts").cast("string"))
    return df.select("event_id", "user_id", "event_type", "value", ts.alias("ts"), text.alias("ts_text"))
