"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITIES = (float("inf"), float("-inf"))


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def dtype_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def missing(df: DataFrame, column: str) -> Column:
    """True where a cell is NULL or NaN."""
    cell = F.col(column)
    if is_float(dtype_of(df, column)):
        return cell.isNull() | F.isnan(cell)
    return cell.isNull()


def infinite(df: DataFrame, column: str) -> Column:
    """True where a cell is +inf or -inf (never NULL)."""
    if is_float(dtype_of(df, column)):
        return F.coalesce(F.col(column).isin(*INFINITIES), F.lit(False))
    return F.lit(False)


def as_number(df: DataFrame, column: str) -> Column:
    """The column as double, with NaN turned into NULL."""
    number = F.col(column).cast("double")
    if is_float(dtype_of(df, column)):
        return F.when(~F.isnan(number), number)
    return number


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def count_true(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def clip(value: Column, low, high) -> Column:
    """Bound to [low, high]; NULL stays NULL although greatest/least skip NULLs."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def adjusted_skewness(n: Column, g1: Column) -> Column:
    """Bias-adjusted skewness from the population form; 0 for a constant, NULL below 3 values."""
    n = n.cast("double")
    value = F.sqrt(n * (n - 1)) / (n - 2) * F.coalesce(nan_to_null(g1), F.lit(0.0))
    return F.when(n > 2, value)


def adjusted_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-adjusted excess kurtosis from the population form; 0 for a constant, NULL below 4 values."""
    n = n.cast("double")
    value = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * nan_to_null(g2) + 6)
    return F.when(n > 3, F.coalesce(value, F.lit(0.0)))


def skewness(value: Column) -> Column:
    return adjusted_skewness(F.count(value), F.skewness(value))


def kurtosis(value: Column) -> Column:
    return adjusted_kurtosis(F.count(value), F.kurtosis(value))


def correlation(a: Column, b: Column) -> Column:
    """Pearson r over rows where both are given; NULL (no error) when one side is constant."""
    shared = a.isNotNull() & b.isNotNull()
    a, b = F.when(shared, a), F.when(shared, b)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return nan_to_null(F.try_divide(F.covar_pop(a, b), F.nullif(spread, F.lit(0.0))))


def correlation_of_sums(n: str, x: str, y: str, xx: str, yy: str, xy: str) -> Column:
    """Pearson r from columns with sums of values that were shifted close to their means.

    Written as SQL text: one such expression per column pair is built in one call.
    """
    var_x, var_y = f"({xx} - {x} * {x} / {n})", f"({yy} - {y} * {y} / {n})"
    spread = f"sqrt(greatest({var_x}, 0D)) * sqrt(greatest({var_y}, 0D))"
    r = f"try_divide({xy} - {x} * {y} / {n}, nullif({spread}, 0D))"
    flat = f"{var_x} <= 1e-14 * {xx} OR {var_y} <= 1e-14 * {yy} OR isnan({r})"
    return F.expr(f"CASE WHEN {n} > 0 AND NOT ({flat}) THEN least(greatest({r}, -1D), 1D) END")


def imputed_kurtosis(moments: str, rows: str, fill: str) -> Column:
    """Adjusted kurtosis of a column whose missing cells all take the value ``fill``.

    Merges the central moments of the given cells (a struct column with n, m,
    v, g1, g2) with those of a constant block, so imputed rows are never
    scanned. Arguments are SQL text.
    """
    na, nb, size = f"{moments}.n", f"({rows} - {moments}.n)", f"CAST({rows} AS DOUBLE)"
    m2 = f"({moments}.v * {na})"
    m3 = f"(coalesce({moments}.g1, 0D) * pow({moments}.v, 1.5D) * {na})"
    m4 = f"((coalesce({moments}.g2, -3D) + 3) * {moments}.v * {moments}.v * {na})"
    d = f"coalesce({fill} - {moments}.m, 0D)"
    all2 = f"({m2} + {d} * {d} * {na} * {nb} / {size})"
    all4 = (
        f"({m4} + pow({d}, 4) * {na} * {nb} * ({na} * CAST({na} AS DOUBLE) - {na} * CAST({nb} AS DOUBLE)"
        f" + {nb} * CAST({nb} AS DOUBLE)) / pow({size}, 3)"
        f" + 6 * {d} * {d} * {nb} * CAST({nb} AS DOUBLE) * {m2} / ({size} * {size}) - 4 * {d} * {nb} * {m3} / {size})"
    )
    g2 = f"try_divide({size} * {all4}, nullif({all2} * {all2}, 0D)) - 3"
    adjusted = f"({size} - 1) / (({size} - 2) * ({size} - 3)) * (({size} + 1) * g + 6)"
    inner = f"element_at(transform(array(g2v), g -> CASE WHEN NOT isnan(g) THEN {adjusted} END), 1)".replace("g2v", g2)
    return F.expr(f"CASE WHEN {rows} > 3 THEN coalesce({inner}, 0D) END")


def folded(key: Column) -> Column:
    """An integer key in [0, 2^31): its high bits are mixed into the low ones."""
    key = key.cast("long")
    return F.pmod(key.bitwiseXOR(F.shiftright(key, 31)), F.lit(2147483648))


def scatter(key: Column, seed: int = 42) -> Column:
    """Arithmetic hash of an integer key in [0, 2^31), the same in any SQL engine."""
    return F.pmod(folded(key) * F.lit(2654435761) + F.lit(seed), F.lit(2147483648))


def fingerprint(df: DataFrame, columns: list[str]) -> list[Column]:
    """Two independent 64-bit hashes of a row that tell NULL positions apart."""
    gaps = [
        total([F.when(missing(df, c), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(columns[at:at + 60])])
        for at in range(0, len(columns), 60)
    ]
    cells = [as_number(df, c) if is_float(dtype_of(df, c)) else F.col(c) for c in columns]
    return [F.xxhash64(F.lit(salt), *gaps, *cells) for salt in (1, 2)]
