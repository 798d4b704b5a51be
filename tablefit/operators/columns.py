"""Column roles, lenient casts, and the row and column filters built on them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablefit.functions.stats import both, clip, dtype_of, is_float, is_integer, is_numeric, is_temporal, missing

# Text layouts tried in turn, each with the shape of the texts that it may fit; the first that parses wins.
_YEAR, _DATE, _CLOCK = r"[+-]?\d{4,19}", r"\d{2}/\d{2}/[+-]?\d{4,19}", r"\d{2}:\d{2}:\d{2}"
TIME_LAYOUTS = {
    "yyyy-MM-dd'T'HH:mm:ss": rf"{_YEAR}-\d{{2}}-\d{{2}}T{_CLOCK}",
    "yyyy/MM/dd": rf"{_YEAR}/\d{{2}}/\d{{2}}",
    "yyyy/MM/dd HH:mm:ss": rf"{_YEAR}/\d{{2}}/\d{{2}} {_CLOCK}",
    "d MMM yyyy": rf"[+-]?\d+ [^\d\s,]+ {_YEAR}",
    "MMM d, yyyy": rf"[^\d\s,]+ [+-]?\d+, {_YEAR}",
    "yyyyMMdd": r"[+-]?\d{8,}",
}
# Layouts that read the same text differently: a column follows one of the two.
MONTH_FIRST = {"MM/dd/yyyy": _DATE, "MM/dd/yyyy HH:mm:ss": f"{_DATE} {_CLOCK}", "MM-dd-yyyy": _DATE.replace("/", "-")}
DAY_FIRST = {"dd/MM/yyyy": _DATE, "dd/MM/yyyy HH:mm:ss": f"{_DATE} {_CLOCK}", "dd-MM-yyyy": _DATE.replace("/", "-")}
# What Spark itself casts to a time begins with a year or holds a clock time.
CAST_SHAPE = r"\s*[+-]?\d{4,}.*|.*:.*"
# Longer texts are no times.
LONGEST_TIME = 100
IDENTIFIER_SHARE = 0.85
SKETCH_ERROR = 0.02


@dataclass(frozen=True)
class Roles:
    """Which column plays which part. Roles belong to the table, not to a segment."""

    columns: tuple[str, ...]
    numeric: tuple[str, ...]
    identifiers: tuple[str, ...] = ()
    target: str | None = None
    time: str | None = None
    datetime: tuple[str, ...] = field(default=())

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(c for c in self.numeric if c != self.target and c not in self.identifiers)

    @property
    def measures(self) -> tuple[str, ...]:
        """Numeric columns that are not identifiers, target included."""
        return tuple(c for c in self.numeric if c not in self.identifiers)

    @property
    def categorical(self) -> tuple[str, ...]:
        return tuple(c for c in self.columns if c not in self.numeric and c not in self.datetime)


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType) and f.name not in without]


def kind_of(dtype: T.DataType) -> str:
    if is_integer(dtype):
        return "int"
    if is_numeric(dtype):
        return "float"
    if is_temporal(dtype):
        return "time"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    return "text" if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)) else "other"


def identifier_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Columns named like a key whose distinct share exceeds 85 %.

    A sketch rules out columns far below the limit; the rest is counted exactly, each in a scan of its own column.
    """
    named = [c for c in (columns or df.columns) if "id" in c.lower() or "key" in c.lower()]
    if not named:
        return []
    sketch = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(c).alias(c) for c in named]
    ).first()
    n = max(1, sketch["n"])
    # Six standard errors of the sketch below the limit.
    likely = [c for c in named if sketch[c] > 0.7 * IDENTIFIER_SHARE * n]
    if not likely:
        return []
    exact = distinct_counts(df, likely).first()
    return [c for c in likely if exact[f"distinct_{c}"] > IDENTIFIER_SHARE * n]


def distinct_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                    exact: bool = True) -> DataFrame:
    """``distinct_<column>`` per segment, without NULL and NaN.

    Exact counts scan each column by itself (its own cells and the segment's keys only): counting several in one
    aggregate would send a copy of each row for each column. Copies are combined before the shuffle.
    """
    by, columns = list(by), list(columns)
    cells = {c: F.when(~missing(df, c), F.col(c)) for c in columns}
    if not exact or len(columns) < 2:
        count = F.count_distinct if exact else partial(F.approx_count_distinct, rsd=SKETCH_ERROR)
        return df.groupBy(*by).agg(*[count(x).alias(f"distinct_{c}") for c, x in cells.items()])
    parts = [df.groupBy(*by).agg(F.count_distinct(x).alias("__n")).withColumn("__i", F.lit(i))
             for i, x in enumerate(cells.values())]
    return reduce(DataFrame.unionByName, parts).groupBy(*by).agg(*[
        F.max(F.when(F.col("__i") == i, F.col("__n"))).alias(f"distinct_{c}") for i, c in enumerate(columns)])


def column_roles(df: DataFrame, target: str | None = None, time: str | None = None,
                 by: Sequence[str] = (), without: Sequence[str] = (),
                 identifiers: Sequence[str] | None = None, sniff: bool = True) -> Roles:
    """Roles of all columns but the segment and order columns; ``sniff`` finds times in text columns."""
    columns = [c for c in df.columns if c not in by and c not in without]
    known = identifier_columns(df, columns) if identifiers is None else list(identifiers)
    texts = text_times(df, [c for c in columns if kind_of(dtype_of(df, c)) == "text"]) if sniff else []
    return Roles(
        columns=tuple(columns),
        numeric=tuple(c for c in columns if is_numeric(dtype_of(df, c))),
        identifiers=tuple(known),
        target=target,
        time=time,
        datetime=tuple(c for c in columns if is_temporal(dtype_of(df, c)) or c in texts),
    )


def shared_features(train: DataFrame, test: DataFrame, target: str | None) -> list[str]:
    return [c for c in numeric_columns(train, [target] if target else []) if c in test.columns]


def cell_shape(cell: Column) -> Column:
    """A text with 9 for each digit and one a for each run of letters; NULL where no time can be: no digit, or too long."""
    digits = F.translate(cell, "0123456789", "9" * 10)
    shape = F.regexp_replace(digits, r"\p{L}+", "a")
    return F.when((F.length(cell) <= LONGEST_TIME) & (F.instr(digits, "9") > 0), shape)


def _fits(text: Column, pattern: str) -> Column:
    return text.rlike(rf"^(?:\s*(?:{pattern})\s*)$")


def fitting_layouts(df: DataFrame, columns: Sequence[str]) -> dict[str, frozenset[str]]:
    """For each text column the layouts that the shape of any of its cells fits ("cast" for Spark's own).

    One scan: shapes are few, and combined before the shuffle; the layouts are tried on the distinct shapes only.
    """
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("i"), cell_shape(F.col(c)).alias("shape")) for i, c in enumerate(columns)])
    shapes = df.select(F.inline(cells)).filter(F.col("shape").isNotNull()).groupBy("i", "shape").count()
    # A run of letters is one letter in a shape, which the layouts' patterns allow.
    patterns = TIME_LAYOUTS | MONTH_FIRST | DAY_FIRST | {"cast": CAST_SHAPE}
    found = shapes.groupBy("i").agg(*[F.bool_or(_fits(F.col("shape"), pattern.replace("T", "a"))).alias(name)
                                      for name, pattern in patterns.items()]).collect()
    fits = {columns[r["i"]]: frozenset(name for name in patterns if r[name]) for r in found}
    return {c: fits.get(c, frozenset()) for c in columns}


def read_time(cell: Column, days_first: bool = False, layouts: frozenset[str] | None = None) -> Column:
    """Timestamp of a text, NULL where no layout fits. No layout fits a text without a digit.

    A layout is tried only on texts of its shape; ``layouts`` names those that fit any cell of the column.
    """
    tried = TIME_LAYOUTS | (DAY_FIRST if days_first else MONTH_FIRST)
    ways = [] if layouts is not None and "cast" not in layouts else [cell.try_cast("timestamp")]
    ways += [F.when(_fits(cell, pattern), F.try_to_timestamp(cell, F.lit(name)))
             for name, pattern in tried.items() if layouts is None or name in layouts]
    if not ways:
        return F.lit(None).cast("timestamp")
    return F.when(cell.rlike(r"\d"), F.coalesce(*ways))


def writes_days_first(df: DataFrame, column: str) -> bool:
    """Do more cells of a text column read with the day first than with the month first? One scan of the column."""
    cell = F.col(column)
    shares = df.agg(*[F.count(F.coalesce(*[F.when(_fits(cell, pattern), F.try_to_timestamp(cell, F.lit(name)))
                                           for name, pattern in layouts.items()])).alias(which)
                      for which, layouts in (("days", DAY_FIRST), ("months", MONTH_FIRST))]).first()
    return shares["days"] > shares["months"]


def time_likeness(column: str, layouts: frozenset[str]) -> dict[str, Column]:
    """Aggregates over all given cells of a text column: are all numbers, what share reads as times, with likely years.

    ``layouts`` are those that fit any cell; without any, no cell is parsed. Only a column that both orders of day and
    month may fit is read twice.
    """
    cell = F.col(column)
    orders = [days for days, names in ((False, MONTH_FIRST), (True, DAY_FIRST)) if layouts & names.keys()] or [False]
    reads = {days: read_time(cell, days, layouts) for days in orders}
    parsed = {days: F.avg(F.when(cell.isNotNull(), at.isNotNull().cast("double"))) for days, at in reads.items()}
    years = {days: F.avg(F.year(at).between(1900, 2100).cast("double")) for days, at in reads.items()}
    if len(orders) == 1:
        return {"all_numbers": numeric_text(column), "parsed": parsed[orders[0]], "years_ok": years[orders[0]]}
    days_first = F.coalesce(parsed[True] > parsed[False], F.lit(False))
    return {
        "all_numbers": numeric_text(column),
        "parsed": F.when(days_first, parsed[True]).otherwise(parsed[False]),
        "years_ok": F.when(days_first, years[True]).otherwise(years[False]),
    }


def text_times(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The text columns that hold times: four in five cells read as times, with likely years, and not all are numbers."""
    fits = {c: names for c, names in fitting_layouts(df, columns).items() if names}
    if not fits:
        return []
    likeness = {c: time_likeness(c, names) for c, names in fits.items()}
    row = df.agg(*[F.coalesce(~x["all_numbers"] & (x["parsed"] >= 0.8) & (x["years_ok"] >= 0.8), F.lit(False)).alias(c)
                   for c, x in likeness.items()]).first()
    return [c for c in fits if row[c]]


def lenient_timestamp(df: DataFrame, column: str) -> Column:
    """Timestamp of a cell, NULL where it cannot be read; never an error.

    Day and month of a text column keep one order in all its cells: the one that reads more of them, on ties the month
    first.
    """
    cell, dtype = F.col(column), dtype_of(df, column)
    if is_temporal(dtype):
        return cell.cast("timestamp")
    if is_integer(dtype):
        return F.timestamp_micros(cell.cast("long"))
    if isinstance(dtype, T.StringType):
        return read_time(cell, writes_days_first(df, column))
    return F.lit(None).cast("timestamp")


def numeric_text(column: str) -> Column:
    """Aggregate: do all given texts read as numbers?"""
    return F.bool_and(F.col(column).try_cast("double").isNotNull())


def normalize_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL, so that both count as missing everywhere."""
    floats = [f.name for f in df.schema if is_float(f.dataType)]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep rows whose given columns are all present (listwise deletion)."""
    return df.filter(both([~missing(df, c) for c in (columns or df.columns)]))


def fill_missing(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.withColumns(
        {c: F.when(missing(df, c), F.lit(v)).otherwise(F.col(c)) for c, v in values.items() if c in df.columns}
    )


def clip_columns(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns(
        {c: clip(F.col(c).cast("double"), low, high) for c, (low, high) in bounds.items() if c in df.columns}
    )


def role_table(df: DataFrame, by: Sequence[str] = (), without: Sequence[str] = ()) -> DataFrame:
    """One row per column: its role (numeric, datetime or categorical)."""
    roles = column_roles(df, by=by, without=without, identifiers=[])
    rows = [(i, c, "numeric" if c in roles.numeric else "datetime" if c in roles.datetime else "categorical")
            for i, c in enumerate(roles.columns)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, role string")
