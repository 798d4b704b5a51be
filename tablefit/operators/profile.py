"""Table and column profiles: one wide aggregate per pass, unpivoted to rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefit.functions.frames import join_on
from tablefit.functions.stats import (
    as_number,
    both,
    correlation_of_sums,
    count_true,
    dtype_of,
    fingerprint,
    infinite,
    is_numeric,
    kurtosis,
    missing,
    skewness,
    total,
)
from tablefit.operators.columns import distinct_counts, kind_of, numeric_columns
from tablefit.operators.select import medians

# Pair correlations per aggregate; more pairs are summed by matrix products, in one scan whatever their number.
PAIRS_PER_PASS = 300
# What a task may hold of such sums before it sends them on.
GRAM_BYTES = 256 << 20
ROWS_PER_PRODUCT = 2048


def _columns(df: DataFrame, by: Sequence[str], columns: Sequence[str] | None) -> list[str]:
    return [c for c in (columns or df.columns) if c not in by]


def column_profile(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None,
                   exact: bool = True) -> DataFrame:
    """Per segment and column: type, missing and distinct counts, moments, median."""
    by, columns = list(by), _columns(df, by, columns)
    numeric = [c for c in columns if is_numeric(dtype_of(df, c))]
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[count_true(missing(df, c)).alias(f"missing_{c}") for c in columns],
        *[agg.alias(f"{name}_{c}") for c in numeric for name, agg in _moments(as_number(df, c)).items()],
    )
    base = join_on(base, distinct_counts(df, columns, by, exact), by)
    if numeric:
        base = join_on(base, medians(df, numeric, by, exact=exact).withColumnsRenamed(
            {c: f"median_{c}" for c in numeric}), by)
    none = F.lit(None).cast("double")

    def entry(position: int, c: str) -> Column:
        number = c in numeric
        several = F.col("n") - F.col(f"missing_{c}") > 1

        def stat(name: str, zero: bool = False) -> Column:
            if not number:
                return none
            value = F.col(f"{name}_{c}")
            return F.when(several, F.coalesce(value, F.lit(0.0)) if zero else value)

        return F.struct(
            F.lit(c).alias("column"), F.lit(position).alias("position"),
            F.lit(dtype_of(df, c).simpleString()).alias("type"), F.lit(kind_of(dtype_of(df, c))).alias("kind"),
            F.col(f"missing_{c}").alias("missing_count"),
            (F.col(f"missing_{c}") / F.col("n")).alias("missing_rate"),
            F.col(f"distinct_{c}").alias("unique_count"),
            (F.col(f"distinct_{c}") / F.col("n")).alias("cardinality_ratio"),
            stat("mean").alias("mean"), stat("std", True).alias("std"), stat("min").alias("min"),
            stat("max").alias("max"), stat("median").alias("median"),
            stat("skewness", True).alias("skewness"), stat("kurtosis", True).alias("kurtosis"),
        )

    entries = F.array(*[entry(i, c) for i, c in enumerate(columns)])
    return base.select(*by, F.inline(entries))


def _moments(x: Column) -> dict[str, Column]:
    return {
        "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x),
        "skewness": skewness(x), "kurtosis": kurtosis(x),
    }


def shape_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per segment and column: count, adjusted skewness and adjusted excess kurtosis."""
    by = list(by)
    numbers = {c: as_number(df, c) for c in columns}
    wide = df.groupBy(*by).agg(*[
        F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), skewness(x).alias("skewness"),
                 kurtosis(x).alias("kurtosis")).alias(f"s_{c}")
        for c, x in numbers.items()
    ])
    return wide.select(*by, F.inline(F.array(*[F.col(f"s_{c}") for c in columns])))


def table_profile(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Per segment: rows, columns, missing cells, repeated rows, approximate bytes."""
    by, columns = list(by), _columns(df, by, columns)
    gaps = total([missing(df, c).cast("int") for c in columns])
    sizes = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.sum(gaps).alias("missing_cells"),
        F.sum(total([_cell_bytes(df, c) for c in columns])).alias("bytes"),
    )
    sizes = join_on(sizes, duplicate_rows(df, by, columns).select(*by, "duplicate_rows"), by)
    share = F.col("missing_cells") / (F.col("num_rows") * len(columns))
    return sizes.select(
        *by, "num_rows", F.lit(len(columns)).cast("long").alias("num_columns"), "missing_cells",
        (share * 100).alias("missing_pct"), "duplicate_rows", "bytes",
        (100 - share * 200).alias("__s"),
    ).withColumn("static_score", F.greatest(F.lit(0.0), "__s")).drop("__s")


def _cell_bytes(df: DataFrame, column: str) -> Column:
    dtype = dtype_of(df, column)
    widths = {"byte": 1, "boolean": 1, "short": 2, "integer": 4, "float": 4, "date": 4}
    if is_numeric(dtype) or dtype.typeName() in ("boolean", "date", "timestamp", "timestamp_ntz"):
        return F.lit(widths.get(dtype.typeName(), 8))
    return F.coalesce(F.octet_length(F.col(column).cast("string")), F.lit(0))


def duplicate_rows(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None,
                   exact: bool = False) -> DataFrame:
    """Per segment: rows, and rows that repeat an earlier one.

    Rows are compared by a 128-bit fingerprint, so 16 bytes per row are
    shuffled instead of the row; a false match among 10^13 rows has odds below
    10^-12. ``exact=True`` compares whole rows. Copies of a frequent row are
    merged before the shuffle either way.
    """
    by, columns = list(by), _columns(df, by, columns)
    if exact:
        keys = [F.when(~missing(df, c), F.col(c)).alias(f"__c{i}") for i, c in enumerate(columns)]
    else:
        keys = [h.alias(f"__h{i}") for i, h in enumerate(fingerprint(df, columns))]
    copies = df.select(*by, *keys).groupBy(*by, *[f"__{'c' if exact else 'h'}{i}" for i in range(len(keys))])
    counted = copies.agg(F.count(F.lit(1)).alias("copies")).groupBy(*by)
    return counted.agg(
        F.sum("copies").alias("n"), F.sum(F.col("copies") - 1).alias("duplicate_rows")
    ).withColumn("duplicate_rate", F.col("duplicate_rows") / F.col("n"))


def pair_correlations(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (),
                      listwise: bool = False, target: str | None = None, only_target: bool = False,
                      centres: dict[str, float] | None = None) -> DataFrame:
    """Pearson r per segment and column pair: ``feat_a, feat_b, n, r``.

    Pairwise deletion by default; ``listwise`` keeps only rows complete in all
    ``columns``. ``target`` adds the pairs (column, target), over rows where
    the target is given as well; ``only_target`` leaves out all other pairs.
    """
    by = list(by)
    columns = [c for c in (columns or numeric_columns(df, by)) if c != target]
    source = df.filter(both([~missing(df, c) for c in columns])) if listwise else df
    pairs = [] if only_target else [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    pairs += [(c, target) for c in columns] if target else []
    if centres is None:
        centres = column_centres(source, [*columns, target] if target else columns)
    if len(pairs) > PAIRS_PER_PASS:
        return gram_correlations(source, [*columns, target] if target else columns, centres, by, only_target)
    return _pair_pass(source, pairs, centres, by, frozenset(columns if listwise else ()))


def column_centres(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Mean of the finite cells per column: one number each, to keep later sums small."""
    finite = {c: F.when(~infinite(df, c), as_number(df, c)) for c in columns}
    row = df.agg(*[F.avg(x).alias(c) for c, x in finite.items()]).first()
    return {c: float(row[c] or 0.0) for c in columns}


def _pair_pass(df: DataFrame, pairs: Sequence[tuple[str, str]], centres: dict[str, float], by: list[str],
               full: frozenset[str]) -> DataFrame:
    """One scan for many pairs: plain sums of shifted products.

    Columns in ``full`` have no gaps, so their own sums are shared by all pairs.
    """
    x = {c: as_number(df, c) - F.lit(centres[c]) for pair in pairs for c in pair}
    number = {c: i for i, c in enumerate(x)}
    aggregates = [F.count(F.lit(1)).alias("n")]
    for c, i in number.items():
        if c in full:
            aggregates += [F.sum(x[c]).alias(f"s{i}"), F.sum(x[c] * x[c]).alias(f"q{i}")]
    for i, (a, b) in enumerate(pairs):
        aggregates.append(F.sum(x[a] * x[b]).alias(f"p{i}"))
        if not (a in full and b in full):
            xa, xb = F.when(x[b].isNotNull(), x[a]), F.when(x[a].isNotNull(), x[b])
            aggregates += [
                F.count(x[a] + x[b]).alias(f"n{i}"), F.sum(xa).alias(f"sa{i}"), F.sum(xb).alias(f"sb{i}"),
                F.sum(xa * xa).alias(f"qa{i}"), F.sum(xb * xb).alias(f"qb{i}"),
            ]
    wide = df.groupBy(*by).agg(*aggregates)

    def entry(i: int, a: str, b: str) -> Column:
        if a in full and b in full:
            names = ("n", f"s{number[a]}", f"s{number[b]}", f"q{number[a]}", f"q{number[b]}", f"p{i}")
        else:
            names = (f"n{i}", f"sa{i}", f"sb{i}", f"qa{i}", f"qb{i}", f"p{i}")
        return F.struct(F.lit(a).alias("feat_a"), F.lit(b).alias("feat_b"), F.col(names[0]).alias("n"),
                        correlation_of_sums(*names).alias("r"))

    return wide.select(*by, F.inline(F.array(*[entry(i, a, b) for i, (a, b) in enumerate(pairs)])))


def gram_correlations(df: DataFrame, columns: Sequence[str], centres: dict[str, float],
                      by: Sequence[str] = (), only_last: bool = False) -> DataFrame:
    """Pearson r of all column pairs (``only_last``: of the last column with all others) over the rows that have both,
    in one scan: ``feat_a, feat_b, n, r``.

    Each task sums the products of blocks of rows (the cells, their squares and where they are given) as matrices, one
    set per segment, and sends a segment's sums when all together pass ``GRAM_BYTES`` or its rows end. A pair of which
    both cells are given and one is infinite has no r.
    """
    columns, by = list(columns), list(by)
    size = len(columns)
    right = np.arange(size - 1 if only_last else 0, size)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.select(*by, F.array(*[as_number(df, c) - F.lit(centres[c]) for c in columns]).alias("__x"))
    sums = ("n", "sa", "sb", "qa", "qb", "p")
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "a int", "b array<int>",
                        *(f"{s} array<double>" for s in sums)])

    def products(x: np.ndarray) -> np.ndarray:
        """``sums`` of each column (rows) with each one on the right."""
        given = ~np.isnan(x)
        far = np.isinf(x)
        filled = np.where(given & ~far, x, 0.0)
        mask = given.astype(float)
        square = filled * filled
        out = np.stack([mask.T @ mask[:, right], filled.T @ mask[:, right], mask.T @ filled[:, right],
                        square.T @ mask[:, right], mask.T @ square[:, right], filled.T @ filled[:, right]])
        if far.any():
            out[1:, far.T.astype(float) @ mask[:, right] + mask.T @ far[:, right].astype(float) > 0] = np.nan
        return out

    def emit(head: pa.RecordBatch, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(size - 1):
            later = right > a
            yield pa.RecordBatch.from_arrays(
                [*head.columns, pa.array([a], pa.int32()), pa.array([right[later]], pa.list_(pa.int32())),
                 *(pa.array([x]) for x in total[:, a, later])], names=[*by, "a", "b", *sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[pa.RecordBatch, np.ndarray]] = {}
        for batch in batches:
            keys = batch.select(by)
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(k.to_pylist() for k in keys.columns)) if by else [()] * batch.num_rows):
                groups.setdefault(key, []).append(i)
            flat = batch.column("__x").flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, size)
            for key, at in groups.items():
                for start in range(0, len(at), ROWS_PER_PRODUCT):
                    part = products(x[at[start:start + ROWS_PER_PRODUCT]])
                    if key in held:
                        held[key][1][:] += part
                    else:
                        held[key] = keys.slice(at[0], 1), part
                if len(held) * len(sums) * 8 * size * len(right) > GRAM_BYTES:
                    for head, total in held.values():
                        yield from emit(head, total)
                    held.clear()
        for head, total in held.values():
            yield from emit(head, total)

    spread = rows.mapInArrow(run, schema).select(*by, "a", F.explode(F.arrays_zip("b", *sums)).alias("sum"))
    total = spread.groupBy(*by, "a", F.col("sum.b").alias("b")).agg(*[F.sum(f"sum.{s}").alias(s) for s in sums])
    label = F.array(*map(F.lit, columns))
    return total.select(
        *by, F.get(label, F.col("a")).alias("feat_a"), F.get(label, F.col("b")).alias("feat_b"),
        F.col("n").cast("long").alias("n"), correlation_of_sums(*sums).alias("r"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Full symmetric matrix in long form; undefined values are 0, rounded to 3 digits."""
    by = list(by)
    columns = list(columns or numeric_columns(df, by))
    half = pair_correlations(df, columns, by).select(*by, "feat_a", "feat_b", F.coalesce("r", F.lit(0.0)).alias("r"))
    mirrored = half.select(*by, F.col("feat_b").alias("feat_a"), F.col("feat_a").alias("feat_b"), "r")
    varied = df.groupBy(*by).agg(*[(F.min(c) != F.max(c)).alias(c) for c in columns])
    diagonal = varied.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feat_a"), F.lit(c).alias("feat_b"),
                 F.when(F.col(c), 1.0).otherwise(0.0).alias("r")) for c in columns
    ])))
    return half.unionByName(mirrored).unionByName(diagonal).withColumn("r", F.round("r", 3))


def class_shares(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Per segment and class: count and share of the given cells."""
    by = list(by)
    counts = df.filter(~missing(df, column)).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("__all"))
    return join_on(counts, totals, by).withColumn("share", F.col("n") / F.col("__all")).drop("__all")


def static_missingness(rate: Column, slope: float = 200.0) -> Column:
    """Score of missingness alone: 100 minus slope times the missing rate, at least 0."""
    return F.greatest(F.lit(0.0), F.lit(100.0) - rate * slope)
