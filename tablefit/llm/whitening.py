"""Embedding whitening with a covariance over distinct vectors.

Components c become whole numbers x = floor(64 c) + 1000000. Identical x vectors are grouped by their SHA-256 digest;
copies are dropped within each task before the shuffle, so a vector that fills a third of all rows is no hot key. The fit
weighs each distinct vector by one or by its number of rows. Sums are exact; the covariance is a sum of weighted products
of centred blocks, one matrix product a block and one row of sums for each task and dimension. Each distinct vector is
projected once, and the result is joined back to the rows. The driver holds dimensions x dimensions numbers.

Defined results: vectors that are NULL, hold NULL or non-finite components, or components of 2**56 and more (whose x fits
no long) are dropped; shorter vectors count as filled up with zeros to the longest; repeated rows and rows without id keep
their rows; a component whose eigenvalue is zero to double precision has no whitened value (NULL) and takes no part in
identity_error; without any spread, explained is NULL; a deviation of 39 digits is NULL; an empty table gives an empty
table. Other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.llm.common import broadcastable, finite_vectors, materialize, matrix_of

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
ROWS_AT_ONCE = 2048
LONG = 1 << 62
WHOLE = "decimal(38,0)"


@dataclass
class Whitening:
    """Fitted on n vectors (copies counted if they are weights) whose sums by dimension are ``sums``."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors, in columns
    trace: float
    wide: bool  # n * x may exceed a long

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        return self.n * x.astype(object if self.wide else np.int64) - np.array(self.sums, object if self.wide else np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.offsets(x) / self.n).astype(float)

    def usable(self) -> np.ndarray:
        """Which components have an eigenvalue above the error of double precision."""
        return self.values > self.values.max(initial=0) * len(self.sums) * np.finfo(float).eps

    def whitened(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.usable(), np.sqrt(np.maximum(self.values, 0)), np.nan)
        return self.centred(x) @ self.vectors / scale

    def deviations(self, x: np.ndarray) -> list[Decimal | None]:
        off = self.offsets(x)
        if int(np.abs(off).max(initial=0)) ** 2 * max(off.shape[1], 1) >= LONG:
            off = off.astype(object)
        return [Decimal(d) if d < 10 ** 38 else None for d in (off * off).sum(axis=1).tolist()]


def _blocks(batches: Iterator[pa.RecordBatch], name: str, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(a, ROWS_AT_ONCE)
            yield part, matrix_of(part.column(name), width)


def covariance(rows: DataFrame, name: str, width: int, centred: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """Weighted covariance (divisor n) of a vector column, centred before multiplying; weights in ``weight``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for part, block in _blocks(batches, name, width):
            block = centred(block)
            total += (block * part.column("weight").to_numpy()[:, None]).T @ block
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                                         names=["i", "products"])

    partial = rows.select(name, "weight").mapInArrow(run, "i int, products array<double>")
    sums = partial.select("i", F.posexplode("products").alias("j", "product")).groupBy("i", "j").agg(
        F.sum("product").alias("product")).toArrow()
    out = np.zeros((width, width))
    out[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("product").to_numpy()
    return (out + out.T) / 2 / n


def group(df: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, DataFrame, int]:
    """(id and digest of each row; digest, x and copies of each distinct vector, written; dimensions)."""
    rows = finite_vectors(df, id_column, vector_column).filter(
        F.forall("v", lambda c: F.abs(c) < F.lit(float(1 << 56))))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    whole = rows.select("id", F.transform(
        F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))),
        lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))
    whole = whole.withColumn("digest", F.unhex(F.sha2(F.concat_ws(",", F.col("x").cast("array<string>")), 256)))
    distinct = whole.groupBy("digest").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("copies"))
    return whole.select("id", "digest"), materialize(distinct, "distinct"), width


def fit(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit on (x, weight); None without rows or dimensions."""
    size = distinct.agg(F.sum("weight").alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("most")).first()
    if not width or not size["n"]:
        return None
    wide = size["n"] * size["most"] >= LONG
    kind = WHOLE if wide else "long"
    sums = distinct.select("weight", F.posexplode("x").alias("dim", "x")).groupBy("dim").agg(
        F.sum(F.col("x").cast(kind) * F.col("weight").cast(kind)).alias("s")).collect()
    start = Whitening(size["n"], [int(r["s"]) for r in sorted(sums, key=lambda r: r["dim"])], np.zeros(0), np.zeros(0), 0.0,
                      wide)
    matrix = covariance(distinct, "x", width, start.centred, start.n)
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    # One sign for all rows: the largest entry is positive.
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
    return Whitening(start.n, start.sums, values, vectors, float(np.trace(matrix)), wide)


def project(distinct: DataFrame, width: int, model: Whitening) -> DataFrame:
    """digest, weight, deviation and whitened (an array) of each distinct vector."""
    usable = model.usable()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, "x", width):
            values = model.whitened(x)
            flat = pa.array(values.ravel(), mask=np.broadcast_to(~usable, values.shape).ravel())
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(usable))
            yield pa.RecordBatch.from_arrays(
                [part.column("digest"), part.column("weight"), pa.array(model.deviations(x), pa.decimal128(38, 0)),
                 pa.ListArray.from_arrays(offsets, flat)], names=["digest", "weight", "deviation", "whitened"])

    return distinct.select("digest", "weight", "x").mapInArrow(
        run, f"digest binary, weight bigint, deviation {WHOLE}, whitened array<double>")


def identity_error(projected: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    width = int(model.usable().sum())  # eigenvalues fall, so the usable components come first
    if not width:
        return None
    rows = projected.select(F.slice("whitened", 1, width).alias("whitened"), "weight")
    means = rows.select("weight", F.posexplode("whitened").alias("j", "w")).groupBy("j").agg(
        (F.sum(F.col("w") * F.col("weight")) / model.n).alias("mean")).collect()
    mean = np.array([r["mean"] for r in sorted(means, key=lambda r: r["j"])])
    found = covariance(rows, "whitened", width, lambda block: block - mean, model.n)
    return float(np.abs(found - np.eye(width)).max())


def whiten(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS,
           weights: str = "one") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each row and component.

    ``weights``: "one" fits on each distinct x vector once, "counts" by its number of rows.
    """
    rows, distinct, width = group(df, id_column, vector_column)
    distinct = distinct.withColumn("weight", F.col("copies") if weights == "counts" else F.lit(1).cast("long"))
    model = fit(distinct, width, components)
    if model is None:
        return rows.filter("false").select(
            F.col("id").alias("vec_id"), F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"),
            F.lit(0).cast(WHOLE).alias("deviation"), F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"),
            F.lit(0.0).alias("identity_error"))
    projected = materialize(project(distinct, width, model), "whitened")
    error = identity_error(projected, model)
    explained = [v / model.trace if model.trace > 0 else None for v in model.values.tolist()]
    found = broadcastable(projected.drop("weight"), projected.count(), 64 + 8 * components)
    joined = rows.join(found, "digest").select("id", "deviation", F.posexplode(F.arrays_zip(
        "whitened", F.lit(explained).cast("array<double>").alias("explained"))).alias("component", "value"))
    return joined.select(F.col("id").alias("vec_id"), (F.col("component") + 1).alias("component"),
                         F.lit(model.n).cast("long").alias("n"), "deviation", F.col("value.whitened").alias("whitened"),
                         F.col("value.explained").alias("explained"),
                         F.lit(error).cast("double").alias("identity_error"))
