"""Vector compression to part codes, in whole numbers only.

Components become whole numbers (floor of ``scale`` times the component) and vectors are cut into equal consecutive parts.
Each part position has a codebook, refined by rounds of assigning and floor means. Parts and entries are padded with
zeros to a power of two and transformed by an integer Walsh-Hadamard transform, which multiplies squared distances by the
padded length. Squared differences are added up in sequency order (slowest coefficients first); an entry is dropped as
soon as its sum exceeds a complete distance that is known already. A round sends one row of sums for each task and entry.

Defined results: vectors that are NULL or hold NULL or non-finite components are dropped; shorter vectors are filled up
with zeros to the longest, and to a multiple of the number of parts; rows that share an id are ordered by vector, rows
without id come last; fewer rows than entries give as many entries as rows; repeated rows count each; numbers of any size
stay exact, but an error too large for a long is NULL, and so is the sum of a label that has one; an empty table gives an
empty table. Other input columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.llm.common import broadcastable, finite_vectors, materialize, matrix_of

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
ROWS_AT_ONCE = 2048
LONG = 1 << 62


def whole(v: np.ndarray, scale: int, kind: type) -> np.ndarray:
    """floor(scale * v) as long, or as Python's whole numbers where longs may be too small."""
    if kind is not object:
        return np.floor(v * scale).astype(np.int64)
    # From 2**53 on every double is a whole number, so nothing is left to round down.
    return np.array([math.floor(x * scale) if abs(x) < 1 << 53 else int(x) * scale for x in v.ravel().tolist()],
                    object).reshape(v.shape)


def _butterflies(x: np.ndarray) -> np.ndarray:
    shape, half = x.shape, 1
    while half < shape[-1]:
        x = x.reshape(*shape[:-1], -1, 2, half)
        x = np.stack([x[..., 0, :] + x[..., 1, :], x[..., 0, :] - x[..., 1, :]], axis=-2)
        half *= 2
    return x.reshape(shape)


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients over the last axis, which is padded to a power of two, in order of sign changes."""
    size = 1 << max(x.shape[-1] - 1, 0).bit_length()
    x = np.concatenate([x, np.zeros((*x.shape[:-1], size - x.shape[-1]), x.dtype)], axis=-1)
    waves = _butterflies(np.eye(size, dtype=np.int64))
    return _butterflies(x)[..., np.argsort((np.diff(waves, axis=1) != 0).sum(axis=1))]


def assign(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row (the lower on ties) and its squared distance; both sides transformed."""
    first = (rows[:, None, 0] - entries[None, :, 0]) ** 2
    bound = ((rows - entries[first.argmin(axis=1)]) ** 2).sum(axis=1)
    row, entry = np.nonzero(first <= bound[:, None])
    total = first[row, entry]
    for s in range(1, rows.shape[1]):
        total = total + (rows[row, s] - entries[entry, s]) ** 2
        left = np.flatnonzero(total <= bound[row])
        row, entry, total = row[left], entry[left], total[left]
    # The entry behind the bound is always left, so every row is there; entries ascend within a row.
    least = np.minimum.reduceat(total, np.searchsorted(row, np.arange(len(rows))))
    hits = np.flatnonzero(total == least[row])
    hits = hits[np.searchsorted(row[hits], np.arange(len(rows)))]
    return entry[hits], least // rows.shape[1]


def limbs(value: int, count: int) -> list[int]:
    """A whole number as ``count`` longs of 32 bits, the lowest first; sums of limbs are limbs of the sum."""
    return [value >> 32 * i & 0xFFFFFFFF if i + 1 < count else value >> 32 * i for i in range(count)]


class Codec:
    """Codebooks (parts x entries x components, whole numbers) and how to read vectors for them."""

    def __init__(self, books: np.ndarray, width: int, scale: int, kind: type):
        self.books, self.width, self.scale, self.kind = books, width, scale, kind
        self.transformed = transform(books)

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, its rows' vectors as rows x parts x components), a block at a time."""
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            v = whole(matrix_of(batch.column("v").slice(a, ROWS_AT_ONCE), self.width), self.scale, self.kind)
            yield a, v.reshape(len(v), len(self.books), -1)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row and part."""
        found = [assign(transform(parts[:, p]), self.transformed[p]) for p in range(parts.shape[1])]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
        scale: int = SCALE) -> Codec | None:
    """Codebooks from (id, v) of ``finite_vectors``; None without rows. The driver holds entries x width numbers."""
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(
        F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))).alias("most")).first()
    if not size["n"]:
        return None
    width = max(math.ceil(size["width"] / parts), 1) * parts
    most = (int(size["most"]) + 1) * scale
    padded = 1 << max(width // parts - 1, 0).bit_length()
    # Longs hold every coefficient, distance and sum that can occur, else Python's numbers do.
    kind = np.int64 if max(4 * padded ** 2 * most ** 2 * parts, size["n"] * most) < LONG else object
    many = 1 if kind is np.int64 else math.ceil((size["n"] * most).bit_length() / 32) + 1
    start = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    books = whole(matrix_of(start.column("v").combine_chunks(), width), scale, kind)
    books = books.reshape(len(books), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        sums = _sums(vectors, Codec(books, width, scale, kind), many)
        books = books.copy()
        for slot, count, values in sums:
            books[slot // books.shape[1], slot % books.shape[1]] = [value // count for value in values]
    return Codec(books, width, scale, kind)


def _sums(vectors: DataFrame, codec: Codec, many: int) -> list[tuple[int, int, list[int]]]:
    """(part and entry as one number, count, sums of components) of the entries that any part is assigned to."""
    shape = codec.books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(shape, codec.kind), np.zeros(shape[:2], np.int64)
        for batch in batches:
            for _, parts in codec.parts(batch):
                entry, _ = codec.nearest(parts)
                for p in range(shape[0]):
                    np.add.at(sums[p], entry[:, p], parts[:, p])
                    counts[p] += np.bincount(entry[:, p], minlength=shape[1])
        used = np.flatnonzero(counts)
        flat = sums.reshape(-1, shape[2])[used].tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(counts.ravel()[used], pa.int64()),
             pa.array([[x for value in row for x in limbs(value, many)] for row in flat], pa.list_(pa.int64()))],
            names=["slot", "n", "s"])

    partial = vectors.select("v").mapInArrow(run, "slot int, n bigint, s array<bigint>")
    size = shape[2] * many
    found = partial.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(size)])
    return [(r["slot"], r["n"], [sum(r[f"s{i + j}"] << 32 * j for j in range(many)) for i in range(0, size, many)])
            for r in found.collect()]


def encode(vectors: DataFrame, codec: Codec) -> DataFrame:
    """The columns beside v, then code (two hex digits a part) and error (squared distance)."""
    others = [c for c in vectors.columns if c != "v"]
    kinds = dict(vectors.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, parts in codec.parts(batch):
                entry, distance = codec.nearest(parts)
                errors = [e if e < 1 << 63 else None for e in distance.sum(axis=1).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, len(parts)) for c in others),
                     pa.array([row.tobytes().hex() for row in entry.astype(np.uint8)]), pa.array(errors, pa.int64())],
                    names=[*others, "code", "error"])

    return vectors.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", code string, error bigint")


def compress(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
             label_column: str = "label") -> DataFrame:
    """Per row: vec_id, label, code, error, label_error (errors summed over equal labels) and codebooks_sha256."""
    vectors = finite_vectors(df, id_column, vector_column, F.col(label_column).alias("label"))
    codec = fit(vectors.select("id", "v"))
    if codec is None:
        return vectors.filter("false").select(
            F.col("id").alias("vec_id"), "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
            F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    # Written, so that both sides of the join are plain shuffles, which AQE splits at hot labels.
    coded = materialize(encode(vectors, codec), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = materialize(coded.groupBy(F.col("label").alias("__label")).agg(
        F.when(F.count("error") == F.count(F.lit(1)), total).try_cast("long").alias("label_error")), "label-errors")
    joined = coded.join(broadcastable(sums, sums.count(), 64), F.col("label").eqNullSafe(F.col("__label")))
    return joined.select(F.col("id").alias("vec_id"), "label", "code", "error", "label_error",
                         F.lit(codec.digest()).alias("codebooks_sha256"))
