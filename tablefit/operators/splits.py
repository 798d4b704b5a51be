"""Train/test splits as a column: the cut is a key found by rank, so no row is moved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefit.functions.stats import scatter
from tablefit.operators.columns import lenient_timestamp
from tablefit.operators.profile import class_shares
from tablefit.operators.select import with_tile

MIN_ROWS = 20


def _parts(tile: Column, names: Sequence[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), tile + 1)


def train_rows(n: Column, test_share: float) -> Column:
    """Rows left for training when the test part is rounded up."""
    return n - F.ceil(F.round(n * F.lit(test_share), 9))


def random_split(df: DataFrame, key: str, test_share: float = 0.3, seed: int = 42, by: Sequence[str] = (),
                 exact: bool = True, **options) -> DataFrame:
    """Add ``part`` by hash order of a unique integer key.

    ``exact`` gives the precise sizes; otherwise each row is drawn on its own,
    without any pass over the table.
    """
    spread = df.withColumn("__h", scatter(F.col(key), seed))
    if not exact:
        late = F.pmod(F.col("__h"), F.lit(1000003)) % 10000 >= round((1 - test_share) * 10000)
        return spread.withColumn("part", F.when(late, "test").otherwise("train")).drop("__h")
    cut = [lambda n: train_rows(n, test_share)]
    tiled = with_tile(spread, ["__h", key], cut, by, "__tile", **options)
    return tiled.withColumn("part", _parts(F.col("__tile"), ["train", "test"])).drop("__h", "__tile")


def stratified_split(df: DataFrame, key: str, target: str, test_share: float = 0.3, seed: int = 42,
                     exact: bool = True, **options) -> DataFrame:
    """Random split within each class; plain random when a class has a single row."""
    counts = class_shares(df, target).agg(F.min("n")).first()[0]
    by = [target] if (counts or 0) >= 2 else []
    return random_split(df, key, test_share, seed, by, exact, **options)


def chronological_split(df: DataFrame, time: str, row_order: str, train_share: float = 0.7,
                        by: Sequence[str] = (), **options) -> DataFrame:
    """The earliest rows train, the latest test; rows without a readable time are left out."""
    timed = df.withColumn("__at", lenient_timestamp(df, time)).filter("__at is not null")
    cut = [lambda n: F.floor(n * F.lit(train_share))]
    tiled = with_tile(timed, ["__at", row_order], cut, by, "__tile", **options)
    return tiled.withColumn("part", _parts(F.col("__tile"), ["train", "test"])).drop("__at", "__tile")


def three_way_split(df: DataFrame, keys: Sequence[str], shares: tuple[float, float] = (0.6, 0.8),
                    by: Sequence[str] = (), **options) -> DataFrame:
    """60 % train, 20 % calibration, 20 % test in the order of the keys."""
    cuts = [lambda n, s=s: F.floor(n * F.lit(s)) for s in shares]
    tiled = with_tile(df, keys, cuts, by, "__tile", **options)
    return tiled.withColumn("part", _parts(F.col("__tile"), ["train", "calibration", "test"])).drop("__tile")


def three_way_random(df: DataFrame, key: str, seed: int = 42, by: Sequence[str] = (), **options) -> DataFrame:
    spread = df.withColumn("__h", scatter(F.col(key), seed))
    return three_way_split(spread, ["__h", key], by=by, **options).drop("__h")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in a repeatable random order (a distributed sort on the hash)."""
    return df.orderBy(scatter(F.col(key), seed), key)


def split_checks(parts: DataFrame, key: str, time: str | None = None) -> DataFrame:
    """Sizes, keys found in both parts, and whether training ends before testing starts."""
    train, test = F.col("part") == "train", F.col("part") == "test"
    per_key = parts.groupBy(key).agg(
        F.max(train.cast("int")).alias("a"), F.max(test.cast("int")).alias("b"))
    shared = per_key.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).cast("long").alias("shared_keys"))
    sizes = [F.count_if(train).alias("train_rows"), F.count_if(test).alias("test_rows")]
    if time:
        at = lenient_timestamp(parts, time)
        sizes.append((F.max(F.when(train, at)) < F.min(F.when(test, at))).alias("in_time_order"))
    return parts.agg(*sizes).crossJoin(F.broadcast(shared))
