"""Order-free hashes of key sets and tables, and comparison of two result tables.

A set is hashed as a tree: keys fall into buckets of bounded size, each bucket
is hashed in sorted order, and bucket hashes are hashed again until one is
left. Adding executors splits the work; no group grows with the table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefit.functions.frames import join_on
from tablefit.functions.stats import folded, missing

FAN_IN = 4096
PRIME = 2147483647


def bucket_count(n: int, fan_in: int = FAN_IN) -> int:
    return max(1, math.ceil(n / fan_in))


def _fold(hashes: DataFrame, by: list[str], buckets: int, fan_in: int) -> DataFrame:
    """Reduce ``bucket, digest`` rows level by level to one digest per segment."""
    while True:
        last = buckets <= fan_in
        group = F.lit(0).cast("long") if last else F.floor(F.col("bucket") / fan_in)
        entry = F.struct("bucket", "digest")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["digest"]), ",")
        hashes = hashes.groupBy(*by, group.alias("parent")).agg(F.sha2(joined, 256).alias("digest"))
        hashes = hashes.withColumnRenamed("parent", "bucket")
        if last:
            return hashes
        buckets = math.ceil(buckets / fan_in)


def id_set_hash(df: DataFrame, key: str, by: Sequence[str] = (), fan_in: int = FAN_IN) -> DataFrame:
    """Count and SHA-256 of the set of integer keys, whatever their order or width."""
    by = list(by)
    ids = df.select(*by, F.col(key).cast("long").alias("id")).filter("id is not null").distinct()
    buckets = bucket_count(ids.count(), fan_in)
    spread = folded(F.col("id")) * F.lit(2654435761)
    bucket = F.pmod(F.pmod(spread, F.lit(PRIME)), F.lit(buckets))
    leaves = ids.groupBy(*by, bucket.alias("bucket")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ","), 256)
        .alias("digest"),
        F.count(F.lit(1)).alias("c"),
    )
    counts = leaves.groupBy(*by).agg(F.sum("c").alias("ids"))
    return join_on(counts, _fold(leaves.drop("c"), by, buckets, fan_in).drop("bucket"), by)


def row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of a row; each cell goes in behind its length, so no text can pose as two cells."""
    texts = {c: F.col(c).cast("string") for c in columns}
    cells = [F.when(missing(df, c), F.lit("~")).otherwise(F.concat(F.length(x).cast("string"), F.lit("="), x))
             for c, x in texts.items()]
    return F.sha2(F.concat_ws("|", *cells), 256)


def content_hash(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (),
                 fan_in: int = FAN_IN) -> DataFrame:
    """Count and SHA-256 of the rows as a multiset; copies are counted before they are hashed."""
    by = list(by)
    columns = [c for c in (columns or df.columns) if c not in by]
    rows = df.select(*by, row_digest(df, columns).alias("row")).groupBy(*by, "row").agg(
        F.count(F.lit(1)).alias("c"))
    buckets = bucket_count(df.count(), fan_in)
    bucket = F.pmod(F.conv(F.substring("row", 1, 12), 16, 10).cast("long"), F.lit(buckets))
    entries = F.array_sort(F.collect_list(F.concat(F.col("row"), F.lit(":"), F.col("c").cast("string"))))
    leaves = rows.groupBy(*by, bucket.alias("bucket")).agg(
        F.sha2(F.array_join(entries, ","), 256).alias("digest"), F.sum("c").alias("c"))
    counts = leaves.groupBy(*by).agg(F.sum("c").alias("rows"))
    return join_on(counts, _fold(leaves.drop("c"), by, buckets, fan_in).drop("bucket"), by)


def immutability(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Do both tables hold the same keys? Counts, hashes, and keys found on one side only."""
    a, b = id_set_hash(before, key), id_set_hash(after, key)
    sides = before.select(F.col(key).alias("k"), F.lit(1).alias("s")).unionByName(
        after.select(F.col(key).alias("k"), F.lit(-1).alias("s")))
    moved = sides.groupBy("k").agg(F.sum("s").alias("s")).agg(F.count_if(F.col("s") != 0).alias("changed_keys"))
    joined = a.select(F.col("ids").alias("ids_before"), F.col("digest").alias("hash_before")).crossJoin(
        b.select(F.col("ids").alias("ids_after"), F.col("digest").alias("hash_after")))
    return joined.crossJoin(moved).withColumn(
        "immutable", (F.col("hash_before") == F.col("hash_after")) & (F.col("changed_keys") == 0))


def compare_runs(first: DataFrame, second: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of two runs matched on keys: how many differ, per column and overall."""
    keys, columns = list(keys), list(columns)
    a = first.select(*keys, F.lit(True).alias("__a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = second.select(*[F.col(k).alias(f"__{k}") for k in keys], F.lit(True).alias("__b"),
                      *[F.col(c).alias(f"b_{c}") for c in columns])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    joined = a.join(b, on, "full_outer")
    paired = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    differs = {c: paired & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in columns}
    any_differs = reduce(lambda x, y: x | y, differs.values())
    return joined.agg(
        F.count_if(paired).alias("paired"), F.count_if(F.col("__b").isNull()).alias("only_first"),
        F.count_if(F.col("__a").isNull()).alias("only_second"), F.count_if(any_differs).alias("mismatches"),
        *[F.count_if(d).alias(f"mismatch_{c}") for c, d in differs.items()],
    )


def split_receipt(parts: DataFrame, key: str, features: Sequence[str], target: str | None = None,
                  parameters: dict[str, object] | None = None, log: Sequence[str] = (),
                  metrics: dict[str, float | None] | None = None) -> DataFrame:
    """One row per part: hash, count, features and target, and what a later audit needs to repeat the run: parameters
    (as text), the actions that were done, in order, and the metrics that came out."""
    hashed = id_set_hash(parts, key, ["part"])
    none = F.create_map().cast("map<string,string>")
    given = F.create_map(*[F.lit(x) for k, v in (parameters or {}).items() for x in (k, str(v))]) if parameters else none
    measured = F.create_map(*[x for k, v in (metrics or {}).items() for x in (F.lit(k), F.lit(v).cast("double"))]) \
        if metrics else F.create_map().cast("map<string,double>")
    return hashed.select(
        "part", F.col("ids").alias("rows"), F.col("digest").alias("key_hash"),
        F.lit(",".join(features)).alias("features"), F.lit(target).alias("target"),
        given.alias("parameters"), F.array(*map(F.lit, log)).cast("array<string>").alias("log"), measured.alias("metrics"),
    )
