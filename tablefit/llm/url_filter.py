"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

Only DataFrame functions are used. A rule is a host and the beginning of a path; it fits its host and all subdomains.
Every URL yields one key for each (host suffix of as many labels as a listed host may have, listed path length); keys that
pass the Bloom filter are joined exactly
with the list, and the longest fitting rule wins (same length: the longer host).

Defined results: NULL or text without ``://`` has an empty host and path, fits no rule and gets the default verdict;
repeated rows keep their rows; an empty table gives an empty table; an empty list gives every row the default verdict;
of two rules with the same host and path the smaller verdict counts. Other input columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefit.llm.common import broadcastable

BITS_PER_KEY = 16
WORDS = 4  # a block is four 64-bit words; a key sets one bit in each
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical_host(url: Column) -> Column:
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def canonical_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(key: Column) -> list[Column]:
    second = F.xxhash64(F.lit(1), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"),
                            F.shiftright(second, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
            for i in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of the strings in column ``key``; combined before the shuffle, one row per block."""
    bits = _bits(F.col("key"))
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(
        *[F.bit_or(bit).alias(f"w{i}") for i, bit in enumerate(bits)])


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",),
                default: str = "allow") -> DataFrame:
    """Judge every row of ``pages`` by ``rules(host, path, verdict)``; returns keep + host, path, rule, verdict."""
    listed = (
        rules.filter(F.col("host").isNotNull())
        .select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"),
                "verdict")
        .groupBy("rule_host", "rule_path").agg(F.min("verdict").alias("verdict"))
        .withColumn("key", F.concat("rule_host", "rule_path"))
    )
    # Path lengths are numbers of characters of listed paths: a short array, whatever the number of rules.
    # No host suffix of more labels than any listed host has can be listed.
    size = listed.agg(F.count("key").alias("n"), F.collect_set(F.length("rule_path")).alias("lengths"),
                      F.max(F.size(F.split("rule_host", r"\."))).alias("labels")).first()
    judged = pages.select(*keep, canonical_host(F.col(url)).alias("host"), canonical_path(F.col(url)).alias("path"))
    if not size["n"]:
        return judged.select(*keep, "host", "path", F.lit(None).cast("string").alias("rule"),
                             F.lit(default).alias("verdict"))
    blocks = math.ceil(size["n"] * BITS_PER_KEY / (64 * WORDS))
    bloom = broadcastable(bloom_filter(listed, blocks), blocks, 8 * (WORDS + 1))
    labels = F.split("host", r"\.")
    labels = F.slice(labels, F.greatest(F.size(labels) - size["labels"] + 1, F.lit(1)), size["labels"])
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.array(*[F.lit(n) for n in sorted(size["lengths"])])
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    bits = _bits(F.col("key"))
    possible = (
        judged.filter(F.col("host") != "").select("host", "path").distinct()
        .withColumn("key", F.explode(F.array_distinct(keys)))
        .withColumn("block", _block(F.col("key"), blocks)).join(bloom, "block")
        .filter(reduce(and_, [F.col(f"w{i}").bitwiseAND(bit) == bit for i, bit in enumerate(bits)]))
        .select("host", "path", "key")
    )
    exact = possible.join(broadcastable(listed, size["n"], 300), "key")
    best = exact.groupBy("host", "path").agg(
        F.max(F.struct(F.length("key").alias("long"), F.length("rule_host").alias("host_long"),
                       F.col("key").alias("rule"), "verdict")).alias("best"))
    return (
        judged.join(best, ["host", "path"], "left")
        .select(*keep, "host", "path", F.col("best.rule").alias("rule"),
                F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )

