"""SimHash near duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints that differ in at most ``radius`` bits differ in at most
``radius // segments`` bits in one segment at least, so each fingerprint looks up the Hamming ball around each of its
segments in the table of that segment, and the complete distances of what it meets are verified. More fingerprints take
fewer, longer segments; all choices give the same links.

Copies share a fingerprint, so tables hold distinct fingerprints only. Looked-up buckets are verified in array blocks,
which give the edges of a spanning forest instead of all pairs; buckets above ``BUCKET`` rows are cut into slices, and
every pair of slices is a bucket of its own.

``similar`` links all texts whose word shingles have a Jaccard similarity of 0.8 or more. Texts that share a segment of one
of several independent fingerprints and are near in all of them are compared first, a spanning forest of them in each
bucket, which joins most groups. Whatever that left out meets again by its prefix: sets of n shingles that are similar share
one of the first n / 5 + 1 of them in any order that holds for all texts, here from rare to frequent. Each pair that does,
could be similar by its sizes and places, and is not in one component yet, is compared: no similar pair stays apart.

Defined results: NULL, empty and blank texts have the fingerprint zero, linked like any other; repeated rows keep their
rows; a NULL id keeps its row but never names a component that has another id; an empty table gives an empty table.
Other input columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tablefit.llm.common import blocks_of, broadcastable, map_batches, materialize, texts
from tablefit.llm.graph import components, spanning_edges

BITS = 64
SEED = 42
BUCKET = 4096  # rows of a bucket that are verified at a time
# Distinct fingerprints up to which each number of segments is used.
SEGMENTS = ((3, 50_000_000), (2, None))
# Fingerprints for similarities, their segments (as many at any size, so that links don't depend on it), the radius of
# candidates, and most connected ones of a bucket that all pairs are taken of.
PRINTS = 3
WIDE_SEGMENTS = 4
WIDE_RADIUS = 12
ALL_PAIRS = 4
# Share of the bits of all fingerprints together that a candidate may differ in: far above what similar texts have.
WIDE_SHARE = 0.25
# Counters that tell rare shingles from frequent ones, and how many of them travel together.
COUNTERS, COUNTERS_PER_ROW = 1 << 20, 1 << 14
# Texts that a task remembers, so that copies of them are not sent again.
REMEMBERED = 100_000
# Far above rounding errors, far below one shingle.
TOLERANCE = 1e-6


def shingle_hashes(text: bytes, words: int = 4) -> np.ndarray:
    """Hashes of the shingles of lower-cased UTF-8 text, repeats included; of fewer words, of all of them."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(part) + 1 for part in parts]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    return np.array([xxh64_intdigest(joined[a:b], SEED)
                     for a, b in zip(begins[:len(parts) - words + 1].tolist(), ends[words - 1:].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[a:a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash of lower-cased UTF-8 text over shingles of ``words`` words."""
    return majority(shingle_hashes(text, words))


def _mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Other hashes of the same shingles; seed 0 leaves them as they are."""
    if not seed:
        return hashes
    h = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _named(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """Distinct shingles, sorted, and a signed number for them."""
    found = np.unique(hashes)
    return found, int(np.uint64(xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def fingerprints(docs: DataFrame, words: int = 4, prints: int = 1, sets: bool = False) -> DataFrame:
    """(doc_id, th, fp, fp1, ...): th is a hash of the text, the fingerprints are signed longs.

    ``sets`` adds ``node``, a hash of the distinct shingles, and at the end of each task rows (part, counts) that say how
    many of its texts hold shingles of each counter; ``part`` is NULL in all others.
    """
    names = ["fp", *[f"fp{i}" for i in range(1, prints)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS if sets else 0, np.int64)
        for batch in batches:
            column = batch.column("text")
            for a, b in blocks_of(pc.binary_length(column).to_numpy(zero_copy_only=False)):
                hashes = [shingle_hashes(value, words) for value in column.slice(a, b - a).cast(pa.binary()).to_pylist()]
                found = [np.array([majority(_mixed(h, i)) for h in hashes], np.uint64).view(np.int64)
                         for i in range(prints)]
                columns = [batch.column("doc_id").slice(a, b - a), batch.column("th").slice(a, b - a), *map(pa.array, found)]
                if sets:
                    distinct, nodes = zip(*map(_named, hashes), strict=True)
                    total += np.bincount(_counter(np.concatenate(distinct)), minlength=COUNTERS)
                    columns += [pa.array(nodes, pa.int64()), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*schema])
        if total.any():
            parts = total.reshape(-1, COUNTERS_PER_ROW)
            held = np.flatnonzero(parts.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(held), pa.int64())] * (3 + prints) + [
                    pa.array(held, pa.int32()), pa.array([parts[i].astype(np.int32).tobytes() for i in held], pa.binary())],
                names=[*schema])

    schema = dict.fromkeys(["doc_id", "th", *names], "bigint")
    if sets:
        schema |= {"node": "bigint", "part": "int", "counts": "binary"}
    rows = texts(docs).withColumn("th", F.xxhash64("text"))
    return rows.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in schema.items()))


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(COUNTERS - 1)).astype(np.int64)


def shingle_levels(counted: DataFrame) -> np.ndarray:
    """Bits of the sum of each counter, from rows (part, counts). Their number is fixed; they are added in tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                found = np.frombuffer(counts, np.int32).astype(np.int64)
                total[part] = total[part] + found if part in total else found
        bits = [np.frexp(found.astype(float))[1].astype(np.uint8).tobytes() for found in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(bits, pa.binary())],
                                         names=["part", "bits"])

    levels = np.zeros(COUNTERS, np.uint8)
    for row in counted.repartition("part").mapInArrow(add, "part int, bits binary").collect():
        a = row["part"] * COUNTERS_PER_ROW
        levels[a:a + COUNTERS_PER_ROW] = np.frombuffer(row["bits"], np.uint8)
    return levels


def segments_for(distinct: int) -> int:
    return next(n for n, most in SEGMENTS if most is None or distinct <= most)


def _cuts(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _lookups(prints: np.ndarray, segments: int, flips_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket key, place of the fingerprint, own) of the home buckets and of the balls around them.

    A pair could meet in the home bucket of either; one is enough, so a ball holds no value below its centre.
    """
    keys, members, own = [], [], []
    for number, (shift, width) in enumerate(_cuts(segments)):
        value = (prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        for flips in range(flips_ + 1):
            for bits in combinations(range(width), flips):
                ball = value ^ np.uint64(sum(1 << bit for bit in bits))
                near = ball >= value
                keys.append(ball[near] * np.uint64(8) + np.uint64(number))
                members.append(np.flatnonzero(near))
                own.append(np.full(int(near.sum()), flips == 0))
    return np.concatenate(keys), np.concatenate(members), np.concatenate(own)


def _verify(prints: np.ndarray, own: np.ndarray, radius: int, reduced=spanning_edges) -> tuple[np.ndarray, np.ndarray]:
    """Edges (places) of one bucket: residents against all rows, block by block, each block's reduced with those before."""
    home = np.flatnonzero(own)
    left = right = np.array([], np.int64)
    step = max(1, (1 << 22) // max(1, len(prints)))
    for a in range(0, len(home), step):
        near = np.bitwise_count(prints[home[a:a + step], None] ^ prints[None, :]) <= radius
        i, y = np.nonzero(near)
        x = home[a + i]
        # Two residents meet once.
        once = (x < y) | (x > y) & ~own[y]
        left, right = reduced(np.concatenate([left, x[once]]), np.concatenate([right, y[once]]))
    return left, right


def _forest(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Places of pairs: all of small groups that they connect, the minimum spanning forest of larger ones.

    Whatever the pairs up to a distance connect, those of the forest up to that distance do.
    """
    if not len(x):
        return np.array([], np.int64)
    order = np.lexsort((y, x, apart))
    nodes, index = np.unique(np.concatenate([x[order], y[order]]), return_inverse=True)
    a, b = index[:len(x)], index[len(x):]
    root, left, taken = np.arange(len(nodes)), np.arange(len(x)), np.zeros(len(x), bool)
    while True:
        left = left[root[a[left]] != root[b[left]]]
        if not len(left):
            break
        nearest = np.full(len(nodes), len(x))
        np.minimum.at(nearest, root[a[left]], left)
        np.minimum.at(nearest, root[b[left]], left)
        chosen = np.unique(nearest[nearest < len(x)])
        taken[chosen] = True
        member, low = spanning_edges(root[a[chosen]], root[b[chosen]])
        merged = np.arange(len(nodes))
        merged[member] = low
        root = merged[root]
    taken |= np.bincount(root)[root[a]] <= ALL_PAIRS
    return order[taken]


def link_edges(prints: DataFrame, radius: int, segments: int, bucket: int = BUCKET, flips: int | None = None,
               others: tuple[str, ...] = (), apart: float = 0) -> DataFrame:
    """Edges (a, b) that connect exactly what links of at most ``radius`` bits connect. ``prints``: distinct fp.

    ``flips`` sets the balls' radius instead: then the edges are pairs of ``node`` (a column besides fp) within ``radius``
    that meet in some bucket and differ in at most ``apart`` bits of fp and the ``others`` together, for further checks: of
    more than a few that are connected in a bucket, the minimum spanning tree by that distance. A bucket of m rows gives
    less than 2 m of them.
    """
    pairs = flips is not None
    flips = radius // segments if flips is None else flips
    carried = ("node", *others) if pairs else ()

    def look_up(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = batch.column("fp").to_numpy().view(np.uint64)
        for a in range(0, len(values), 2000):
            keys, places, own = _lookups(values[a:a + 2000], segments, flips)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(own),
                 *[batch.column(c).slice(a, 2000).take(pa.array(places)) for c in ("fp", *carried)]],
                names=["key", "own", "fp", *carried])

    rows = map_batches(prints, look_up, "key bigint, own boolean, fp bigint" + "".join(f", {c} bigint" for c in carried))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("home"))
    large = sizes.filter((F.col("n") > bucket) & F.col("home")).select(
        "key", F.ceil(F.col("n") / bucket).cast("int").alias("slices"))
    large = materialize(large, "large-buckets")
    rows = rows.join(large, "key", "left") if large.first() else rows.withColumn("slices", F.lit(None).cast("int"))
    slice_of = F.pmod(F.xxhash64("node" if pairs else "fp"), "slices").cast("int")
    rows = rows.select("key", "fp", "own", *carried, F.explode(F.when(
        F.col("slices").isNull(), F.array(F.lit(0))).otherwise(F.transform(
            F.sequence(F.lit(0), F.col("slices") - 1),
            lambda t: F.least(t, slice_of) * F.col("slices") + F.greatest(t, slice_of)))).alias("slice"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.array([], np.int64),) * 2 + (np.array([], np.uint64), np.array([], bool)) + (
            np.array([], np.int64),) * len(carried)
        for batch in _with_end(batches):
            if batch is None:
                cut, now = len(rest[0]), rest
            else:
                now = tuple(np.concatenate([r, c]) for r, c in zip(rest, (
                    batch.column("key").to_numpy(), batch.column("slice").to_numpy().astype(np.int64),
                    batch.column("fp").to_numpy().view(np.uint64),
                    batch.column("own").to_numpy(zero_copy_only=False),
                    *[batch.column(c).to_numpy() for c in carried]), strict=True))
                change = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0))
                cut = int(change[-1]) + 1 if len(change) else 0
            rest = tuple(x[cut:] for x in now)
            keys, parts, prints_, own, *more = (x[:cut] for x in now)
            if not cut:
                continue
            begins = np.concatenate([[0], np.flatnonzero((np.diff(keys) != 0) | (np.diff(parts) != 0)) + 1, [cut]])
            sizes_ = np.diff(begins)
            left, right = [], []
            # Pairs of small buckets by offset, for all buckets at a time.
            bucket_of = np.repeat(np.arange(len(sizes_)), sizes_)
            small = sizes_ <= 64
            for offset in range(1, int(sizes_[small].max(initial=1))):
                x, y = np.arange(cut - offset), np.arange(offset, cut)
                same = (bucket_of[x] == bucket_of[y]) & small[bucket_of[x]]
                x, y = x[same], y[same]
                near = (own[x] | own[y]) & (np.bitwise_count(prints_[x] ^ prints_[y]) <= radius)
                left.append(x[near])
                right.append(y[near])
            def wide(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                far = np.bitwise_count(prints_[x] ^ prints_[y]).astype(np.int64)
                for other in more[1:]:
                    far += np.bitwise_count((other[x] ^ other[y]).view(np.uint64))
                x, y, far = x[far <= apart], y[far <= apart], far[far <= apart]
                best = _forest(x, y, far)
                return x[best], y[best]

            if left and pairs:
                x, y = wide(np.concatenate(left), np.concatenate(right))
                left, right = [x], [y]
            for k in np.flatnonzero(~small).tolist():
                a, b = begins[k], begins[k + 1]
                x, y = _verify(prints_[a:b], own[a:b], radius, (
                    lambda x, y, a=a: tuple(z - a for z in wide(a + x, a + y))) if pairs else spanning_edges)
                left.append(a + x)
                right.append(a + y)
            if left:
                x, y = np.concatenate(left), np.concatenate(right)
                if pairs:
                    x, y = more[0][x], more[0][y]
                    x, y = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                else:
                    x, y = spanning_edges(prints_[x].view(np.int64), prints_[y].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    dealt = rows.repartition("key", "slice").sortWithinPartitions("key", "slice", "fp", *carried)
    return dealt.select("key", "slice", "fp", "own", *carried).mapInArrow(verify, "a bigint, b bigint")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, segments: int | None = None,
                    bucket: int = BUCKET) -> DataFrame:
    """Per row: doc_id, th, fp (signed long) and component_id, the smallest doc_id that links reach."""
    rows = materialize(fingerprints(docs, words), "prints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-prints")
    edges = link_edges(prints.select("fp"), radius, segments or segments_for(prints.count()), bucket)
    roots = materialize(components(edges), "roots")
    joined = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    named = joined.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "th", "fp", "component_id")


def shingle_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shingles): distinct shingle hashes of the text (id, th) that stands for each node."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column("text")
        for a, b in blocks_of(pc.binary_length(column).to_numpy(zero_copy_only=False)):
            sets = [np.unique(shingle_hashes(value, words)).view(np.int64)
                    for value in column.slice(a, b - a).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))],
                                             names=["node", "shingles"])

    rows = texts(docs).withColumn("th", F.xxhash64("text"))
    standing = broadcastable(nodes, nodes.count(), 32)
    rows = rows.join(standing, rows["doc_id"].eqNullSafe(standing["id"]) & (rows["th"] == standing["node_th"]))
    # Repeated rows stand for a node once.
    return map_batches(rows.select("node", "text").dropDuplicates(["node"]), run, "node bigint, shingles array<bigint>")


def candidates(nodes: DataFrame, names: list[str], radius: int, bucket: int = BUCKET, flips: int = 1) -> DataFrame:
    """Distinct pairs (a, b), a < b, of nodes that are near in one of their fingerprints and not far in all together."""
    apart = WIDE_SHARE * BITS * len(names)
    edges = []
    for name in names:
        # All fingerprints together tell candidates that only happen to be near in one.
        others = {f"other{i}": n for i, n in enumerate(names) if n != name}
        prints = nodes.select("node", F.col(name).alias("fp"), *[F.col(n).alias(o) for o, n in others.items()])
        edges.append(link_edges(prints, radius, WIDE_SEGMENTS, bucket, flips, tuple(others), apart))
    return reduce(DataFrame.unionByName, edges).distinct()


def prefixes(docs: DataFrame, levels: np.ndarray, similarity: float, words: int, bucket: int = BUCKET) -> DataFrame:
    """(node, size, keys, hot): number of distinct shingles, the first ones of them from rare to frequent, as many as
    similar sets need to share one, and those of them whose counter allows more than ``bucket`` texts."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = shared.value, set()
        for batch in batches:
            column = batch.column("text")
            for a, b in blocks_of(pc.binary_length(column).to_numpy(zero_copy_only=False)):
                found = []
                for value in column.slice(a, b - a).cast(pa.binary()).to_pylist():
                    shingles, node = _named(shingle_hashes(value, words))
                    if node in seen or not len(shingles):
                        continue
                    seen.add(node)
                    level = levels[_counter(shingles)]
                    most = len(shingles) - math.ceil(similarity * len(shingles) - TOLERANCE) + 1
                    first = np.argsort(level, kind="stable")[:most]
                    keys = shingles.view(np.int64)[first]
                    found.append((node, len(shingles), keys, keys[2.0 ** level[first] > bucket]))
                if len(seen) > REMEMBERED:
                    seen.clear()
                if found:
                    node, size, keys, hot = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                         pa.array(hot, pa.list_(pa.int64()))], names=["node", "size", "keys", "hot"])

    return texts(docs).select("text").mapInArrow(
        run, "node bigint, size bigint, keys array<bigint>, hot array<bigint>")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of batches of longs, cut where the first two columns change, and where their runs begin."""
    rest = None
    for batch in _with_end(batches):
        if batch is None:
            now, cut = rest, 0 if rest is None else len(rest[0])
        else:
            now = tuple(c.to_numpy() for c in batch.columns)
            now = now if rest is None else tuple(np.concatenate(both) for both in zip(rest, now, strict=True))
            change = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0))
            cut = int(change[-1]) + 1 if len(change) else 0
            rest = tuple(x[cut:] for x in now)
        if cut:
            done = tuple(x[:cut] for x in now)
            change = np.flatnonzero((np.diff(done[0]) != 0) | (np.diff(done[1]) != 0)) + 1
            yield *done, np.concatenate([[0], change, [cut]])


def prefix_pairs(rows: DataFrame, roots: DataFrame, similarity: float, bucket: int = BUCKET) -> DataFrame:
    """Distinct pairs (a, b), a < b, of nodes in different components that could have the similarity: they share a key of
    their prefixes, and what follows it in both sets is enough.

    ``rows``: what ``prefixes`` gives; ``roots``: (node, root) of those in components. Keys of more than ``bucket`` rows are
    cut into slices, and every pair of slices is a bucket of its own.
    """
    large = rows.select(F.explode("hot").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > bucket).select("key", F.ceil(F.col("n") / bucket).cast("long").alias("slices"))
    large = materialize(large, "large-prefixes")
    rows = rows.join(broadcastable(roots, roots.count(), 16), "node", "left")
    rows = rows.select("node", F.coalesce("root", "node").alias("root"), "size", F.posexplode("keys").alias("place", "key"))
    slices = large.count()
    rows = rows.join(broadcastable(large, slices, 16), "key", "left") if slices else rows.withColumn(
        "slices", F.lit(None).cast("long"))
    slice_of = F.pmod(F.xxhash64("node"), "slices")
    rows = rows.select("key", F.explode(F.when(F.col("slices").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("slices") - 1),
        lambda t: F.least(t, slice_of) * F.col("slices") + F.greatest(t, slice_of)))).alias("slice"),
        "node", "root", "size", F.col("place").cast("long").alias("place"))
    share = similarity / (1 + similarity)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, node, root, size, place, begins in _buckets(batches):
            lengths = np.diff(begins)

            def possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                left = np.minimum(size[x] - place[x], size[y] - place[y])
                return (root[x] != root[y]) & (left >= share * (size[x] + size[y]) - TOLERANCE)

            def pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
                found = np.unique(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])]), axis=1)
                return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

            bucket_of = np.repeat(np.arange(len(lengths)), lengths)
            small = lengths <= 64
            for offset in range(1, int(lengths[small].max(initial=1))):
                x = np.flatnonzero((bucket_of[:-offset] == bucket_of[offset:]) & small[bucket_of[offset:]])
                x = x[possible(x, x + offset)]
                if len(x):
                    yield pairs(x, x + offset)
            for k in np.flatnonzero(~small).tolist():
                a, b = int(begins[k]), int(begins[k + 1])
                step = max(1, (1 << 20) // (b - a))
                for i in range(a, b, step):
                    x, y = np.arange(i, min(i + step, b))[:, None], np.arange(i + 1, b)[None, :]
                    p, q = np.nonzero(possible(x, y) & (x < y))
                    if len(p):
                        yield pairs(x[p, 0], y[0, q])

    dealt = rows.repartition("key", "slice").sortWithinPartitions("key", "slice")
    return dealt.mapInArrow(meet, "a bigint, b bigint").distinct()


def similar_pairs(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float, words: int) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have the similarity."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    standing = nodes.join(ends, "node").select("node", F.col("place.doc_id").alias("id"), F.col("place.th").alias("node_th"))
    # Written, so that AQE can split the joins where one text has very many candidates.
    sets = materialize(shingle_sets(docs, materialize(standing, "standing"), words), "shingle-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    shared = F.size(F.array_intersect("left", "right"))
    links = both.filter(shared >= F.lit(similarity) * (F.size("left") + F.size("right") - shared)).select("a", "b")
    return materialize(links, "links")


def similar(docs: DataFrame, similarity: float = 0.8, words: int = 5, prints: int = PRINTS, radius: int = WIDE_RADIUS,
            bucket: int = BUCKET) -> DataFrame:
    """Per row: doc_id, th, node (a hash of the shingle set) and component_id, the smallest doc_id that links reach.

    Links are all pairs of texts whose shingle sets have a Jaccard similarity of ``similarity`` or more. Texts whose
    fingerprints share a segment are compared first; pairs by prefix only where these links left them apart. Each text that
    is compared travels once for each pair.
    """
    names = ["fp", *[f"fp{i}" for i in range(1, prints)]]
    found = materialize(fingerprints(docs, words, prints, sets=True), "prints")
    rows = found.filter("part IS NULL").select("doc_id", "th", "node", *names)
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "th", *names)).alias("place"))
    nodes = materialize(nodes.select("node", "low", "place", *[F.col(f"place.{n}").alias(n) for n in names]), "distinct-sets")
    # Prefixes find what the segments miss, so no balls are looked up around them.
    near = materialize(candidates(nodes, names, radius, bucket, flips=0), "candidates")
    roots = materialize(components(similar_pairs(docs, nodes, near, similarity, words)), "roots")
    levels = shingle_levels(found.filter("part IS NOT NULL").select("part", "counts"))
    keys = materialize(prefixes(docs, levels, similarity, words, bucket), "prefixes")
    pairs = materialize(prefix_pairs(keys, roots, similarity, bucket), "prefix-pairs")
    links = similar_pairs(docs, nodes, pairs, similarity, words)
    if links.first():
        joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = materialize(components(links.unionByName(joined)), "roots")
    joined = nodes.join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    named = joined.join(lowest, "root").select("node", "component_id")
    return rows.join(named, "node").select("doc_id", "th", "node", "component_id")


def one_of_each(docs: DataFrame, found: DataFrame | None = None, key: str = "node") -> DataFrame:
    """One row of each component, that of the smallest doc_id (same id: smallest text hash); all columns of ``docs``.

    ``found`` has doc_id, th, the key of equal fingerprints and component_id (the result of ``similar`` by default). Rows
    without id stay only where their component has no id at all; of rows with equal id and text one stays.
    """
    found = similar(docs) if found is None else found
    found = materialize(found, "components")
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id", F.when(
        F.col("component_id").isNull(), F.col(key)).alias("lone")).agg(F.min("th").alias("th"))
    kept = materialize(kept.select(F.col("component_id").alias("__id"), F.col("th").alias("__kept_th")), "kept")
    rows = docs.withColumn("__th", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = rows.join(broadcastable(kept, kept.count(), 32), (rows["__th"] == kept["__kept_th"]) & rows[
        "doc_id"].cast("long").eqNullSafe(kept["__id"]), "left_semi")
    again = found.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (joined.dropDuplicates(["doc_id", "__th"]) if again.first() else joined).drop("__th")


def as_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
