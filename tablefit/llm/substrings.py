"""Repeated-substring removal by deep-shallow suffix sorting.

A byte goes when it lies in a string of ``length`` bytes that starts at another place too, in the same or another text.

1. *Anchors.* Every window of ``length`` bytes has an anchor: its 32-byte string with the smallest hash (leftmost on
   ties). Equal windows have equal anchors at equal offsets. Consecutive windows with one anchor form a stretch.
2. *Candidates.* Only stretches whose anchor hash occurs twice can hold repeated windows. Stretches with equal bytes form
   a class; a class with two members is repeated as a whole.
3. *Suffix sorting.* Where an anchor has several classes, the suffixes at all window starts of these classes are sorted
   up to ``length`` bytes: multikey quicksort, a word of eight bytes at a time, to a shallow depth; groups that are still
   together are ordered by a blind trie, which skips the bytes that a group has in common and branches at the first
   difference. Suffixes that end in one leaf are equal windows. An anchor with more than ``GROUP`` classes is cut into
   slices; leaves of the slices are then matched by 128-bit digests with pre-aggregated counts, first of the bytes that
   neighbouring windows share, then, where these occur twice, of the windows.
4. *Cut.* The repeated windows of each row are merged into spans and cut out.

Defined results: NULL and empty texts have no bytes and stay empty; texts below ``length`` bytes keep all; repeated rows
(same id and text too) are copies of each other; rows that share an id are told apart by their text; an empty table
gives an empty table. Other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from tablefit.llm.common import blocks_of, map_batches, materialize

GRAM = 32
POSITION = np.uint64((1 << 24) - 1)
CHUNK = 4 << 20  # bytes of one text that are turned into arrays at a time; below 2**24
SHALLOW = 16  # bytes ordered by multikey quicksort
GROUP = 1024  # classes of an anchor that are sorted together
BLOCK = 8  # windows next to each other that are compared between slices together
SORT_BYTES = 1 << 20
BYTE_CODES = np.random.default_rng(32).integers(1, 1 << 63, 256, dtype=np.uint64)
FACTORS = np.random.default_rng(64).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
OCCURRENCE = "d bigint, th bigint, start bigint, anchor bigint, cls bigint, off int, n int"
CLASS = ["anchor", "off", "n", "cls"]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each position on."""
    h, width = BYTE_CODES[data], 1
    for factor in FACTORS[:5]:
        h = h[:-width] * factor + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return h


def stretches(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(start, n, offset of the anchor, anchor hash) of every stretch of the texts data[begin:end]."""
    grams = gram_hashes(data)
    least = (grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64)
    width, need = 1, length - GRAM + 1
    while width * 2 <= need:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if need > width:
        least = np.minimum(least[:len(least) - (need - width)], least[need - width:])
    sizes = np.maximum(ends - begins - length + 1, 0)
    starts = np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    anchors = (least[starts] & POSITION).astype(np.int64)
    first = np.flatnonzero(np.diff(anchors, prepend=-1))
    n = np.diff(first, append=len(anchors))
    return starts[first], n, anchors[first] - starts[first], grams[anchors[first]].view(np.int64)


def occurrences(rows: DataFrame, length: int) -> DataFrame:
    """Every stretch of every row (d, th, text)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column("text")
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
        d, th = batch.column("d").to_numpy(), batch.column("th").to_numpy()
        for a, b in blocks_of(sizes):
            values = column.slice(a, b - a).cast(pa.binary()).to_pylist()
            # (row, place in the text, bytes): long texts overlap by length - 1 bytes.
            parts = [(a + i, at, value[at:at + CHUNK + length - 1]) for i, value in enumerate(values)
                     for at in range(0, max(len(value) - length + 1, 0), CHUNK)]
            for x, y in blocks_of(np.array([len(p[2]) for p in parts], np.int64)):
                raw = b"".join(p[2] for p in parts[x:y])
                ends = np.cumsum([len(p[2]) for p in parts[x:y]])
                begins = np.concatenate([[0], ends[:-1]])
                start, n, off, anchor = stretches(np.frombuffer(raw, np.uint8), begins, ends, length)
                part = np.searchsorted(ends, start, side="right")
                row = np.array([p[0] for p in parts[x:y]])[part]
                place = np.array([p[1] for p in parts[x:y]])[part]
                cls = np.array([xxh3_64_intdigest(raw[s:s + m + length - 1])
                                for s, m in zip(start.tolist(), n.tolist())], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d[row]), pa.array(th[row]), pa.array(start - begins[part] + place), pa.array(anchor),
                     pa.array(cls), pa.array(off.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["d", "th", "start", "anchor", "cls", "off", "n"])

    return map_batches(rows, run, OCCURRENCE)


def sort_suffixes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Leaf number of the suffix at each start: equal exactly where the next ``length`` bytes are equal."""
    leaf = np.full(len(starts), -1)
    if not len(starts):
        return leaf
    # Shallow: multikey quicksort by words of eight bytes; groups of one are done.
    group, alive, leaves = np.zeros(len(starts), np.int64), np.arange(len(starts)), 0
    windows = np.lib.stride_tricks.sliding_window_view(data, 8)
    for depth in range(0, SHALLOW, 8):
        word = np.ascontiguousarray(windows[starts[alive] + depth]).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((word, group))
        alive, word, group = alive[order], word[order], group[order]
        alive, group, leaves = _split(alive, (np.diff(group) != 0) | (np.diff(word) != 0), leaf, leaves)
    # Deep: a blind trie of every group that is left, all of them level by level.
    windows = np.lib.stride_tricks.sliding_window_view(data, length - SHALLOW)
    while len(alive):
        first = np.flatnonzero(np.diff(group, prepend=-1))
        head = np.repeat(first, np.diff(first, append=len(alive)))
        same_to = np.empty(len(alive), np.int64)
        for a in range(0, len(alive), 1 << 14):
            part = slice(a, a + (1 << 14))
            differs = windows[starts[alive[part]] + SHALLOW] != windows[starts[alive[head[part]]] + SHALLOW]
            same_to[part] = np.where(differs.any(axis=1), differs.argmax(axis=1), length - SHALLOW)
        skip = np.repeat(np.minimum.reduceat(same_to, first), np.diff(first, append=len(alive)))
        done = skip == length - SHALLOW
        ends = np.flatnonzero(done & np.isin(np.arange(len(alive)), first))
        numbers = np.cumsum(np.isin(np.arange(len(alive)), ends)) - 1 + leaves
        leaf[alive[done]] = numbers[done]
        leaves += len(ends)
        alive, group, skip = alive[~done], group[~done], skip[~done]
        branch = data[starts[alive] + SHALLOW + skip]
        order = np.lexsort((branch, group))
        alive, branch, group = alive[order], branch[order], group[order]
        alive, group, leaves = _split(alive, (np.diff(group) != 0) | (np.diff(branch) != 0), leaf, leaves)
    return leaf


def _split(alive: np.ndarray, change: np.ndarray, leaf: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray, int]:
    """New groups after a sort; suffixes that are alone become leaves."""
    group = np.concatenate([[0], np.cumsum(change)]) if len(alive) else np.zeros(0, np.int64)
    alone = np.bincount(group)[group] == 1 if len(alive) else np.zeros(0, bool)
    leaf[alive[alone]] = leaves + np.arange(int(alone.sum()))
    return alive[~alone], group[~alone], leaves + int(alone.sum())


def extract_classes(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of one member of every class in ``wanted(d, th, start, class columns, copies, slice, slices)``."""
    names = [*CLASS, "copies", "slice", "slices"]
    lists = wanted.groupBy("d", "th").agg(F.collect_list(F.struct("start", *names)).alias("found"))
    joined = rows.join(lists, ["d", "th"]).select("text", "found")
    types = ("anchor bigint, off int, n int, cls bigint, copies bigint, slice int, slices int, bytes binary")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = batch.column("found")
        fields = found.flatten()
        row = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
        start, n = (fields.field(fields.type.get_field_index(x)).to_numpy() for x in ("start", "n"))
        column = batch.column("text").cast(pa.binary())
        for a, b in blocks_of(np.asarray(n, np.int64) + length):
            out, value, at = [], b"", -1
            for i in range(a, b):
                if row[i] != at:
                    at = row[i]
                    value = column[int(at)].as_py()
                out.append(value[start[i]:start[i] + n[i] + length - 1])
            part = fields.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [part.field(part.type.get_field_index(x)) for x in names] + [pa.array(out, pa.binary())],
                names=[*names, "bytes"])

    return map_batches(joined, run, types)


def repeated_windows(classes: DataFrame, length: int) -> DataFrame:
    """Suffix-sort the classes of each (anchor, slice).

    Rows without ``core``: windows [first, last] of a class that lie in another class too. Other rows: up to ``BLOCK``
    windows of an anchor that has several slices, each with its place (-1: repeated in the slice); windows that are equal
    in two slices come with the same core.
    """
    dealt = classes.repartition("anchor", "slice").sortWithinPartitions("anchor", "slice")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            table = rest if batch is None else batch if rest is None else pa.concat_batches([rest, batch])
            if table is None or not table.num_rows:
                continue
            keys = np.stack([table.column("anchor").to_numpy(), table.column("slice").to_numpy()])
            edge = np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1
            cut = table.num_rows if batch is None else int(edge[-1]) if len(edge) else 0
            rest = table.slice(cut)
            bounds = [0, *[int(e) for e in edge if e < cut], cut] if cut else [0]
            sizes = pc.binary_length(table.column("bytes")).to_numpy(zero_copy_only=False).astype(np.int64)
            per_group = np.add.reduceat(sizes[:cut], bounds[:-1]) if cut else np.zeros(0, np.int64)
            for a, b in blocks_of(per_group, SORT_BYTES):
                yield _sorted_block(table.slice(bounds[a], bounds[b] - bounds[a]), length)
            if batch is None:
                rest = None

    return dealt.mapInArrow(run, "anchor bigint, off int, n int, cls bigint, first int, last int, core binary, "
                            "windows array<struct<at: int, digest: binary>>")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _sorted_block(table: pa.RecordBatch, length: int) -> pa.RecordBatch:
    raw = b"".join(table.column("bytes").to_pylist())
    n = table.column("n").to_numpy().astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(n + length - 1)[:-1]])
    row = np.repeat(np.arange(len(n)), n)
    index = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    starts = begins[row] + index
    leaf = sort_suffixes(np.frombuffer(raw, np.uint8), starts, length)
    several = np.bincount(leaf)[leaf] > 1
    single = table.column("copies").to_numpy()[row] == 1
    sliced = table.column("slices").to_numpy()[row] > 1
    # Runs of windows that another class holds too.
    hit = several & single
    begin = np.flatnonzero(hit & ~(np.roll(hit, 1) & (index > 0)))
    end = np.flatnonzero(hit & ~(np.roll(hit, -1) & (np.roll(index, -1) > 0)))
    rows, first, last = row[begin], index[begin], index[end]
    # Leaves to compare between slices: one window of each, put together by the bytes that windows nearby share.
    some = np.flatnonzero(sliced)
    _, one = np.unique(leaf[some], return_index=True)
    one = np.sort(some[one])
    off = table.column("off").to_numpy().astype(np.int64)
    back = off[row[one]] - index[one]  # bytes from the window's start to its anchor
    block = back // BLOCK
    core = starts[one] + back - block * BLOCK
    edge = np.flatnonzero((np.diff(row[one], prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
    size = length - BLOCK + 1
    cores = [xxh3_128_digest(raw[c:c + size] + bytes([k])) for c, k in zip(core[edge].tolist(), block[edge].tolist())]
    owner = several[one] | ~single[one]
    windows = pa.ListArray.from_arrays(
        pa.array(np.append(edge, len(one)).astype(np.int32)),
        pa.StructArray.from_arrays(
            [pa.array(np.where(owner, -1, index[one]).astype(np.int32)),
             pa.array([xxh3_128_digest(raw[s:s + length]) for s in starts[one].tolist()], pa.binary())],
            names=["at", "digest"]))
    columns = [table.column(x).take(pa.array(np.concatenate([rows, row[one][edge]]))) for x in CLASS]
    none = len(rows)
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array([*first.tolist(), *[None] * len(edge)], pa.int32()),
         pa.array([*last.tolist(), *[None] * len(edge)], pa.int32()), pa.array([None] * none + cores, pa.binary()),
         pa.concat_arrays([pa.nulls(none, windows.type), windows])],
        names=[*CLASS, "first", "last", "core", "windows"])


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    kept, spans = [], []
    for text, found in zip(batch.column("text").cast(pa.binary()), batch.column("found"), strict=True):
        value, merged = text.as_py(), []
        pairs = found.as_py() or ()
        for s, e in sorted((p["s"], p["e"]) for p in pairs):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        edges = [0, *[x for pair in merged for x in pair], len(value)]
        kept.append(b"".join(value[a:b] for a, b in zip(edges[::2], edges[1::2])))
        spans.append([{"start": s, "end": e} for s, e in merged])
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pc.binary_length(batch.column("text")).cast(pa.int64()),
         pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
        names=["doc_id", "n_bytes", "spans", "kept"]).add_column(0, "row", batch.column("row"))


def remove_repeats(docs: DataFrame, length: int = 200, group: int = GROUP, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: row (struct of the columns to carry along), doc_id, n_bytes, spans (removed byte ranges), kept (bytes)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(F.lit(0).alias("_"), *carry).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       text.alias("text"), F.xxhash64(text).alias("th")).withColumn(
        "d", F.coalesce("doc_id", F.lit(-(1 << 63))))
    found = materialize(occurrences(rows.select("d", "th", "text"), length), "stretches")
    twice = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select("anchor")
    # Written, so that both sides of the join are plain shuffles, which AQE splits at hot anchors.
    twice = materialize(twice, "twice")
    repeated = materialize(found.join(twice, "anchor"), "repeated")
    classes = materialize(repeated.groupBy(*CLASS).agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("d", "th", "start")).alias("place")), "classes")
    open_ = classes.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("classes"), F.count_if(F.col("copies") == 1).alias("single")).filter(
        "classes > 1 AND single > 0").select("anchor", F.ceil(F.col("classes") / group).cast("int").alias("slices"))
    open_ = materialize(open_, "open")
    wanted = classes.join(open_, "anchor").select(
        "place.*", *CLASS, "copies", F.pmod(F.xxhash64("cls", "off", "n"), "slices").cast("int").alias("slice"), "slices")
    pieces = extract_classes(rows.select("d", "th", "text"), wanted, length)
    sorted_ = materialize(repeated_windows(pieces, length), "sorted")
    local = sorted_.filter("core IS NULL").select(*CLASS, "first", "last")
    sliced = sorted_.filter("core IS NOT NULL")
    cores = materialize(sliced.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core"), "cores")
    leaves = materialize(sliced.join(cores, "core").select(*CLASS, F.inline("windows")), "leaves")
    shared = materialize(leaves.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"),
                         "shared")
    across = leaves.filter("at >= 0").join(shared, "digest").select(*CLASS, F.col("at").alias("first"),
                                                                    F.col("at").alias("last"))
    whole = classes.filter("copies > 1").select(*CLASS, F.lit(0).alias("first"), (F.col("n") - 1).alias("last"))
    windows = whole.unionByName(local).unionByName(across)
    # Classes are few and joined by their whole key; a class that fills a third of all rows is split by AQE.
    hits = repeated.join(windows, CLASS).select(
        "d", "th", (F.col("start") + F.col("first")).alias("s"), (F.col("start") + F.col("last") + length).alias("e"))
    spans = hits.distinct().groupBy("d", "th").agg(F.collect_list(F.struct("s", "e")).alias("found"))
    joined = rows.join(spans, ["d", "th"], "left").select(
        "row", "doc_id", "text", "found")
    kind = joined.schema["row"].dataType.simpleString()
    return map_batches(joined, lambda batch: [_cut(batch)], f"row {kind}, doc_id bigint, n_bytes bigint, "
                       "spans array<struct<start:bigint,end:bigint>>, kept binary")
