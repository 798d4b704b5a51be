"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, other words lose case and surrounding signs. Windows of five tokens
of the benchmark items and of the documents are joined by their hash; a bitmap lets a task drop windows that no item has
before they are sent. The windows of an item and a document that meet in one alignment (same distance between both
places) fill slots: the item's values and the document's must map one to one, else the alignment is dropped. A window
without any plain word must have the item's own values.

A document is contaminated by an item when at least ``SHARE`` of the item's different windows are left, or when the windows
left in one alignment cover at least ``SHARE`` of its tokens. Items below ``LONG_ITEM`` tokens are not decided by one or
two windows: all of them must be found in one alignment, or several that cover ``SHARE`` of the tokens with the item's own
values. A short item in which an ordinary word was changed is therefore not found.

An item's first word is read as a sentence's first word and, where the document has this same word, as a name. Items
below five tokens are windows of their own length, which are also taken from longer documents; their numbers, names and
units must be the same there.

Defined results: NULL and empty texts match nothing; repeated rows and repeated items are judged each; empty tables give
no rows. Other input columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.llm.common import blocks_of, broadcastable, materialize, texts

WINDOW = 5
SHARE = 0.8
LONG_ITEM = 12
# The bitmap has this many bits for each listed window, within bounds (32 MB at most; a fuller one only sends more rows).
BITS_PER_WINDOW, LEAST_BITS, MOST_BITS = 32, 16, 28
PLAIN, NUMBER, NAME, UNIT = range(4)
SLOT_IDS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
UNITS = frozenset("""
mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ton tons ml cl l liter liters
litre litres ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
mph kmh kph hz khz mhz ghz w kw v a j kj cal kcal pa kpa k c f usd eur gbp dollar dollars cent cents euro euros pound
pounds percent degree degrees % $ € £ ° meter meters metre metres gram grams kilogram kilograms kilometer kilometers
""".split())
SPACE, LETTER, DIGIT, SYMBOL, QUOTE, JOIN = range(1, 7)
COMMON = 0x3000  # code points below are looked up in a small table
STOPS = np.array([ord(c) for c in ".!?:"], np.uint32)
BASE = np.uint64(0x9FB21C651E98DF25)
BLOCK = 512 << 10  # bytes of text that are made into arrays at a time
INSIDE = 16  # added to the length in hashes of short items inside longer documents
FACTORS = np.random.default_rng(5).integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)


class Characters:
    """What the word rule needs to know about each code point below ``limit``."""

    def __init__(self, limit: int):
        every = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(limit)]
        joined = "".join(every)
        self.kind = np.zeros(limit, np.uint8)
        for kind, pattern in ((SPACE, r"\s"), (LETTER, r"[^\W\d_]"), (DIGIT, r"\d"), (SYMBOL, "[%$€£°]"), (QUOTE, "['’]"),
                              (JOIN, "[.,:/]")):
            self.kind[[m.start() for m in re.finditer(pattern, joined)]] = kind
        self.lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in every], np.uint64)
        self.is_lower = np.array([c.islower() for c in every])
        self.is_upper = np.array([c.isupper() for c in every])
        # Signs that may follow the sign that ends a sentence.
        self.trails = np.array([c in "\"')»”*&#%$" or c.isspace() for c in every])


@lru_cache(maxsize=2)
def characters(limit: int) -> Characters:
    return Characters(limit)


@dataclass
class Tokens:
    """The tokens of several texts: place in the joined text, hash, placeholder (PLAIN: none) and number of the text."""

    joined: str
    start: np.ndarray
    end: np.ndarray
    ids: np.ndarray
    slot: np.ndarray
    row: np.ndarray
    counts: np.ndarray

    def value(self, i: int) -> str | None:
        """What a placeholder stands for."""
        return self.joined[self.start[i]:self.end[i]].lower() if self.slot[i] else None


def _hashes(lower: np.ndarray, inside: np.ndarray, first: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Polynomial hash of each token's lower-cased characters (``first``: its first place within ``inside``)."""
    place = inside - np.repeat(begins, np.diff(first, append=len(inside)))
    powers = np.full(int(place.max(initial=0)) + 1, BASE, np.uint64)
    powers[0] = 1
    total = np.add.reduceat((lower + np.uint64(1)) * np.multiply.accumulate(powers)[place], first) if len(first) else lower[:0]
    return (total ^ (total >> np.uint64(29))) * BASE


def parse(values: list[str]) -> Tokens:
    """Parts of words: numbers, words (with apostrophes inside) and currency or percent signs, all by array operations."""
    joined = "\n".join([*values, ""])
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    table = characters(COMMON if codes.max(initial=0) < COMMON else 0x110000)
    raw = table.kind[codes]
    kind = raw.copy()
    for sign, around in ((QUOTE, LETTER), (JOIN, DIGIT)):
        kind[1:-1][(raw[1:-1] == sign) & (raw[:-2] == around) & (raw[2:] == around)] = around
    part = (kind >= LETTER) & (kind <= SYMBOL)
    change = np.ones(len(kind) + 1, bool)
    change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == SYMBOL)
    begins, ends = np.flatnonzero(part & change[:-1]), np.flatnonzero(part & change[1:]) + 1
    inside = np.flatnonzero(part)
    first = np.searchsorted(inside, begins)
    ids = _hashes(table.lower[codes[inside]], inside, first, begins)
    # Words between white space: which of them begin a sentence?
    space = raw == SPACE
    word_begins = np.flatnonzero(~space & np.append(True, space[:-1]))
    word = np.searchsorted(word_begins, begins, "right") - 1
    firm = np.flatnonzero(~table.trails[codes])
    last = np.full(len(word_begins), -1)
    last[np.searchsorted(word_begins, firm, "right") - 1] = firm  # the last place of each word stays
    stops = np.isin(codes[last], STOPS) & (last >= 0)
    line = np.searchsorted(np.flatnonzero(codes == 10), word_begins)
    opens = np.ones(len(word_begins), bool)
    opens[1:] = stops[:-1] | (line[1:] != line[:-1])
    leads = np.append(True, word[1:] != word[:-1])[:len(word)]
    number = kind[begins] == DIGIT
    after_number = np.append(False, number[:-1])[:len(word)] & ~leads
    size = ends - begins
    unit = np.isin(ids, unit_hashes()) & ((kind[begins] == SYMBOL) | after_number | (size > 2)) if len(values) else number
    small = np.maximum.reduceat(table.is_lower[codes[inside]], first) if len(first) else number
    named = (kind[begins] == LETTER) & table.is_upper[codes[begins]] & small & ~unit & ~(leads & opens[word])
    slot = np.select([number, unit, named], [NUMBER, UNIT, NAME], PLAIN).astype(np.int8)
    ids = np.where(slot > 0, SLOT_IDS[slot], ids)
    lengths = np.array([len(value) + 1 for value in values], np.int64)
    row = np.searchsorted(np.cumsum(lengths), begins, "right")
    return Tokens(joined, begins, ends, ids, slot, row, np.bincount(row, minlength=len(values)))


@lru_cache(maxsize=1)
def unit_hashes() -> np.ndarray:
    out = []
    for unit in sorted(UNITS):
        codes = np.array([ord(c) for c in unit], np.uint64)
        out.append(_hashes(codes, np.arange(len(codes)), np.array([0]), np.array([0]))[0])
    return np.array(out, np.uint64)


def windows_of(ids: np.ndarray, row: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first token) of the windows of one length that lie within one row."""
    size = max(len(ids) - length + 1, 0)
    total = np.full(size, seed, np.uint64)
    for i in range(length):
        total += ids[i:i + size] * FACTORS[i]
    at = np.flatnonzero(row[:size] == row[length - 1:length - 1 + size])
    total = total[at]
    return (total ^ (total >> np.uint64(31))).view(np.int64), at


def all_windows(ids: np.ndarray, counts: np.ndarray, lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(hash, first token, length) of the windows of rows of tokens; a row below five tokens is one window with its
    length, and windows of the given lengths are those of short items inside longer texts."""
    row = np.repeat(np.arange(len(counts)), counts)
    yield *windows_of(ids, row, WINDOW, 0), WINDOW
    for length in range(1, WINDOW):
        whole = np.flatnonzero(counts[row] == length)
        if len(whole):
            w, at = windows_of(ids[whole], row[whole], length, length)
            yield w, whole[at], length
    for length in lengths:
        yield *windows_of(ids, row, length, length + INSIDE), length


def _forms(text: str) -> Iterator[tuple]:
    """(w, base, place, size, slot values, which of them the document must have) of an item's windows."""
    parsed = parse([text])
    size = len(parsed.ids)
    if not size:
        return
    ids, counts, found = parsed.ids, parsed.counts, [parsed.value(i) for i in range(size)]
    first = parsed.joined[parsed.start[0]:parsed.end[0]].lower()
    named = [first, *found[1:]] if found[0] is None and first[0].isalpha() else None

    def form(w: int, base: int, place: int, values: list, exact: int) -> tuple:
        """The first ``exact`` tokens must keep their values."""
        part = values[place:place + WINDOW]
        at = [i for i, value in enumerate(part) if value is not None]
        every = len(at) == len(part)
        return w, base, place, size, [part[i] for i in at], [every or i < exact for i in at]

    whole = [(int(w), int(at)) for ws, places, _ in all_windows(ids, counts, []) for w, at in zip(ws, places)]
    for w, place in whole:
        yield form(w, w, place, found, 0)
    base = whole[0][0]
    other = np.array([SLOT_IDS[NAME], *ids[1:]], np.uint64)
    if size < WINDOW:
        for values, hashes in ((found, ids), (named, other)):
            if values:
                w, _ = windows_of(hashes, np.zeros(size, int), size, size + INSIDE)
                yield form(int(w[0]), base, 0, values, size)
    elif named:
        w, _ = windows_of(other[:WINDOW], np.zeros(WINDOW, int), WINDOW, 0)
        yield form(int(w[0]), base, 0, named, 1)


def item_windows(items: DataFrame) -> DataFrame:
    """Windows of the items: w as documents have it, base (the window that it is a form of), the item's size in tokens,
    and which slots a document must fill with the item's own value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks_of(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)):
                part = batch.slice(a, b - a)
                found = [(r, *f) for r, text in enumerate(part.column("text").to_pylist()) for f in _forms(text)]
                row, w, base, place, size, slots, exact = zip(*found) if found else ((),) * 7
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id").take(at), part.column("item_th").take(at), pa.array(w, pa.int64()),
                     pa.array(base, pa.int64()), pa.array(place, pa.int32()), pa.array(size, pa.int32()),
                     pa.array(slots, pa.list_(pa.string())), pa.array(exact, pa.list_(pa.bool_()))],
                    names=["item_id", "item_th", "w", "base", "place", "size", "slots", "exact"])

    return items.select("item_id", "item_th", "text").mapInArrow(
        run, "item_id bigint, item_th bigint, w bigint, base bigint, place int, size int, slots array<string>, "
             "exact array<boolean>")


def windows(df: DataFrame, keep: list[str], bitmap: np.ndarray, lengths: list[int]) -> DataFrame:
    """Windows of the column ``text`` that are in the bitmap, with the kept columns; also those of the given lengths."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)
    mask = np.uint64(8 * len(bitmap) - 1)
    kinds = dict(df.dtypes)

    def listed(w: np.ndarray) -> np.ndarray:
        bit = w.view(np.uint64) & mask
        return shared.value[(bit >> np.uint64(3)).view(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks_of(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), BLOCK):
                part = batch.slice(a, b - a)
                found = parse(part.column("text").to_pylist())
                begins = np.cumsum(found.counts) - found.counts
                hits = [(w[hit], at[hit], length) for w, at, length in all_windows(found.ids, found.counts, lengths)
                        if (hit := listed(w)).any()]
                for w, at, length in hits:
                    row = found.row[at]
                    slots = [[found.value(i) for i in range(t, t + length) if found.slot[i]] for t in at.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c).take(pa.array(row)) for c in keep), pa.array(w),
                         pa.array((at - begins[row]).astype(np.int32)), pa.array(slots, pa.list_(pa.string()))],
                        names=[*keep, "w", "place", "slots"])

    return df.select(*keep, "text").mapInArrow(
        run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", w bigint, place int, slots array<string>")


def _bitmap(found: DataFrame, bits: int) -> np.ndarray:
    bit = F.col("w").bitwiseAND(F.lit((1 << bits) - 1))
    rows = found.groupBy(F.floor(bit / 8).alias("byte")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 3), np.uint8)
    out[rows.column("byte").to_numpy()] = rows.column("bits").to_numpy()
    return out


def matches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, th (hash of the text), item_id, n_windows (of the item), n_matched, containment; contaminated pairs."""
    items = texts(benchmark, "item_id").select(
        F.col("doc_id").alias("item_id"), F.xxhash64("text").alias("item_th"), "text")
    listed = materialize(item_windows(items), "item-windows")
    n = listed.count()
    sizes = listed.groupBy("item_id", "item_th").agg(F.count_distinct("base").alias("n_windows"))
    known = listed.join(sizes.withColumnsRenamed({"item_id": "own_id", "item_th": "own_th"}),
                        F.col("item_id").eqNullSafe(F.col("own_id")) & (F.col("item_th") == F.col("own_th")))
    known = materialize(known.select("item_id", "item_th", "w", "base", "size", "n_windows", "exact",
                                     F.col("place").alias("item_place"), F.col("slots").alias("item_slots")), "items")
    lengths = [r["size"] for r in listed.filter(F.col("size") < WINDOW).select("size").distinct().collect()]
    bits = min(max((BITS_PER_WINDOW * n).bit_length(), LEAST_BITS), MOST_BITS)
    rows = texts(docs).withColumn("th", F.xxhash64("text"))
    found = windows(rows, ["doc_id", "th"], _bitmap(listed, bits), sorted(lengths))
    # Very common windows fill many rows of documents, but each once per document and item place.
    pairs = found.join(broadcastable(known, n, 160), "w").withColumn("slot", F.arrays_zip("item_slots", "slots"))
    pairs = pairs.filter(F.forall(F.arrays_zip("exact", "slot"), lambda x: ~x["exact"] | (
        x["slot"]["item_slots"] == x["slot"]["slots"])))
    pairs = materialize(pairs.select("doc_id", "th", "item_id", "item_th", "base", "size", "n_windows", "item_place",
                                     (F.col("place") - F.col("item_place")).alias("shift"), "slot"), "pairs")
    # An alignment has as many rows as the item has windows at most.
    keys = ["doc_id", "th", "item_id", "item_th", "size", "n_windows"]
    aligned = pairs.groupBy(*keys, "shift").agg(
        F.array_sort(F.collect_set("item_place")).alias("places"), F.collect_set("base").alias("bases"),
        F.array_distinct(F.flatten(F.collect_set("slot"))).alias("map"))
    one_to_one = ((F.size(F.array_distinct("map.item_slots")) == F.size("map"))
                  & (F.size(F.array_distinct("map.slots")) == F.size("map")))
    covered = F.least("size", F.lit(WINDOW)) + F.aggregate(
        F.zip_with(F.slice("places", 2, F.size("places")), F.slice("places", 1, F.size("places") - 1),
                   lambda b, a: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda total, x: total + x)
    own = F.forall("map", lambda x: x["item_slots"] == x["slots"])
    left = aligned.filter(one_to_one).withColumn("covered", covered / F.col("size")).withColumn("sure", (
        F.size("bases") == F.col("n_windows")) | ((F.size("bases") > 1) & own & (F.col("covered") >= share)))
    left = materialize(left.drop("places", "map"), "aligned")
    counted = left.select(*keys, "covered", "sure", F.explode("bases").alias("base")).groupBy(*keys).agg(
        F.count_distinct("base").alias("n_matched"), F.max("covered").alias("covered"), F.max("sure").alias("sure"))
    counted = counted.withColumn("containment", F.greatest(F.col("n_matched") / F.col("n_windows"), F.col("covered")))
    return counted.filter((F.col("containment") >= share) & (F.col("sure") | (F.col("size") >= LONG_ITEM))).select(
        "doc_id", "th", "item_id", "n_windows", "n_matched", "containment")


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents without those that an item contaminates; all their columns."""
    bad = materialize(matches(docs, benchmark, share).select("doc_id", "th").distinct(), "contaminated")
    bad = bad.withColumnsRenamed({"doc_id": "__bad_id", "th": "__bad_th"})
    rows = docs.withColumn("__th", F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.join(broadcastable(bad, bad.count(), 32),
                     (rows["__th"] == bad["__bad_th"]) & rows["doc_id"].cast("long").eqNullSafe(bad["__bad_id"]),
                     "left_anti").drop("__th")
