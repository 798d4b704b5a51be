"""Byte-level BPE encoding and decoding with a priority queue of merges.

A text is cut at the special strings of the tokenizer file, then into words by the file's pattern. The bytes of a word
become a doubly linked list of symbols; a priority queue holds the ranks of the possible merges of neighbours. The lowest
rank (the leftmost on ties) is merged first, and entries whose symbols have changed since are skipped. Decoding
concatenates the vocabulary's byte strings.

Words repeat, and a task remembers their ids and texts up to a number of bytes. A word holds whole characters, so the
texts decoded from words make up the text decoded from all ids.

Defined results: NULL and empty texts have no ids and decode to the empty text; repeated rows keep their rows; an empty
table gives an empty table; bytes that are no UTF-8 decode to replacement characters and unknown ids to nothing. Other
input columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tablefit.llm.common import blocks_of, texts

# What a task remembers, twice (a store and an older one), in bytes with an allowance for each entry; longer words are
# not remembered.
KNOWN_BYTES = 64 << 20
ENTRY_BYTES, WORD_CHARS = 300, 128
SCHEMA = "doc_id bigint, n_tokens bigint, ids string, decoded string"
# The words of a text, with classes for letters and numbers; ASCII texts are cut by the faster module.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?{x}+| ?{n}+| ?[^\s{x}{n}]+|\s+(?!\S)|\s+"
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")


def byte_characters() -> list[str]:
    """The character that stands for each byte in files of byte-level vocabularies: printable ones stand for themselves."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, others = [], 0
    for byte in range(256):
        out.append(chr(byte if byte in printable else 256 + others))
        others += byte not in printable
    return out


def _newer(splitter, kind: str, neighbour: str) -> str:
    """Characters that the regex module counts as ``kind`` (L or N) but the library, whose tables are older, does not."""
    found = "".join(regex.findall(rf"\p{{{kind}}}", "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))))
    # A run of one kind is one word, which the neighbour joins if it is of the kind asked for.
    runs = [found[a:b] for _, (a, b) in splitter.pre_tokenize_str(found)]
    return "".join([run for run in runs if len(splitter.pre_tokenize_str(neighbour + run[0])) > 1])


class BytePairModel:
    """Encodes and decodes by a byte-level BPE file (.json) of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        before, model, added = parts.get("pre_tokenizer") or {}, parts["model"], parts.get("added_tokens", [])
        if (parts.get("normalizer") or model["type"] != "BPE" or before.get("type") != "ByteLevel"
                or not before.get("use_regex", True) or before.get("add_prefix_space") or model.get("dropout")
                or model.get("ignore_merges") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)):
            raise ValueError(f"{path} is no plain byte-level BPE file")
        names = byte_characters()
        byte_of = {name: byte for byte, name in enumerate(names)}
        vocabulary: dict[str, int] = model["vocab"]
        self.byte_ids = [vocabulary[name] for name in names]
        self.surface: dict[int, bytes] = {
            i: bytes(map(byte_of.__getitem__, token)) if set(token) <= byte_of.keys() else token.encode()
            for token, i in [*vocabulary.items(), *((t["content"], t["id"]) for t in added)]}
        # A pair of symbols is one whole number: the first id above the second.
        self.shift = max(self.surface).bit_length()
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocabulary[a] << self.shift | vocabulary[b]] = rank
            self.merged.append(vocabulary[a + b])
        self.decimal = {i: str(i) for i in self.surface}
        self.special = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_strings = re.compile(f"({'|'.join(map(re.escape, longest_first))})")
        splitter = ByteLevel(add_prefix_space=False)
        newer = {"L": _newer(splitter, "L", "a"), "N": _newer(splitter, "N", "1")}
        self.newer = frozenset("".join(newer.values()))
        letters, numbers = (f"[\\p{{{kind}}}--[{regex.escape(found)}\\uFFFF]]" for kind, found in newer.items())
        self.words, self.words_newer = (regex.compile("(?V1)" + WORDS.format(x=x, n=n))
                                        for x, n in ((r"\p{L}", r"\p{N}"), (letters, numbers)))
        self.forget()

    def forget(self) -> None:
        """Drop what is remembered: workers live on and serve other jobs."""
        self.known_ids: dict[str, str] = {}
        self.known_text: dict[str, str] = {}
        self.older: tuple[dict[str, str], dict[str, str]] = {}, {}
        self.held = 0

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ids = [self.byte_ids[b] for b in word]
        size = len(ids)
        if size == 1:
            return ids
        rank_of, merged, shift, bits = self.rank.get, self.merged, self.shift, size.bit_length()
        left, right, mask = list(range(-1, size - 1)), list(range(1, size + 1)), (1 << bits) - 1
        # Rank of the merge that each symbol and its neighbour have now. An entry is the rank above the place of the
        # first symbol, so ties go to the left; it is stale where the rank is another one by now.
        now = [rank_of(a << shift | b) for a, b in zip(ids, ids[1:])]
        queue = [rank << bits | i for i, rank in enumerate(now) if rank is not None]
        now.append(None)
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i, rank = entry & mask, entry >> bits
            if now[i] != rank:
                continue
            j = right[i]
            new = ids[i] = merged[rank]
            ids[j], now[j] = -1, None
            after = right[i] = right[j]
            if after < size:
                left[after] = i
                rank = now[i] = rank_of(new << shift | ids[after])
                if rank is not None:
                    heappush(queue, rank << bits | i)
            else:
                now[i] = None
            before = left[i]
            if before >= 0:
                rank = now[before] = rank_of(ids[before] << shift | new)
                if rank is not None:
                    heappush(queue, rank << bits | before)
        return [i for i in ids if i >= 0]

    def cut(self, text: str) -> list[str]:
        """The special strings and the words of a text."""
        out = []
        for part in self.special_strings.split(text) if self.special else [text]:
            if part in self.special:
                out.append(part)
            elif part.isascii():
                out += ASCII_WORDS.findall(part)
            else:
                out += (self.words if self.newer.isdisjoint(part) else self.words_newer).findall(part)
        return out

    def _ids(self, word: str) -> list[int]:
        return [self.special[word]] if word in self.special else self.merge(word.encode())

    def encode(self, text: str) -> list[int]:
        return [i for word in self.cut(text) for i in self._ids(word)]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.surface.get(i, b"") for i in ids]).decode(errors="replace")

    def rows(self, values: list[str]) -> Iterator[tuple[str, int, str]]:
        """(ids joined by commas, number of ids, text decoded from them) of each text."""
        cut = [self.cut(value) for value in values]
        if self.held > KNOWN_BYTES:
            # What isn't asked for again until the store is full once more goes.
            self.older = self.known_ids, self.known_text
            self.known_ids, self.known_text, self.held = {}, {}, 0
        known_ids, known_text, (older_ids, older_text) = self.known_ids, self.known_text, self.older
        long = []
        for word in set().union(*cut).difference(known_ids):
            if word in older_ids:
                known_ids[word], known_text[word] = older_ids[word], older_text[word]
            else:
                ids = self._ids(word)
                known_ids[word], known_text[word] = ",".join([self.decimal[i] for i in ids]), self.decode(ids)
            if len(word) > WORD_CHARS:
                long.append(word)
            else:
                self.held += 8 * len(word) + ENTRY_BYTES
        for words in cut:
            ids = ",".join(map(known_ids.__getitem__, words))
            yield ids, ids.count(",") + 1 if ids else 0, "".join(map(known_text.__getitem__, words))
        for word in long:
            del known_ids[word], known_text[word]


@lru_cache(maxsize=2)
def model(path: str) -> BytePairModel:
    """One model per worker and file."""
    return BytePairModel(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (decimal, joined by commas) and the text decoded from them.

    ``path`` names a tokenizer file that all executors have installed.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            column = batch.column("text")
            for a, b in blocks_of(pc.binary_length(column).to_numpy(zero_copy_only=False), 1 << 20):
                rows = list(own.rows(column.slice(a, b - a).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[0] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"])
        own.forget()

    return texts(docs).mapInArrow(encode, SCHEMA)
