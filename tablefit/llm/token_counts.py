"""Token counts: a digest cache.

The cache is a folder of Parquet files (digest, tokenizer, n_tokens). A text is known by the SHA-256 of its normalised
content (NULL becomes the empty text; nothing else changes, as any other change could alter the count) and a tokenizer
by the SHA-256 of its file. Only distinct texts that the cache lacks are encoded; their counts are appended.

Defined results: NULL and empty texts have 0 bytes and 0 tokens; repeated rows keep their rows; an empty table gives an
empty table. Other input columns are not read. Special strings inside texts count as the library counts them.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablefit.llm.common import blocks_of, materialize, texts

CACHE_SCHEMA = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("tokenizer", T.StringType()),
                             T.StructField("n_tokens", T.LongType())])
# What a task remembers of words, in bytes with an allowance for each entry; a full store is emptied, and longer words are
# not remembered.
KNOWN_BYTES = 96 << 20
ENTRY_BYTES, WORD_CHARS = 200, 128


class JsonCounter:
    """Counts tokens of a byte-level tokenizer file (.json) of the tokenizers library.

    Its pre-tokenizer never lets a token cross from a non-space into a single space, so a text cut before such spaces
    has the sum of the counts of its parts; parts repeat and are encoded once. Texts where a space stands beside other
    white space are encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        pieces = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(pieces.values()) + 1, bool)
        self.spaced[[i for piece, i in pieces.items() if piece.startswith("Ġ")]] = True
        before = parts.get("pre_tokenizer") or {}
        self.cuts = (
            parts.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
                        for t in parts.get("added_tokens", ()))
        )

    def forget(self) -> None:
        """Drop what is remembered: workers live on and serve other jobs."""
        self.known: dict[str, int | None] = {}
        self.held = 0

    def _whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def counts(self, values: list[str]) -> list[int]:
        if self.held > KNOWN_BYTES:
            self.forget()
        known = self.known
        cut = [value.split(" ") if self.cuts else [] for value in values]
        missing = set().union(*[words[1:] for words in cut]).difference(known)
        words = []
        for word in missing:
            if word and not word[0].isspace() and not word[-1].isspace():
                words.append(word)
            else:
                known[word] = None  # a space beside other white space
        if words:
            # One call for all: a token that begins with a space begins a word.
            [encoded] = self.tokenizer.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)
            begins = np.flatnonzero(self.spaced[np.array(encoded.ids)])
            known.update(zip(words, np.diff(begins, append=len(encoded.ids)).tolist(), strict=True))
        out = []
        for value, words in zip(values, cut, strict=True):
            if not value:
                out.append(0)
                continue
            found = list(map(known.__getitem__, words[1:]))
            if not words or not words[0] or words[0][-1].isspace() or None in found:
                out.append(self._whole(value))
            else:
                out.append(self._whole(words[0]) + sum(found))
        for word in missing:
            if len(word) > WORD_CHARS:
                del known[word]
            else:
                self.held += 4 * len(word) + ENTRY_BYTES
        return out


class PieceCounter:
    """Counts tokens of a sentencepiece model (.model)."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)

    def forget(self) -> None:
        """Nothing is remembered."""

    def counts(self, values: list[str]) -> list[int]:
        return [len(self.processor.encode(value)) for value in values]


@lru_cache(maxsize=4)
def _counter(path: str, version: str) -> JsonCounter | PieceCounter:
    """One counter per worker and tokenizer version."""
    return PieceCounter(path) if path.endswith(".model") else JsonCounter(path)


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 1024) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit. ``tokenizer`` is a file that all executors have installed."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    rows = texts(docs).withColumn("digest", F.unhex(F.sha2("text", 256)))
    known = stored_counts(spark, cache, version)
    # Copies are dropped within each task before the shuffle, so a text that fills a third of all rows is no hot key.
    misses = rows.select("digest", "text").dropDuplicates(["digest"]).join(known, "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = _counter(tokenizer, version)
        for batch in batches:
            column = batch.column("text")
            for a, b in blocks_of(pc.binary_length(column).to_numpy(zero_copy_only=False)):
                counts = counter.counts(column.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("digest").slice(a, b - a), pa.array([version] * len(counts)),
                     pa.array(counts, pa.int64())], names=["digest", "tokenizer", "n_tokens"])
        counter.forget()

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    # Written, so that both sides of the join are plain shuffles, which AQE splits at hot digests.
    counts = materialize(stored_counts(spark, cache, version), "counts")
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest").join(
        counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def stored_counts(spark, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; no rows where the cache doesn't exist yet.

    Two jobs that append at once may store a digest twice; it counts once.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA).select("digest", "n_tokens")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
