"""Language-model scores by masked pseudo-likelihood.

A word belongs to one of 2**16 hash buckets and, through it, to one of 128 classes: the most frequent buckets have a
class each, the others share the rest. A network sees the classes on the left and on the right of a masked word and
predicts its class; the word follows from its class by its own count in the corpus. The score of a text is the sum of
the logarithms of the conditional probabilities of all its words, each masked in turn.

All documents count: how often each word occurs, and how often each class stands between each pair of neighbours. The
words are a written table that grows with the corpus: frequent ones go to every task, the others of each document are
counted there and joined by shuffle. The neighbour counts are all that the network's loss depends on, so it is trained
in numpy on that table (129 x 129 x 128 cells, whatever the size of the corpus) with the gradient of the whole corpus in
every step.

Defined results: NULL, empty and blank texts have no words, the sum 0 and no mean; repeated rows keep their rows and
count as often; an empty table gives an empty table. Other input columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from tablefit.llm.common import blocks_of, materialize, texts

BUCKETS = 1 << 16
CLASSES = 128
OWN = 96  # classes of a single bucket
EDGE = CLASSES  # stands beside the first and the last word
HIDDEN = 32
STEPS = 150
RATE = 0.02
KNOWN_WORDS = 500_000
COUNTED_WORDS = 300_000  # different words that a task holds before it passes their counts on
HOT_WORDS = 1 << 16  # most words whose counts every task gets; those of all others are joined


class _Buckets(dict):
    """Word to bucket, remembered; a full store is emptied."""

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        bucket = self[word] = xxh32_intdigest(word) & (BUCKETS - 1)
        return bucket


def _word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    """(rows, words of each row)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        for a, b in blocks_of(sizes):
            part = batch.slice(a, b - a)
            yield part, [value.lower().split() for value in part.column("text").to_pylist()]


def _numbers(words: list[list[str]], known: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words, number of words of each row)."""
    counts = np.array([len(w) for w in words], np.int64)
    return np.fromiter((known[w] for row in words for w in row), np.int64, int(counts.sum())), counts


def _neighbours(classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left, right = np.roll(classes, 1), np.roll(classes, -1)
    ends = np.cumsum(counts)
    full = counts > 0
    left[(ends - counts)[full]] = EDGE
    right[ends[full] - 1] = EDGE
    return left, right


def _sums(df: DataFrame, cells: int, cell_numbers) -> np.ndarray:
    """Counts of cells over all rows: summed in each task, then across tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(cells, np.int64), _Buckets()
        for _, words in _word_blocks(batches):
            total += np.bincount(cell_numbers(*_numbers(words, known)), minlength=cells)
        found = np.flatnonzero(total)
        for a in range(0, len(found), 100_000):
            part = found[a:a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["cell", "n"])

    table = df.select("text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells)
    out[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return out


def class_of_buckets(bucket_counts: np.ndarray) -> np.ndarray:
    order = np.lexsort((np.arange(BUCKETS), -bucket_counts))
    classes = OWN + np.arange(BUCKETS) % (CLASSES - OWN)
    classes[order[:OWN]] = np.arange(OWN)
    return classes


def train(counts: np.ndarray, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 0) -> np.ndarray:
    """log p(class | left, right) of a network with one hidden layer, fitted to counts[left, right, class]."""
    side, classes = counts.shape[0], counts.shape[2]
    random = np.random.default_rng(seed)
    shares = counts.sum(axis=(0, 1)) + 0.5
    weights = [random.normal(0, 0.3, (side, hidden)), random.normal(0, 0.3, (side, hidden)), np.zeros(hidden),
               random.normal(0, 0.1, (hidden, classes)), np.log(shares / shares.sum())]
    weights = [w.astype(np.float32) for w in weights]
    means, squares = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    target = (counts / max(1.0, counts.sum())).astype(np.float32)
    mass = target.sum(axis=2, keepdims=True)

    def forward() -> tuple[np.ndarray, np.ndarray]:
        left, right, bias, out, prior = weights
        inner = np.tanh(left[:, None, :] + right[None, :, :] + bias)
        scores = inner @ out + prior
        scores -= scores.max(axis=2, keepdims=True)
        return inner, scores - np.log(np.exp(scores).sum(axis=2, keepdims=True))

    for step in range(1, steps + 1):
        inner, logs = forward()
        error = np.exp(logs) * mass - target
        back = (error @ weights[3].T) * (1 - inner ** 2)
        slopes = [back.sum(axis=1), back.sum(axis=0), back.sum(axis=(0, 1)),
                  inner.reshape(-1, hidden).T @ error.reshape(-1, classes), error.sum(axis=(0, 1))]
        for i, slope in enumerate(slopes):
            means[i] = 0.9 * means[i] + 0.1 * slope
            squares[i] = 0.999 * squares[i] + 0.001 * slope ** 2
            weights[i] = weights[i] - RATE * (means[i] / (1 - 0.9 ** step)) / (
                np.sqrt(squares[i] / (1 - 0.999 ** step)) + 1e-8)
    return forward()[1].astype(np.float32)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, bucket, n): how often each word of the corpus occurs. One row per word, so it grows with the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = _Buckets(), Counter()

        def counted() -> pa.RecordBatch:
            words = list(found)
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([known[w] for w in words], pa.int64()),
                 pa.array(list(found.values()), pa.int64())], names=["word", "bucket", "n"])

        for _, words in _word_blocks(batches):
            for row in words:
                found.update(row)
            if len(found) > COUNTED_WORDS:
                yield counted()
                found.clear()
        if found:
            yield counted()

    found = rows.select("text").mapInArrow(run, "word string, bucket bigint, n bigint")
    return found.groupBy("word", "bucket").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """Per row: doc_id, n_words, log_likelihood (sum), mean_log_likelihood."""
    rows = texts(docs)
    counted = materialize(word_counts(rows), "words")
    by_bucket = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket_counts = np.zeros(BUCKETS)
    bucket_counts[by_bucket.column("bucket").to_numpy()] = by_bucket.column("n").to_numpy()
    classes = class_of_buckets(bucket_counts)
    class_counts = np.bincount(classes, weights=bucket_counts, minlength=CLASSES)
    class_logs = np.log(np.maximum(class_counts, 1))
    side = CLASSES + 1

    def cells(buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        found = classes[buckets]
        left, right = _neighbours(found, counts)
        return (left * side + right) * CLASSES + found

    table = train(_sums(rows, side * side * CLASSES, cells).reshape(side, side, CLASSES), steps=steps).ravel()
    # At most HOT_WORDS words have such a share of all; no other word can fill a task of the join.
    frequent = counted.filter(F.col("n") * HOT_WORDS >= float(bucket_counts.sum())).select("word", "n").toArrow()
    hot = dict(zip(frequent.column("word").to_pylist(), np.log(frequent.column("n").to_numpy()).tolist()))
    shared = rows.sparkSession.sparkContext.broadcast((table, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hot = shared.value
        known = _Buckets()
        for part, words in _word_blocks(batches):
            buckets, counts = _numbers(words, known)
            own = np.fromiter((hot.get(w, 0.0) for row in words for w in row), np.float64, len(buckets))
            logs = table[cells(buckets, counts)].astype(np.float64) - class_logs[classes[buckets]] + own
            sums = np.zeros(len(counts))
            full = counts > 0
            if full.any():
                sums[full] = np.add.reduceat(logs, (np.cumsum(counts) - counts)[full])
            others = [Counter(w for w in row if w not in hot) for row in words]
            offsets = np.concatenate([[0], np.cumsum([len(o) for o in others])]).astype(np.int32)
            others = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
                [pa.array([w for o in others for w in o], pa.string()),
                 pa.array([n for o in others for n in o.values()], pa.int64())], names=["word", "times"]))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), pa.array(counts), pa.array(sums), others],
                names=["row", "doc_id", "n_words", "part", "others"])

    found = materialize(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        run, "row bigint, doc_id bigint, n_words bigint, part double, others array<struct<word:string,times:bigint>>"),
        "scored-parts")
    others = found.select("row", F.inline("others")).join(counted.select("word", "n"), "word").groupBy("row").agg(
        F.sum(F.col("times") * F.log("n")).alias("rest"))
    total = F.col("part") + F.coalesce("rest", F.lit(0.0))
    return found.select("row", "doc_id", "n_words", "part").join(others, "row", "left").select(
        "doc_id", "n_words", total.alias("log_likelihood"),
        F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_likelihood"))
