"""Quality classifier: hashed word n-gram logistic regression, learnt by follow-the-regularised-leader.

A text's features are hashed n-grams of two sequences over its words: the words themselves (one and two
in a row) and their shapes (one, two and three in a row), where a shape is the word's run-collapsed
classes of characters, marked if the word repeats the one before. A feature's value is its share of the text's
n-grams of that length and sequence, so texts of all lengths are alike; an empty text has the intercept only.
A score is one sparse dot product through a logistic function.

Learning is per-coordinate FTRL-proximal over a bounded sample of labelled texts: at most `MAX_TEXTS`
texts of the documents with the smallest hash of their id, in that order and each text of a document once; a text that would take
the sample above `MAX_BYTES` is passed over and the next ones are tried. It runs in one task whose input has that bound; scoring
reads every text where it lies, without a shuffle.

Defined results: null and empty texts score the intercept; labels other than 0 and 1 and null labels are
left out; a document with several labels counts by the largest; documents that repeat give a row each; with no usable
label every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _text as X
from tessera.llm._spark import saved

#: Bounds of the sample that is learnt from: texts, and bytes of these whole texts.
MAX_TEXTS, MAX_BYTES = 6000, 48 << 20
BITS, EPOCHS = 18, 3
ALPHA, BETA, L1, L2 = 0.5, 1e-2, 1e-6, 1e-6
#: A document is kept from this score on.
THRESHOLD = 0.3

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = ord("A"), ord("a"), ord("0"), ord("a")
_K = np.uint64(0x9E3779B97F4A7C15)


def features(buf: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: the slots of all texts' n-grams, and each text's first one (len+1)."""
    start, end, words_at = X.word_spans(buf, at, X.NOT_SPACE)
    word = X.span_hashes(buf, start, end)
    kind = _CLASS[buf]
    keep = np.ones(len(buf), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[start] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    shape = X.span_hashes(kind[keep], upto[start], upto[end])
    repeat = np.zeros(len(word), np.uint64)
    repeat[1:] = word[1:] == word[:-1]
    first = words_at[:-1][words_at[:-1] < len(word)]
    repeat[first] = 0
    out = []
    with np.errstate(over="ignore"):
        shape = X.mix(shape + repeat)
        for salt, (h, n) in enumerate([(word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3)]):
            count = np.maximum(np.diff(words_at) - n + 1, 0)
            i = X.concat_ranges(words_at[:-1], count)
            g = h[i] + np.uint64(salt)
            for k in range(1, n):
                g = g * _K + h[i + k]
            out.append(((X.mix(g) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate([[0], np.cumsum(count)])))
    return out


def _rows(buf: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct slots and values of each text."""
    kinds = features(buf, at)
    for r in range(len(at) - 1):
        parts = [s[f[r] : f[r + 1]] for s, f in kinds]
        slot = np.concatenate(parts)
        value = np.concatenate([np.full(len(p), 1.0 / max(len(p), 1)) for p in parts])
        slot, inverse = np.unique(slot, return_inverse=True)
        yield slot, np.bincount(inverse, value, len(slot))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """z and n of each slot, with the intercept in the last one; weights follow from them."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, slot) -> np.ndarray:
        z, n = self.z[slot], self.n[slot]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, slot: np.ndarray, value: np.ndarray, label: int) -> None:
        slot, value = np.append(slot, 1 << BITS), np.append(value, 1.0)
        w = self.weights(slot)
        g = (_sigmoid(value @ w) - label) * value
        sigma = (np.sqrt(self.n[slot] + g * g) - np.sqrt(self.n[slot])) / ALPHA
        self.z[slot] += g - sigma * w
        self.n[slot] += g * g


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the weights, as bytes. Its input is bounded by MAX_TEXTS and MAX_BYTES."""
    rows = []
    for batch in X.slices(batches):
        buf, at = X.text_buffer(batch.column("text"))
        rows += [(s.astype(np.int32), v.astype(np.float32), y) for (s, v), y in zip(_rows(buf, at), batch.column("label").to_pylist(), strict=True)]
    if not rows:
        return
    model = Ftrl()
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            model.learn(*rows[i])
    w = model.weights(slice(None)).astype(np.float32)
    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["weights"])


def train(docs: DataFrame, labels: DataFrame, max_texts: int = MAX_TEXTS, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """Weights of all slots and the intercept, from documents with a label 0 or 1 in `labels` (doc_id, label)."""
    spark = docs.sparkSession
    order = F.xxhash64("doc_id")
    known = labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    n = known.count()
    if n > 8 * max_texts:  # few rows to sort: hashes are spread evenly, so about four times as many lie below this
        known = known.where(order < -(1 << 63) + (1 << 64) * 4 * max_texts // n)
    sample = known.orderBy(order, "doc_id").limit(max_texts)
    found = X.only(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id")
    # copies of one document and text count once, before anything comes together
    texts = saved(found.groupBy("doc_id", "label", F.xxhash64("text").alias("th")).agg(F.min("text").alias("text")))
    sizes = texts.select("doc_id", "th", F.octet_length("text").alias("size")).orderBy(order, "doc_id", "th").limit(max_texts).collect()
    chosen, total = [], 0
    for doc, th, size in sizes:
        if total + size <= max_bytes:
            total += size
            chosen.append((doc, th))
    if not chosen:
        return np.zeros((1 << BITS) + 1, np.float32)
    own = spark.createDataFrame(chosen, "doc_id long, th long")
    # one partition on purpose: max_texts rows and max_bytes of text at most reach it
    rows = texts.join(F.broadcast(own), ["doc_id", "th"]).repartition(1).sortWithinPartitions(order, "doc_id", "th")
    got = rows.select("label", "text").mapInArrow(_learn, "weights binary").collect()
    return np.frombuffer(got[0][0], np.float32)


def _score(weights, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(weights.value, np.float32)
        for batch in X.slices(batches):
            buf, at = X.text_buffer(batch.column("text"))
            x = np.full(batch.num_rows, float(w[-1]))
            for slot, first in features(buf, at):
                x += X.sums(w[slot].astype(np.float64), first) / np.maximum(np.diff(first), 1)
            names = [n for n in schema.names if n != "score"]
            yield pa.RecordBatch.from_arrays([batch.column(n).cast(schema.field(n).type) for n in names] + [pa.array(_sigmoid(x))], schema=schema)

    return run


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score (0 to 1) of every row of `docs`."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    sent = docs.sparkSession.sparkContext.broadcast(weights.tobytes())
    return X.only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_score(sent, schema), "doc_id long, score double")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(spark: SparkSession, sf_dir: str, docs: DataFrame) -> np.ndarray:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return train(docs, labels.where(fold(F.col("doc_id")) != 0))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, fit(spark, sf_dir, docs))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, that score `threshold` or more. Nothing is shuffled."""
    schema = pa.schema([("score", pa.float64())])
    sent = docs.sparkSession.sparkContext.broadcast(weights.tobytes())

    def make():
        scored = _score(sent, schema)
        return lambda batch: batch.filter(pa.array(next(scored(iter([batch.select(["text"])]))).column("score").to_numpy() >= threshold))

    return X.rewritten(docs, make)
