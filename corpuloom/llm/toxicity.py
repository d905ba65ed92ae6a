"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashed buckets of its words (whole, and
by their stems, the first 4 to 8 bytes, as languages inflect), adjacent word
pairs and pairs one word apart, read as lower-cased runs of letters and digits.  Training takes labelled rows one by one, with a learning rate for each
coordinate and L1 regularisation, so that nearly all of the 2**bits weights stay
zero; the dense table of at most 4 * 2**bits bytes is broadcast for scoring.

The classifier is fitted on at most ``max_rows`` labelled documents, those of
smallest hashed doc_id; scores cover every document and its whole text.

Defined results: a null or wordless text scores the bias alone; repeated rows
score alike; several labels of one document count as the largest; null labels
and labels without a document teach nothing; of rows that share a doc_id the text of the
largest hash teaches; without any label every score is
0.5; a null doc_id is never trained on and not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_ALNUM, U64, Words, list_array, masked, mix, prepared, sequence_hash, slices, sorted_unique, text_of, unmasked, words_of

BITS = 20
STEMS = (4, 5, 6, 7, 8)
MAX_ROWS = 16384
EPOCHS = 4
THRESHOLD = 0.7
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.001


def _features(words: Words, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of every occurrence, for each kind of feature."""
    rows, h, shift = words.rows(), words.hashes, U64(64 - bits)
    yield (h >> shift).astype(np.int64), rows
    for n in STEMS:
        at, stem = words.stems(n)
        yield (stem >> shift).astype(np.int64), rows[at]
    for gap in (1, 2):
        at = np.arange(max(0, len(h) - gap))
        at = at[rows[at] == rows[at + gap]]
        pair = mix(h[at] * U64(3) ^ sequence_hash(h, at + gap, 1) ^ U64(gap))
        yield (pair >> shift).astype(np.int64), rows[at]


def _featured(bits: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, text in slices(text_of(batch["text"])):
                parts = list(_features(words_of(text, NON_ALNUM), bits))
                pairs = sorted_unique(np.concatenate([row << bits | bucket for bucket, row in parts]))
                buckets, rows = pairs & ((1 << bits) - 1), pairs >> bits
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], batch["toxic"][lo:hi], list_array(pa.array(buckets, pa.int32()), np.bincount(rows, minlength=hi - lo))], ["doc_id", "toxic", "features"])

    return make


def _trainer(bits: int, alpha: float, beta: float, l1: float, l2: float):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        bias = 1 << bits
        limit = np.full(len(z), l1)
        limit[bias] = 0.0

        def weights(at):
            far = np.abs(z[at]) - limit[at]
            return np.where(far > 0, -np.sign(z[at]) * far / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

        for batch in batches:
            items = batch["features"]
            offsets, values = items.offsets.to_numpy(), items.values.to_numpy()
            for i, toxic in enumerate(batch["toxic"].to_pylist()):
                at = np.append(values[offsets[i] : offsets[i + 1]], bias)
                w = weights(at)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - toxic
                more = n[at] + g * g
                z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
                n[at] = more
        w = weights(np.arange(len(z)))
        some = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(w[some])], ["bucket", "weight"])

    return train


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, bits: int = BITS, max_rows: int = MAX_ROWS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """2**bits weights and the bias, learned from labels (doc_id, toxic) of rows that are not held out."""
    prepared(docs.sparkSession)
    taught = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    taught = taught.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = slim.join(F.broadcast(taught), slim["doc_id"] == taught["_id"]).select("doc_id", F.col("_toxic").alias("toxic"), "text")
    # One text of each id, so that the bound holds for rows.
    rows = rows.groupBy("doc_id", "toxic").agg(F.max(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    featured = rows.mapInArrow(_featured(bits), "doc_id bigint, toxic int, features array<int>")
    # One task learns from bounded rows, each epoch in another order.
    repeated = featured.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    ordered = repeated.repartition(1).sortWithinPartitions("epoch", F.xxhash64("epoch", "doc_id"), "doc_id").drop("epoch")
    learned = ordered.mapInArrow(_trainer(bits, alpha, beta, l1, l2), "bucket bigint, weight double").toArrow()
    weights = np.zeros((1 << bits) + 1, np.float32)
    weights[learned["bucket"].to_numpy()] = learned["weight"].to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray, *, keys: list[str]) -> DataFrame:
    """keys and score (0 to 1, higher: likelier toxic) of each document's whole text."""
    prepared(docs.sparkSession)
    bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for lo, hi, text in slices(text_of(batch["text"])):
                found = []
                for bucket, row in _features(words_of(text, NON_ALNUM), bits):
                    some = np.flatnonzero(w[bucket])
                    found.append(row[some] << bits | bucket[some])
                pairs = sorted_unique(np.concatenate(found))
                total = w[-1] + np.bincount(pairs >> bits, w[pairs & ((1 << bits) - 1)], hi - lo)
                value = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(batch[x][lo:hi] for x in keys), pa.array(value, pa.float64())], [*keys, "score"])

    slim = docs.select(*dict.fromkeys([*keys, "text"]))
    shape = ", ".join(f"`{x}` {slim.schema[x].dataType.simpleString()}" for x in keys) + ", score double"
    return slim.mapInArrow(scored, shape)


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """docs that score under the threshold; columns as they were."""
    hidden = masked(docs)
    out = score(hidden, fit(docs, labels, **options), keys=hidden.columns)
    return unmasked(out.where(F.col("score") < threshold), docs.columns)
