"""Shared pieces of the operators: Arrow text buffers, vectorised tokenising, lineage cuts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workers_find_us

#: Bytes of text that one vectorised step works on; a longer document is one step by itself.
SLICE_BYTES = 1 << 20
#: Rows in an Arrow batch, so that a batch of long documents stays small.
BATCH_ROWS = 1000

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: After lower-casing, what is neither an ASCII letter or digit nor part of a non-ASCII code point.
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[0x80:] = False
NON_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_BYTE_CODES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def prepared(spark: SparkSession) -> SparkSession:
    """Small Arrow batches unless the session has its own setting, and workers that find this package."""
    workers_find_us(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one under the warehouse only where Spark is local and has none."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("name a folder that the driver and all executors share in spark.checkpoint.dir")
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers = np.ones(1, U64), np.ones(1, U64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        base = int(_ODD)
        size = max(n, SLICE_BYTES + 1)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers = made[0], made[1]
    return _powers


class Text(NamedTuple):
    """The bytes of a string column; row i is data[offsets[i]:offsets[i + 1]], nulls are empty."""

    data: np.ndarray
    offsets: np.ndarray


def text_of(column: pa.Array) -> Text:
    if pa.types.is_null(column.type):
        return Text(np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if ends is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    return Text(np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets.astype(np.int64))


def slices(text: Text, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Text]]:
    """Runs of rows (first, past the last) of at most limit bytes, or of one row, with their text."""
    n, lo = len(text.offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(text.offsets, text.offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        a, b = text.offsets[lo], text.offsets[hi]
        yield lo, hi, Text(text.data[a:b], text.offsets[lo : hi + 1] - a)
        lo = hi


class Words(NamedTuple):
    """Byte spans and hashes of the words of all rows; row i has words first[i]:first[i + 1].

    sums: running sums of the bytes' codes times powers of the base, of which the hashes are made.
    """

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    sums: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def stems(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The words longer than n bytes, and hashes of their first n bytes."""
        at = np.flatnonzero(self.ends - self.starts > n)
        start = self.starts[at]
        h = (self.sums[start + n] - self.sums[start]) * _power_tables(len(self.sums))[1][start]
        return at, mix(h + np.full(len(at), n, U64) * _ODD)


def spans_of(text: Text, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes that separate nothing, and each row's first run."""
    sep = separators[text.data]
    edge = np.unique(text.offsets[:-1][np.diff(text.offsets) > 0])
    start = ~sep
    end = start.copy()
    begins = edge[start[edge]] if len(edge) else edge
    closes = text.offsets[1:][np.diff(text.offsets) > 0] - 1
    closes = closes[end[closes]] if len(closes) else closes
    start[1:] &= sep[:-1]
    end[:-1] &= sep[1:]
    start[begins] = True
    end[closes] = True
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, text.offsets)


def words_of(text: Text, separators: np.ndarray = WHITESPACE) -> Words:
    """Lower-cases A-Z and hashes each word; equal words have equal hashes in any batch."""
    starts, ends, first = spans_of(text, separators)
    powers, inverse = _power_tables(len(text.data) + 1)
    sums = np.zeros(len(text.data) + 1, U64)
    np.cumsum(_BYTE_CODES[LOWER[text.data]] * powers[: len(text.data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return Words(starts, ends, mix(h + (ends - starts).astype(U64) * _ODD), first, sums)


_STEPS = mix(np.arange(1, 65, dtype=np.uint64) * _ODD) | U64(1)


def sequence_hash(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """One hash of the n words from each position in at."""
    total = np.full(len(at), n * int(_ODD) & 0xFFFFFFFFFFFFFFFF, U64)
    for j in range(n):
        total += hashes[at + j] * _STEPS[j % 64]
    return mix(total)


def shingles_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, and each one's row; a row of fewer words, but not none, is one run."""
    count = np.diff(words.first)
    rows = words.rows()
    at = np.arange(len(words.hashes))
    full = at + n <= words.first[rows + 1] if len(rows) else np.zeros(0, bool)
    hashes, owner = sequence_hash(words.hashes, at[full], n), rows[full]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.empty(len(short), U64)
        for k in np.unique(count[short]):
            here = count[short] == k
            extra[here] = sequence_hash(words.hashes, words.first[short[here]], int(k))
        hashes, owner = np.concatenate([hashes, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def distinct_by_row(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashes once, sorted within the row."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[keep], o[keep]


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """As np.unique(), by sorting, which is faster here than hashing."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64), pa.int64())


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not taken, whatever its case."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def masked(docs: DataFrame) -> DataFrame:
    """docs with text and all other columns by number, so that no result can clash with them."""
    return docs.select(*(F.col(f"`{x}`").alias(x if x == "text" else f"_c{i}") for i, x in enumerate(docs.columns)))


def unmasked(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns of masked() under their names again."""
    return df.select(*(F.col(x if x == "text" else f"_c{i}").alias(x) for i, x in enumerate(names)))


def sized(small: DataFrame, most_rows: int) -> DataFrame:
    """With a broadcast hint if it has at most that many rows; else Spark joins by shuffling.

    small: read from a checkpoint, so that counting is cheap; its rows must be of bounded width.
    """
    return F.broadcast(small) if small.count() <= most_rows else small
