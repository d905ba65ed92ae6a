"""Document fingerprints by locally consistent parsing.

A text is parsed level by level.  At each level runs of one symbol become one;
deterministic coin tossing (the lowest bit in which a symbol differs from its
left neighbour, and its value there), repeated ROUNDS times, gives every symbol
a label below 6 that depends on a few neighbours only; a symbol whose label is
above both neighbours' begins a phrase; a phrase's name is a hash of its symbols
and is a symbol of the next level.  Equal substrings are therefore cut and named
alike inside, wherever they stand.

The fingerprint is the ``size`` smallest hashed names of all levels from the second on
(phrases of about a dozen bytes, of a few dozen, and so on up to passages and whole
texts) together with the name of the whole text where a text is shorter than that;
likeness estimates the share of names that two texts have in common.

``edited_pairs`` needs each document beside the next one in descending doc_id.
Documents are dealt into ranges of doc_id, each with a copy of the next range's
first document, so texts move once.

Defined results: a null text counts as empty; the empty fingerprint is the empty
string, alike only with itself; ids sort nulls last, and rows that share an id
by a hash of their text; a single document is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, U64, _power_tables, mix, partitions, prepared, sorted_unique

ROUNDS = 4
#: A phrase of the last level is a passage of half a million bytes or so; the parse ends before where every text is one name.
LEVELS = 12
#: The first level whose names are kept.
KEPT = 2
SIZE = 48
#: Ids in the sample for each range.
SAMPLE = 64

_FIRST = mix(np.arange(1, 257, dtype=np.uint64))


def _toss_table() -> np.ndarray:
    """One round of coin tossing for symbols below 256: at 256 * left + own, twice the lowest differing bit plus its value."""
    left, own = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
    differ = left ^ own
    bit = np.where(differ > 0, np.log2(np.maximum(1, differ & -differ)), 0).astype(np.int64)
    return (2 * bit + (own >> bit & 1)).astype(np.uint8).ravel()


_TOSS = _toss_table()
#: A de Bruijn sequence of 64 bits: its products with powers of two differ in their top six bits.
_DE_BRUIJN = U64(0x03F79D71B4CB0A89)
_BIT = np.zeros(64, np.uint8)
_BIT[(((U64(1) << np.arange(64, dtype=np.uint64)) * _DE_BRUIJN) >> U64(58)).astype(np.int64)] = np.arange(64)


def _tossed(label: np.ndarray, head: np.ndarray) -> np.ndarray:
    """One round over symbols that differ from their left neighbours; a row's first meets itself with the lowest bit turned."""
    left = np.empty_like(label)
    left[1:] = label[:-1]
    left[head] = label[head] ^ label.dtype.type(1)
    if label.dtype == np.uint8:
        return _TOSS[left.astype(np.uint16) << 8 | label]
    differ = label ^ left
    bit = _BIT[((differ & (~differ + U64(1))) * _DE_BRUIJN >> U64(58)).astype(np.int64)]
    return bit << 1 | (label >> bit & U64(1)).astype(np.uint8)


def _level(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each row's names (bytes, or 64-bit); row i has names[first[i]:first[i + 1]], at least one."""
    n = len(names)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(names[1:], names[:-1], out=new[1:])
    new[first[:-1]] = True
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, n))
    label = names[at]
    symbols = _FIRST[label] if names.dtype == np.uint8 else label.copy()
    runs = np.flatnonzero(length > 1)
    symbols[runs] = mix(symbols[runs] ^ mix(length[runs].astype(U64)))
    head = np.searchsorted(at, first[:-1])
    for _ in range(ROUNDS):
        label = _tossed(label, head)
    top = np.zeros(len(at), bool)
    if len(at) > 1:
        up = label[1:] > label[:-1]
        top[1:] = up
        top[1:-1] &= ~(label[2:] > label[1:-1])
        # A row's last symbol has nothing after it that counts.
        last = np.append(head[1:], len(at)) - 1
        last = last[last > 0]
        top[last] = up[last - 1]
    top[head] = True
    starts = np.flatnonzero(top)
    powers, inverse = _power_tables(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, U64)
    np.cumsum(symbols * powers[: len(symbols)], out=sums[1:])
    stop = np.append(starts[1:], len(symbols))
    made = mix((sums[stop] - sums[starts]) * inverse[starts] ^ (stop - starts).astype(U64))
    return made, np.append(np.searchsorted(starts, head), len(starts))


def _sketches(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Each text's smallest names, sorted, as 32-bit numbers."""
    out: list[np.ndarray] = []
    lo = 0
    while lo < len(texts):
        hi, total = lo + 1, len(texts[lo])
        while hi < len(texts) and total + len(texts[hi]) <= SLICE_BYTES:
            total += len(texts[hi])
            hi += 1
        out += _sliced(texts[lo:hi], size)
        lo = hi
    return out


def _sliced(texts: list[bytes], size: int) -> list[np.ndarray]:
    lengths = np.array([len(x) for x in texts])
    full = np.flatnonzero(lengths)
    result = [np.zeros(0, np.uint32)] * len(texts)
    if not len(full):
        return result
    names = np.frombuffer(b"".join(texts), np.uint8)
    first = np.concatenate([[0], np.cumsum(lengths[full])])
    kept, owner = [], []
    for level in range(1, LEVELS + 1):
        names, first = _level(names, first)
        rows = np.repeat(np.arange(len(full)), np.diff(first))
        whole = np.diff(first)[rows] == 1  # the name of a whole text, on whatever level it is reached
        chosen = np.ones(len(rows), bool) if level >= KEPT else whole
        kept.append((mix(names[chosen] + U64(level)) >> U64(32)).astype(np.int64))
        owner.append(rows[chosen])
        if len(names) == len(full):
            break
    pairs = sorted_unique(np.concatenate(owner) << 32 | np.concatenate(kept))
    rows, values = pairs >> 32, (pairs & 0xFFFFFFFF).astype(np.uint32)
    edge = np.searchsorted(rows, np.arange(len(full) + 1))
    for i, row in enumerate(full):
        result[row] = values[edge[i] : min(edge[i + 1], edge[i] + size)]
    return result


def _written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def _alike(a: np.ndarray, b: np.ndarray, size: int) -> float:
    """The share of the smallest names of both together that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = np.zeros(len(both), bool)
    np.equal(both[1:], both[:-1], out=twice[1:])
    first = np.flatnonzero(~twice)
    # Beyond the end of a full sketch it is not known which names a text lacks.
    least = first[:size]
    return float(twice[np.minimum(least + 1, len(both) - 1)].sum() / len(least))


def likeness(a: str, b: str, size: int = SIZE) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    return _alike(*(np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32) for x in (a, b)), size)


def fingerprints(docs: DataFrame, *, size: int = SIZE) -> DataFrame:
    """doc_id and fingerprint of each document's whole text."""
    prepared(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([_written(x) for x in _sketches(texts, size)], pa.string())], ["doc_id", "fingerprint"])

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(make, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def _pairs(size: int):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row so far, with its sketch
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            marks = _sketches([x.encode() for x in texts], size)
            rows = held + list(zip(batch["pid"].to_pylist(), batch["halo"].to_pylist(), batch["doc_id"].to_pylist(), texts, marks, strict=True))
            held = rows[-1:]
            todo = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if x[0] == y[0] and not x[1]]
            edited = []
            for (_, _, _, text, _), (_, _, _, after, _) in todo:
                k = len(text) // 3
                edited.append((text[: len(text) - k] + after[:k]).encode())
            out = []
            for (x, y), new, mark in zip(todo, edited, _sketches(edited, size), strict=True):
                out.append((x[2], len(x[3]), hashlib.sha256(new).hexdigest(), _written(x[4]), _written(mark), _alike(x[4], mark, size), _alike(x[4], y[4], size)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return pairs


def _range_number(value: Column, bounds: list[int]) -> Column:
    """How many of the bounds, in descending order, are above value: by blocks, then within one."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*(F.lit(b[0]).cast("bigint") for b in blocks))
    block = F.size(F.filter(heads, lambda b: b > value))
    inner = F.array(*(F.array(*(F.lit(x).cast("bigint") for x in b)) for b in blocks))
    within = F.size(F.filter(F.element_at(inner, F.greatest(block, F.lit(1))), lambda b: b > value))
    return F.when(value.isNull(), len(bounds)).when(block == 0, 0).otherwise((block - 1) * step + within)


def edited_pairs(docs: DataFrame, *, size: int = SIZE) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The edited text has its last third of code points replaced by the first as many of the next
    document's in descending doc_id.
    """
    spark = prepared(docs.sparkSession)
    n = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sample = rows.select("doc_id").dropna().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE * n)
    drawn = sorted((r["doc_id"] for r in sample.collect()), reverse=True)
    bounds = sorted({drawn[len(drawn) * i // n] for i in range(1, n)}, reverse=True) if drawn else []
    placed = rows.withColumn("row", F.xxhash64("text")).withColumn("pid", _range_number(F.col("doc_id"), bounds).cast("int"))
    heads = placed.groupBy("pid").agg(F.max(F.struct("doc_id", "row")).alias("head")).orderBy("pid").collect()  # a row for each range
    follow = [(r["pid"], after["head"]["doc_id"], after["head"]["row"]) for r, after in zip(heads, heads[1:] + heads[:1], strict=True)]
    wanted = F.broadcast(spark.createDataFrame(follow, "to_pid int, _id bigint, _row bigint"))
    halo = placed.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))).dropDuplicates(["to_pid"])
    both = placed.withColumn("halo", F.lit(0)).unionByName(halo.select("doc_id", "text", "row", F.col("to_pid").alias("pid"), F.lit(1).alias("halo")))
    dealt = both.repartitionById(len(bounds) + 1, F.col("pid")).sortWithinPartitions("pid", "halo", F.col("doc_id").desc_nulls_last(), F.col("row").desc())
    shape = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(_pairs(size), shape)
