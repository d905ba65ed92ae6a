"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``window`` words; an item of fewer words, but
not none, is one window.  A window's set holds its ``token`` -word shingles.
Containment of a window asks for all of them, so the necessary prefix is one
shingle: the rarest in the corpus, counted over all documents.  A document
meets a window only where that shingle stands; from its offset in the window
follows the only possible start, which length and position bounds and then a
comparison of all the window's words confirm.

Documents are not shuffled.  The benchmark is dealt into blocks of about
``block_words`` words, each of which is broadcast; every document is held
against every block.  What further blocks find is joined by the text's hash, for which
documents are shuffled only where many texts are found.

Defined results: a null or wordless text has no words, no hits and is clean; a
null or wordless item has no windows; items of equal text are all reported;
repeated document rows are judged one by one; a null item_id is not reported
(its windows still count as hits); other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_ALNUM, U64, Words, cut, fresh, list_array, masked, prepared, sequence_hash, signed, sized, slices, text_of, unmasked, words_of

FILTER_BITS = 20
#: Texts found by further blocks up to which their spans are broadcast.
BROADCAST_TEXTS = 50_000
FOUND = "n_words bigint, hits array<struct<start:int,end:int>>, items array<string>"


class Windows(NamedTuple):
    """One block of the benchmark.  Window i has words[first[i]:first[i] + length[i]]."""

    words: np.ndarray
    first: np.ndarray
    length: np.ndarray
    item: np.ndarray
    names: np.ndarray


class Prefixes(NamedTuple):
    """Sorted shingle hashes; shingle i is the prefix of window[start[i]:start[i + 1]], offset words in."""

    size: int
    hashes: np.ndarray
    start: np.ndarray
    window: np.ndarray
    offset: np.ndarray
    bitmap: np.ndarray


def _windows(items: pa.Table, window: int) -> Windows:
    parts, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for _, _, part in slices(text_of(items["text"].combine_chunks())):
        found = words_of(part, NON_ALNUM)
        parts.append(found.hashes)
        counts.append(np.diff(found.first))
    words, count = np.concatenate(parts), np.concatenate(counts)
    starts = np.cumsum(count) - count
    per_item = np.where(count == 0, 0, np.maximum(1, count - window + 1))
    item = np.repeat(np.arange(len(count), dtype=np.int32), per_item)
    first = (starts - np.cumsum(per_item) + per_item)[item] + np.arange(len(item))
    names = np.array([None if x is None else str(x) for x in items["item_id"].to_pylist()], object)
    return Windows(words, first, np.minimum(count[item], window).astype(np.int32), item, names)


def _shingles(w: Windows, token: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By shingle size: the windows that have such shingles, the hash of the shingle at each word of the items, and the words where one begins.

    Windows that overlap share their words' shingles; none is written out for each window.
    """
    made = {}
    for size in range(1, token + 1):
        of = np.flatnonzero(np.minimum(w.length, token) == size)
        if len(of):
            at = np.zeros(len(w.words) + 1, np.int64)
            np.add.at(at, w.first[of], 1)
            np.add.at(at, w.first[of] + w.length[of] - size + 1, -1)
            begins = np.flatnonzero(np.cumsum(at[:-1]) > 0)
            hashes = np.zeros(len(w.words), U64)
            hashes[begins] = sequence_hash(w.words, begins, size)
            made[size] = of, hashes, begins
    return made


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[(hashes >> U64(64 - FILTER_BITS)).astype(np.int64)] = True
    return bits


def _matches(hashes: np.ndarray, known: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose hash is among the sorted known ones, and which one it is."""
    at = np.flatnonzero(bitmap[(hashes >> U64(64 - FILTER_BITS)).astype(np.int64)])
    which = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
    same = known[which] == hashes[at]
    return at[same], which[same]


def _starts(words: Words, size: int) -> np.ndarray:
    at = np.arange(len(words.hashes))
    return at[at + size <= words.first[words.rows() + 1]] if len(at) else at


def _rarity(docs: DataFrame, shingles: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each shingle stands in the documents, over all of them."""
    shared = docs.sparkSession.sparkContext.broadcast({n: (h, _bitmap(h)) for n, h in shingles.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {n: np.zeros(len(h), np.int64) for n, (h, _) in shared.value.items()}
        for batch in batches:
            for _, _, text in slices(text_of(batch["text"])):
                words = words_of(text, NON_ALNUM)
                for n, (known, bitmap) in shared.value.items():
                    _, which = _matches(sequence_hash(words.hashes, _starts(words, n), n), known, bitmap)
                    totals[n] += np.bincount(which, minlength=len(known))
        for n, total in totals.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), n), pa.int32()), signed(seen), signed(total[seen])], ["size", "shingle", "n"])

    counted = docs.select("text").mapInArrow(count, "size int, shingle bigint, n bigint").groupBy("size", "shingle").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    out = {n: np.zeros(len(h), np.int64) for n, h in shingles.items()}
    for n in out:
        rows = got.filter(pa.compute.equal(got["size"], n))
        out[n][rows["shingle"].to_numpy()] = rows["n"].to_numpy()
    return out


def _prefixes(docs: DataFrame, w: Windows, token: int) -> list[Prefixes]:
    """The rarest shingle of each window, by a running minimum over its words; of equally rare ones that of smallest hash."""
    made = _shingles(w, token)
    unique = {n: np.unique(h[begins]) for n, (_, h, begins) in made.items()}
    often = _rarity(docs, unique)
    out = []
    for n, (of, h, begins) in made.items():
        place = np.empty(len(unique[n]), np.int64)
        place[np.lexsort((unique[n], often[n]))] = np.arange(len(place))
        rank = np.zeros(len(h), np.int64)
        rank[begins] = place[np.searchsorted(unique[n], h[begins])]
        first, last = w.first[of], w.length[of] - n
        best, offset = rank[first], np.zeros(len(of), np.int64)
        for j in range(1, int(last.max(initial=0)) + 1):
            other = rank[np.minimum(first + j, len(rank) - 1)]
            rarer = (j <= last) & (other < best)
            best[rarer], offset[rarer] = other[rarer], j
        of_best = h[first + offset]
        order = np.argsort(of_best, kind="stable")
        hashes, start = np.unique(of_best[order], return_index=True)
        out.append(Prefixes(n, hashes, np.r_[start, len(order)], of[order], offset[order], _bitmap(hashes)))
    return out


def _occurrences(words: Words, w: Windows, prefixes: list[Prefixes]) -> tuple[np.ndarray, np.ndarray]:
    """Every occurrence of a window: the position of its first word, and the window."""
    rows, found = words.rows(), []
    for p in prefixes:
        begins = _starts(words, p.size)
        at, which = _matches(sequence_hash(words.hashes, begins, p.size), p.hashes, p.bitmap)
        if not len(at):
            continue
        n = p.start[which + 1] - p.start[which]
        entry = np.repeat(p.start[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, window = np.repeat(begins[at], n), p.window[entry]
        row, start = rows[at], at - p.offset[entry]
        fits = (start >= words.first[row]) & (start + w.length[window] <= words.first[row + 1])
        start, window = start[fits], window[fits]
        for j in range(int(w.length[window].max(initial=0))):
            same = (j >= w.length[window]) | (words.hashes[np.minimum(start + j, len(rows) - 1)] == w.words[np.minimum(w.first[window] + j, len(w.words) - 1)])
            start, window = start[same], window[same]
        found.append((start, window))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _scanner(shared, names: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, prefixes = shared.value
        for batch in batches:
            for lo, hi, text in slices(text_of(batch["text"])):
                words = words_of(text, NON_ALNUM)
                start, window = _occurrences(words, w, prefixes)
                edge = np.zeros(len(words.hashes) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + w.length[window], -1)
                hit = np.cumsum(edge[:-1]) > 0
                row = words.rows()
                opens, closes = hit.copy(), hit.copy()
                opens[1:] &= ~(hit[:-1] & (row[1:] == row[:-1]))
                closes[:-1] &= ~(hit[1:] & (row[1:] == row[:-1]))
                a, b = np.flatnonzero(opens), np.flatnonzero(closes)
                base = words.first[row[a]]
                spans = pa.StructArray.from_arrays([pa.array(a - base, pa.int32()), pa.array(b + 1 - base, pa.int32())], ["start", "end"])
                pairs = np.unique(np.stack([row[start], w.item[window]], 1), axis=0) if len(start) else np.zeros((0, 2), np.int64)
                pairs = pairs[[w.names[i] is not None for i in pairs[:, 1]]] if len(pairs) else pairs
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [*(batch[x][lo:hi] for x in names), signed(np.diff(words.first)), list_array(spans, np.bincount(row[a], minlength=n)), list_array(pa.array(w.names[pairs[:, 1]], pa.string()), np.bincount(pairs[:, 0], minlength=n))],
                    [*names, "n_words", "hits", "items"],
                )

    return scan


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, keys: list[str], window: int = 13, token: int = 3, block_words: int = 2_000_000) -> DataFrame:
    """One row per document: keys, n_words, hits (merged spans of word positions), items (ids of occurring items).

    keys: columns of docs to carry along.  Results depend on the text alone, so what further blocks of the
    benchmark find is kept by text and joined.
    """
    prepared(docs.sparkSession)
    items = benchmark.select("item_id", "text")
    total = items.agg(F.sum(F.regexp_count("text", F.lit(r"(?i)[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    slim, names = docs.select(*dict.fromkeys([*keys, "text"])), list(keys)
    own = [fresh("_key", slim.columns), fresh("_more", slim.columns)]
    if blocks > 1:
        slim, names = slim.withColumns({own[0]: F.xxhash64("text"), own[1]: F.xxhash64("text", F.lit(1))}), [*keys, *own]

    def scanned(block: int, columns: list[str]) -> DataFrame:
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        w = _windows(part.toArrow(), window)
        shared = docs.sparkSession.sparkContext.broadcast((w, _prefixes(docs, w, token) if len(w.first) else []))
        shape = ", ".join(f"`{x}` {slim.schema[x].dataType.simpleString()}" for x in columns) + f", {FOUND}"
        return slim.select(*dict.fromkeys([*columns, "text"])).mapInArrow(_scanner(shared, columns), shape)

    first = scanned(0, names)
    if blocks == 1:
        return first
    rest = [scanned(block, own).where(F.size("hits") > 0).groupBy(*own).agg(F.first("hits").alias("hits"), F.first("items").alias("items")) for block in range(1, blocks)]
    union = rest[0]
    for more in rest[1:]:
        union = union.unionByName(more)
    found = cut(union.groupBy(*(F.col(x).alias(f"_r{i}") for i, x in enumerate(own))).agg(F.flatten(F.collect_list("hits")).alias("_r_hits"), F.flatten(F.collect_list("items")).alias("_r_items")))
    both = first.join(sized(found, BROADCAST_TEXTS), (F.col(own[0]) == F.col("_r0")) & (F.col(own[1]) == F.col("_r1")), "left")
    none = F.array().cast("array<string>")
    hits = F.when(F.col("_r_hits").isNull(), F.col("hits")).otherwise(_merged_spans(F.concat("hits", "_r_hits")))
    every = F.array_sort(F.concat("items", F.coalesce("_r_items", none)))
    return both.select(*keys, "n_words", hits.alias("hits"), every.alias("items"))


def _merged_spans(spans):
    """Overlapping or touching spans as one."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), empty, step)


def judged(found: DataFrame, share: float = 0.05) -> DataFrame:
    """Adds n_hit, n_items and contaminated: hit words, and at least that share of all."""
    per = round(1 / share)
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    out = found.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("bigint")})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * per >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    hidden = masked(docs)
    found = find_contamination(hidden, benchmark, keys=hidden.columns, **options)
    return unmasked(judged(found).where(~F.col("contaminated")), docs.columns)
