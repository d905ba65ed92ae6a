"""Line deduplication over range-partitioned line hashes.

Each document's lines become 128-bit key hashes with the positions that hold
them.  The hashes are range-partitioned and sorted by key, then document, so
that one pass over each partition streams the first document of every key
(the one that keeps its lines) and the later ones (which lose them).  The range
also splits within a key: a line that a third of all documents hold is dealt
over many partitions.  For the keys at a partition's two ends the pass returns
how many documents it saw and the few rows it could not decide, which a join
of a handful of rows a partition decides.  The result is a compressed bitmap a
document, never text: its runs of kept lines, which slice the lines where the
documents are read.

Defined results: a null or empty text is one empty line; lines are split at
\\n only; rows that share a doc_id count as one document (rows without doc_id
too, as the smallest one); repeated rows lose the same lines; a document may
lose all its lines and then keeps an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, masked, partitions, prepared

SPACE = b" \t\n\x0b\x0c\r"
DROP, OPEN, RUN = 0, 1, 2
#: Bytes of all bitmaps up to which they are broadcast; what a row and a run of one take there.
BROADCAST_BYTES = 32 << 20
ROW_BYTES, RUN_BYTES = 96, 24
KEEP = "array<struct<first:int,lines:int>>"


def _keyed(min_chars: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            digests, owner, positions, lines = [], [], [], []
            for i, text in enumerate(batch["text"].cast(pa.binary()).to_pylist()):
                found: dict[bytes, list[int]] = {}
                split = (text or b"").split(b"\n")
                for at, line in enumerate(split):
                    if len(line) < min_chars:
                        continue
                    line = line.strip(SPACE).lower()
                    n = len(line)
                    if n < min_chars or not line.isascii() and len(line.decode("utf-8", "replace")) < min_chars:
                        continue
                    found.setdefault(digest(line), []).append(at)
                for key, at in found.items():
                    digests.append(key)
                    owner.append(i)
                    positions.append(np.array(at, "<u4").tobytes())
                    lines.append(len(split))
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            owner = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch["doc"].take(owner), batch["row"].take(owner), pa.array(lines, pa.int32()), pa.array(positions, pa.binary())],
                ["hi", "lo", "doc", "row", "n_lines", "positions"],
            )

    return keys


def _sweep(min_docs: int):
    unset = object()

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, text, top, docs, runs, pending, out = None, unset, None, None, 0, 0, [], []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            out.clear()
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "hi", "lo", "doc", "row", "n_lines", "docs", "positions"])

        def close(at_end: bool) -> None:
            if key is not None and (runs == 1 or at_end):
                out.append((RUN, *key, top, None, None, docs, None))
                out.extend((OPEN, *key, *x) for x in pending)
            pending.clear()

        for batch in batches:
            for hi, lo, doc, row, n_lines, positions in zip(*(batch[x].to_pylist() for x in ("hi", "lo", "doc", "row", "n_lines", "positions")), strict=True):
                if (hi, lo) != key:
                    close(False)
                    key, last, top, docs, runs = (hi, lo), unset, doc, 0, runs + 1
                if last is unset or doc != last:
                    docs, last = docs + 1, doc
                elif row == text:
                    continue  # a repeated row
                text = row
                x = (doc, row, n_lines, docs, positions)
                if docs == 1:
                    if runs == 1:
                        out.append((OPEN, *key, *x))
                elif docs < min_docs:
                    pending.append(x)
                else:
                    out.extend((DROP, *key, *y) for y in pending)
                    pending.clear()
                    out.append((DROP, *key, *x))
            yield packed()
        close(True)
        yield packed()

    return sweep


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("first", pa.int32()), ("lines", pa.int32())])
    for batch in batches:
        keep, dropped = [], []
        for n, parts in zip(batch["n_lines"].to_pylist(), batch["positions"].to_pylist(), strict=True):
            bits = np.ones(n + 2, bool)
            bits[[0, -1]] = False
            bits[np.frombuffer(b"".join(parts), "<u4").astype(np.int64) + 1] = False
            dropped.append(n - int(bits.sum()))
            edges = np.flatnonzero(bits[1:] != bits[:-1])
            keep.append([{"first": a, "lines": b - a} for a, b in edges.reshape(-1, 2).tolist()])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], batch["n_lines"], pa.array(dropped, pa.int64()), pa.array(keep, pa.list_(run))], ["doc_id", "row", "n_lines", "n_dropped", "keep"])


def line_keep_bitmaps(docs: DataFrame, *, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """One row per document that loses lines: doc_id, row (xxhash64 of its text), n_lines, n_dropped, keep.

    keep: the bitmap of kept lines, compressed to its runs of ones (first line from 0, lines).  A key is
    a line with ASCII white space stripped and A-Z lower-cased; keys of at least min_chars code points in
    at least min_docs documents stay only in the largest doc_id.  Documents without a row keep everything.
    """
    spark = prepared(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.xxhash64("text").alias("row"), "text")
    keyed = cut(rows.mapInArrow(_keyed(min_chars), "hi bigint, lo bigint, doc bigint, row bigint, n_lines int, positions binary"))
    order = [F.col("hi"), F.col("lo"), F.col("doc").desc_nulls_last()]
    dealt = keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "row")
    swept = cut(dealt.mapInArrow(_sweep(min_docs), "kind int, hi bigint, lo bigint, doc bigint, row bigint, n_lines int, docs bigint, positions binary"))
    runs = swept.where(F.col("kind") == RUN).groupBy("hi", "lo").agg(F.sum("docs").alias("all_docs"), F.max("doc").alias("keeper"))
    decided = swept.where(F.col("kind") == OPEN).join(runs, ["hi", "lo"]).where((F.col("all_docs") >= min_docs) & ~F.col("doc").eqNullSafe(F.col("keeper")))
    names = ["doc", "row", "n_lines", "positions"]
    drops = swept.where(F.col("kind") == DROP).select(*names).unionByName(decided.select(*names))
    # Repeated rows bring the same positions: a set is bounded by the lines of one text.
    each = drops.groupBy(F.col("doc").alias("doc_id"), "row", "n_lines").agg(F.collect_set("positions").alias("positions"))
    return each.mapInArrow(_bitmaps, f"doc_id bigint, row bigint, n_lines int, n_dropped bigint, keep {KEEP}")


def _left(text: Column, keep: Column) -> Column:
    """The lines of text in the runs of keep; split once, as the argument of an outer lambda."""
    runs = lambda lines: F.flatten(F.transform(keep, lambda r: F.slice(lines, r["first"] + 1, r["lines"])))
    return F.element_at(F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.array_join(runs(lines), "\n")), 1)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with the dropped lines gone from text, and n_lines (before) and n_dropped.

    Columns of those two names in docs stay; the new ones then end in an underscore.  All of it is done by
    expressions: only texts that lose lines are split.
    """
    hidden, names = masked(docs), docs.columns
    total, dropped = fresh("n_lines", names), fresh("n_dropped", names)
    small = cut(bitmaps.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("n_lines").alias("_n"), F.col("n_dropped").alias("_gone"), F.col("keep").alias("_keep")))
    if (small.agg(F.sum(F.size("_keep") * RUN_BYTES + ROW_BYTES)).first()[0] or 0) <= BROADCAST_BYTES:
        small = F.broadcast(small)
    doc_id = F.col(f"_c{[x.lower() for x in names].index('doc_id')}").cast("bigint")
    both = hidden.join(small, doc_id.eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_row")), "left")
    whole = F.col("_row").isNull()
    newlines = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0))
    made = both.select(
        *(F.when(whole, F.col("text")).otherwise(_left(F.col("text"), F.col("_keep"))).alias(x) if x == "text" else F.col(x) for x in hidden.columns),
        F.when(whole, newlines + 1).otherwise(F.col("_n")).cast("bigint").alias("_total"),
        F.when(whole, 0).otherwise(F.col("_gone")).cast("bigint").alias("_dropped"),
    )
    return made.select(*(F.col(x if x == "text" else f"_c{i}").alias(n) for i, (x, n) in enumerate(zip(hidden.columns, names, strict=True))), F.col("_total").alias(total), F.col("_dropped").alias(dropped))


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    return apply_bitmaps(docs, line_keep_bitmaps(docs, **options))
