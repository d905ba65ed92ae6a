"""Substring and regex search through an index of grams, three bytes of UTF-8 each.

Texts are numbered; BLOCK_BITS bits of a number are its place in a block of texts.  The index
has rows for each gram and block: the sorted places of the texts that hold the gram, written
as differences (Parquet's delta encoding), so that a gram that is in every text is as many
small rows as there are blocks.  A task writes the rows of WINDOW bytes of texts at a time, by
gram and without a shuffle; pages are short, so that a reader leaves out those of other grams.
A query's literal must be in a text as a whole, so all of its grams must; the rarest few are
intersected block by block, and what is left is read from the texts' own files by block and
held against the query itself.  The index thus changes what is read, never what is found.

Grams are of folded text (ASCII case), so one index serves both cases.  Literals of fewer
than three bytes, and patterns from which none can be drawn, read all texts.

Defined results: those of search.substring_search() and search.grep() on all texts; null and
empty texts are never found; rows may share a key; an empty table gives none.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import smart_case
from ..lineage import cut
from ..session import arrow_map
from . import search
from .store import numbered

with warnings.catch_warnings():
    warnings.simplefilter("ignore")
    from re import _constants as rc
    from re import _parser as rp

#: log2 of the texts in a block; grams that are intersected; bytes of texts whose grams are sorted together; rows of a page.
BLOCK_BITS, RAREST, WINDOW, PAGE_ROWS = 14, 4, 1 << 22, 1000
#: Grams that there can be.
GRAMS = 1 << 24
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def grams(literal: str) -> list[int]:
    return np.unique(_codes(np.frombuffer(literal.encode(), np.uint8))).tolist()


def _codes(data: np.ndarray) -> np.ndarray:
    """The gram at each byte but the last two, folded."""
    low = _LOWER[data].astype(np.int32)
    return (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]


def _grams_of(data: np.ndarray) -> np.ndarray:
    """The distinct grams of one text, whatever its length."""
    seen = np.zeros(GRAMS, bool)
    for lo in range(0, len(data), WINDOW):
        seen[_codes(data[lo : lo + WINDOW + 2])] = True
    return np.flatnonzero(seen)


def postings(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a gram and the number of a text that holds it, by both; texts lie one after the other, up to ends."""
    if len(ends) == 1 and len(data) > WINDOW:
        every = _grams_of(data)
        return every, np.zeros(len(every), np.int64)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    inside = text[:-2] == text[2:]
    pairs = np.sort((_codes(data)[inside].astype(np.int64) << 32) | text[:-2][inside])
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    return pairs >> 32, pairs & 0xFFFFFFFF


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, block, n and places for each gram of each window of a block's texts."""
    for batch in batches:
        block, place = (batch[c].to_numpy(zero_copy_only=False) for c in ("block", "place"))
        order = np.lexsort((place, block))
        block, place, text = block[order], place[order], batch["text"].take(pa.array(order))
        if not len(text):
            continue
        ends = np.frombuffer(text.buffers()[1], np.int32 if text.type == pa.binary() else np.int64)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        lo = 0
        while lo < len(block):
            hi = max(lo + 1, min(int(np.searchsorted(ends, ends[lo] + WINDOW, "right")) - 1, int(np.searchsorted(block, block[lo], "right"))))
            gram, at = postings(data[ends[lo] : ends[hi]], ends[lo + 1 : hi + 1] - ends[lo])
            first = np.flatnonzero(np.diff(gram, prepend=-1) != 0)
            bounds = np.append(first, len(gram))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(place[lo:hi][at], pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(gram[first], pa.int32()), pa.array(np.full(len(first), block[lo]), pa.int64()), pa.array(np.diff(bounds), pa.int32()), lists], ["gram", "block", "n", "places"])
            lo = hi


def required_literal(pattern: str) -> str:
    """The longest run of characters that every match of a regex holds; empty if none can be told.

    Only plain characters of the outermost sequence count, and of what is repeated at least once in it;
    classes, choices and what may be absent end a run.  Letters outside ASCII end one too, as case may be
    ignored and only ASCII is folded alike.
    """
    try:
        tree = rp.parse(pattern)
    except (rc.error, OverflowError, RecursionError):
        return ""
    runs, now = [], ""

    def walk(items) -> None:
        nonlocal now
        for op, value in items:
            if op is rc.LITERAL and value < 128:
                now += chr(value)
            elif op is rc.SUBPATTERN and not value[1] and not value[2]:
                walk(value[3])
            elif op is rc.AT:
                continue
            else:
                runs.append(now)
                now = ""
                if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and value[0] >= 1:
                    walk(value[2])
                    runs.append(now)
                    now = ""

    walk(tree)
    return max([*runs, now], key=len)


class TrigramIndex:
    """An index below a folder of any file system: texts by block, and postings by gram."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, rows: DataFrame, text: str, order: list[str]) -> None:
        """Writes rows (any columns) numbered in order, which brings near texts into one block, and their postings."""
        kept = numbered(rows.where(F.length(text) > 0), order, -1, "_id").withColumn("_block", F.shiftright("_id", BLOCK_BITS))
        kept.hint("rebalance", "_block").write.partitionBy("_block").parquet(f"{self.root}/texts")
        texts = self.spark.read.parquet(f"{self.root}/texts")
        place = F.col("_id").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
        slim = texts.select(F.col("_block").cast("bigint").alias("block"), place.alias("place"), F.col(text).cast("binary").alias("text"))
        lists = arrow_map(slim, _post, "gram int, block bigint, n int, places array<int>")
        written = lists.write.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")
        written.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.root}/grams")
        self.spark.read.parquet(f"{self.root}/grams").groupBy("gram").agg(F.sum("n").alias("n")).write.parquet(f"{self.root}/counts")

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/texts")

    def candidates(self, literal: str) -> DataFrame | None:
        """block and _id of the texts that hold the rarest grams of a literal; None if it has no gram."""
        wanted = grams(literal)
        if not wanted:
            return None
        # As many rows as the literal has grams.
        found = self.spark.read.parquet(f"{self.root}/counts").where(F.col("gram").isin(wanted)).collect()
        if len(found) < len(wanted):
            return self.spark.createDataFrame([], "_block int, _id bigint")
        rarest = [r["gram"] for r in sorted(found, key=lambda r: (r["n"], r["gram"]))[:RAREST]]
        lists = self.spark.read.parquet(f"{self.root}/grams").where(F.col("gram").isin(rarest))
        whole = lists.groupBy("block", "gram").agg(F.flatten(F.collect_list("places")).alias("places"))
        held = whole.groupBy("block").agg(F.collect_list("places").alias("all")).where(F.size("all") == len(rarest))
        shared = F.aggregate(F.slice("all", 2, len(rarest)), F.element_at("all", 1), lambda a, b: F.array_intersect(a, b))
        return held.select(F.col("block").cast("int").alias("_block"), F.explode(shared).alias("_p")).select("_block", (F.shiftleft(F.col("_block").cast("bigint"), BLOCK_BITS) + F.col("_p")).alias("_id"))

    def narrowed(self, literal: str) -> DataFrame:
        """The texts that may hold a literal: only blocks with candidates are read."""
        some = self.candidates(literal)
        if some is None:
            return self.texts().drop("_id", "_block")
        some = cut(some)
        # One number for each block of texts.
        blocks = [r[0] for r in some.select("_block").distinct().collect()]
        return self.texts().where(F.col("_block").isin(blocks)).join(some.select("_id"), "_id", "left_semi").drop("_id", "_block")

    def substring_search(self, query: str, **options) -> DataFrame:
        """As search.substring_search() over the indexed chunks."""
        rows = self.narrowed(query) if query.strip() else self.texts().limit(0)
        return search.substring_search(rows, query, **options)

    def grep(self, pattern: str, *, ignore_case: bool = False, smart: bool = True, context: int = 0) -> DataFrame:
        """As search.grep() over the indexed files (path, text)."""
        literal = required_literal(smart_case(pattern, ignore_case) if smart else pattern)
        return search.grep(self.narrowed(literal), pattern, ignore_case=ignore_case, smart=smart, context=context)

    def share_read(self, literal: str) -> float:
        """The share of all texts that a literal leaves to be read."""
        some, every = self.candidates(literal), self.texts().count()
        return (every if some is None else some.count()) / every if every else 0.0
