"""Mixing sources to target weights by blocks of fixed length.

Each source's words are packed, document after document, into blocks of
``block`` words.  The mix has as many slots as its targets need blocks; a slot
of a source maps through a pseudorandom permutation of that source's block
numbers (another one for each pass over the source), and the block is joined by
its number.  Output shards of ``shard_slots`` slots draw how many slots each
source gets from a multinomial over what the sources still owe, so that every
shard looks like the mix and the totals are met to the word (the last slot of a
source is cut to fit).

The word positions come from two-level sums, buckets first, so that a source
with a third of all rows is spread over many tasks.

Defined results: sources are ranked by code point, null last; a source without
words has target 0; a null or wordless text has size 0 and is never taken; rows
that repeat are packed one by one; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, cut, mix, prepared

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
#: Documents whose positions one task sums.
BUCKET_ROWS = 2_000
#: Groups of shards that the driver draws; the shards of a group are drawn by a task.
GROUPS = 1024


def _key(*parts: int) -> int:
    k = 0
    for p in parts:
        k = int(mix(np.array([(k * 31 + p + 1) & 0xFFFFFFFFFFFFFFFF], U64))[0])
    return k


def _rounds(key: int) -> list[np.uint64]:
    return [U64(_key(key, r)) for r in range(4)]


def permuted(index: np.ndarray, n: int, key: int, *, inverse: bool = False) -> np.ndarray:
    """index through a pseudorandom permutation of 0..n-1: a Feistel cipher that walks on until it is below n."""
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    mask, shift, keys = U64((1 << half) - 1), U64(half), _rounds(key)
    out = index.astype(U64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        a, b = x >> shift, x & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                a, b = b ^ (mix(a ^ k) & mask), a
            else:
                a, b = b, a ^ (mix(b ^ k) & mask)
        out[todo] = a << shift | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


class Source(NamedTuple):
    """What the mix takes of a source: slots blocks, the last cut to last words."""

    words: int
    blocks: int
    slots: int
    last: int
    key: int


def planned(size: int, target: float, block: int, key: int) -> Source:
    """As many slots as give the rounded target to the word."""
    want = min(round(target), CAP * size)
    if size <= 0 or want <= 0:
        return Source(size, 0, 0, 0, key)
    n = -(-size // block)
    passes, rest = divmod(want, size)
    if not rest:
        return Source(size, n, passes * n, size - (n - 1) * block if permuted(np.array([n - 1]), n, _key(key, passes - 1))[0] == n - 1 else block, key)
    lack = n * block - size  # of the short last block
    at = int(permuted(np.array([n - 1]), n, _key(key, passes), inverse=True)[0])
    slots = -(-rest // block)
    if at < slots:
        slots = -(-(rest + lack) // block)
    before = (slots - 1) * block - (lack if at < slots - 1 else 0)
    return Source(size, n, passes * n + slots, rest - before, key)


def _drawn(owed: np.ndarray, slots: int, rng: np.random.Generator) -> np.ndarray:
    """A multinomial draw of slots by what is owed, none above it."""
    got = np.zeros(len(owed), np.int64)
    slots = min(slots, int(owed.sum()))
    while slots > 0:
        left = owed - got
        got = np.minimum(owed, got + rng.multinomial(slots, left / left.sum()))
        slots = slots - int(got.sum() - (owed - left).sum())
    return got


def _shards(sources: list[Source], shard_slots: int, block: int, seed: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, first, count, owed, done in zip(*(batch[x].to_pylist() for x in ("group", "first", "shards", "owed", "done")), strict=True):
                rng = np.random.default_rng([seed, 1, group])
                owed, done = np.array(owed), np.array(done)
                for shard in range(first, first + count):
                    drawn = _drawn(owed, shard_slots if shard < first + count - 1 else int(owed.sum()), rng)
                    parts = []
                    for s, (source, n) in enumerate(zip(sources, drawn, strict=True)):
                        number = done[s] + np.arange(n)
                        blocks = np.empty(n, np.int64)
                        for turn in np.unique(number // source.blocks) if n else ():
                            here = number // source.blocks == turn
                            blocks[here] = permuted(number[here] % source.blocks, source.blocks, _key(source.key, int(turn)))
                        take = np.minimum(block, source.words - blocks * block)
                        take[number == source.slots - 1] = source.last
                        parts.append((np.full(n, s), blocks, take))
                    rank, blocks, take = (np.concatenate(x) for x in zip(*parts, strict=True))
                    order = rng.permutation(len(rank))
                    owed, done = owed - drawn, done + drawn
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(order), shard), pa.int64()), pa.array(np.arange(len(order)), pa.int32()), pa.array(rank[order], pa.int32()), pa.array(blocks[order], pa.int64()), pa.array(take[order], pa.int32())],
                        ["shard", "slot", "rank", "block", "take"],
                    )

    return make


class Mix(NamedTuple):
    """sources: source, rank, source_size, target.  slots: shard, slot, rank, block, take.

    pieces: rank, block, doc_id, size, start (of the document in its source), and the words begin..end
    of the block that the document fills.  wordless: the documents without words.
    """

    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame
    wordless: DataFrame

    def blocks(self) -> DataFrame:
        """The mix itself: one row for each slot and document in its block, with the word span taken."""
        cut_off = F.least("end", "take")
        joined = self.slots.hint("merge").join(self.pieces, ["rank", "block"]).where(F.col("begin") < F.col("take"))
        return joined.select("shard", "slot", "rank", "block", "doc_id", (F.col("offset")).alias("from_word"), (F.col("offset") + cut_off - F.col("begin")).alias("to_word"))

    def taken(self) -> DataFrame:
        """Words the mix takes of each document: doc_id, size, source_size, target, taken."""
        # Slots come out of a few rows of plans: the planner must not take them for small.
        often = self.slots.groupBy("rank", "block", "take").agg(F.count("*").alias("n"))
        words = F.greatest(F.lit(0), F.least("end", "take") - F.col("begin")) * F.col("n")
        each = self.pieces.join(often.hint("merge"), ["rank", "block"], "left").groupBy("rank", "start", "doc_id", "size").agg(F.coalesce(F.sum(words), F.lit(0)).cast("bigint").alias("taken"))
        every = each.select("rank", "doc_id", "size", "taken").unionByName(self.wordless.select("rank", "doc_id", "size", F.lit(0).cast("bigint").alias("taken")))
        return every.join(F.broadcast(self.sources), "rank").select("doc_id", "size", "source_size", "target", "taken")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """source, rank, source_size, target of a table (source, size); one row for each source.

    Targets share the sum of all sizes by weight; one above cap times its source's size stops there and
    the excess goes to the others by weight: each is the lesser of its cap and a common level times its
    weight.  The level is found where sources, in the order in which they fill up, first have room.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = each.withColumn("rank", F.row_number().over(by_source) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    filling = Window.orderBy((F.col("source_size") * cap / F.col("weight")), "rank")
    before, after, every = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap) / F.sum("weight").over(after)
    levels = ranked.withColumn("weight", weight).withColumn("level", level).withColumn("room", F.col("source_size") * cap / F.col("weight") >= F.col("level"))
    common = F.min(F.when(F.col("room"), F.struct(F.col("source_size") * cap / F.col("weight"), "rank", "level"))).over(every)["level"]
    full = F.col("source_size") * float(cap)
    return levels.select("source", "rank", "source_size", F.least(full, F.coalesce(common, F.lit(0.0)) * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), block: int = 128, shard_slots: int = 4096, seed: int = 17) -> Mix:
    """The mix of docs (doc_id, text, source) to the targets of source_targets()."""
    spark = prepared(docs.sparkSession)
    sized = cut(docs.select(F.col("doc_id"), F.col("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")))
    sources = cut(source_targets(sized, weights))
    known = sources.orderBy("rank").collect()  # the mix's own weights: a row for each source
    plans = [planned(int(r["source_size"]), float(r["target"]), block, _key(seed, r["rank"])) for r in known]

    buckets = max(1, -(-sized.count() // BUCKET_ROWS))
    ids = sources.select(F.col("source").alias("_source"), "rank")
    placed = sized.join(F.broadcast(ids), F.col("source").eqNullSafe(F.col("_source"))).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets))).select("doc_id", "size", "rank", "bucket")
    some = placed.where("size > 0")
    totals = some.groupBy("rank", "bucket").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("rank", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("rank", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    starts = some.withColumn("upto", F.sum("size").over(within)).join(totals, ["rank", "bucket"]).withColumn("start", F.col("ahead") + F.col("upto") - F.col("size"))
    numbers = F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")
    begin = F.greatest(F.lit(0), F.col("start") - F.col("block") * block).cast("int")
    end = F.least(F.lit(block), F.col("start") + F.col("size") - F.col("block") * block).cast("int")
    pieces = starts.withColumn("block", F.explode(numbers)).select("rank", "block", "doc_id", "size", "start", begin.alias("begin"), end.alias("end"), (F.greatest(F.lit(0), F.col("block") * block - F.col("start"))).alias("offset"))

    slots_each = np.array([p.slots for p in plans], np.int64)
    n_shards = int(-(-slots_each.sum() // shard_slots)) if len(plans) else 0
    per, rng, done, groups = max(1, -(-n_shards // GROUPS)), np.random.default_rng([seed, 0]), np.zeros(len(plans), np.int64), []
    for g, first in enumerate(range(0, n_shards, per)):
        count = min(per, n_shards - first)
        drawn = _drawn(slots_each - done, count * shard_slots if first + count < n_shards else int((slots_each - done).sum()), rng)
        groups.append((g, first, count, drawn.tolist(), done.tolist()))
        done = done + drawn
    drawn = spark.createDataFrame(groups, "group int, first bigint, shards int, owed array<bigint>, done array<bigint>").repartition(max(1, min(len(groups), spark.sparkContext.defaultParallelism)))
    slots = drawn.mapInArrow(_shards(plans, shard_slots, block, seed), "shard bigint, slot int, rank int, block bigint, take int")
    return Mix(sources, slots, pieces, placed.where("size = 0"))
