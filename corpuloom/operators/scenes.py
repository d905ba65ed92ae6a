"""Scenes from frame differences: a sequential rule, evaluated over ranges.

A frame begins a scene where its difference reaches a threshold and at least ``shortest``
frames have gone by since the last scene began.  Which frames count thus depends on all before
them.  Only frames over the threshold matter; they are dealt into ranges of video and frame,
and each range says, for every frame that can be its first cut, where its last cut will be.
As the cut before lies ahead of the range, that is one of the frames within ``shortest`` of
its first, so this takes a few numbers.  They are followed range by range for each video (a
row each), and every range then marks its cuts with the one that came before.

A video of any length is thus many tasks; none holds more than a batch of its frames, but for
the ranges of frames over the threshold.

Defined results: frames that repeat count by their largest difference; null frames are left
out, null differences are 0; null is a video; the last scene ends behind the last frame; an
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..session import arrow_map

THRESHOLD, SHORTEST = 27.0, 15


def _last_cuts(at: np.ndarray, shortest: int) -> np.ndarray:
    """For each frame taken as a cut, the last cut of the range."""
    after = np.searchsorted(at, at + shortest)
    last = at.copy()
    for i in range(len(at) - 1, -1, -1):
        if after[i] < len(at):
            last[i] = last[after[i]]
    return last


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda r: tuple(r[k] for k in keys))


def _summaries(shortest: int):
    shape = pa.schema([("video", pa.string()), ("part", pa.int64()), ("starts", pa.list_(pa.int64())), ("lasts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (video, part), rows in _groups(batches, ("video", "part")):
            at = np.fromiter((r["frame"] for r in rows), np.int64)
            n = min(len(at), int(np.searchsorted(at, at[0] + shortest)) + 1)
            yield pa.RecordBatch.from_pylist([{"video": video, "part": part, "starts": at[:n].tolist(), "lasts": _last_cuts(at, shortest)[:n].tolist()}], shape)

    return run


def _followed(shortest: int):
    """The last cut before each range, and before the end (part null) of each video."""
    shape = pa.schema([("video", pa.string()), ("part", pa.int64()), ("before", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (video,), rows in _groups(batches, ("video",)):
            made, last = [], None
            for r in rows:
                last = r["first"] if last is None else last
                made.append({"video": video, "part": r["part"], "before": last})
                i = int(np.searchsorted(np.array(r["starts"]), last + shortest))
                last = r["lasts"][i] if i < len(r["starts"]) else last
            yield pa.RecordBatch.from_pylist([*made, {"video": video, "part": None, "before": last}], shape)

    return run


def _marked(shortest: int):
    shape = pa.schema([("video", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (video, _), rows in _groups(batches, ("video", "part")):
            made, last = [], None
            for r in rows:
                if r["before"] is not None:
                    last = r["before"]
                elif r["frame"] >= last + shortest:
                    made.append({"video": video, "start": last, "end": r["frame"]})
                    last = r["frame"]
                if len(made) >= 1000:
                    yield pa.RecordBatch.from_pylist(made, shape)
                    made = []
            yield pa.RecordBatch.from_pylist(made, shape)

    return run


def scenes(frames: DataFrame, threshold: float = THRESHOLD, shortest: int = SHORTEST) -> DataFrame:
    """video, start and end (exclusive) of each scene; frames: video (string), frame (long), difference (double)."""
    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = frames.where(F.col("frame").isNotNull()).select("video", F.col("frame").cast("bigint").alias("frame"), F.coalesce(F.col("difference").cast("double"), F.lit(0.0)).alias("difference"))
    ends = slim.groupBy(F.col("video").alias("_video")).agg(F.min("frame").alias("first"), F.max("frame").alias("_last"))
    over = slim.where(F.col("difference") >= threshold).select("video", "frame").distinct()
    # Kept with its ranges, which three later steps read.
    dealt = cut(over.repartitionByRange(n, "video", "frame").sortWithinPartitions("video", "frame").withColumn("part", F.spark_partition_id().cast("bigint")))
    found = arrow_map(dealt, _summaries(shortest), "video string, part bigint, starts array<bigint>, lasts array<bigint>")
    with_first = found.join(ends, F.col("video").eqNullSafe(F.col("_video"))).select("video", "part", "starts", "lasts", "first")
    before = cut(arrow_map(with_first.repartition(n, "video").sortWithinPartitions("video", "part"), _followed(shortest), "video string, part bigint, before bigint"))
    none = F.lit(None).cast("bigint")
    marks = before.where("part IS NOT NULL").select("video", "part", none.alias("frame"), "before")
    stream = dealt.select("video", "part", "frame", none.alias("before")).unionByName(marks).repartition(n, "video", "part").sortWithinPartitions("video", "part", F.asc_nulls_first("frame"))
    cuts = arrow_map(stream, _marked(shortest), "video string, start bigint, end bigint")
    last = before.where("part IS NULL").select(F.col("video").alias("_v"), "before")
    final = ends.join(last, F.col("_video").eqNullSafe(F.col("_v")), "left").select(F.col("_video").alias("video"), F.coalesce("before", "first").alias("start"), (F.col("_last") + 1).alias("end"))
    return cuts.unionByName(final)
