"""Requests answered from stored extractions where there are any, else computed once and stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import extraction_id
from ..lineage import cut
from ..operators.chunks import cacheable
from ..operators.store import Store


def dispatched(store: Store, requests: DataFrame, compute: Callable[[DataFrame], DataFrame], fresh: bool = False, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """position, file_uri, id, output and cached of each request, in order of position.

    requests: position, file_uri, content_hash, profile, model, mode, extra, created_at.  Requests of the same
    id are computed once: compute gets one request of each id that is not stored and gives id and output; if it
    hands on all columns that it gets, outputs do not have to meet their requests again.
    What it gives is kept by a checkpoint before it is stored and returned, so that it runs once; outputs
    that are empty, null or say an error in brackets are returned but not stored, nor are those of a file that
    the store does not have.  Requests without a content hash are computed each for itself and not stored.  fresh: stored extractions of the requests are evicted first.
    shown: what to return of an output, worked out where it lies, before outputs move to their requests.
    """
    known = extraction_id(F.col("content_hash"), F.col("profile"), F.col("model"), F.col("mode"), F.lit(False), F.col("extra"))
    alone = F.concat(F.lit("request "), F.col("position"))
    asked = cut(requests.withColumn("id", F.when(F.col("content_hash").isNull(), alone).otherwise(known)))
    if fresh:
        store.evict_extractions(asked.select("id").distinct())
    show = lambda answers: answers if shown is None else answers.withColumn("output", shown(F.col("output")))
    hits = cut(show(store.outputs(asked.where("content_hash IS NOT NULL").select("id").distinct())))
    files = store.read("files").select(F.col("uri").alias("file_uri"), F.lit(True).alias("stored")).distinct()
    missed = cut(asked.join(hits.select("id"), "id", "left_anti").dropDuplicates(["id"]).join(files, "file_uri", "left"))
    made = compute(missed)
    if not {*missed.columns} <= {*made.columns}:
        made = missed.join(made.select("id", "output"), "id")
    made = cut(made.select(*missed.columns, "output"))
    if not made.groupBy("id").count().where("count > 1").isEmpty():
        made = cut(made.dropDuplicates(["id"]))
    # Outputs are written and shown where the checkpoint has them.
    worth = made.where(F.col("content_hash").isNotNull() & F.col("stored") & F.col("output").isNotNull() & (F.col("output") != "") & cacheable(F.col("output")))
    if not worth.isEmpty():
        store.put_kept(worth.withColumns({"detail": F.lit(0), "metadata": F.lit(None).cast("string")}))
    answers = hits.withColumn("cached", F.lit(True)).unionByName(show(made.select("id", "output")).withColumn("cached", F.lit(False)))
    return asked.join(answers, "id", "left").select("position", "file_uri", "id", "output", F.coalesce("cached", F.lit(False)).alias("cached")).orderBy("position")
