"""Ordered, role-tagged items with short ids, and the messages made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import ref_id
from ..lineage import cut
from ..schema import ROLES

#: Mistyped ids up to which they are broadcast.
MOST_WANTED = 10_000


def with_refs(items: DataFrame, session: str, key: str, attempts: int = 32) -> DataFrame:
    """Adds ref_id; ids that several keys of the session share are hashed again for all but the smallest key, until none is left.

    A session of more keys than short ids can tell apart is an error.
    """
    out = items.withColumn("ref_id", ref_id(F.col("kind"), F.lit(session), F.col(key).cast("string")))
    for attempt in range(1, attempts):
        if out.groupBy("ref_id").count().where("count > 1").isEmpty():
            return out
        order = Window.partitionBy("ref_id").orderBy(key)
        clash = F.row_number().over(order) > 1
        # A round is kept, so that the next does not work all rounds before out again.
        out = cut(out.withColumn("_clash", clash).withColumn("ref_id", F.when(F.col("_clash"), ref_id(F.col("kind"), F.lit(session), F.col(key).cast("string"), attempt)).otherwise(F.col("ref_id"))).drop("_clash"))
    raise ValueError(f"too many items for short ids in session {session}")


def refs_column(files: DataFrame, refs: DataFrame, session: str | None) -> DataFrame:
    """files with session_id and ref_id (of refs: path, ref_id; null where a path has none); as they are without a session."""
    if session is None:
        return files
    known = refs.select(F.col("path").alias("_path"), "ref_id")
    return files.join(known, F.col("path") == F.col("_path"), "left").drop("_path").withColumn("session_id", F.lit(session))


def valid_items(items: DataFrame) -> DataFrame:
    """Items of a known role; only users have other than text."""
    return items.where(F.col("role").isin(*ROLES) & ((F.col("role") == "user") | (F.col("kind") == "text")))


def metadata_line(ref: Column, note: Column, summary: Column, extras: Column) -> Column:
    """[ref=id], the note or else the summary, and (k=v, ...) of the other entries (array of k, v)."""
    rest = F.array_join(F.transform(extras, lambda x: F.concat_ws("=", x["k"], x["v"])), ", ")
    return F.concat_ws(" ", F.concat(F.lit("[ref="), ref, F.lit("]")), F.coalesce(note, summary), F.when(F.size(extras) > 0, F.concat(F.lit("("), rest, F.lit(")"))))


def role_runs(items: DataFrame, conversation: str = "conv_id", position: str = "turn") -> DataFrame:
    """Adds run, the number of the consecutive run of one role within a conversation."""
    order = Window.partitionBy(conversation).orderBy(position)
    change = F.when(F.lag("role").over(order) == F.col("role"), 0).otherwise(1)
    return items.withColumn("_change", change).withColumn("run", F.sum("_change").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def messages(items: DataFrame, conversation: str = "conv_id", position: str = "turn") -> DataFrame:
    """One message for each run of a role: conversation, run, role and content (texts in order)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(position, "text"))), lambda x: x["text"])
    return role_runs(items, conversation, position).groupBy(conversation, "run", "role").agg(parts.alias("content"))


def single_turn(items: DataFrame, conversation: str = "conv_id", position: str = "turn") -> DataFrame:
    """One user turn a conversation: texts in order, those of other roles behind a [role=x] part."""
    part = F.when(F.col("role") == "user", F.array("text")).otherwise(F.array(F.concat(F.lit("[role="), F.col("role"), F.lit("]")), F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct(position, part.alias("parts"))))
    return items.groupBy(conversation).agg(F.flatten(F.transform(ordered, lambda x: x["parts"])).alias("parts"))


def closest_refs(refs: DataFrame, wanted: DataFrame, most: int = 4) -> DataFrame:
    """wanted and its suggestion: the ref of the same prefix at the least edit distance, up to most; the first position wins.

    refs: ref_id, pos; wanted: mistyped ids, broadcast up to MOST_WANTED.
    """
    asked = wanted.select("wanted", F.split_part("wanted", F.lit("_"), F.lit(1)).alias("prefix"))
    known = refs.select("ref_id", "pos", F.split_part("ref_id", F.lit("_"), F.lit(1)).alias("prefix"))
    near = known.join(F.broadcast(asked) if asked.count() <= MOST_WANTED else asked, "prefix").withColumn("d", F.levenshtein("wanted", "ref_id")).where(F.col("d") <= most)
    return near.groupBy("wanted").agg(F.min_by("ref_id", F.struct("d", "pos")).alias("suggestion"))


def removed(items: DataFrame, ref: str) -> DataFrame:
    return items.where(F.col("ref_id") != ref)


def got(items: DataFrame, ref: str) -> DataFrame:
    return items.where(F.col("ref_id") == ref)
