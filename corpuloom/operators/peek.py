"""Flat metadata records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import media_kind_of

BASIC = ("path", "name", "ext", "size", "modified", "mime", "media_kind", "dimensions", "duration_s", "fps", "video_codec", "audio_codec", "has_audio", "exif_camera", "exif_date", "exif_gps", "pages", "line_count", "word_count", "content_hash")
DOCUMENT = ("doc_title", "doc_author", "doc_subject", "doc_keywords", "doc_creator", "doc_producer")


def peek(files: DataFrame, full: bool = False) -> DataFrame:
    """The columns of a record that files have; full: document properties too.  media_kind is the coarser kind."""
    rows = files.withColumn("media_kind", media_kind_of(F.col("ext")))
    return rows.select(*(x for x in (*BASIC, *(DOCUMENT if full else ())) if x in rows.columns))


def peek_json(files: DataFrame, full: bool = False) -> DataFrame:
    """One JSON text a record, without nulls."""
    return peek(files, full).select(F.to_json(F.struct("*")).alias("json"))
