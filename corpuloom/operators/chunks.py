"""Overlapping text chunks and their reassembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 2048, 100


def chunk_count(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """How many windows chunk_texts gives."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, F.lit(0)).when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(float(size - overlap))).cast("int") + 1)


def chunk_texts(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of size characters, each overlap into the one before; the last is the first to reach the end."""
    made = F.transform(F.sequence(F.lit(0), chunk_count(text, size, overlap) - 1), lambda i: F.substring(text, i * (size - overlap) + 1, F.lit(size)))
    return F.when(F.length(text) > 0, made).otherwise(F.expr("cast(array() as array<string>)"))


def chunked(rows: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row for each chunk: the other columns, chunk_idx and chunk_text; empty and null texts give none."""
    keep = [x for x in rows.columns if x != text]
    return rows.select(*keep, F.posexplode(chunk_texts(F.col(text), size, overlap)).alias("chunk_idx", "chunk_text"))


def reassembled(chunks: DataFrame, keys: list[str], overlap: int = OVERLAP) -> DataFrame:
    """keys and text: the first chunk and every later one without its overlap."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk_text")))
    parts = F.transform(ordered, lambda x, i: F.when(i == 0, x["chunk_text"]).otherwise(F.substring(x["chunk_text"], F.lit(overlap + 1), F.length(x["chunk_text"]))))
    return chunks.groupBy(*keys).agg(F.array_join(parts, "").alias("text"))


def tiered(file_chunks: DataFrame, output_chunks: DataFrame) -> DataFrame:
    """The file's own text as tier metadata beside the chunks of an extraction's output under its mode."""
    return file_chunks.withColumn("mode", F.lit("metadata")).unionByName(output_chunks)


def batches(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Adds batch, the number of the group of n rows in order within keys.

    Rows are dealt into ranges of keys and order, so that one key may fill many tasks, and counted range by range.
    """
    from .store import ranked

    return ranked(rows, keys, [order], "_n").withColumn("batch", F.floor((F.col("_n") - 1) / n).cast("int")).drop("_n")


def cacheable(text: Column) -> Column:
    """Extraction errors are written in brackets and are not cached."""
    return ~text.startswith("[")
