"""Files, bytes, lines and tokens, in all and by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.media import kind_tokens
from ..functions.text import byte_tokens, char_tokens, density, document_line_count, line_count


def measured(files: DataFrame) -> DataFrame:
    """Adds lines and tokens to files (kind, size, text, width, height).

    Documents count characters // 4 and at least a line, other texts bytes // 4, images tiles.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.lit(None).cast("int")
    width, height = (F.col(x) if x in files.columns else none for x in ("width", "height"))
    media = F.col("kind").isin("image", "video", "audio")
    lines = F.when(media, F.lit(0).cast("bigint")).when(F.col("kind") == "document", document_line_count(text)).otherwise(line_count(text))
    tokens = F.when(media, kind_tokens(F.col("kind"), F.col("size"), width, height)).when(F.col("kind") == "document", char_tokens(text)).otherwise(byte_tokens(text))
    return files.withColumns({"lines": lines, "tokens": tokens})


def wc(files: DataFrame) -> DataFrame:
    """kind, files, bytes, lines, tokens, tok_per_mb, tok_per_img; the row of kind null is the total.

    Both grains come from one pass with partial sums.
    """
    sums = measured(files).rollup("kind").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("lines").alias("lines"), F.sum("tokens").alias("tokens"))
    per_image = F.when(F.col("kind") == "image", F.bround(F.col("tokens") / F.col("files")).cast("bigint"))
    return sums.withColumns({"tok_per_mb": density(F.col("tokens"), F.col("bytes")), "tok_per_img": per_image})


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name and rows of each stored table."""
    counted = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


def bench_stats(runs: DataFrame, size: str | None = None) -> DataFrame:
    """name, rounds, mean, sample deviation (0 for one run), min, max and median of timings_ms (array), and rates over size bytes."""
    return timing_stats(runs.select("name", *([size] if size else []), F.explode("timings_ms").alias("ms")), size)


def token_usage(calls: DataFrame, by: str = "model") -> DataFrame:
    """Calls and tokens of each model; a call that reports none counts as 0."""
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("bigint")
    sums = calls.groupBy(by).agg(F.count("*").alias("calls"), total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens"))
    return sums.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def timing_stats(each: DataFrame, size: str | None = None) -> DataFrame:
    """As bench_stats(), of one row for each timing (name, ms)."""
    keys = ["name", *([size] if size else [])]
    stats = each.groupBy(*keys).agg(
        F.count("*").alias("rounds"), F.avg("ms").alias("mean_ms"), F.coalesce(F.stddev_samp("ms"), F.lit(0.0)).alias("std_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.median("ms").alias("median_ms")
    )
    if not size:
        return stats
    seconds = F.col("mean_ms") / 1000
    return stats.withColumns({"mb_per_s": F.try_divide(F.col(size) / 1048576.0, seconds), "bits_per_s": F.try_divide(F.col(size) * 8.0, seconds)})


def selected_runs(runs: DataFrame, *, command: str | None = None, group: str | None = None, model: str | None = None, task: str | None = None) -> DataFrame:
    """Benchmark rows by a part of their command, group, model and task, all that are given."""
    out = runs if command is None else runs.where(F.contains("command", F.lit(command)))
    for name, value in (("group", group), ("model", model), ("task", task)):
        out = out if value is None else out.where(F.col(name) == value)
    return out
