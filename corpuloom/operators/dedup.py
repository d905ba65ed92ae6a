"""Exact duplicates by content hash and near ones by Hamming distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_duplicates(files: DataFrame, hash_column: str = "content_hash", key: str = "path") -> DataFrame:
    """content_hash, n and the smallest key of every group of more than one.

    The members are files joined to this table; one row never holds a whole group.
    """
    return files.groupBy(hash_column).agg(F.count("*").alias("n"), F.min(key).alias(f"first_{key}")).where("n > 1")


def duplicate_members(files: DataFrame, hash_column: str = "content_hash", key: str = "path") -> DataFrame:
    """A row for each member of every group of more than one: content_hash, n, key."""
    groups = files.groupBy(hash_column).agg(F.count("*").alias("n")).where("n > 1")
    return files.select(hash_column, key).join(groups, hash_column).select(hash_column, "n", key)


def duplicate_paths(files: DataFrame, hash_column: str = "content_hash", key: str = "path", separator: str = ", ") -> DataFrame:
    """As exact_duplicates(), with all keys of a group in one text: for listings of small groups."""
    return files.groupBy(hash_column).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(key)), separator).alias(f"{key}s")).where("n > 1")


def hamming_pairs(hashes: DataFrame, key: str, column: str = "phash", below: int = 8) -> DataFrame:
    """(a, b, distance) of pairs of different 64-bit hashes whose distance is below 8.

    Fewer than 8 different bits leave one of 4 bands of 16 bits with one difference at most: a band is
    the key of one side, and it and its 16 neighbours are keys of the other, so every pair is found.
    Equal hashes are first brought to one row.
    """
    if below > 8:
        raise ValueError("four bands find distances below 8")
    each = hashes.groupBy(F.col(column).alias("h")).agg(F.min(key).alias("k"))
    bands = each.select("k", "h", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("band")).withColumn("part", F.expr("cast(shiftrightunsigned(h, band * 16) & 65535 as int)"))
    near_keys = F.expr("concat(array(part), transform(sequence(0, 15), i -> part ^ shiftleft(1, i)))")
    other = bands.select(F.col("k").alias("b"), F.col("h").alias("hb"), "band", F.explode(near_keys).alias("part"))
    pairs = bands.join(other, ["band", "part"]).where(F.col("k") < F.col("b"))
    near = pairs.withColumn("distance", F.bit_count(F.col("h").bitwiseXOR(F.col("hb"))).cast("int")).where(F.col("distance") < below)
    return near.select(F.col("k").alias("a"), "b", "distance").distinct()
