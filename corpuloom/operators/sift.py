"""Rows left out before a join moves them, where keys are too many to broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and at most (16 MB); a bitmap's row has PART bits.
BITS, MOST, PART = 16, 1 << 27, 32768


def sifted(rows: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """rows without most of those whose keys (by) wanted does not have; none that it has is lost, so an exact join follows.

    A bitmap of hashed keys is broadcast, 16 bits a key and never more than 16 MB: a sixteenth of other rows
    stays, more beyond eight million keys.  wanted gives the same keys each time it is read.
    """
    if any(rows.schema[k].dataType != wanted.schema[k].dataType for k in by):  # the same value hashes differently
        return rows
    parts = max(1, min(MOST, BITS * wanted.count()) // PART)
    at = F.pmod(F.xxhash64(*by), F.lit(parts * PART))
    bits = wanted.groupBy(F.bitmap_bucket_number(at).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    return rows.join(F.broadcast(bits), (F.bitmap_bucket_number(at) == F.col("_part")) & _set(F.col("_bits"), F.bitmap_bit_position(at)), "left_semi")


def _set(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1
