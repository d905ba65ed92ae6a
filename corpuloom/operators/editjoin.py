"""Pairs of texts within an edit distance, joined by pieces that must agree.

If two texts are within t edits and one is cut into t + 1 pieces, one piece is untouched in
the other, shifted no further than the edits before and behind it allow.  Pieces of one side
and the few substrings of the other that can match them are join keys, so nothing is joined
on less than a length, a piece's number and its text.

Suggestions take the least distance first: most mistypings are resolved within one edit,
whose pieces are half the text, and only what is left is looked for at two, three and four.

Defined results: null texts match nothing; equal texts are at distance 0; repeated rows of one
side meet once; texts shorter than the number of pieces have empty pieces, which all texts of
a fitting length match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


def _piece(length: Column, i: int, t: int) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th of t + 1 pieces; the last ones are a character longer."""
    base, extra = F.floor(length / (t + 1)).cast("int"), (length % (t + 1)).cast("int")
    longer_from = F.lit(t + 1) - extra
    start = F.lit(i) * base + F.greatest(F.lit(0), F.lit(i) - longer_from)
    return start, base + (F.lit(i) >= longer_from).cast("int")


def _own_keys(text: Column, t: int) -> Column:
    length = F.length(text)
    pieces = []
    for i in range(t + 1):
        start, size = _piece(length, i, t)
        pieces.append(F.struct(length.alias("length"), F.lit(i).alias("piece"), F.substring(text, start + 1, size).alias("part")))
    return F.array(*pieces)


def _other_keys(text: Column, t: int) -> Column:
    """Keys that a text's partners within t edits may have: their lengths, and where their pieces can stand here."""
    here, made = F.length(text), []

    def keys(at: Column, length: Column, i: int, size: Column) -> Column:
        return F.transform(at, lambda p: F.struct(length.alias("length"), F.lit(i).alias("piece"), F.substring(text, p + 1, size).alias("part")))

    for delta in range(-t, t + 1):
        length = here - delta
        for i in range(t + 1):
            start, size = _piece(length, i, t)
            # At most i edits before the piece and t - i behind it.
            low = F.greatest(F.lit(0), start - i, start + delta - (t - i))
            high = F.least(here - size, start + i, start + delta + (t - i))
            at = F.when((length >= 0) & (low <= high), F.sequence(low, F.greatest(low, high))).otherwise(F.expr("cast(array() as array<int>)"))
            made.append(keys(at, length, i, size))
    return F.array_distinct(F.flatten(F.array(*made)))


def within(left: DataFrame, right: DataFrame, t: int, a: str, b: str, same: str | None = None) -> DataFrame:
    """Columns of left and right, and d: pairs whose texts a and b are within t edits; same: a column that must be equal in both.

    A pair can come up more than once, for each piece that agrees.
    """
    keys = ["_length", "_piece", "_part"]
    of = lambda df, made: df.select("*", F.explode(made).alias("_k")).select(*df.columns, *(F.col(f"_k.{k[1:]}").alias(k) for k in keys))
    on = keys + ([same] if same else [])
    pairs = of(left, _own_keys(F.col(a), t)).join(of(right, _other_keys(F.col(b), t)), on)
    return pairs.drop(*keys).withColumn("d", F.levenshtein(a, b)).where(F.col("d") <= t)


def suggested(refs: DataFrame, wanted: DataFrame, most: int = 4) -> DataFrame:
    """wanted and its suggestion, as context.closest_refs(): the ref of the same prefix at the least distance up to most; the first position wins.

    refs: ref_id, pos; wanted: mistyped ids.  Edits are counted behind the prefix, which both share.
    """
    split = lambda df, name: df.where(F.col(name).isNotNull()).withColumn("prefix", F.split_part(name, F.lit("_"), F.lit(1))).withColumn(f"_{name}", F.expr(f"substring({name}, length(prefix) + 1)"))
    left = cut(split(wanted.select("wanted").distinct(), "wanted"))
    known = split(refs.groupBy("ref_id").agg(F.min("pos").alias("pos")), "ref_id")
    out = None
    for t in range(1, most + 1):
        near = within(left, known, t, "_wanted", "_ref_id", "prefix")
        found = cut(near.groupBy("wanted").agg(F.min_by("ref_id", F.struct("d", "pos")).alias("suggestion")))
        out = found if out is None else out.unionByName(found)
        left = cut(left.join(found.select("wanted"), "wanted", "left_anti"))
        if left.isEmpty():
            break
    return out
