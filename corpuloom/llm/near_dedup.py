"""MinHash near-duplicate detection with tensored banding.

A document's set holds its distinct five-word shingles.  Two collections of
``tables`` short keys, each of ``width`` minhashes, are computed; table (i, j)
of the index is keyed by the pair (left key i, right key j), so tables**2 tables
cost 2 * tables * width minhashes.  Documents of one key are candidates.

1. Documents of equal sets become one representative (the smallest doc_id).
2. In each bucket every representative is held against its most central one (of
   the most rows in all its buckets), which links most of a group in linear work,
   a star about any member included; what is linked within two hops is taken for
   a component until the end.
3. Where a bucket still holds several components, all pairs across components are
   compared: as pairs of ids in a bucket of at most PAIR_ROWS rows, and else where
   the rows meet, in blocks of BLOCK by BLOCK rows.  There the rows outside the
   bucket's largest component meet all of its rows, so that rows are repeated only
   beyond a block of either.  Which way a bucket goes changes no result.

Every pair that shares a table is thus linked or compared on full sets, only the
sizes of the sets tell beforehand.  A pair at the threshold shares none of the 100
default tables with a chance of 5e-4; at a likeness of 0.8 it is 7e-5, at 0.9 1e-7.

Defined results: case folds for A-Z only; fewer words than a shingle make one
shingle of them all; a null or wordless text has an empty set and is linked
with nothing; rows that share a doc_id count as one document; a null doc_id is
linked with nothing, is its own component (null) and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, cut, distinct_by_row, list_array, mix, partitions, prepared, shingles_of, signed, sized, slices, text_of, words_of
from .components import components, hopped

#: Candidate ids up to which they are broadcast to the scan that makes their sets.
BROADCAST_IDS = 500_000
#: Rows of a bucket up to which its pairs across components are listed by their ids.
PAIR_ROWS = 24
#: Rows of a larger bucket that meet as many others in one group.
BLOCK = 4096
#: Shingles of a block.
BLOCK_ITEMS = 1 << 22
#: Pairs of one leader that meet one copy of its set.
LEADER_PAIRS = 512


def _sets(text, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct shingles, sorted; the rows they are of; the sets' sizes."""
    words = words_of(text)
    hashes, owner = distinct_by_row(*shingles_of(words, shingle))
    return hashes, owner, np.bincount(owner, minlength=len(text.offsets) - 1)


def _by_row(ufunc: np.ufunc, values: np.ndarray, size: np.ndarray, empty: int) -> np.ndarray:
    out = np.full(len(size), empty, U64)
    some = size > 0
    if some.any():
        out[some] = ufunc.reduceat(values, (np.cumsum(size) - size)[some])
    return out


def _sketcher(shingle: int, tables: int, width: int):
    seeds = np.random.default_rng(5).integers(0, 1 << 63, (2 * tables * width, 2), dtype=np.uint64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, text in slices(text_of(batch["text"])):
                hashes, _, size = _sets(text, shingle)
                ids = _by_row(np.add, mix(hashes ^ seeds[0, 0]), size, 0), _by_row(np.add, mix(hashes ^ seeds[0, 1]), size, 0)
                least = [(_by_row(np.minimum, (hashes ^ flip) * (factor | U64(1)), size, 0) >> U64(32)).astype(np.uint32).view(np.int32) for flip, factor in seeds]
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], signed(size), signed(ids[0]), signed(ids[1]), list_array(pa.array(np.stack(least, 1).ravel()), np.full(len(size), len(seeds)))], ["doc_id", "n", "s1", "s2", "minhashes"])

    return sketch


def _set_maker(shingle: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, text in slices(text_of(batch["text"])):
                hashes, _, size = _sets(text, shingle)
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], list_array(signed(hashes), size)], ["id", "items"])

    return make


def _sets_of(ids: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(id, items): the full sets of the documents among ids."""
    wanted = docs.join(sized(ids, BROADCAST_IDS), docs["doc_id"] == ids["id"], "left_semi").select("doc_id", "text")
    return wanted.mapInArrow(_set_maker(shingle), "id bigint, items array<bigint>")


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike: 100 * shared >= threshold * joint."""
    a, b = (reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * threshold
    likely = cut(pairs.join(b, "b").join(a, "a").where(sizes).select("a", "b"))
    ids = cut(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = _sets_of(ids, docs, shingle)
    # Many pairs of one leader are dealt over copies of its set.
    copies = cut(likely.groupBy("a").agg(F.ceil(F.count("*") / LEADER_PAIRS).alias("copies")).where("copies > 1"))
    dealt = likely.join(sized(copies, BROADCAST_IDS), "a", "left").withColumn("copy", F.pmod(F.xxhash64("b"), F.coalesce("copies", F.lit(1)))).drop("copies")
    own = sets.join(sized(copies.withColumnRenamed("a", "id"), BROADCAST_IDS), "id", "left")
    own = own.select(F.col("id").alias("a"), F.col("items").alias("of_a"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    joint = F.size("of_a") + F.size("of_b") - shared
    other = sets.select(F.col("id").alias("b"), F.col("items").alias("of_b"))
    return cut(dealt.join(other, "b").join(own, ["a", "copy"]).where(shared * 100 >= joint * threshold).select("a", "b"))


def _mixed_only(rows: DataFrame) -> DataFrame:
    """The rows of keys that hold more than one component, with the number of rows of each key."""
    held = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m")).where("low < high")
    return rows.drop("m").join(held.select("key", "m"), "key")


def _dealt(large: DataFrame) -> DataFrame:
    """The rows of large buckets in groups (key, p, q), where the rows of block p (left) meet the minor ones of block q (right)."""
    each = large.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("items"))
    held = each.groupBy("key").agg(F.max(F.struct("c", "label", "items")).alias("main"), F.sum("c").alias("m"), F.sum("items").alias("items"))
    blocks = lambda rows, items: F.greatest(F.ceil(rows / BLOCK), F.ceil(items / BLOCK_ITEMS), F.lit(1).cast("bigint"))
    held = held.select("key", F.col("main.label").alias("main"), blocks(F.col("m"), F.col("items")).alias("n_p"), blocks(F.col("m") - F.col("main.c"), F.col("items") - F.col("main.items")).alias("n_q"))
    rows = large.join(held, "key").withColumn("minor", F.col("label") != F.col("main"))
    rows = rows.withColumn("own_p", F.pmod(F.xxhash64("rep", F.lit(3)), "n_p")).withColumn("own_q", F.pmod(F.xxhash64("rep", F.lit(4)), "n_q"))
    zero = F.lit(0).cast("bigint")
    left = F.transform(F.sequence(zero, F.col("n_q") - 1), lambda q: F.struct(F.col("own_p").alias("p"), q.alias("q")))
    right = F.transform(F.sequence(zero, F.col("n_p") - 1), lambda p: F.struct(p.alias("p"), F.col("own_q").alias("q")))
    right = F.filter(right, lambda x: F.col("minor") & (x["p"] != F.col("own_p")))
    met = rows.withColumn("at", F.explode(F.concat(left, right)))
    return met.select("key", "table", "rep", "label", "n", "short", "minor", (F.col("at.p") == F.col("own_p")).alias("left"), (F.col("minor") & (F.col("at.q") == F.col("own_q"))).alias("right"), "at.p", "at.q")


_GROUP = "key bigint, table int, rep bigint, label bigint, n bigint, short array<bigint>, minor boolean, left boolean, right boolean, p bigint, q bigint"


def _meeting(group: pa.Table, tables: int, threshold: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each left row the right ones of another component and a fitting size, in the first table that both share."""
    rep, label, n, minor, left, right = (group[x].to_numpy() for x in ("rep", "label", "n", "minor", "left", "right"))
    short = group["short"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
    table = group["table"][0].as_py()
    right = np.flatnonzero(right)
    # Columns of the table's own keys agree by themselves; the pair has been here before where earlier ones on both sides do.
    i, j = divmod(table, tables)
    for at in np.flatnonzero(left):
        fits = (label[right] != label[at]) & (np.minimum(n[right], n[at]) * 100 >= np.maximum(n[right], n[at]) * threshold)
        if minor[at]:
            fits &= rep[right] > rep[at]
        other = right[fits]
        for first, k in ((0, i), (tables, j)):
            if k and len(other):
                other = other[~(short[other, first : first + k] == short[at, first : first + k]).any(1)]
        if len(other):
            yield at, other


def _linked(large: DataFrame, docs: DataFrame, shingle: int, threshold: int, tables: int) -> DataFrame:
    """The links across components of large buckets, held against each other where they meet."""

    def wanted(group: pa.Table) -> pa.Table:
        rows = [np.append(other, at) for at, other in _meeting(group, tables, threshold)]
        kept = group.take(np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64))
        return kept.set_column(kept.schema.get_field_index("short"), "short", kept["short"].cast(pa.list_(pa.int64())))

    def confirm(group: pa.Table) -> pa.Table:
        rep, items = group["rep"].to_numpy(), group["items"].combine_chunks()
        offsets = items.offsets.to_numpy() - items.offsets[0].as_py()
        known, ids = np.unique(items.flatten().to_numpy(), return_inverse=True)
        size, a, b = np.diff(offsets), [], []
        held = np.zeros(len(known), np.int64)
        for at, other in _meeting(group, tables, threshold):
            own = ids[offsets[at] : offsets[at + 1]]
            held[own] = 1
            flat = np.repeat(offsets[other] - np.cumsum(size[other]) + size[other], size[other]) + np.arange(size[other].sum())
            shared = np.add.reduceat(held[ids[flat]], np.cumsum(size[other]) - size[other])
            held[own] = 0
            alike = other[shared * 100 >= (size[other] + size[at] - shared) * threshold]
            a.append(np.minimum(rep[at], rep[alike]))
            b.append(np.maximum(rep[at], rep[alike]))
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
        return pa.table({"a": pa.array(flat[0], pa.int64()), "b": pa.array(flat[1], pa.int64())})

    rows = cut(_dealt(large).groupBy("key", "p", "q").applyInArrow(wanted, _GROUP))
    ids = cut(rows.select(F.col("rep").alias("id")).distinct())
    met = rows.join(_sets_of(ids, docs, shingle), F.col("rep") == F.col("id")).drop("id")
    return cut(met.groupBy("key", "p", "q").applyInArrow(confirm, "a bigint, b bigint").distinct())


def _across(rows: DataFrame) -> DataFrame:
    """Pairs of one key and different components."""
    other = rows.select("key", F.col("rep").alias("b"), F.col("label").alias("label_b"))
    return rows.join(other, "key").where((F.col("label") != F.col("label_b")) & (F.col("rep") < F.col("b"))).select(F.col("rep").alias("a"), "b").distinct()


def find_near_duplicates(docs: DataFrame, *, shingle: int = 5, threshold: int = 75, tables: int = 10, width: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept (the component's smallest doc_id)."""
    spark = prepared(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = cut(docs.mapInArrow(_sketcher(shingle, tables, width), "doc_id bigint, n bigint, s1 bigint, s2 bigint, minhashes array<int>"))
    reps = cut(rows.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("minhashes").alias("minhashes")))
    short = F.expr(f"transform(sequence(0, {2 * tables - 1}), k -> xxhash64(k, slice(minhashes, k * {width} + 1, {width})))")
    table_keys = F.expr(f"flatten(transform(sequence(0, {tables - 1}), i -> transform(sequence({tables}, {2 * tables - 1}), j -> xxhash64(short[i], short[j]))))")
    keyed = reps.select("rep", short.alias("short")).select("rep", F.explode(table_keys).alias("key")).repartition(partitions(spark), "key")
    # Reading both columns on both sides, so that one exchange serves them.
    shared = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").drop("low", "high")
    grouped = cut(keyed.join(shared, "key"))
    degree = grouped.groupBy("rep").agg(F.sum("m").alias("degree"))
    central = grouped.join(degree, "rep").groupBy("key").agg((-F.max(F.struct("degree", -F.col("rep")))["col2"]).alias("leader"))
    tested = cut(grouped.join(central, "key").where("rep != leader").select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")).distinct())
    links = _confirmed(tested, reps, docs, shingle, threshold)
    labels = hopped(links)

    labelled = grouped.join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    mixed = cut(_mixed_only(labelled))
    few, large = mixed.where(F.col("m") <= PAIR_ROWS), mixed.where(F.col("m") > PAIR_ROWS)
    untested = _across(few.select("key", "rep", "label")).join(tested, ["a", "b"], "left_anti")
    links = links.unionByName(_confirmed(untested, reps, docs, shingle, threshold))
    if not large.isEmpty():
        table = (F.array_position(table_keys, F.col("key")) - 1).cast("int").alias("table")
        large = large.join(reps.select("rep", "n", short.alias("short")), "rep").select("key", table, "rep", "label", "n", "short")
        links = links.unionByName(_linked(large, docs, shingle, threshold, tables))
    labels = components(links)

    sets = reps.select("s1", "s2", F.col("rep")).join(labels, F.col("rep") == F.col("node"), "left").select("s1", "s2", F.coalesce("label", "rep").alias("label"))
    # A row without a set or id belongs to no class, and would meet others under one hot key.
    classed = rows.where("n > 0 and doc_id is not null").select("doc_id", "n", "s1", "s2").join(sets, ["s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("label").alias("component_id"))
    alone = rows.where("not (n > 0 and doc_id is not null)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return classed.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each component, the smallest doc_id; columns as they were.

    Rows that repeat the kept doc_id stay.
    """
    gone = cut(find_near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(sized(gone, BROADCAST_IDS), docs["doc_id"].cast("bigint") == gone["_gone"], "left_anti").select(*docs.columns)
