"""Exact nearest neighbours through pivots, without comparing every query with every row.

Pivots are drawn from a bounded sample; every row lies in the cell of its nearest pivot, with
its distance to it.  By the triangle inequality a row x of pivot p is no nearer to a query q
than |d(q, p) - d(x, p)|.  A query first meets the rows of its most promising cells, enough
for k answers; their k-th distance is an upper bound of the true one, so a second round meets
only the cells, and of these only the rows, whose lower bounds do not exceed it.  Two rounds
are exact, whatever the pivots; these only decide how much is left out.

Cells are divided into blocks of about BLOCK rows, so that a cell which holds a third of
all rows (equal vectors) is many tasks; queries go to the blocks they must meet, by shuffle.
A block and at most ASKED or so of its queries meet in one task, which takes the rows in slices
by their distance to the pivot, each with the queries whose bounds reach it, and leaves k rows
a query.  The driver holds the pivots and a row for each cell.

Defined results: rows and queries without a vector are left out; ties go to the smaller key;
a query is not its own answer; fewer than k other rows give as many; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..session import arrow_map, workers_find_us
from .nearpairs import by_key, codes, matrix, nearest_pairs

#: Pivots at most, rows of the sample that they are drawn from, rows of a block, queries that meet it in a task, rows of a slice.
PIVOTS, SAMPLE, BLOCK, ASKED, SLICE = 128, 4096, 8192, 16384, 512
#: Bounds are kept apart by this much of the distances, for rounding.
SLACK = 1e-6


class Cells(NamedTuple):
    """The pivots, and of each cell the number of rows and the least and largest distance to its pivot."""

    pivots: np.ndarray
    rows: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def blocks(self) -> np.ndarray:
        return np.maximum(1, -(-self.rows // BLOCK))


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, from differences: products of large near vectors would lose digits."""
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((x - p) ** 2).sum(1))
    return out


def drawn(vectors: DataFrame, key: str, column: str, pivots: int) -> np.ndarray:
    """The sample's row of smallest hash, then each time the row farthest from all pivots so far; equal rows give one pivot."""
    rows = vectors.where(F.col(column).isNotNull()).select(F.xxhash64(key).alias("h"), key, column).orderBy("h", key).limit(SAMPLE).collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.array([r[column] for r in rows], np.float64)
    chosen, near = [0], _to_pivots(x, x[:1])[:, 0]
    while len(chosen) < pivots and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _to_pivots(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


class PivotIndex:
    """Rows (key, column) by cell and block; to be written once where it is to be used again."""

    def __init__(self, vectors: DataFrame, key: str = "vec_id", column: str = "embedding", pivots: int = PIVOTS):
        self.spark, self.key, self.column = vectors.sparkSession, key, column
        self.kind = vectors.schema[key].dataType.simpleString()
        points = drawn(vectors, key, column, pivots)
        self.width = points.shape[1] if len(points) else 0

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = _to_pivots(matrix(batch["x"], points.shape[1]), points)
                cell = d.argmin(1) if len(d) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch["key"], batch["x"], pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["key", "x", "cell", "r"])

        slim = vectors.where(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("x"))
        if not len(points):
            placed = slim.select("key", "x", F.lit(0).alias("cell"), F.lit(0.0).alias("r"))
        else:
            placed = cut(arrow_map(slim, place, f"key {self.kind}, x array<double>, cell int, r double"))
        # A row for each pivot.
        found = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()
        n, low, high = np.zeros(len(points), np.int64), np.full(len(points), np.inf), np.zeros(len(points))
        for r in found:
            n[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
        self.cells = Cells(points, n, low, high)
        blocks = F.array(*(F.lit(int(b)) for b in self.cells.blocks())) if len(points) else F.array(F.lit(1))
        self.rows = placed.withColumn("block", F.pmod(F.xxhash64("key"), F.get(blocks, F.col("cell")).cast("bigint")).cast("int"))

    def _asked(self, queries: DataFrame, first: bool, k: int) -> DataFrame:
        """query, at, cell, block, dq and bound: each query at the blocks it must meet in a round.

        queries: query, at, and bound (the k-th distance of the first round).
        """
        cells, blocks = self.cells, self.cells.blocks()

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not len(cells.pivots):
                    continue
                d = _to_pivots(matrix(batch["at"], cells.pivots.shape[1]), cells.pivots)
                low = np.maximum(0, np.maximum(d - cells.most, cells.least - d))
                low[:, cells.rows == 0] = np.inf
                # The cells of nearest pivots that hold k rows besides the query itself.
                order = np.argsort(d + np.where(cells.rows == 0, np.inf, 0), 1, kind="stable")
                held = np.cumsum(cells.rows[order], 1)
                early = np.zeros(d.shape, bool)
                np.put_along_axis(early, order, held - cells.rows[order] < k + 1, 1)
                early &= np.isfinite(low)
                if not first:
                    bound = batch["bound"].to_numpy(zero_copy_only=False)[:, None]
                    wanted = ~early & (low <= bound + SLACK * (1 + bound + d))
                else:
                    wanted = early
                row, cell = np.nonzero(wanted)
                times = blocks[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                for lo in range(0, len(row), 4096):
                    at = slice(lo, lo + 4096)
                    yield pa.RecordBatch.from_arrays([batch["query"].take(pa.array(row[at])), batch["at"].take(pa.array(row[at])), pa.array(cell[at], pa.int32()), pa.array(block[at], pa.int32()), pa.array(d[row[at], cell[at]]), batch["bound"].take(pa.array(row[at]))], ["query", "at", "cell", "block", "dq", "bound"])

        return arrow_map(queries, choose, f"query {self.kind}, at array<double>, cell int, block int, dq double, bound double")

    def _met(self, asked: DataFrame, k: int, groups: int, counted: bool = False) -> DataFrame:
        """query, key and distance of the k nearest of what the bounds of a round leave, for each block; counted: how many pairs are worked out.

        Queries are dealt to groups, and a block goes to each of them.
        """
        width, kind = self.width, self.kind

        def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
            asked, rows = asked.combine_chunks(), rows.combine_chunks()
            one = lambda t, name: t[name].chunk(0) if t[name].num_chunks else pa.array([], t.schema.field(name).type)
            query, key = one(asked, "query"), one(rows, "key")
            order = by_key(key)
            key, x, r = key.take(pa.array(order)), matrix(one(rows, "x"), width)[order], one(rows, "r").to_numpy(zero_copy_only=False)[order]
            at, dq = matrix(one(asked, "at"), width), one(asked, "dq").to_numpy(zero_copy_only=False)
            bound = one(asked, "bound").fill_null(np.inf).to_numpy(zero_copy_only=False)
            bound = bound + SLACK * (1 + bound + dq)
            mine, theirs = codes(query, key)
            near, worked, found = np.argsort(r, kind="stable"), 0, []
            for lo in range(0, len(x), SLICE):
                some = np.sort(near[lo : lo + SLICE])  # rows stay by key
                reach = np.flatnonzero((dq - bound <= r[some].max()) & (dq + bound >= r[some].min()))
                for at_once in range(0, len(reach), SLICE):
                    who = reach[at_once : at_once + SLICE]
                    barred = mine[who][:, None] == theirs[some][None, :]
                    worked += barred.size - int(barred.sum())
                    if not counted:
                        row, col, far = nearest_pairs(at[who], x[some], barred, k)
                        found.append((who[row], some[col], far))
            if counted:
                return pa.table({"worked": pa.array([worked], pa.int64())})
            row, col, far = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
            best = np.lexsort((col, far, row))
            row, col, far = row[best], col[best], far[best]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            return pa.table({"query": query.take(pa.array(row[kept])), "key": key.take(pa.array(col[kept])), "distance": pa.array(far[kept])})

        rows, by = self.rows, ["cell", "block"]
        if groups > 1:
            by = [*by, "_g"]
            asked = asked.withColumn("_g", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int"))
            rows = rows.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        workers_find_us(self.spark)
        # A block without queries gives nothing.
        return asked.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(meet, "worked bigint" if counted else f"query {kind}, key {kind}, distance double")

    @staticmethod
    def _best(found: DataFrame, k: int) -> DataFrame:
        # Spark keeps k of each query in each task before it shuffles them.
        rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def rounds(self, queries: DataFrame, k: int, counted: bool = False) -> tuple[DataFrame, DataFrame | None, DataFrame]:
        """The best of the first round and what the second finds; counted: how many pairs either works out."""
        asked = queries.where(F.col(self.column).isNotNull()).select(F.col(self.key).alias("query"), F.col(self.column).cast("array<double>").alias("at")).dropDuplicates(["query"])
        groups = max(1, -(-asked.count() // ASKED))
        at_first = self._asked(asked.withColumn("bound", F.lit(None).cast("double")), True, k)
        best = cut(self._best(self._met(at_first, k, groups), k))
        # Without k answers nothing is ruled out.
        bound = best.groupBy("query").agg(F.max("distance").alias("_d"), F.count("*").alias("_n"))
        bounded = asked.join(bound, "query", "left").select("query", "at", F.when(F.col("_n") == k, F.col("_d")).otherwise(F.lit(float("inf"))).alias("bound"))
        second = self._met(self._asked(bounded, False, k), k, groups, counted)
        return best, self._met(at_first, k, groups, True) if counted else None, second

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """query, key, distance and rank of the k nearest rows of every query (key, column)."""
        best, _, second = self.rounds(queries, k)
        found = self._best(best.drop("rank").unionByName(second), k)
        return found.select("query", F.col("key").alias(self.key), "distance", "rank")

    def compared(self, queries: DataFrame, k: int) -> float:
        """The share of all pairs of a query and another row whose distance is worked out."""
        _, first, second = self.rounds(queries, k, True)
        n = queries.where(F.col(self.column).isNotNull()).select(self.key).distinct().count()
        every = n * (int(self.cells.rows.sum()) - 1)
        worked = first.unionByName(second).agg(F.coalesce(F.sum("worked"), F.lit(0))).first()[0]
        return worked / every if every > 0 else 0.0
