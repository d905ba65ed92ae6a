"""Exact nearest neighbours through pivots against brute force."""

import numpy as np
import pytest

from corpuloom.operators import metric, search

SHAPE = "vec_id long, embedding array<float>"


def brute(rows, asked, k):
    out = []
    for q, e in asked:
        if e is None:
            continue
        near = sorted((float(np.sqrt(sum((float(a) - float(b)) ** 2 for a, b in zip(np.float32(x), np.float32(e), strict=True)))), i) for i, x in rows if x is not None and i != q)[:k]
        out += [(q, i, round(d, 5), n + 1) for n, (d, i) in enumerate(near)]
    return sorted(out)


def got(index, asked, k):
    return sorted((r["query"], r["vec_id"], round(r["distance"], 5), r["rank"]) for r in index.nearest(asked, k).collect())


def clustered(n, seed, width=6, centres=9, spread=0.05):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(centres, width))
    return [(i, [float(v) for v in middles[rng.integers(centres)] + spread * rng.normal(size=width)]) for i in range(n)]


@pytest.mark.parametrize("pivots", [1, 5, 64])
@pytest.mark.parametrize("k", [1, 4, 700])
def test_equal_to_brute_force(spark, monkeypatch, pivots, k):
    monkeypatch.setattr(metric, "BLOCK", 40)
    rows = clustered(300, 1) + [(1000 + i, [0.0] * 6) for i in range(150)] + [(2000, None), (2001, [1e6] * 6)]
    vectors = spark.createDataFrame(rows, SHAPE).repartition(3)
    asked = [r for r in rows if r[0] % 50 == 0]
    index = metric.PivotIndex(vectors, pivots=pivots)
    assert got(index, spark.createDataFrame(asked, SHAPE), k) == brute(rows, asked, k)


def test_most_pairs_are_left_out(spark):
    rows = clustered(3000, 2, width=16, centres=40)
    vectors = spark.createDataFrame(rows, SHAPE)
    asked = vectors.where("vec_id % 50 = 0")
    index = metric.PivotIndex(vectors)
    assert index.compared(asked, 5) < 0.1
    want = sorted((r["query"], r["vec_id"], round(r["distance"], 5), r["rank"]) for r in search.nearest_to_rows(vectors, asked, 5).collect())
    assert got(index, asked, 5) == want


def test_structureless_vectors_are_right_too(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=20)]) for i in range(400)]
    vectors = spark.createDataFrame(rows, SHAPE)
    asked = [r for r in rows if r[0] % 50 == 0]
    assert got(metric.PivotIndex(vectors, pivots=16), spark.createDataFrame(asked, SHAPE), 3) == brute(rows, asked, 3)


def test_queries_from_elsewhere_and_empty_tables(spark):
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0])]
    index = metric.PivotIndex(spark.createDataFrame(rows, SHAPE))
    asked = [(7, [0.0, 1.0]), (8, None), (1, [0.0, 0.0])]
    assert got(index, spark.createDataFrame(asked, SHAPE), 5) == brute(rows, asked, 5)
    none = metric.PivotIndex(spark.createDataFrame([], SHAPE))
    assert none.nearest(spark.createDataFrame(asked, SHAPE), 3).collect() == []


def test_plain_search_is_exact_in_matrices(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "ROW_BLOCK", 32)
    rows = clustered(200, 4) + [(1000 + i, [0.5] * 6) for i in range(60)] + [(3000, [1e6] * 6), (3050, [1e6] * 5 + [1e6 + 1])]
    vectors = spark.createDataFrame(rows, SHAPE).repartition(3)
    asked = [r for r in rows if r[0] % 50 == 0]
    for k in (1, 3, 400):
        found = search.nearest_to_rows(vectors, spark.createDataFrame(asked, SHAPE), k)
        assert sorted((r["query"], r["vec_id"], round(r["distance"], 5), r["rank"]) for r in found.collect()) == brute(rows, asked, k)
    # Rows of a pair of matrices leave k a query: no operator emits all pairs.
    assert "Cartesian" in found._jdf.queryExecution().toString() and "Broadcast" not in found._jdf.queryExecution().toString()


def test_rows_without_a_vector_come_last(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, [float("nan"), 0.0]), (4, [3.0, 4.0]), (5, [float("inf"), 0.0])]
    found = search.nearest_to_rows(spark.createDataFrame(rows, SHAPE), spark.createDataFrame([rows[0], rows[1]], SHAPE), 4)
    got = {q: [(r["vec_id"], repr(r["distance"])) for r in sorted(found.where(f"query = {q}").collect(), key=lambda r: r["rank"])] for q in (1, 2)}
    assert got == {1: [(4, "5.0"), (5, "inf"), (3, "nan"), (2, "None")], 2: [(1, "None"), (3, "None"), (4, "None"), (5, "None")]}


@pytest.mark.parametrize("k", [1, 5])
def test_matrices_of_all_sizes_leave_the_same(k):
    from corpuloom.operators.nearpairs import nearest_pairs, plain

    rng = np.random.default_rng(k)
    for n, m in ((0, 5), (5, 0), (1, 1), (9, 300), (40, 64)):
        q, x = 1e5 + rng.integers(0, 3, (n, 4)) / 1024, 1e5 + rng.integers(0, 3, (m, 4)) / 1024  # near rows far from the origin, many ties
        barred = rng.random((n, m)) < 0.1
        want = [(i, j, d) for i in range(n) for d, j in sorted((float(plain(q[i : i + 1], x[j : j + 1])[0]), j) for j in range(m) if not barred[i, j])[:k]]
        assert list(zip(*(c.tolist() for c in nearest_pairs(q, x, barred, k)), strict=True)) == want


def test_queries_of_a_block_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(metric, "ASKED", 3)
    monkeypatch.setattr(metric, "SLICE", 16)
    rows = clustered(150, 5)
    asked = [r for r in rows if r[0] % 10 == 0]
    index = metric.PivotIndex(spark.createDataFrame(rows, SHAPE), pivots=4)
    assert got(index, spark.createDataFrame(asked, SHAPE), 3) == brute(rows, asked, 3)
