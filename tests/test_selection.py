"""Edit-distance joins and exact medians against plain versions."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from corpuloom.operators import context, editjoin, medians


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("t", [1, 2, 3, 4])
def test_pairs_within_a_distance(spark, t):
    rng = random.Random(t)
    make = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(0, 9)))
    left, right = sorted({make() for _ in range(60)}), sorted({make() for _ in range(60)})
    frame = lambda xs, n: spark.createDataFrame([(x,) for x in [*xs, None]], f"{n} string")
    got = {(r["a"], r["b"], r["d"]) for r in editjoin.within(frame(left, "a"), frame(right, "b"), t, "a", "b").collect()}
    assert got == {(a, b, d) for a in left for b in right if (d := levenshtein(a, b)) <= t}


def test_suggestions_equal_the_plain_join(spark):
    rng = random.Random(7)
    ids = [f"{rng.choice(['img', 'doc'])}_{rng.getrandbits(24):06x}" for _ in range(400)]
    refs = spark.createDataFrame([(x, i) for i, x in enumerate([*ids, ids[3]])], "ref_id string, pos long")
    typed = [x[:-1] + "z" for x in ids[:20]] + [x[:5] + x[6:] for x in ids[20:40]] + ["img_zzzzzz", "doc_", "nope_123456", "doc", "img_0z0z0z", ids[5], ids[5]]
    wanted = spark.createDataFrame([(x,) for x in [*typed, None]], "wanted string")
    want = {tuple(r) for r in context.closest_refs(refs, wanted.distinct()).collect()}
    assert {tuple(r) for r in editjoin.suggested(refs, wanted).collect()} == want and len(want) > 38
    plan = editjoin.within(wanted.selectExpr("wanted AS a"), refs.selectExpr("ref_id AS b"), 1, "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("few", [4, 1024])
def test_medians(spark, monkeypatch, few):
    monkeypatch.setattr(medians, "FEW", few)
    monkeypatch.setattr(medians, "BINS", 7)
    rng = random.Random(few)
    values = {"even": [rng.gauss(0, 1) for _ in range(200)], "odd": [rng.expovariate(1) for _ in range(151)], "ties": [1.0] * 60 + [2.0] * 60, "one": [5.0], "two": [1.0, 4.0], "wide": [1e308, -1e308, 1e-300, 0.0, 3.0, 2.0, 7.0], "none": [], "tiny": [0.1 + k * 5e-17 for k in range(30)], None: [float(k) for k in range(20)], "skew": [0.0] * 3 + [10.0**k for k in range(-30, 30)]}
    rows = [(g, v) for g, of in values.items() for v in of] + [("none", None), ("none", float("nan")), ("odd", None), ("even", float("nan"))]
    rng.shuffle(rows)
    got = {r["g"]: r["median"] for r in medians.exact_medians(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v").collect()}
    assert set(got) == set(values)
    for g, of in values.items():
        assert got[g] is None if not of else got[g] == pytest.approx(statistics.median(of), rel=1e-12, abs=1e-320)


def test_medians_without_keys_and_rows(spark):
    rows = spark.range(1001).selectExpr("id % 37 AS v")
    assert medians.exact_medians(rows, [], "v").first()["median"] == rows.agg(F.median("v")).first()[0]
    assert medians.exact_medians(rows.limit(0).selectExpr("v", "v AS k"), ["k"], "v").collect() == []
