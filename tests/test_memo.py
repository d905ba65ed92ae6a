"""The bounded memo against a plain LRU."""

import random

from pyspark.sql import functions as F

from corpuloom.operators import memo


def test_evictions_against_a_plain_sum(spark):
    rng = random.Random(1)
    entries = [(f"k{i:03}", rng.choice([None, 0, 5, 50, 500])) for i in range(200)]
    uses = [(f"k{rng.randint(0, 180):03}", rng.randint(0, 40)) for _ in range(500)]
    last = {}
    for k, u in uses:
        last[k] = max(last.get(k, u), u)
    want, total = {}, 0
    for k, b in sorted(entries, key=lambda e: (e[0] not in last, -last.get(e[0], 0), e[0])):
        total += b or 0
        if total > 4000:
            want[k] = (b or 0, last.get(k), total)
    got = memo.evictions(spark.createDataFrame(entries, "cache_key string, bytes long").repartition(5), spark.createDataFrame(uses, "cache_key string, used long"), 4000)
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want and 20 < len(want) < 200


def test_memo_is_an_lru(spark, tmp_path):
    made = memo.Memo(spark, str(tmp_path / "m"), "v string", budget=30, buckets=4)
    calls = []

    def ask(now, *keys):
        rows = spark.createDataFrame([(k,) for k in keys], "cache_key string")
        before = made.read("entries").select("cache_key").collect()
        got = made.through(rows, lambda df: df.withColumn("v", F.concat(F.lit(f"{now}:"), F.coalesce("cache_key", F.lit("none")), F.lit("x" * 5))), now, F.length("v"))
        calls.append({r[0] for r in before})
        return {(r["cache_key"], r["v"].split(":")[0]) for r in got.collect()}

    assert ask(1, "a", "b", "b", None) == {("a", "1"), ("b", "1"), (None, "1")}
    assert ask(2, "a", "c") == {("a", "1"), ("c", "2")}
    assert ask(3, "d") == {("d", "3")}  # 4 entries of 8 bytes: b, unused for longest, goes
    assert {r[0] for r in made.read("entries").collect()} == {"a", "c", "d"} == {r[0] for r in made.read("uses").collect()}
    assert ask(4, "b", "a") == {("b", "4"), ("a", "1")}
    assert {r[0] for r in made.read("entries").collect()} == {"a", "b", "d"}
    assert made.trim() == 0


def test_running_totals(spark):
    rows = spark.range(1000).selectExpr("id", "hash(id) AS h", "id % 7 AS v").repartition(6)
    got = {r["id"]: r["t"] for r in memo.running_totals(rows, ["h", "id"], "v", "t").collect()}
    total = 0
    for r in sorted(rows.collect(), key=lambda r: (r["h"], r["id"])):
        total += r["v"]
        assert got[r["id"]] == total
