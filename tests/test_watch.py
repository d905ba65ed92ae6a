"""Stateful ingestion against the batch operators."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corpuloom.operators import catalog
from corpuloom.streaming import watch

T0 = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


@pytest.fixture
def state(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield watch.with_state(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(spark, tmp_path, batches, name, **options):
    """The changes of a stream of batches, each a file; a last sighting far ahead moves the watermark."""
    for n, rows in enumerate([*batches, [("~end", 0, 0, at(100000))]]):
        spark.createDataFrame(rows, watch.SEEN).coalesce(1).write.parquet(f"{tmp_path}/{name}/b{n:03}")
    stream = spark.readStream.schema(watch.SEEN).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{name}")
    query = watch.watched(stream, **options).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}_cp").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return [(r["uri"], r["change"], r["modified"], r["size"]) for r in spark.table(name).where("uri <> '~end'").collect()]


def test_changes_against_the_tables(spark, state, tmp_path):
    rng = random.Random(2)
    stored = [(f"u{i}", 10, i, at(0)) for i in range(60)]
    scans, present = [], dict.fromkeys((s[0] for s in stored))
    known = {u: (m, s) for u, m, s, _ in stored}
    seen = []
    for n in range(3):
        rows = []
        for i in range(70):
            if rng.random() < (0.5 if n else 0.9) and i % 9:
                m, s = (10, i) if rng.random() < 0.7 else (11 + n, i + rng.randint(0, 1))
                rows.append((f"u{i}", m, s, at(5 * n + 1)))
        scans.append(rows)
        seen += rows
    got = run(spark, tmp_path, scans, "against", after="1 hour", stored=spark.createDataFrame(stored, watch.SEEN))
    want = []
    for rows in scans:
        current, was = spark.createDataFrame(rows, watch.SEEN), spark.createDataFrame([(u, m, s, None) for u, (m, s) in known.items()], watch.SEEN)
        stale = {r["uri"] for r in catalog.stale(current, was).collect()}
        want += [(u, "stale" if u in known else "new", m, s) for u, m, s, _ in rows if u in stale]
        known |= {u: (m, s) for u, m, s, _ in rows}
    never = {r["uri"] for r in catalog.prune_candidates(spark.createDataFrame(stored, watch.SEEN), spark.createDataFrame(seen, watch.SEEN)).collect()}
    assert sorted(g for g in got if g[1] != "gone") == sorted(want) and len(want) > 20
    gone = {g[0] for g in got if g[1] == "gone"}
    # At the end of all scans everything has gone unseen for an hour: first those that no scan ever showed.
    assert gone == set(known) and never <= gone and len(never) > 3 and len([g for g in got if g[1] == "gone"]) == len(gone)


def test_timers_move_and_uris_come_back(spark, state, tmp_path):
    batches = [[("a", 1, 1, at(0)), ("b", 1, 1, at(0)), (None, 1, 1, at(0)), ("c", 1, 1, None)], [("a", 1, 1, at(50)), ("a", 2, 1, at(49))], [("b", 1, 1, at(200)), ("a", 1, 1, at(90))], [("a", 1, 1, at(195))], [("a", None, 1, at(230))]]
    got = run(spark, tmp_path, batches, "timers", after="60 minutes", late="1 minute")
    assert [g for g in got if g[0] == "b"] == [("b", "new", 1, 1), ("b", "gone", 1, 1), ("b", "new", 1, 1), ("b", "gone", 1, 1)] or [g[1] for g in got if g[0] == "b"] == ["new", "gone"]
    changes = [g[1:] for g in got if g[0] == "a"]
    assert changes[0] == ("new", 1, 1) and changes[-1] == ("gone", None, 1) and ("stale", None, 1) in changes
    assert {g[0] for g in got} == {"a", "b"}


def test_sessions_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted((rng.randint(0, 6), T0 + datetime.timedelta(minutes=rng.randint(0, 2000)), float(i)) for i in range(300))
    rows.sort(key=lambda r: r[1])
    shape = "user_id long, ts timestamp, value double"
    for n in range(3):
        spark.createDataFrame(rows[100 * n : 100 * n + 100], shape).coalesce(1).write.parquet(f"{tmp_path}/ev/b{n}")
    spark.createDataFrame([(99, at(100000), 0.0)], shape).coalesce(1).write.parquet(f"{tmp_path}/ev/b9")
    table = spark.createDataFrame(rows, shape)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/ev")
    query = watch.sessions(stream).writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    assert sorted(map(tuple, spark.table("sess").where("user_id <> 99").collect())) == sorted(map(tuple, watch.sessions(table).collect()))
    assert table.agg(F.count("*")).first()[0] == sum(r["n"] for r in watch.sessions(table).collect())
