"""Bucketed versions, change feeds, ranks under any plan, and dispatch."""

import pytest
from pyspark.sql import functions as F

from corpuloom.operators import buckets, store
from corpuloom.plans import dispatch

SHAPE = "k long, v string, w int"


@pytest.fixture
def kept(spark, tmp_path):
    schema = spark.createDataFrame([], SHAPE).schema
    return buckets.Buckets(spark, str(tmp_path / "kept"), {"t": buckets.Table(schema, "k", "k"), "u": buckets.Table(schema, "k", "k")}, buckets=16, keep=3)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_a_small_change_writes_only_its_buckets(spark, kept):
    kept.write("t", spark.range(2000).selectExpr("id AS k", "'a' AS v", "0 AS w"))
    before = kept.manifest()
    few = spark.createDataFrame([(5, "b", 1), (9999, "new", 2)], SHAPE)
    assert kept.put("t", few) == 2
    after = kept.manifest()
    differ = [b for b in range(16) if before.tables["t"].get(b) != after.tables["t"].get(b)]
    assert differ == kept.touched("t", few) and 1 <= len(differ) <= 2
    assert kept.read("t").count() == 2001 and kept.read("t", 1).count() == 2000
    got = sorted((r["k"], r["change"], r["before"] and r["before"]["v"], r["after"] and r["after"]["v"]) for r in kept.changes("t", 1).collect())
    assert got == [(5, "changed", "a", "b"), (9999, "added", None, "new")]
    kept.put("t", few)  # putting the same in again changes nothing
    assert kept.changes("t", 2).count() == 0


def test_removed_and_emptied(spark, kept):
    kept.write("t", spark.createDataFrame([(k, None if k % 2 else "x", k) for k in range(40)], SHAPE))
    kept.remove("t", spark.createDataFrame([(k,) for k in range(39)], "k long"))
    assert rows_of(kept.read("t")) == [(39, None, 39)]
    assert {(r["k"], r["change"]) for r in kept.changes("t", 1, 2).collect()} == {(k, "gone") for k in range(39)}
    assert {r["change"] for r in kept.changes("t", 0, 1).collect()} == {"added"} and kept.changes("t", 0, 1).count() == 40
    kept.remove("t", spark.createDataFrame([(39,)], "k long"))
    assert kept.read("t").collect() == [] and kept.read("u").collect() == [] and kept.changes("u", 1).collect() == []


def test_tables_change_together(spark, kept):
    base = kept.manifest()
    one = spark.createDataFrame([(1, "a", 1)], SHAPE)
    staged = {t: kept.staged(t, one) for t in ("t", "u")}
    assert kept.read("t").count() == kept.read("u").count() == 0
    kept.commit(base, staged)
    assert rows_of(kept.read("t")) == rows_of(kept.read("u")) == [(1, "a", 1)]


def test_a_second_writer_is_refused_and_lost_ones_are_passed(spark, kept, tmp_path, monkeypatch):
    one = spark.createDataFrame([(1, "a", 1)], SHAPE)
    base = kept.manifest()
    staged = {"t": kept.staged("t", one)}
    kept.write("t", one.withColumn("v", F.lit("first")))
    with pytest.raises(buckets.Conflict):
        kept.commit(base, staged)
    assert kept.read("t").first()["v"] == "first"
    (tmp_path / "kept" / "_versions" / "2").touch()  # a writer that was lost between its claim and its manifest
    assert kept.version() == 1 and kept.read("t").count() == 1
    with pytest.raises(buckets.Conflict):
        kept.write("t", one)
    monkeypatch.setattr(buckets, "LOST", -1)
    assert kept.write("t", one) == 2 and kept.read("t").first()["v"] == "a"


def test_old_versions_go_with_what_only_they_name(spark, kept, tmp_path):
    kept.write("t", spark.range(50).selectExpr("id AS k", "'a' AS v", "0 AS w"))
    for n in range(5):
        kept.put("t", spark.createDataFrame([(3, f"n{n}", n)], SHAPE))
    assert kept._pointers() == [4, 5, 6]
    assert kept.read("t").count() == 50 and rows_of(kept.read("t", 4).where("k = 3")) == [(3, "n2", 2)]
    named = {p for v in (4, 5, 6) for parts in kept.manifest(v).tables.values() for p in parts.values()}
    there = {str(p.relative_to(tmp_path / "kept")) for p in (tmp_path / "kept" / "t").glob("*/bucket=*")}
    assert there == named


def test_the_number_of_buckets_stays(spark, kept, tmp_path):
    kept.write("t", spark.createDataFrame([(None, "null key", 1), (1, "a", 1)], SHAPE))
    again = buckets.Buckets(spark, str(tmp_path / "kept"), kept.tables, buckets=999)
    assert again.buckets == 16 and rows_of(again.read("t").where("k = 1")) == [(1, "a", 1)] and again.read("t").count() == 2


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_ranks_are_the_same_under_any_plan(spark, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        rows = spark.range(200_000).selectExpr("hash(id) AS v", "id % 3 AS k").repartition(7)
        numbers = store.numbered(rows, ["v"], 10)
        low, high, n = numbers.agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()
        assert (low, high, n) == (11, 200_010, 200_000)
        within = store.ranked(rows, ["k"], ["v"], "at").groupBy("k").agg(F.min("at"), F.max("at"), F.count_distinct("at"), F.count("*")).collect()
        assert all(r[1] == 1 and r[2] == r[3] == r[4] for r in within)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def stored(spark, kept, files):
    from corpuloom import schema

    fill = {"string": F.lit(""), "bigint": F.lit(0), "int": F.lit(0)}
    rows = spark.createDataFrame(files, "uri string, content_hash string, text_preview string, content_indexed_at long")
    columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None) if f.nullable else fill[f.dataType.simpleString()]).cast(f.dataType).alias(f.name) for f in schema.STORED]
    kept.upsert_files(rows.select(*columns))


def test_dispatch_computes_once_and_keeps_both_tiers(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "s"), buckets=4)
    stored(spark, kept, [("a", "h1", "own text", 1), ("b", "h1", "own text", 1), ("c", "h2", None, None), ("d", "h3", "x", 1)])
    asked = spark.createDataFrame([(0, "c", "h2"), (1, "a", "h1"), (2, "b", "h1"), (3, "d", "h3"), (4, "nowhere", "h9"), (5, "a", None), (6, "b", None)], "position int, file_uri string, content_hash string")
    asked = asked.withColumns({"profile": F.lit("p"), "model": F.lit("m"), "mode": F.lit("fast"), "extra": F.lit(""), "created_at": F.lit(1).cast("bigint")})
    counted = spark.sparkContext.accumulator(0)

    def compute(df):
        def each(r):
            counted.add(1)
            return (r["id"], "[error]" if r["content_hash"] == "h3" else f"made of {r['content_hash']} " + "y" * 3000)

        return spark.createDataFrame(df.rdd.map(each), "id string, output string")

    first = dispatch.dispatched(kept, asked, compute).collect()
    assert [r["position"] for r in first] == list(range(7)) and not any(r["cached"] for r in first) and counted.value == 6
    again = dispatch.dispatched(kept, asked, compute).collect()
    # Stored: h1 and h2. Computed again: the error, the file that is not stored, and two without a hash.
    assert counted.value == 10 and [r["cached"] for r in again] == [True, True, True, False, False, False, False]
    assert [r["output"] for r in again] == [r["output"] for r in first] and first[1]["output"] == first[2]["output"]
    tiers = kept.read("chunks").groupBy("content_hash", "mode").count().collect()
    assert {tuple(r) for r in tiers} == {("h1", "metadata", 1), ("h1", "fast", 2), ("h2", "fast", 2)}
    fresh = dispatch.dispatched(kept, asked.where("position = 1"), compute, fresh=True).collect()
    assert not fresh[0]["cached"] and counted.value == 11 and kept.read("extractions").count() == 2
    ids = kept.read("chunks").select("id")
    assert ids.distinct().count() == ids.count()


def test_texts_move_little_in_a_dispatch(spark, tmp_path, monkeypatch):
    """A first upsert joins nothing; outputs are read back by one move; what is shown of them is worked out before they move."""
    from corpuloom import queries
    from corpuloom.operators import store
    from corpuloom.plans import dispatch

    monkeypatch.setattr(store, "upserted", None)
    docs = spark.createDataFrame([(i, f"text {i % 7} " * (i % 5 * 200), "en", "s", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept, requests, compute = queries._stored_corpus(spark, str(tmp_path), str(tmp_path / "store"))
    dispatch.dispatched(kept, requests.where("position % 2 = 0"), compute)
    want = {r["position"]: (r["output"], r["cached"]) for r in dispatch.dispatched(kept, requests.where("position < 20"), compute).collect()}
    shown = dispatch.dispatched(kept, requests, compute, shown=lambda x: x.substr(1, 30)).collect()
    assert [r["position"] for r in shown] == list(range(40)) and all(want[r["position"]][0][:30] == r["output"] for r in shown if r["position"] < 20)
    plan = kept.outputs(kept.read("extractions").select("id"))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("extraction_id") and "chunk_text" in plan
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(want[i][0] == f"n={len(texts[i])} {texts[i]}" for i in want)


def test_a_dispatch_moves_texts_a_few_times(spark, tmp_path):
    """Bytes shuffled by a dispatch of half the texts and then of all, against the bytes of the texts."""
    from corpuloom import queries

    docs = spark.range(1200).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 120), i -> sha2(concat(id, ':', i), 256)), '') AS text", "'en' AS lang", "'s' AS source", "1 AS n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    got = queries.cached_dispatch(spark, str(tmp_path))
    assert got.where("cached").count() == 600 and got.select("output_hash").distinct().count() == 1200
    assert (shuffled() - before) / (1200 * 120 * 64) < 5


def extraction(spark, few, mode="fast"):
    shape = "id string, file_uri string, content_hash string, profile string, model string, mode string, detail int, extra string, metadata string, created_at long, output string"
    return spark.createDataFrame([(i, u, h, "p", "m", mode, 0, "", None, 1, t) for i, u, h, t in few], shape)


def test_new_extractions_come_beside_stored_ones(spark, tmp_path, monkeypatch):
    kept = store.Store(spark, str(tmp_path / "s"), buckets=2, keep=1)
    stored(spark, kept, [(f"f{i}", f"h{i}", f"own text {i} " * 300, 1) for i in range(12)])
    outputs = {f"i{i}": (f"f{i}", f"h{i}", f"made of {i} " * 400) for i in range(12)}
    put = lambda at: kept.put_extraction(extraction(spark, [(k, *outputs[k]) for k in at]))
    put([f"i{i}" for i in range(6)])
    first = kept.manifest().tables
    put([f"i{i}" for i in range(6, 12)])
    second = kept.manifest().tables
    for table in ("chunks", "extractions"):  # what lay there was not written again
        assert all(set(place.split(",")) < set(second[table][b].split(",")) for b, place in first[table].items())
    whole = lambda: {r["id"]: r["output"] for r in kept.outputs(spark.createDataFrame([(k,) for k in outputs], "id string")).collect()}
    assert whole() == {k: v[2] for k, v in outputs.items()}
    of = kept.read("chunks").select("id", "extraction_id", "mode", "chunk_idx").collect()
    assert sorted(r["id"] for r in of) == list(range(1, len(of) + 1))
    runs = {}
    for r in of:
        runs.setdefault((r["extraction_id"], r["mode"]), []).append((r["chunk_idx"], r["id"]))
    assert len(runs) == 24 and all(len(x) > 1 and len({b - a for a, b in x}) == 1 for x in runs.values())
    monkeypatch.setattr(buckets, "FOLDERS", 2)  # full: the next are put together with what the buckets hold
    outputs["i12"] = ("f0", "h0", "another")
    outputs["i13"] = ("f1", "h1", "another")
    put(["i12", "i13"])
    put(["i0"])  # replaced, not repeated
    ids = [r["id"] for r in kept.read("chunks").select("id").collect()]
    assert whole() == {k: v[2] for k, v in outputs.items()} and len(ids) == len(set(ids)) and kept.read("extractions").count() == 14
    named = {p for v in kept._pointers() for parts in kept.manifest(v).tables.values() for place in parts.values() for p in place.split(",")}
    there = {str(p.relative_to(tmp_path / "s")) for t in ("files", "extractions", "chunks") for p in (tmp_path / "s" / t).glob("*/bucket=*")}
    assert there == named


def test_own_texts_of_repeated_files_are_stored_once(spark, tmp_path):
    """A uri that is there twice: of two contents each gives its own text, of one content only one."""
    kept = store.Store(spark, str(tmp_path / "s"), buckets=2)
    stored(spark, kept, [("a", "h1", "one", 1), ("a", "h1", "one", 1), ("b", "h2", "two", 1), ("b", "h3", "three", 1)])
    kept.put_extraction(extraction(spark, [("i1", "a", "h1", "x"), ("i2", "b", "h2", "y"), ("i3", "b", "h3", "z")]))
    got = sorted((r["extraction_id"], r["chunk_text"]) for r in kept.read("chunks").where("mode = 'metadata'").collect())
    assert got == [("i1", "one"), ("i2", "two"), ("i3", "three")]


def test_sifting_loses_no_wanted_row(spark):
    from corpuloom.operators.sift import sifted

    rows = spark.range(200_000).selectExpr("id", "concat('k', id) AS k")
    wanted = rows.where("id % 20 = 0")
    left = sifted(rows, wanted, ["k"])
    assert left.join(wanted, "k", "left_semi").count() == 10_000 and left.count() < 30_000
    assert sifted(rows, wanted.select(F.col("id").cast("int")), ["id"]).count() == 200_000  # other types: nothing is left out
    assert sifted(rows, wanted.where("false"), ["k"]).count() == 0
