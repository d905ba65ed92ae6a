"""The trigram index against full scans."""

import random
import re

import pytest

from corpuloom.operators import chunks, search, trigrams


@pytest.fixture(scope="module")
def files(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeéA") for _ in range(rng.randint(2, 7))) for _ in range(120)]
    rows = []
    for i in range(400):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 6))]
        if i % 40 == 0:
            lines.append(rng.choice(["Licensed under the Apache License", "a%b_c [x] LOOP", "quantum loop; v1.0", "İstanbul ÉTÉ ſharp K"]))
        rows.append((f"d{i % 5}/f{i:03}", rng.choice(["\n", "\r\n"]).join(lines)))
    rows += [("z/null", None), ("z/empty", ""), ("z/short", "ab"), ("z/long", "xyz " * 4000 + "needle in hay"), ("d0/f000", rows[0][1])]
    return spark.createDataFrame(rows, "path string, text string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, files, tmp_path_factory):
    made = trigrams.TrigramIndex(spark, str(tmp_path_factory.mktemp("grams") / "i"))
    before, trigrams.BLOCK_BITS = trigrams.BLOCK_BITS, 5
    made.build(files, "text", ["path"])
    yield made
    trigrams.BLOCK_BITS = before


@pytest.fixture(scope="module")
def indexed_chunks(spark, files, tmp_path_factory):
    made = chunks.chunked(files.selectExpr("path AS file_uri", "'fast' AS mode", "text")).cache()
    index = trigrams.TrigramIndex(spark, str(tmp_path_factory.mktemp("grams") / "c"))
    index.build(made, "chunk_text", ["file_uri", "chunk_idx"])
    return made, index


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("pattern", ["licensed? +under", "Apache", "apache", r"\bloop\b", "(quantum|license) loo", "v1\\.0", "needle", "[A-Z]ello", "ab", "", "zzzz", r"(under)+ the", r"(?:Apache )?License", "é", "K", "ſharp", "x{3}|needle", "needle(?= in)", "^a.*b$", "istanbul"])
def test_grep_equals_a_full_scan(index, files, pattern):
    for ignore_case in (False, True):
        assert rows_of(index.grep(pattern, ignore_case=ignore_case)) == rows_of(search.grep(files.where("length(text) > 0"), pattern, ignore_case=ignore_case))


@pytest.mark.parametrize("query", ["the APACHE", "ntum LOOP", "a%b_c", "%", "", "  ", "ab", "needle in", "é", "absent text", "xyz xyz"])
def test_substrings_equal_a_full_scan(indexed_chunks, query):
    made, index = indexed_chunks
    assert rows_of(index.substring_search(query)) == rows_of(search.substring_search(made, query))
    assert rows_of(index.substring_search(query, prefix="d1", limit=3)) == rows_of(search.substring_search(made, query, prefix="d1", limit=3))


def test_little_is_read(index, files):
    hits = files.where("lower(text) LIKE '%apache%'").count()
    assert hits / 404 <= index.share_read("Apache License") <= 2 * hits / 404 and index.share_read("zzzzz") == 0 and index.share_read("ab") == 1
    plan = index.narrowed("Apache License")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_block" in plan or re.search(r"PartitionFilters: \[.*_block", plan)


def test_required_literals():
    cases = {"licensed? +under": "license", "(quantum|license) loop": " loop", "v1\\.0": "v1.0", "a.b": "a", "(abc)+d": "abc", "(abc)?d": "d", "x|y": "", "(?i)needle": "needle", "[": "", "é+abc": "abc", "(?=look)abc": "abc", "abc$": "abc", "(?i:abc)d": "d", "a{3}": "a"}
    assert {p: trigrams.required_literal(p) for p in cases} == cases


def test_literals_are_in_every_match():
    rng = random.Random(5)
    atoms = ["a", "b", "ab", "a?", "b+", "[ab]", "(ab|ba)", "(a)", "(ab)+", "(?:ba)*", ".", "$", "\\b", "a{2}", "(a|)"]
    for _ in range(2000):
        pattern = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 6)))
        literal = trigrams.required_literal(pattern)
        for text in ("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(10)):
            if re.search(pattern, text):
                assert literal in text, (pattern, literal, text)


def test_postings_of_windows_of_any_size(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    texts = ["".join(rng.choice("abAé \n日") for _ in range(rng.choice([0, 1, 2, 3, 40, 700]))).encode() for _ in range(60)]
    want = {(b, t[i : i + 3].lower(), p) for p, t in enumerate(texts) for b in [p // 16] for i in range(len(t) - 2)}
    order = list(range(60))
    rng.shuffle(order)
    batch = pa.RecordBatch.from_arrays([pa.array([p // 16 for p in order], pa.int64()), pa.array(order, pa.int32()), pa.array([texts[p] for p in order], pa.binary())], ["block", "place", "text"])
    for window in (50, 1000, 1 << 22):
        monkeypatch.setattr(trigrams, "WINDOW", window)
        rows = [r for made in trigrams._post(iter([batch.slice(0, 7), batch.slice(7)])) for r in made.to_pylist()]
        got = [(r["block"], r["gram"].to_bytes(3, "big"), p) for r in rows for p in r["places"]]
        assert len(got) == len(set(got)) and set(got) == want
        assert all(r["places"] == sorted(r["places"]) and r["n"] == len(r["places"]) for r in rows)
    assert [g.to_bytes(3, "big") for g in trigrams.grams("ABÉab")] == sorted({b"ab\xc3", b"b\xc3\x89", b"\xc3\x89a", b"\x89ab"}) and len(np.unique(trigrams.grams("aaaa"))) == 1


def test_postings_are_written_where_they_are_made(spark, files, tmp_path, monkeypatch):
    """Grams are neither exploded into rows nor shuffled before they are written."""
    from corpuloom.operators import store

    seen = []
    monkeypatch.setattr(trigrams, "arrow_map", lambda df, f, shape, real=trigrams.arrow_map: seen.append(real(df, f, shape)) or seen[-1])
    trigrams.TrigramIndex(spark, str(tmp_path / "i")).build(files, "text", ["path"])
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    ids = store.numbered(spark.range(1000).selectExpr("id % 7 AS a", "id AS b").repartition(5), ["a", "b"], 10, "at").orderBy("at").collect()
    assert [(r["a"], r["b"]) for r in ids] == sorted((i % 7, i) for i in range(1000)) and [r["at"] for r in ids] == list(range(11, 1011))
