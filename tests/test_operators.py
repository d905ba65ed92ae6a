import datetime
import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuloom import schema
from corpuloom.functions import ids, media, text
from corpuloom.operators import accounting, cache, catalog, chunks, context, dedup, peek, search, store
from corpuloom.plans import encoders, generate, media_plans, specs, sqlview, strategy, transcription
from corpuloom.sources import av, extract, files, office, pixels, sinks
from corpuloom.streaming import ingest


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first().asDict()


# ---------------------------------------------------------------- schemas and scans


def test_schemas():
    assert len(schema.FILES) == 14 and len(schema.EXTENDED) == 32 and len(schema.STORED) == 36
    assert len(schema.EXTRACTIONS) == 11 and len(schema.CHUNKS) == 10


@pytest.fixture
def tree(tmp_path):
    for path, data in {
        "lab/start.py": b"print(1)\n", "lab/probe.rs": b"fn probe() {", "docs/readme.md": b"# hi\n", "etc/limits.toml": b"a = 1", ".hidden/x.txt": b"x", "Makefile": b"all:", "archive.tar.gz": b"\x1f\x8b",
        "skip.log": b"log", "data/file.csv": b"a,b", "myfile.py": b"", "broken.png": b"\x89PNG\r\n\x1a\n" + b"\0" * 4,
        "icon.png": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 3, 5), "clip.mp4": b"\0\0\0 ftyp", ".gitignore": b"*.log\ndata/\n",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    (tmp_path / "link.py").symlink_to(tmp_path / "myfile.py")
    return tmp_path


def test_scan(spark, tree):
    rows = {r["path"]: r for r in files.scan(spark, str(tree)).collect()}
    assert set(rows) == {"lab/start.py", "lab/probe.rs", "docs/readme.md", "etc/limits.toml", ".hidden/x.txt", "Makefile", "archive.tar.gz", "myfile.py", "broken.png", "icon.png", "clip.mp4", ".gitignore"}
    assert files.scan(spark, str(tree)).columns == schema.FILES.names
    my = rows["myfile.py"]
    assert (my["name"], my["stem"], my["ext"], my["parent"], my["depth"], my["kind"], my["mime"], my["size"]) == ("myfile.py", "myfile", ".py", "", 0, "code", "text/x-python", 0)
    assert (rows["icon.png"]["width"], rows["icon.png"]["height"]) == (3, 5)
    assert (rows["broken.png"]["width"], rows["broken.png"]["height"]) == (None, None)
    assert rows["archive.tar.gz"]["ext"] == ".gz" and rows["archive.tar.gz"]["stem"] == "archive.tar"
    assert rows[".gitignore"]["ext"] == "" and rows[".gitignore"]["kind"] == "other"
    assert (rows["lab/start.py"]["parent"], rows["lab/start.py"]["depth"]) == ("lab", 1)
    assert isinstance(my["modified"], datetime.datetime)
    every = {r["path"] for r in files.scan(spark, str(tree), no_ignore=True).collect()}
    assert every - set(rows) == {"skip.log", "data/file.csv"}
    stored = {r["path"]: r["size"] for r in files.scan_store(spark, str(tree)).collect()}
    assert stored["lab/start.py"] == 9


def test_scan_of_nothing(spark, tmp_path):
    assert files.scan(spark, str(tmp_path)).count() == 0
    spark.createDataFrame([], "a int").write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no rows"):
        files.read_parquet(spark, str(tmp_path / "t"))


@pytest.mark.parametrize(
    ("given_", "want"),
    [('["a", {"path": "b"}, {"uri": "c"}, {"name": "d"}, {"x": 1}]', ["a", "b", "c", "d"]), ('{"path": "b"}', ["b"]), ("path\n1\ta\n2\tb\n", ["a", "b"]), ("kind,path\ntext,a b.txt\n", ["a b.txt"]), ("a\n\nb\n", ["a", "b"]), ("  ", []), ("[not json", ["[not json"])],
)
def test_piped_paths(given_, want):
    assert files.piped_paths(given_) == want


def test_image_headers():
    assert files.image_size(b"GIF89a" + struct.pack("<HH", 7, 9)) == (7, 9)
    assert files.image_size(b"BM" + b"\0" * 16 + struct.pack("<ii", 4, -6)) == (4, 6)
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 20, 10)
    assert files.image_size(jpeg + b"\0" * 8) == (10, 20)
    assert files.image_size(b"\xff\xd8\xff") is None and files.image_size(b"") is None


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": {"mtime_us": 5, "size": 1}, "b": {"mtime_us": 6, "size": 2}}')
    assert sorted(map(tuple, files.manifest(spark, str(tmp_path / "m.json")).collect())) == [("a", 5, 1), ("b", 6, 2)]


# ---------------------------------------------------------------- text functions


def test_lines_and_tokens(spark):
    t = F.lit("line1\nline2\nline3\n")
    got = one(spark, a=text.line_count(t), b=text.byte_tokens(t), c=text.line_count(F.lit("")), d=text.document_line_count(F.lit("")), e=text.line_count(F.lit("a\nb")), f=text.word_count(F.lit(" a b\n")), g=text.char_tokens(F.lit("éééé")), h=text.byte_tokens(F.lit("éééé")))
    assert got == {"a": 3, "b": 4, "c": 0, "d": 1, "e": 2, "f": 2, "g": 1, "h": 2}
    assert one(spark, a=media.image_tokens(F.lit(1024), F.lit(1024)), b=media.image_tokens(F.lit(None), F.lit(3))) == {"a": 765, "b": 85}
    assert one(spark, a=text.density(F.lit(5), F.lit(2097152)), b=text.density(F.lit(5), F.lit(0))) == {"a": 2, "b": None}


def test_split_lines_is_pythons(spark):
    for s in ("a\r\nb\rc\n", "", "\n", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i", "a\n\nb", "\r\n\r\n"):
        assert one(spark, x=text.split_lines(F.lit(s)))["x"] == s.splitlines()


@pytest.mark.parametrize(("pattern", "line", "hit"), [("go paperless", "Go Paperless", True), ("PAPERLESS", "Go Paperless", False), (r"\S+ world", "LARGE WORLD", True), ("[A-Z]ello", "hello world", False)])
def test_smart_case(spark, pattern, line, hit):
    assert one(spark, x=F.lit(line).rlike(text.smart_case(pattern)))["x"] is hit
    assert one(spark, x=F.lit("Go Paperless").rlike(text.smart_case("PAPERLESS", True)))["x"]


def test_sizes(spark):
    assert [text.size_literal(x) for x in ("10", "1KB", "1.5mb", "2 GB", 7)] == [10, 1024, 1572864, 2147483648, 7]
    with pytest.raises(ValueError):
        text.size_literal("many")
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1536: "1.5 KB", 5 * 1024**3: "5.0 GB"}
    assert {n: one(spark, x=text.human_size(F.lit(n)))["x"] for n in sizes} == sizes
    counts = {5: "5", 1500: "1.5K", 2_500_000: "2.5M", 3_210_000_000: "3.21B"}
    assert {n: one(spark, x=text.human_count(F.lit(n)))["x"] for n in counts} == counts
    assert one(spark, x=text.clock(F.lit(75.5)))["x"] == "1m 15.5s"


def test_snippets(spark):
    long = "x" * 100 + "NEEDLE" + "y" * 100
    got = one(spark, a=text.snippet(F.lit(long), "NEEDLE"), b=text.snippet(F.lit(long), "absent"), c=text.snippet(F.lit("a NEEDLE\nb"), "NEEDLE"))
    assert got == {"a": "..." + "x" * 40 + "NEEDLE" + "y" * 40 + "...", "b": long[:90] + "..." + long[-50:], "c": "a NEEDLE b"}


# ---------------------------------------------------------------- catalog


def test_find(spark, tree):
    found = files.scan(spark, str(tree))
    paths = lambda df: [r["path"] for r in df.collect()]
    assert set(paths(catalog.find(found, kind="code,config"))) == {"lab/start.py", "lab/probe.rs", "myfile.py", "etc/limits.toml"}
    assert paths(catalog.find(found, ext=".py", sort="size", descending=True)) == ["lab/start.py", "myfile.py"]
    assert paths(catalog.find(found, name="^START", ignore_case=True)) == ["lab/start.py"]
    assert set(paths(catalog.find(found, max_depth=0))) == {"Makefile", "archive.tar.gz", "myfile.py", "broken.png", "icon.png", "clip.mp4", ".gitignore"}
    with pytest.raises(ValueError):
        catalog.find(found, sort="colour")
    a, b = catalog.find(catalog.find(found, kind="code"), min_size=1), catalog.find(found, kind="code", min_size=1)
    assert sorted(paths(a)) == sorted(paths(b))
    rolled = {r["dir"]: (r["files"], r["bytes"]) for r in catalog.rollup(found).collect()}
    assert rolled["lab"] == (2, 21) and rolled[""][0] == 12
    tree_ = sinks.tree(catalog.rollup(found), found)
    assert tree_["files"] == 12 and {c["name"] for c in tree_["children"]} >= {"lab", "docs", "Makefile"}
    assert "clip.mp4" not in paths(catalog.searchable(found)) and ".hidden/x.txt" not in paths(catalog.searchable(found))
    assert catalog.shown_columns(found)[:4] == ["path", "name", "kind", "size"]


def test_scope(spark):
    uris = spark.createDataFrame([("/a/b/c",), ("/a/bc",)], "uri string")
    assert catalog.in_scope(uris, "/a/b").count() == 1 and catalog.in_scope(uris, "/a/b", loose=True).count() == 2


def test_staleness(spark):
    now = spark.createDataFrame([("new", 1, 1), ("same", 1, 1), ("time", 2, 1), ("size", 1, 2)], "uri string, modified long, size long")
    was = spark.createDataFrame([("same", 1, 1), ("time", 1, 1), ("size", 1, 1), ("gone", 1, 1)], "uri string, modified long, size long")
    assert {r["uri"] for r in catalog.stale(now, was).collect()} == {"new", "time", "size"}
    assert {r["uri"] for r in catalog.prune_candidates(was, now).collect()} == {"gone"}
    assert {r["uri"] for r in catalog.unindexed(now, was).collect()} == {"new"}


# ---------------------------------------------------------------- chunks


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab é\n", max_size=60), max_size=8))
def test_chunks_reassemble(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["text"] for r in chunks.reassembled(chunks.chunked(rows, size=10, overlap=3), ["id"], overlap=3).collect()}
    assert got == {i: t for i, t in enumerate(texts) if t}


def test_chunk_windows(spark):
    for n, want in ((1, 1), (2048, 1), (2049, 2), (3996, 2), (3997, 3)):
        assert len(one(spark, x=chunks.chunk_texts(F.lit("x" * n)))["x"]) == want


# ---------------------------------------------------------------- search


def test_substrings(spark):
    rows = [("/a/1.MD", "fast", 0, "Breaking the Quantum Loop"), ("/a/2.md", "fast", 0, "won't hello-world v1.0 100% a_b É"), ("/ab/3.md", "fast", 0, "quantum loop")]
    parts = spark.createDataFrame(rows, "file_uri string, mode string, chunk_idx int, chunk_text string")
    count = lambda q, **k: search.substring_search(parts, q, **k).count()
    assert [count(q) for q in ("ntum LOOP", "won't", "hello-world", "v1.0", "", "  ", "%", "a_b", "é")] == [2, 1, 1, 1, 0, 0, 1, 1, 0]
    assert count("loop", prefix="/a") == 1 and count("loop", prefix="/a", loose=True) == 2 and count("loop", ext=".md") == 2 and count("loop", limit=1) == 1
    kinds = spark.createDataFrame([("/a/1.MD", "text")], "uri string, kind string")
    assert count("loop", kinds=kinds, kind=["text"]) == 1


def test_nearest_of_all_is_a_sort(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(20)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [r["vec_id"] for r in search.nearest(vectors, rows[3][1], 20).collect()]
    point = np.array(rows[3][1], np.float32)
    assert got == sorted(range(20), key=lambda i: (np.linalg.norm(np.array(rows[i][1], np.float32) - point), i))
    assert [r["vec_id"] for r in search.nearest(vectors, rows[3][1], 5, where=F.col("vec_id") > 10).collect()] == [i for i in got if i > 10][:5]


def test_grep(spark):
    rows = spark.createDataFrame([("a", "one\nTwo\nthree\n"), ("b", ""), ("c", None)], "path string, text string")
    assert [tuple(r) for r in search.grep(rows, "two").collect()] == [("a", 2, "Two")]
    assert search.grep(rows, "two", smart=False).count() == 0
    assert search.grep(rows, "one", context=1).first()["context"] == ["one", "Two"]
    assert [tuple(r) for r in search.grep_counts(rows, "o|e").collect()] == [("a", 3)]


# ---------------------------------------------------------------- store


def stored_files(spark, rows):
    names = ["uri", "size", "modified", "text_preview", "session_id", "ref_id"]
    df = spark.createDataFrame(rows, "uri string, size long, modified long, text_preview string, session_id string, ref_id string")
    filled = {f.name: F.lit(None).cast(f.dataType) if f.nullable else F.lit({"string": "", "int": 0, "bigint": 0}[f.dataType.simpleString()]).cast(f.dataType) for f in schema.STORED}
    return df.select(*(F.col(n) if n in names else filled[n].alias(n) for n in schema.STORED.names))


def test_store(spark, tmp_path):
    made = store.Store(spark, str(tmp_path / "store"))
    assert made.read("files").count() == 0
    made.upsert_files(stored_files(spark, [("a", 1, 1, "text", "s", "r1"), ("b", 1, 1, None, None, None)]))
    again = stored_files(spark, [("a", 2, 2, None, "s", "r2"), ("c", 3, 3, None, "s", "r3")])
    for _ in range(2):  # putting the same in twice changes nothing
        made.upsert_files(again)
        got = {r["uri"]: (r["size"], r["text_preview"], r["ref_id"]) for r in made.read("files").collect()}
        assert got == {"a": (2, "text", "r1"), "b": (1, None, None), "c": (3, None, "r3")}
    made.upsert_files(stored_files(spark, [("a", 2, 2, None, "other", "r9")]))
    assert made.read("files").where("uri = 'a'").first()["ref_id"] == "r9"

    row = ("i1", "a", "h", "p", "m", "fast", 0, "", None, 1, "x" * 5000)
    shape = "id string, file_uri string, content_hash string, profile string, model string, mode string, detail int, extra string, metadata string, created_at long, output string"
    for text_ in ("x" * 5000, "y" * 2500):
        made.put_extraction(spark.createDataFrame([(*row[:-1], text_)], shape))
    assert made.read("extractions").count() == 1 and made.read("chunks").count() == 2
    assert chunks.reassembled(made.read("chunks"), ["file_uri"]).first()["text"] == "y" * 2500
    with pytest.raises(ValueError, match="no stored file"):
        made.put_extraction(spark.createDataFrame([("i2", "nowhere", *row[2:])], shape))
    embeddings = made.read("chunks").select("file_uri", F.col("chunk_idx").alias("ordinal"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    made.write("chunks_vec", store.upsert_vectors(made.read("chunks"), made.read("chunks_vec"), embeddings))
    status = search.index_status(made.read("files"), made.read("chunks"), made.read("chunks_vec"))
    assert {r["uri"]: r["status"] for r in status.collect()} == {"a": "indexed", "b": "unprocessed", "c": "unprocessed"}
    assert made.evict_extractions(spark.createDataFrame([("nope",)], "id string")) == 0
    made.delete_files(spark.createDataFrame([("a",)], "uri string"))
    assert [made.read(t).count() for t in ("files", "extractions", "chunks", "chunks_vec")] == [2, 0, 0, 0]
    made.register()
    assert spark.sql("SELECT count(*) FROM files f LEFT JOIN chunks c ON f.uri = c.file_uri").first()[0] == 2


def test_extraction_ids(spark):
    key = lambda mode: ids.extraction_id(F.lit("h"), F.lit("p"), F.lit("m"), F.lit(mode), F.lit(True), F.lit(""))
    got = one(spark, a=key("fast"), b=key("fast"), c=key("accurate"))
    assert got["a"] == got["b"] != got["c"] and len(got["a"]) == 24
    assert ids.override_string({"max_width": 768, "fps": 5}) == ids.override_string({"fps": 5, "max_width": 768})


def test_numbered_rows_are_consecutive(spark):
    rows = spark.range(1000).withColumn("k", F.xxhash64("id"))
    got = sorted(store.numbered(rows, ["k"], 7, "n").select("k", "n").collect())
    assert [r["n"] for r in got] == list(range(8, 1008))


# ---------------------------------------------------------------- the rest


def test_hamming(spark):
    rng = np.random.default_rng(2)
    values = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 60)]
    values += [v % (1 << 64) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for v in values[:30] for k in (3, 8)]
    values = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    rows = spark.createDataFrame(list(enumerate(values)), "k long, phash long")
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if bin((values[i] ^ values[j]) & ((1 << 64) - 1)).count("1") < 8}
    assert {(r["a"], r["b"]) for r in dedup.hamming_pairs(rows, "k").collect()} == want


def test_perceptual_hash():
    rng = np.random.default_rng(3)
    image = np.kron(rng.random((8, 8)), np.ones((16, 16)))
    a, b, c = (media.perceptual_hash(x) for x in (image, image * 0.8 + 0.05, rng.random((128, 128))))
    apart = lambda x, y: bin(int(x, 16) ^ int(y, 16)).count("1")
    assert len(a) == 16 and apart(a, b) <= 2 and apart(a, c) > 10


def test_media(spark):
    windows = one(spark, x=media.windows(F.lit(130.0), 60, 5))["x"]
    assert [tuple(w) for w in windows] == [(0.0, 60.0), (55.0, 115.0), (110.0, 130.0)]
    assert one(spark, x=media.windows(F.lit(0.0), 60, 5))["x"] == []
    items = F.sequence(F.lit(0), F.lit(99))
    assert one(spark, x=media.sampled(items, 4))["x"] == [0, 25, 50, 75]
    assert len(one(spark, x=media.decimated(items, 6))["x"]) == 50
    assert one(spark, x=media.gps(media.decimal_position(F.lit(48), F.lit(30), F.lit(0), F.lit("S")), F.lit(2.0)))["x"] == "-48.500000,2.000000"


def test_contexts(spark):
    items = spark.createDataFrame([(1, 0, "system", "a"), (1, 1, "user", "b"), (1, 2, "user", "c"), (1, 3, "system", "d")], "conv_id long, turn long, role string, text string")
    got = sorted((r["run"], r["role"], r["content"]) for r in context.messages(items).collect())
    assert got == [(1, "system", ["a"]), (2, "user", ["b", "c"]), (3, "system", ["d"])]
    assert context.single_turn(items).first()["parts"] == ["[role=system]", "a", "b", "c", "[role=system]", "d"]
    many = spark.range(30000).select(F.lit("text").alias("kind"), F.col("id").alias("key"))
    assert context.with_refs(many, "s", "key").select("ref_id").distinct().count() == 30000
    assert one(spark, a=ids.ref_session(F.lit("s-1/txt_00ff00")), b=ids.ref_local(F.lit("s/txt_00")), c=ids.is_ref(F.lit("img_abcdef"))) == {"a": "s-1", "b": None, "c": True}


def test_sql_dialect(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "path string, n int")
    got = sqlview.sql(spark, "SELECT n, GROUP_CONCAT(path, ', ') AS p, IFNULL(NULL, 'GROUP_CONCAT(') AS q FROM files GROUP BY n;", {"files": rows}).first()
    assert sorted(got["p"].split(", ")) == ["a", "b"] and got["q"] == "GROUP_CONCAT("
    assert {r["col_name"] for r in sqlview.sql(spark, "PRAGMA table_info(files)").collect()} == {"path", "n"}


def test_pipelines(spark):
    built = {"image": {"encode": {"strategy": "resize", "max_width": 1024}, "generate": {"prompt": "p"}}, "audio": {"encode": {"strategy": "native"}, "generate": {}}}
    assert strategy.resolved_pipeline("image", built_in=built, overrides={"encode": {"max_width": 768}})["encode"] == {"strategy": "resize", "max_width": 768}
    assert "generate" not in strategy.resolved_pipeline("audio", built_in=built, encoder="transcribe")
    assert strategy.rendered_prompt("{a} and {b}", {"a": 1}) == "1 and "
    assert [strategy.coerced("5", int), strategy.coerced("yes", bool), strategy.coerced('{"a": 1}', dict)] == [5, True, {"a": 1}]
    pages = spark.createDataFrame([("f", "p1\fp2\fp3")], "path string, text string")
    got = encoders.encoded(pages, "document/page-text", {"pages_per_message": 2}).collect()
    assert [r["message"] for r in got] == [0, 1] and got[0]["text"].startswith("--- Page 1 ---\np1")


def test_renderings(spark, tmp_path):
    rows = spark.createDataFrame([("a|b", 1.5, None)], "s string, x double, n int")
    assert sinks.joined_rows(rows).first()["line"] == "a|b\t1.50\t"
    assert sinks.markdown_rows(rows).first()["line"] == "| a\\|b | 1.50 |  |"
    assert sinks.string_json_rows(rows).first()["json"] == '{"s":"a|b","x":"1.50","n":""}'
    assert sinks.json_rows(rows).first()["json"] == '{"s":"a|b","x":1.5,"n":null}'
    for name, write in sinks.WRITERS.items():
        write(rows, str(tmp_path / name))
    assert spark.read.parquet(str(tmp_path / "dataset")).count() == 1
    assert sinks.schema_listing(rows).count() == 3 and sinks.resolved_format(None, True) == "tsv"


def test_extraction(spark):
    rows = spark.createDataFrame([("a.py", ".py", "x = 1\n")], "path string, ext string, text string")
    got = extract.extract_text(rows).first()
    assert (got["line_count"], got["word_count"], got["language"]) == (1, 3, "python")
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 3, 5)
    images = spark.createDataFrame([("i.png", bytearray(png)), ("x", None)], "path string, content binary")
    got = {r["path"]: r for r in extract.extract_images(images).collect()}
    assert (got["i.png"]["dimensions"], got["i.png"]["magic_mime"], got["x"]["dimensions"]) == ("3x5", "image/png", None)
    tiff = b"II*\0\x08\0\0\0" + struct.pack("<H", 2) + struct.pack("<HHI4s", 0x010F, 2, 4, b"Cam\0") + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0) + b"\0" * 4
    assert extract.exif(b"\xff\xd8\xff\xe1\0\0Exif\0\0" + tiff) == {"camera": "Cam", "orientation": "6"}


def test_accounting(spark):
    rows = spark.createDataFrame([("image", 100, None, 1024, 1024), ("text", 18, "line1\nline2\nline3\n", None, None), ("document", 8, "éééé", None, None)], "kind string, size long, text string, width int, height int")
    got = {r["kind"]: (r["files"], r["lines"], r["tokens"], r["tok_per_img"]) for r in accounting.wc(rows).collect()}
    assert got == {"image": (1, 0, 765, 765), "text": (1, 3, 4, None), "document": (1, 1, 1, None), None: (3, 4, 770, None)}


def test_stream(spark, tmp_path):
    made = store.Store(spark, str(tmp_path / "store"))
    stored_files(spark, [(f"u{i}", i, i, None, None, None) for i in range(5)]).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        run = ingest.merge_into(made, ingest.stream_of(spark, str(tmp_path / "in"), schema.STORED), str(tmp_path / "ck"))
        run.awaitTermination()
        assert made.read("files").count() == 5


def zipped(**parts):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text_ in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text_)
    return out.getvalue()


def test_office_files(spark):
    docx = zipped(word__document_xml='<w:d xmlns:w="w"><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:t>Three</w:t></w:p></w:d>')
    xlsx = zipped(
        xl__workbook_xml='<x><sheets><sheet name="S"/></sheets></x>',
        xl__sharedStrings_xml="<sst><si><t>a|b</t></si></sst>",
        xl__worksheets__sheet1_xml='<x><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2</v></c></row><row><c r="A2" t="inlineStr"><is><t>z</t></is></c></row></x>',
    )
    pptx = zipped(ppt__slides__slide1_xml='<x xmlns:a="a"><a:p><a:t>Hi</a:t></a:p></x>', ppt__slides__slide2_xml='<x xmlns:a="a"><a:p><a:t>Bye</a:t></a:p></x>')
    odt = zipped(content_xml='<o:d xmlns:o="office" xmlns:t="text"><o:text><t:h>Head</t:h><t:p>a<t:span>b</t:span>c</t:p></o:text></o:d>')
    rows = spark.createDataFrame([(f"f{e}", e, bytearray(d)) for e, d in ((".docx", docx), (".XLSX", xlsx), (".pptx", pptx), (".odt", odt), (".odp", b"junk"))], "path string, ext string, content binary")
    got = {r["path"]: (r["text"], r["pages"]) for r in office.extract_office(rows).collect()}
    assert got["f.docx"] == ("One\ttwo\nThree", None)
    assert got["f.XLSX"] == ("## S\n\n| a\\|b |  | 2 |\n| --- | --- | --- |\n| z |  |  |", 1)
    assert got["f.pptx"] == ("## Slide 1\n\nHi\n\n## Slide 2\n\nBye", 2)
    assert got["f.odt"] == ("Head\nabc", None) and got["f.odp"] == (None, None)


def test_av_files(spark):
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    header = lambda kind, scale, length: box(kind, b"\0" * 12 + struct.pack(">II", scale, length) + b"\0" * 8)
    entry = struct.pack(">I4s", 86, b"avc1") + b"\0" * 24 + struct.pack(">HH", 640, 360) + b"\0" * 50
    table = box(b"stsd", b"\0" * 4 + struct.pack(">I", 1) + entry) + box(b"stts", b"\0" * 4 + struct.pack(">III", 1, 50, 40))
    track = lambda what, stbl: box(b"trak", box(b"mdia", header(b"mdhd", 1000, 2000) + box(b"hdlr", b"\0" * 8 + what + b"\0" * 12) + box(b"minf", box(b"stbl", stbl))))
    sound = box(b"stsd", b"\0" * 4 + struct.pack(">I", 1) + struct.pack(">I4s", 36, b"mp4a") + b"\0" * 28)
    movie = box(b"ftyp", b"isom") + box(b"moov", header(b"mvhd", 600, 1200) + track(b"vide", table) + track(b"soun", sound))
    wav = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", 32000)
    element = lambda i, body: i + bytes([0x40 | len(body) >> 8, len(body) & 255]) + body
    mkv = element(b"\x1a\x45\xdf\xa3", b"") + element(b"\x18\x53\x80\x67", element(b"\x15\x49\xa9\x66", element(b"\x44\x89", struct.pack(">d", 2500.0))) + element(b"\x16\x54\xae\x6b", element(b"\xae", element(b"\x83", b"\x01") + element(b"\x86", b"V_VP9") + element(b"\xe0", element(b"\xb0", b"\x02\x80") + element(b"\xba", b"\x01\x68")))))
    rows = spark.createDataFrame([(p, "." + p.split(".")[1], bytearray(d)) for p, d in (("a.mp4", movie), ("b.wav", wav), ("c.mkv", mkv), ("d.mp4", b"junk"), ("e.avi", b""))], "path string, ext string, content binary")
    got = {r["path"]: tuple(r[f] for f in av.FIELDS) for r in av.extract_media(rows).collect()}
    assert got["a.mp4"] == ("640x360", 2.0, 25.0, "avc1", "mp4a", True)
    assert got["b.wav"] == (None, 2.0, None, None, "pcm", True)
    assert got["c.mkv"] == ("640x360", 2.5, None, "V_VP9", None, False)
    assert got["d.mp4"] == got["e.avi"] == (None,) * 6


def test_media_plans(spark):
    assert len(media_plans.PLANS) == 29 and media_plans.encoder_table(spark).count() == 29
    rows = spark.createDataFrame([("v", 130.0), ("n", None)], "uri string, duration_s double")
    assert [(r["start"], r["end"]) for r in media_plans.window_rows(rows, "video/chunked").collect()] == [(0.0, 60.0), (55.0, 115.0), (110.0, 130.0)]
    frames = media_plans.frame_rows(rows, "video/mosaic").collect()
    assert len(frames) == 128 and max(r["message"] for r in frames) == 7
    assert one(spark, w=media_plans.fitted(F.lit(4000), F.lit(1000))[0], h=media_plans.fitted(F.lit(4000), F.lit(1000))[1]) == {"w": 1024, "h": 256}
    spoken = F.array(F.struct(F.lit(6.0).alias("start"), F.lit(7.75).alias("end"), F.lit("hi").alias("text")))
    assert one(spark, x=media_plans.transcript(spoken, 2))["x"] == "[12.0s - 15.5s] hi"


def test_cache_computes_once(spark, tmp_path):
    made = cache.Cache(spark, str(tmp_path / "cache"))
    rows = cache.keyed(spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", None, 3)], "path string, modified long, size long"), "x")
    first = made.through(rows, lambda df: df.select("cache_key", "path", F.lit(1).alias("v")))
    again = made.through(rows, lambda df: df.select("cache_key", "path", F.lit(2).alias("v")))
    assert {r["path"]: r["v"] for r in first.collect()} == {"a": 1, "b": 1, "c": 1}
    assert {r["path"]: r["v"] for r in again.collect()} == {"a": 1, "b": 1, "c": 2}


def test_specs_and_peek(spark, tmp_path):
    (tmp_path / "p.toml").write_text('kind = "image"\n[encode]\nstrategy = "tile"')
    (tmp_path / "q.json").write_text('[{"kind": "audio"}, {"kind": "video"}]')
    assert specs.by_kind(specs.loaded(specs.located("p", tmp_path)))["image"]["encode"]["strategy"] == "tile"
    assert set(specs.by_kind(specs.loaded(tmp_path / "q.json"))) == {"audio", "video"}
    rows = spark.createDataFrame([("a.toml", ".toml", 3, None)], "path string, ext string, size long, pages long")
    assert peek.peek_json(rows).first()["json"] == '{"path":"a.toml","ext":".toml","size":3,"media_kind":"text"}'


# ---------------------------------------------------------------- ignore rules, globs, headers, plans

IGNORED = [
    (["a/*.txt"], "", [("a/x.txt", True), ("a/b/x.txt", False), ("c/a/x.txt", False)]),
    (["doc/**/y"], "", [("doc/y", True), ("doc/a/b/y", True), ("doc/ay", False)]),
    (["*.log", "!keep.log"], "", [("x.log", True), ("d/x.log", True), ("d/keep.log", False)]),
    (["/top", "logs/**"], "", [("top", True), ("d/top", False), ("logs/a/b", True), ("logs", False)]),
    (["*.tmp", "own/*.c"], "sub", [("sub/x.tmp", True), ("sub/deep/x.tmp", True), ("sub/own/m.c", True), ("sub/deep/own/m.c", False)]),
    (["[ab]?.x", "[!ab].y", "# no", "\\#yes"], "", [("az.x", True), ("cz.x", False), ("c.y", True), ("a.y", False), ("#yes", True), ("# no", False)]),
]


@pytest.mark.parametrize(("lines", "folder", "cases"), IGNORED)
def test_ignore_rules(lines, folder, cases):
    rules = files.IgnoreRules(lines, folder)
    assert [(p, bool(rules.verdict(p, False))) for p, _ in cases] == cases


def test_inner_ignore_files_decide(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "conf"))
    root = tmp_path / "root"
    for path, data in {"conf/git/ignore": "*.mine\n", "root/.gitignore": "*.o\nbuild/\n", "root/sub/.gitignore": "!wanted.o\n/only.txt\n", "root/sub/.ignore": "quiet\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(data)
    for path in ("a.o", "b.mine", "build/x", "sub/wanted.o", "sub/other.o", "sub/only.txt", "sub/deep/only.txt", "sub/quiet", "only.txt"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("x")
    got = {r["path"] for r in files.scan(spark, str(root)).collect()}
    assert got == {".gitignore", "only.txt", "sub/.gitignore", "sub/.ignore", "sub/wanted.o", "sub/deep/only.txt"}


def test_header_words_are_no_paths():
    assert files.piped_paths("kind\tsize\nx\ta.py\nmime,ext\nfile\ntable\n") == ["a.py"]


@pytest.mark.parametrize(("pattern", "fits", "not_"), [("*.py", ["a.py", ".py", "a\n.py"], ["a.pyc", "a.PY"]), ("a?[0-9].[^x]*", ["ab1.yz", "a.2.y"], ["ab1.x", "a1.y"]), ("it's\\*", ["it's\\x"], ["its\\x"]), ("[]a]b[", ["]b[", "ab["], ["b["])])
def test_glob(spark, pattern, fits, not_):
    rows = spark.createDataFrame([(x,) for x in fits + not_], "name string")
    quoted = pattern.replace("'", "''")
    assert {r["name"] for r in sqlview.sql(spark, f"SELECT name FROM globbed WHERE name GLOB '{quoted}'", {"globbed": rows}).collect()} == set(fits)
    with pytest.raises(ValueError, match="GLOB"):
        sqlview.translated("SELECT a GLOB b FROM t")


def test_every_video_encoder_can_be_planned(spark):
    scenes = F.expr("array(struct(0.0D AS start, 4.0D AS end), struct(4.0D AS start, 10.0D AS end))")
    rows = spark.createDataFrame([("v", 10.0)], "uri string, duration_s double").withColumn("scenes", scenes)
    for name, plan in media_plans.PLANS.items():
        if plan.keys() & {"frames", "per_second", "per_shot"} and "window" not in plan:
            assert media_plans.frame_rows(rows, name, scenes="scenes").count() > 0, name
    shots = media_plans.frame_rows(rows, "video/shots", scenes="scenes").collect()
    assert [(r["message"], r["part"], r["time"]) for r in shots if r["part"] in (0, 7)] == [(0, 0, 0.25), (0, 7, 3.75), (1, 0, 4.375), (1, 7, 9.625)]
    assert media_plans.frame_rows(rows, "video/shot-mosaic").count() == 16


def test_hamming_pairs_of_all_distances(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 20)]
    hashes = base + [h ^ sum(1 << int(b) for b in rng.choice(63, n, replace=False)) for h in base for n in range(1, 10)]
    rows = spark.createDataFrame(list(enumerate(hashes)), "k long, phash long")
    got = {(r["a"], r["b"], r["distance"]) for r in dedup.hamming_pairs(rows, "k").collect()}
    want = {(i, j, d) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (d := bin((a ^ b) & ((1 << 64) - 1)).count("1")) < 8}
    assert got == want and len(want) > 100


def test_ranks_of_a_hot_key(spark):
    rows = spark.createDataFrame([("hot" if i % 4 else None if i % 8 else "b", i) for i in range(500)], "key string, n long").repartition(5)
    got = {(r["key"], r["n"]): r["at"] for r in store.ranked(rows, ["key"], ["n"], "at").collect()}
    for key in ("hot", "b", None):
        own = sorted(n for k, n in got if k == key)
        assert [got[key, n] for n in own] == list(range(1, len(own) + 1))


def test_versions_of_a_store(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path))
    assert kept.version("chunks_vec") == 0 and kept.read("chunks_vec").count() == 0
    for n in range(1, 12):
        kept.write("chunks_vec", spark.createDataFrame([(n, [1.0])], "chunk_id long, embedding array<float>"))
    assert kept.version("chunks_vec") == 11 and [r["chunk_id"] for r in kept.read("chunks_vec").collect()] == [11]
    (tmp_path / "chunks_vec" / "v=12").mkdir()  # of a writer that was lost before its pointer
    assert [r["chunk_id"] for r in kept.read("chunks_vec").collect()] == [11]


def test_nearest_by_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.random(3)]) for i in range(60)], "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id % 4 = 0")
    whole = sorted(map(tuple, search.nearest_to_rows(vectors, asked, 3).collect()))
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    assert sorted(map(tuple, search.nearest_to_rows(vectors, asked, 3).collect())) == whole and len(whole) == 45


def test_few_files_are_picked_again_and_again(spark):
    rows = spark.createDataFrame([("d/b", "b", "text", 1), ("c/a", "a", "text", None), ("x", "x", "code", 0)], "path string, name string, kind string, size long")
    assert [r["path"] for r in catalog.picked(rows, "text", 5).orderBy("slot").collect()] == ["c/a", "d/b", "c/a", "d/b", "c/a"]
    assert catalog.picked(rows, "image", 5).count() == 0
    assert catalog.picked_smallest(rows, "text").first()["path"] == "d/b" and catalog.picked_first(rows, "text").first()["path"] == "c/a"


# ---------------------------------------------------------------- injected callables


def test_generated_answers(spark):
    parts = spark.createDataFrame([("b", 1, 0, "text", "two"), ("a", 0, 1, "text", "y"), ("a", 0, 0, "text", "x"), ("b", 0, 0, "text", "one"), ("b", 2, 0, "text", "boom"), ("c", 0, 0, "text", "")], encoders.SCHEMA)

    def call(message):
        said = "".join(p["text"] for p in message)
        if said == "boom":
            raise RuntimeError("no answer")
        return said.upper(), len(said), 1

    got = {r["uri"]: r for r in generate.joined_answers(generate.answered(parts, call)).collect()}
    assert got["a"]["text"] == "XY" and (got["a"]["prompt_tokens"], got["a"]["completion_tokens"]) == (2, 1)
    assert got["b"]["text"] == "ONE\n\n---\n\nTWO" and got["b"]["errors"] == ["[LLM error: no answer]"]
    assert got["c"]["text"] == "" and got["c"]["errors"] == []
    answers = spark.createDataFrame([("a", 0, '[1, {"k": 2}]', 1, 1), ("a", 1, "3", 1, 1), ("a", 2, "no json", 1, 1), ("b", 0, None, 0, 0)], "uri string, message int, answer string, prompt_tokens bigint, completion_tokens bigint")
    merged = {r["uri"]: r["text"] for r in generate.joined_answers(answers, json_mode=True).collect()}
    assert merged == {"a": '[1, {"k": 2}, 3, "no json"]', "b": ""}
    assert generate.joined_answers(generate.answered(parts.limit(0), call), json_mode=True).count() == 0


def test_encoded_transform(spark):
    pages = spark.createDataFrame([("a", "p1\fp2\fp3")], "path string, text string")

    def transform(parts, about):
        return [{"text": f"{about['uri']} {about['pages_per_message']}"}, *({**p, "text": p["text"].upper()} for p in parts if p["message"] == 1)]

    got = encoders.encoded(pages, "document/page-text", {"pages_per_message": 2}, transform=transform).orderBy("message").collect()
    assert [tuple(r) for r in got] == [("a", 0, 0, "text", "a 2"), ("a", 1, 0, "text", "--- PAGE 3 ---\nP3")]


def test_transcription_registry(spark):
    loud = transcription.Backend("loud", lambda data, o: [(0.0, 1.5, data.decode() * o.get("times", 1))], lambda: False)
    transcription.register(loud)
    try:
        assert transcription.backends() == [("loud", False)] and transcription.chosen() is None and transcription.chosen("none") is None
        assert transcription.chosen("loud") is loud and transcription.chosen("loud", times=None) is loud
        files_ = spark.createDataFrame([("a", b"la"), ("b", None)], "path string, content binary")
        got = {r["path"]: [tuple(s) for s in r["segments"]] for r in transcription.transcribed(files_, transcription.chosen("loud", times=2)).collect()}
        assert got == {"a": [(0.0, 1.5, "lala")], "b": []}
        transcription.register(transcription.Backend(transcription.DEFAULT, loud.transcribe))
        assert transcription.chosen().name == transcription.DEFAULT
    finally:
        assert transcription.unregister("loud") and not transcription.unregister("loud")
        transcription.unregister(transcription.DEFAULT)


def test_index_missing(spark):
    files_ = spark.createDataFrame([("done", "x"), ("cut", "y"), ("new", "z" * 3000), ("empty", ""), ("null", None)], "uri string, text string")
    kept = spark.createDataFrame([(1, "done", 0, "x"), (2, "cut", 0, "y"), (3, "cut", 1, "bad")], "id bigint, file_uri string, chunk_idx int, chunk_text string")
    vectors = spark.createDataFrame([(1, [1.0])], "chunk_id bigint, embedding array<float>")

    def embed(texts):
        if "bad" in texts:
            raise ValueError("bad text")
        return [[float(len(t))] for t in texts]

    todo = search.missing_chunks(files_, kept, vectors)
    assert {(r["file_uri"], r["id"], r["chunk_idx"], len(r["chunk_text"])) for r in todo.collect()} == {("cut", 2, 0, 1), ("cut", 3, 1, 3), ("new", None, 0, 2048), ("new", None, 1, 1052)}
    made = search.embedded_partly(todo.coalesce(1), embed, delay=0)
    assert {(r["file_uri"], r["chunk_idx"]): (r["embedding"], r["error"]) for r in made.collect()} == {("cut", 0): ([1.0], None), ("cut", 1): (None, "bad text"), ("new", 0): ([2048.0], None), ("new", 1): ([1052.0], None)}
    assert {tuple(r) for r in search.indexed_files(made).collect()} == {("cut", 1, 1, False), ("new", 2, 0, True)}
    with pytest.raises(Exception, match="1 vectors for 2 texts"):
        search._embedded(["a", "b"], lambda texts: [[0.0]], 0)


def test_extract_by_kind(spark, tmp_path):
    picture = _png(np.arange(48, dtype=np.uint8).reshape(4, 4, 3), (0, 1, 2, 4))
    rows = [("a.py", "py", "code", b"x = 1\n"), ("b.txt", "txt", "text", b"\xff\xfe"), ("c.png", "png", "image", picture), ("d.pdf", "pdf", "document", b"%PDF-"), ("e", None, None, None), ("f.mp3", "mp3", "audio", b"")]
    got = {r["path"]: r for r in extract.extract(spark.createDataFrame(rows, "path string, ext string, kind string, content binary")).collect()}
    assert set(got) == {r[0] for r in rows}
    assert (got["a.py"]["line_count"], got["a.py"]["language"], got["a.py"]["dimensions"]) == (1, "python", None)
    assert got["b.txt"]["content_hash"] is None and got["b.txt"]["text_preview"] is None
    assert got["c.png"]["dimensions"] == "4x4" and len(got["c.png"]["phash"]) == 16
    assert got["d.pdf"]["content_hash"] == hashlib.sha256(b"%PDF-").hexdigest() and got["e"]["content_hash"] == hashlib.sha256(b"").hexdigest()


def _png(rgb, filters):
    """A PNG of 8-bit RGB rows, each written with its own filter."""
    height, width, _ = rgb.shape
    rows = rgb.reshape(height, -1).astype(int)
    raw = b""
    for y in range(height):
        up = rows[y - 1] if y else np.zeros_like(rows[0])
        left, corner = np.r_[[0, 0, 0], rows[y][:-3]], np.r_[[0, 0, 0], up[:-3]]
        base = left + up - corner
        nearest = [min((a, b, c), key=lambda v: abs(p - v)) for a, b, c, p in zip(left, up, corner, base)]
        guess = (0, left, up, (left + up) // 2, np.array(nearest))[filters[y]]
        raw += bytes([filters[y], *((rows[y] - guess) % 256).tolist()])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_pixels():
    rgb = np.random.default_rng(1).integers(0, 256, (10, 7, 3), np.uint8)
    want = rgb @ np.array([0.299, 0.587, 0.114])
    assert np.allclose(pixels.grey(_png(rgb, [0, 1, 2, 3, 4] * 2)), want)
    lines = b"".join(row[:, ::-1].tobytes() + b"\0" * 3 for row in rgb[::-1])
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(lines), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 7, 10, 1, 24, 0, len(lines), 0, 0, 0, 0) + lines
    assert np.allclose(pixels.grey(bmp), want)
    for broken in (b"", b"BM", bmp[:80], _png(rgb, [0] * 10)[:60], b"GIF89a"):
        assert pixels.grey(broken) is None


def test_context_renderings(spark):
    items = spark.createDataFrame([(1, "img_000002", "user", "image", "a|b.png", None, "a\nnote", None, [("w", "3"), ("h", "4")]), (0, "txt_000001", "system", "text", "s" * 90, "x" * 200, None, None, None)], "pos int, ref_id string, role string, kind string, source string, content string, note string, summary string, metadata array<struct<k: string, v: string>>")
    table = sinks.context_table(items, "s1")
    assert table.split("\n")[:4] == ["Context(session=s1, items=2)", "", "| ref | role | kind | source |", "|-----|------|------|--------|"]
    assert table.split("\n")[5] == "| img_000002 | user | image | a\\|b.png |"
    assert sinks.context_table(items.limit(0), "s1") == "Context(session=s1, items=0)\n\n"
    full = sinks.context_table(items, "s1", contents=True).split("\n")
    assert full[2].endswith(f"| {'x' * 119}… |") and full[3].endswith("| a note |")
    assert sinks.context_tree(items, "s1") == f"Context(session=s1, items=2)\n├── [1] txt_000001  system  text  {'s' * 79}…\n└── [2] img_000002  user  image  a|b.png\n         ├─ w: 3\n         └─ h: 4\n"
    refs = spark.createDataFrame([("a|b.png", "img_000002")], "path string, ref_id string")
    assert sinks.to_pandas(items.select(F.col("source").alias("path")).orderBy("pos"), refs, "s1")["ref_id"].notna().sum() == 1
    assert sinks.to_arrow(items).num_rows == 2
