"""Queries over the provided tables, one for each operator, and SQL that says what they return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lineage, schema
from .functions import ids, media, text
from .operators import accounting, buckets, catalog, chunks, context, dedup, editjoin, medians, memo, metric, scenes, search, sift, store, trigrams
from .plans import dispatch, media_plans, sqlview, strategy, table_function
from .sources import extract, files, sinks
from .streaming import ingest, watch

QUERIES, ORACLE_SQL = {}, {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and pages as one files table."""
    names = ["path", "name", "stem", "ext", "parent", "depth", "kind", "mime", "is_binary", "size", "text"]
    return files.from_documents(table(spark, sf_dir, "documents")).select(*names).unionByName(files.from_pages(table(spark, sf_dir, "pages")).select(*names))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.from_documents(table(spark, sf_dir, "documents"))


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("/corpus/"), "path").alias("file_uri"), F.lit("fast").alias("mode"), "text")
    return chunks.chunked(rows)


DOC = "SELECT doc_id, concat_ws('/', coalesce(source, 'unknown'), coalesce(lang, 'und'), doc_id || '.txt') AS path, strlen(text) AS size, text, source, lang FROM documents"
PAGE = "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/' || page_id || '.html' AS path, strlen(html) AS size, html AS text FROM pages"
LINES = "(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END)"
CHUNKS = f"""d AS ({DOC}), c AS (SELECT doc_id, path, i AS chunk_idx, substr(text, i * 1948 + 1, 2048) AS chunk_text FROM
  (SELECT doc_id, path, text, unnest(generate_series(0, CASE WHEN length(text) <= 2048 THEN 0 ELSE CAST(ceil((length(text) - 2048) / 1948.0) AS BIGINT) END)) AS i FROM d WHERE length(text) > 0))"""
FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# ---------------------------------------------------------------- catalog


@query(f"""WITH f AS (SELECT 'text' AS kind, size FROM ({DOC}) UNION ALL SELECT 'other', size FROM ({PAGE}))
SELECT kind, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(size // 4) AS BIGINT) AS tokens FROM f GROUP BY kind""")
def catalog_by_kind(spark, d):
    return corpus(spark, d).groupBy("kind").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum(text.byte_tokens(F.col("text"))).alias("tokens"))


@query(f"SELECT path, 'text' AS kind, size FROM ({DOC}) WHERE size >= 4096 AND size <= 20480 ORDER BY size DESC, path DESC LIMIT 50")
def find_filter_sort_limit(spark, d):
    return catalog.find(documents(spark, d), kind="text, code", min_size="4KB", max_size="20kb", sort="size", descending=True, limit=50, columns=["path", "kind", "size"])


@query(f"SELECT path FROM ({DOC}) WHERE regexp_matches(doc_id || '.txt', '^1[0-9]*5\\.')")
def find_name_regex(spark, d):
    return catalog.find(documents(spark, d), name=r"^1[0-9]*5\.", columns=["path"])


@query(f"SELECT path FROM ({DOC}) WHERE contains('[' || doc_id || '].txt', '[7')")
def find_name_substring(spark, d):
    """No regular expression, and so a part of the name."""
    named = documents(spark, d).withColumn("name", F.concat(F.lit("["), "doc_id", F.lit("].txt")))
    return catalog.find(named, name="[7", columns=["path"])


FILES = f"SELECT *, doc_id || '.txt' AS name FROM ({DOC})"


@query(f"SELECT path, size FROM ({FILES}) ORDER BY size, path LIMIT 1")
def pick_smallest(spark, d):
    return catalog.picked_smallest(documents(spark, d), "text").select("path", "size")


@query(f"""WITH f AS (SELECT path, row_number() OVER (ORDER BY name, path) - 1 AS pos, count(*) OVER () AS m FROM ({FILES}))
SELECT CAST(i AS INTEGER) AS slot, path FROM f JOIN range(7) r(i) ON pos = CASE WHEN m >= 7 THEN i * m // 7 ELSE i % m END""")
def pick_files(spark, d):
    return catalog.picked(documents(spark, d), "text", 7)


@query(f"SELECT path, size, CASE WHEN doc_id % 3 < 2 THEN 'scan' ELSE 'pipe' END AS origin FROM ({DOC})")
def merge_paths(spark, d):
    rows = documents(spark, d).select("doc_id", "path", "size")
    scanned, piped = rows.where("doc_id % 3 < 2").withColumn("origin", F.lit("scan")), rows.where("doc_id % 3 > 0").withColumn("origin", F.lit("pipe"))
    return catalog.merged_paths(scanned.drop("doc_id"), piped.unionByName(piped).drop("doc_id"))


@query(f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM ({DOC})), m AS (SELECT doc_id, CASE WHEN a[len(a)] = '' THEN a[1 : len(a) - 1] ELSE a END AS a FROM l)
SELECT doc_id, array_to_string(a[1:3], chr(10)) AS head, array_to_string(a[greatest(1, len(a) - 1) : len(a)], chr(10)) AS tail FROM m""")
def head_tail(spark, d):
    return documents(spark, d).select("doc_id", text.some_lines(F.col("text"), 3).alias("head"), text.some_lines(F.col("text"), -2).alias("tail"))


@query(f"SELECT path, size FROM ({DOC}) WHERE path LIKE 'src1/%'")
def find_in_scope(spark, d):
    return catalog.in_scope(documents(spark, d), "src1", column="path").select("path", "size")


@query(f"SELECT path FROM ({DOC}) WHERE doc_id IN (1, 2, 3, 5, 8)")
def find_piped_paths(spark, d):
    known = documents(spark, d).where(F.col("doc_id").isin(1, 2, 3, 5, 8)).select("path")
    listed = "path\tsize\n" + "\n".join(f"7\t{r['path']}" for r in known.collect())  # the five piped paths
    return files.restricted(documents(spark, d), files.piped_paths(listed)).select("path")


@query(f"""SELECT path, doc_id || '.txt' AS name, CAST(doc_id AS VARCHAR) AS stem, '.txt' AS ext, coalesce(source, 'unknown') || '/' || coalesce(lang, 'und') AS parent, 2 AS depth, 'text' AS kind, 'text/plain' AS mime, FALSE AS is_binary FROM ({DOC})
UNION ALL SELECT path, page_id || '.html', CAST(page_id AS VARCHAR), '.html', regexp_extract(path, '^(.*)/[^/]*$', 1), 1, 'other', 'text/html', FALSE FROM ({PAGE})""")
def path_parts(spark, d):
    return corpus(spark, d).select("path", "name", "stem", "ext", "parent", "depth", "kind", "mime", "is_binary")


EXTENSIONS = (".py", ".PNG", ".toml", ".csv", ".tex", ".raw", ".html", ".zip", ".parquet", "")


@query("""SELECT p_partkey, e AS ext, k AS kind, b AS is_binary, m AS media_kind, l AS language FROM part JOIN (VALUES
 (0, '.py', 'code', FALSE, 'code', 'python'), (1, '.PNG', 'image', TRUE, 'image', NULL), (2, '.toml', 'config', FALSE, 'code', 'toml'), (3, '.csv', 'data', FALSE, 'text', NULL),
 (4, '.tex', 'document', FALSE, 'text', NULL), (5, '.raw', 'image', TRUE, 'text', NULL), (6, '.html', 'other', FALSE, 'text', 'html'), (7, '.zip', 'other', TRUE, 'text', NULL), (8, '.parquet', 'data', TRUE, 'text', NULL), (9, '', 'other', FALSE, 'text', NULL)) t(i, e, k, b, m, l) ON p_partkey % 10 = i""")
def classify_extensions(spark, d):
    """parts as files whose extensions go by their key."""
    name = F.concat("p_name", F.get(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % 10).cast("int")))
    rows = table(spark, d, "part").select("p_partkey", files.path_parts(name)["ext"].alias("ext"))
    ext = F.col("ext")
    return rows.select("p_partkey", "ext", files.kind_of(ext).alias("kind"), files.is_binary(ext).alias("is_binary"), files.media_kind_of(ext, True).alias("media_kind"), files.language_of(ext).alias("language"))


@query(f"""WITH d AS ({DOC}), p AS (SELECT '' AS dir, size FROM d UNION ALL SELECT coalesce(source, 'unknown'), size FROM d UNION ALL SELECT coalesce(source, 'unknown') || '/' || coalesce(lang, 'und'), size FROM d)
SELECT dir, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM p GROUP BY dir""")
def tree_rollup(spark, d):
    return catalog.rollup(documents(spark, d))


@query(f"WITH f AS (SELECT '.txt' AS ext FROM ({DOC}) UNION ALL SELECT '.html' FROM ({PAGE})) SELECT ext, count(*) AS files FROM f GROUP BY ext ORDER BY files DESC, ext LIMIT 5")
def info_top_ext(spark, d):
    return catalog.info(corpus(spark, d))["extensions"]


@query(f"SELECT path FROM ({PAGE}) EXCEPT SELECT path FROM ({PAGE}) WHERE page_id % 3 = 0")
def unindexed_diff(spark, d):
    pages = files.from_pages(table(spark, d, "pages")).withColumnRenamed("path", "uri")
    return catalog.unindexed(pages, pages.where("page_id % 3 = 0")).withColumnRenamed("uri", "path")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def prune_candidates(spark, d):
    stored, disk = (table(spark, d, x).select(F.col("doc_id").alias("uri")) for x in ("documents", "labels"))
    return catalog.prune_candidates(stored, disk).withColumnRenamed("uri", "doc_id")


@query("SELECT o_orderkey AS uri FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0")
def stale_files(spark, d):
    now = table(spark, d, "orders").select(F.col("o_orderkey").alias("uri"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("modified"), F.floor("o_totalprice").alias("size"))
    known = now.where("uri % 13 <> 0").withColumn("modified", F.when(F.col("uri") % 7 == 0, F.col("modified") + 1).otherwise(F.col("modified"))).withColumn("size", F.when(F.col("uri") % 11 == 0, F.lit(None)).otherwise(F.col("size")))
    return catalog.stale(now, known)


@query(f"""WITH e AS (SELECT coalesce(source, 'unknown') || '/' || coalesce(lang, 'und') AS dir, sha256(path || ':' || doc_id || ':' || size) AS h FROM ({DOC})),
p AS (SELECT dir, left(h, 2) AS part, sha256(string_agg(h, '' ORDER BY h)) AS h FROM e GROUP BY dir, left(h, 2))
SELECT dir, sha256(string_agg(h, '' ORDER BY part)) AS dir_hash FROM p GROUP BY dir""")
def ancestor_dir_hash(spark, d):
    return catalog.directory_hash(documents(spark, d).withColumn("modified", F.col("doc_id")))


@query(f"SELECT path || chr(9) || size || chr(9) || printf('%.2f', size / 1024.0) AS line FROM ({DOC})")
def render_lines(spark, d):
    return sinks.joined_rows(documents(spark, d).select("path", "size", (F.col("size") / 1024.0).alias("kb")))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS shown FROM events")
def render_json(spark, d):
    rows = sinks.json_rows(table(spark, d, "events").select("event_id", "ts"))
    return rows.select(F.get_json_object("json", "$.event_id").cast("bigint").alias("event_id"), F.get_json_object("json", "$.ts").alias("shown"))


# ---------------------------------------------------------------- accounting


@query(f"""WITH f AS (SELECT 'text' AS kind, size, text FROM ({DOC}) UNION ALL SELECT 'other', size, text FROM ({PAGE})),
m AS (SELECT kind, size, {LINES} AS lines, size // 4 AS tokens FROM f),
s AS (SELECT kind, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(tokens) AS BIGINT) AS tokens FROM m GROUP BY ROLLUP (kind))
SELECT *, CAST(round_even(tokens / (bytes / 1048576.0), 0) AS BIGINT) AS tok_per_mb, CAST(NULL AS BIGINT) AS tok_per_img FROM s""")
def wc_by_kind_rollup(spark, d):
    return accounting.wc(corpus(spark, d))


@query(f"""SELECT doc_id, CAST({LINES} AS BIGINT) AS lines, CAST(greatest(1, {LINES}) AS BIGINT) AS document_lines, CAST(greatest(1, length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS piped_lines,
 CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS words, CAST(strlen(text) // 4 AS BIGINT) AS byte_tokens, CAST(length(text) // 4 AS BIGINT) AS char_tokens FROM ({DOC})""")
def line_word_counts(spark, d):
    t = F.col("text")
    return documents(spark, d).select("doc_id", text.line_count(t).alias("lines"), text.document_line_count(t).alias("document_lines"), text.piped_line_count(t, F.lit("text")).alias("piped_lines"), text.word_count(t).alias("words"), text.byte_tokens(t).alias("byte_tokens"), text.char_tokens(t).alias("char_tokens"))


@query("""SELECT p_partkey, CAST(CASE WHEN p_size % 10 = 0 THEN 85 ELSE 85 + 170 * ceil(p_size * 64 / 512.0) * ceil((p_partkey % 3000 + 1) / 512.0) END AS BIGINT) AS tokens FROM part""")
def image_tokens(spark, d):
    width = F.when(F.col("p_size") % 10 != 0, F.col("p_size") * 64)
    return table(spark, d, "part").select("p_partkey", media.image_tokens(width, F.col("p_partkey") % 3000 + 1).alias("tokens"))


@query("""WITH t AS (SELECT event_type AS name, value AS ms FROM events) SELECT name, count(*) AS rounds, round(avg(ms), 6) AS mean_ms, round(coalesce(stddev_samp(ms), 0), 6) AS std_ms, min(ms) AS min_ms, max(ms) AS max_ms, round(median(ms), 6) AS median_ms FROM t GROUP BY name""")
def bench_stats(spark, d):
    stats = accounting.timing_stats(table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("value").alias("ms")))
    return stats.select("name", "rounds", *(F.round(x, 6).alias(x) for x in ("mean_ms", "std_ms")), "min_ms", "max_ms", F.round("median_ms", 6).alias("median_ms"))


@query("SELECT event_type, user_id % 7 AS slot, round(median(value), 9) AS median FROM events GROUP BY ALL")
def exact_medians(spark, d):
    events = table(spark, d, "events").withColumn("slot", F.col("user_id") % 7)
    return medians.exact_medians(events, ["event_type", "slot"], "value").withColumn("median", F.round("median", 9))


@query("""SELECT o_orderpriority AS model, count(*) AS calls, CAST(sum(o_custkey) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(nullif(o_orderkey % 5, 0)), 0) AS BIGINT) AS completion_tokens,
 CAST(sum(o_custkey) + coalesce(sum(nullif(o_orderkey % 5, 0)), 0) AS BIGINT) AS total_tokens FROM orders GROUP BY 1""")
def token_usage(spark, d):
    calls = table(spark, d, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("prompt_tokens"), F.nullif(F.col("o_orderkey") % 5, F.lit(0)).alias("completion_tokens"))
    return accounting.token_usage(calls)


@query("""SELECT 'documents' AS name, (SELECT count(*) FROM documents) AS rows UNION ALL SELECT 'labels', (SELECT count(*) FROM labels)""")
def list_tables(spark, d):
    return accounting.table_counts({x: table(spark, d, x) for x in ("documents", "labels")})


# ---------------------------------------------------------------- chunks and store


@query(f"WITH {CHUNKS} SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, chunk_text FROM c")
def chunk_documents(spark, d):
    return stored_chunks(spark, d).select("doc_id", "chunk_idx", "chunk_text")


@query("SELECT doc_id, text FROM documents WHERE length(text) > 0")
def reassemble_identity(spark, d):
    return chunks.reassembled(stored_chunks(spark, d), ["doc_id"])


@query(f"WITH {CHUNKS}, t AS (SELECT 'metadata' AS mode, chunk_text FROM c UNION ALL SELECT 'fast', left(text, 500) FROM d WHERE length(text) > 0) SELECT mode, count(*) AS chunks, CAST(sum(length(chunk_text)) AS BIGINT) AS chars FROM t GROUP BY mode")
def chunk_tier_stats(spark, d):
    own = stored_chunks(spark, d).drop("mode")
    output = chunks.chunked(documents(spark, d).select("doc_id", F.concat(F.lit("/corpus/"), "path").alias("file_uri"), F.lit("fast").alias("mode"), text.preview(F.col("text")).alias("text")))
    tiers = chunks.tiered(own, output.select(*own.columns, "mode"))
    return tiers.groupBy("mode").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk_text")).cast("bigint").alias("chars"))


@query(f"SELECT doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 4 AS INTEGER) AS batch FROM ({DOC})")
def page_batches(spark, d):
    return chunks.batches(table(spark, d, "documents").select("doc_id", "source"), ["source"], "doc_id", 4).select("doc_id", "batch")


SESSIONS = f"SELECT '/corpus/' || path AS uri, size, 'sess_' || coalesce(source, '') AS session_id, 'txt_' || doc_id AS ref_id, doc_id FROM ({DOC})"


def _session_files(spark, d):
    rows = documents(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return rows.select(F.concat(F.lit("/corpus/"), "path").alias("uri"), "size", F.concat(F.lit("sess_"), F.coalesce("source", F.lit(""))).alias("session_id"), F.concat(F.lit("txt_"), "doc_id").alias("ref_id"), "doc_id")


@query(f"SELECT uri, ref_id FROM ({SESSIONS}) WHERE session_id = 'sess_src1'")
def session_files(spark, d):
    return store.session_files(_session_files(spark, d), "sess_src1").select("uri", "ref_id")


@query(f"SELECT uri, size FROM ({SESSIONS}) WHERE doc_id = 7")
def lookup_by_ref(spark, d):
    rows = _session_files(spark, d)
    one = rows.where("doc_id = 7").first()  # one row
    found = store.by_ref(rows, one["session_id"], one["ref_id"])
    return store.by_uri(found, one["uri"]).select("uri", "size")


@query(f"SELECT uri, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN -1 ELSE size END AS size FROM ({SESSIONS}) WHERE doc_id IN (SELECT doc_id FROM labels) OR doc_id % 10 = 0")
def ensure_metadata(spark, d):
    scanned = _session_files(spark, d).select("uri", "size", "doc_id")
    stored = scanned.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("uri", F.lit(-1).cast("bigint").alias("size"))
    return store.ensured(stored, scanned, scanned.where("doc_id % 10 = 0").select("uri"))


@query(f"""WITH {CHUNKS} SELECT '/corpus/' || path AS file_uri, CAST(chunk_idx AS INTEGER) AS chunk_idx, chunk_text, CAST(NULL AS VARCHAR) AS extraction_id FROM c WHERE doc_id % 4 = 0
UNION ALL SELECT '/corpus/' || path, 0, 'old', NULL FROM d WHERE doc_id % 2 = 0 AND doc_id % 4 <> 0 UNION ALL SELECT '/corpus/' || path, 0, 'out', 'e' FROM d WHERE doc_id % 3 = 0""")
def orphan_text_chunks(spark, d):
    rows = documents(spark, d).select("doc_id", F.concat(F.lit("/corpus/"), "path").alias("file_uri"), F.col("doc_id").cast("string").alias("content_hash"), F.col("text").alias("content"), F.lit(0).cast("bigint").alias("created_at"))
    made = lambda base, extraction, mode, said: ((F.col("doc_id") + base).alias("id"), F.lit(extraction).cast("string").alias("extraction_id"), "file_uri", "content_hash", F.lit("").alias("profile"), F.lit("").alias("model"), F.lit(mode).alias("mode"), F.lit(0).alias("chunk_idx"), F.lit(said).alias("chunk_text"), "created_at")
    known = rows.where("doc_id % 2 = 0").select(*made(0, None, "metadata", "old")).unionByName(rows.where("doc_id % 3 = 0").select(*made(10**9, "e", "fast", "out")))
    vectors = known.select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    out, _ = store.text_chunks(known, vectors, rows.where("doc_id % 4 = 0").drop("doc_id"))
    return out.select("file_uri", "chunk_idx", "chunk_text", "extraction_id")


@query(f"SELECT doc_id, left(sha256(concat_ws(':', sha256(text), 'default', 'none', 'fast', CASE WHEN doc_id % 2 = 0 THEN 'True' ELSE 'False' END, '')), 24) AS id FROM ({DOC})")
def extraction_id(spark, d):
    return documents(spark, d).select("doc_id", ids.extraction_id(ids.content_hash(F.col("text")), F.lit("default"), F.lit("none"), F.lit("fast"), F.col("doc_id") % 2 == 0, F.lit("")).alias("id"))


@query("""SELECT d.doc_id AS uri, d.n_chars AS size, CASE WHEN l.doc_id IS NOT NULL THEN 'old ' || l.quality END AS text_preview, CASE WHEN l.doc_id IS NULL THEN 's2' WHEN l.quality = 1 THEN 's2' ELSE 's2' END AS session_id,
 CASE WHEN l.doc_id IS NOT NULL AND l.quality = 1 THEN 'old_ref' ELSE 'new_ref' END AS ref_id FROM documents d LEFT JOIN labels l USING (doc_id)""")
def upsert_preserve(spark, d):
    quality = F.when(F.col("quality") == 1, "s2").otherwise("s1")
    old = table(spark, d, "labels").select(F.col("doc_id").alias("uri"), F.lit(0).cast("bigint").alias("size"), F.concat(F.lit("old "), "quality").alias("text_preview"), quality.alias("session_id"), F.lit("old_ref").alias("ref_id"))
    new = table(spark, d, "documents").select(F.col("doc_id").alias("uri"), F.col("n_chars").alias("size"), F.lit("s2").alias("session_id"), F.lit("new_ref").alias("ref_id"))
    return store.upserted(old, new)


@query(f"WITH {CHUNKS}, g AS (SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) SELECT 'files' AS name, count(*) AS rows FROM d WHERE doc_id NOT IN (SELECT doc_id FROM g) UNION ALL SELECT 'chunks', count(*) FROM c WHERE doc_id NOT IN (SELECT doc_id FROM g) UNION ALL SELECT 'chunks_vec', count(*) FROM c WHERE doc_id NOT IN (SELECT doc_id FROM g) UNION ALL SELECT 'extractions', count(*) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM g)")
def cascade_delete(spark, d):
    own = stored_chunks(spark, d).withColumn("id", F.concat_ws("#", "file_uri", "chunk_idx"))
    docs = documents(spark, d).select(F.concat(F.lit("/corpus/"), "path").alias("uri"), "doc_id")
    gone = docs.join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi").select("uri")
    kept = store.cascaded(docs, docs.withColumnRenamed("uri", "file_uri"), own, own.select(F.col("id").alias("chunk_id")), gone)
    return accounting.table_counts(dict(zip(("files", "extractions", "chunks", "chunks_vec"), kept, strict=True)))


@query("SELECT sha256(text) AS content_hash, max_by(doc_id || ' ' || left(text, 20), doc_id) AS text_preview FROM documents GROUP BY 1")
def latest_content(spark, d):
    rows = table(spark, d, "documents").select(F.sha2("text", 256).alias("content_hash"), F.concat_ws(" ", "doc_id", F.left("text", F.lit(20))).alias("text_preview"), F.col("doc_id").alias("content_indexed_at"), F.col("doc_id").alias("uri"))
    return store.latest_content(rows)


@query(f"SELECT doc_id FROM ({DOC}) WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def cache_misses(spark, d):
    docs = documents(spark, d).select("doc_id", ids.content_hash(F.col("text")).alias("id"))
    return store.misses(docs, docs.where("doc_id % 2 = 0")).select("doc_id")


@query(f"""SELECT path, sha256(text) AS content_hash, left(text, 500) AS text_preview, CAST({LINES} AS BIGINT) AS line_count, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS word_count, CAST(NULL AS VARCHAR) AS language FROM ({DOC})""")
def extract_text(spark, d):
    return extract.extract_text(documents(spark, d))


# ---------------------------------------------------------------- versions, dispatch


@query("""WITH l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id)
SELECT doc_id, CASE WHEN quality = 0 THEN 'gone' ELSE 'changed' END AS change, d.lang AS before_lang, CASE WHEN quality = 0 THEN NULL ELSE 'toxic' END AS after_lang, n_chars
FROM documents d JOIN l USING (doc_id) WHERE quality = 0 OR (toxic = 1 AND lang IS DISTINCT FROM 'toxic')
UNION ALL SELECT -1 - item_id, 'added', NULL, 'item', length(text) FROM benchmark""")
def store_change_feed(spark, d):
    """documents as version 1, toxic ones relabelled and benchmark items added as 2, those of low quality removed as 3: what differs between 1 and 3."""
    docs, labels = table(spark, d, "documents").select("doc_id", "lang", "n_chars"), table(spark, d, "labels")
    folder = lineage.scratch(spark, "versions")
    kept = buckets.Buckets(spark, folder, {"documents": buckets.Table(docs.schema, "doc_id", "doc_id")}, buckets=32)
    kept.write("documents", docs)
    relabelled = docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi").withColumn("lang", F.lit("toxic"))
    items = table(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), F.lit("item").alias("lang"), F.length("text").cast("bigint").alias("n_chars"))
    kept.put("documents", relabelled.unionByName(items))
    kept.remove("documents", labels.where("quality = 0").select("doc_id"))
    feed = kept.changes("documents", 1).select("doc_id", "change", F.col("before.lang").alias("before_lang"), F.col("after.lang").alias("after_lang"), F.coalesce("after.n_chars", "before.n_chars").alias("n_chars"))
    found = lineage.cut(feed)
    lineage.removed(spark, folder)
    return found


def _stored_corpus(spark, d, folder):
    """documents as stored files with their texts, and a request for each."""
    rows = documents(spark, d).where("text IS NOT NULL").withColumns({"uri": F.concat(F.lit("/corpus/"), "path"), "content_hash": ids.content_hash(F.col("text")), "text_preview": F.col("text"), "content_indexed_at": F.lit(1)})
    fill = {"string": F.lit(""), "bigint": F.lit(0), "int": F.lit(0)}
    columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None) if f.nullable else fill[f.dataType.simpleString()]).cast(f.dataType).alias(f.name) for f in schema.STORED]
    kept = store.Store(spark, folder, buckets=16)
    kept.upsert_files(rows.select(*columns))
    requests = rows.select(F.col("doc_id").alias("position"), F.col("uri").alias("file_uri"), "content_hash", F.lit("default").alias("profile"), F.lit("none").alias("model"), F.lit("fast").alias("mode"), F.lit("").alias("extra"), F.lit(0).cast("bigint").alias("created_at"))
    # A request's position is its document's id; rows that repeat an id and a text give one output.
    texts = rows.select(F.col("doc_id").alias("position"), "content_hash", "text")
    by = ["position", "content_hash"]
    compute = lambda asked: asked.join(sift.sifted(texts, asked, ["position"]), by).dropDuplicates([*by, "id"]).select(*asked.columns, F.concat(F.lit("n="), F.length("text"), F.lit(" "), "text").alias("output"))
    return kept, requests, compute


@query("SELECT doc_id, sha256('n=' || length(text) || ' ' || text) AS output_hash, text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) AS cached FROM documents WHERE text IS NOT NULL")
def cached_dispatch(spark, d):
    """Every other document is asked for first, then all: whose output was stored by then."""
    folder = lineage.scratch(spark, "dispatch")
    kept, requests, compute = _stored_corpus(spark, d, folder)
    dispatch.dispatched(kept, requests.where("position % 2 = 0"), compute)
    found = lineage.cut(dispatch.dispatched(kept, requests, compute, shown=lambda x: F.sha2(x, 256)).select(F.col("position").alias("doc_id"), F.col("output").alias("output_hash"), "cached"))
    lineage.removed(spark, folder)
    return found


@query("""WITH t AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL), n AS (SELECT 'metadata' AS mode, length(text) AS n FROM t UNION ALL SELECT 'fast', length('n=' || length(text) || ' ' || text) FROM t)
SELECT mode, CAST(sum(CASE WHEN n = 0 THEN 0 WHEN n <= 2048 THEN 1 ELSE ceil((n - 2048) / 1948.0) + 1 END) AS BIGINT) AS chunks, CAST(count(*) FILTER (n > 0) AS BIGINT) AS extractions, CAST(sum(CASE WHEN n > 2048 THEN n + 100 * ceil((n - 2048) / 1948.0) ELSE n END) AS BIGINT) AS chars FROM n GROUP BY mode""")
def stored_tiers(spark, d):
    """Chunks of both tiers that a dispatch of all documents stores: each content once."""
    folder = lineage.scratch(spark, "tiers")
    kept, requests, compute = _stored_corpus(spark, d, folder)
    dispatch.dispatched(kept, requests, compute)
    rows = kept.read("chunks").groupBy("mode").agg(F.count("*").alias("chunks"), F.count_distinct("extraction_id").alias("extractions"), F.sum(F.length("chunk_text")).cast("bigint").alias("chars"))
    found = lineage.cut(rows)
    lineage.removed(spark, folder)
    return found


@query(f"""WITH {CHUNKS}, p AS (SELECT '/corpus/' || path AS uri, chunk_idx // 4 AS message, chunk_idx, '--- Page ' || (chunk_idx + 1) || ' ---' || chr(10) || chunk_text AS said FROM c)
SELECT uri, CAST(message AS INTEGER) AS message, 0 AS part, 'text' AS type, sha256(string_agg(said, chr(10) || chr(10) ORDER BY chunk_idx)) AS text_hash FROM p GROUP BY uri, message""")
def encode_sql_pages(spark, d):
    """Documents' chunks as pages, four to a message, by the table function."""
    table_function.register(spark)
    pages = stored_chunks(spark, d).select(F.col("file_uri").alias("uri"), F.col("chunk_idx").alias("ordinal"), F.col("chunk_text").alias("data"))
    return sqlview.sql(spark, "SELECT uri, message, part, type, sha2(text, 256) AS text_hash FROM encode_by(TABLE(pages) PARTITION BY (uri) ORDER BY (ordinal), 'document/pages', map('pages_per_message', '4'))", {"pages": pages})


@query("""WITH u AS (SELECT user_id AS k, max(ts) AS used FROM events GROUP BY 1), r AS (SELECT doc_id, coalesce(n_chars, 0) AS bytes, used, sum(coalesce(n_chars, 0)) OVER (ORDER BY used DESC NULLS LAST, lpad(CAST(doc_id AS VARCHAR), 12, '0') ROWS UNBOUNDED PRECEDING) AS total FROM documents LEFT JOIN u ON k = doc_id)
SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS cache_key, bytes, used, CAST(total AS BIGINT) AS total FROM r WHERE total > (SELECT sum(n_chars) // 2 FROM documents)""")
def memo_evictions(spark, d):
    """documents as kept results, events as their uses, half of all bytes as the budget."""
    docs = table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("cache_key"), F.col("n_chars").alias("bytes"))
    uses = table(spark, d, "events").select(F.lpad(F.col("user_id").cast("string"), 12, "0").alias("cache_key"), F.col("ts").alias("used"))
    budget = docs.agg(F.sum("bytes")).first()[0] // 2
    return memo.evictions(docs, uses, budget).select("cache_key", "bytes", "used", "total")


@query("""WITH RECURSIVE f AS (SELECT event_type AS video, event_id AS frame, value AS difference FROM events), b AS (SELECT video, min(frame) AS first, max(frame) + 1 AS past FROM f GROUP BY video),
c AS (SELECT video, first AS frame FROM b UNION ALL SELECT c.video, (SELECT min(f.frame) FROM f WHERE f.video = c.video AND f.frame >= c.frame + 200 AND f.difference >= 75) FROM c WHERE c.frame IS NOT NULL),
k AS (SELECT * FROM c WHERE frame IS NOT NULL)
SELECT k.video, k.frame AS start, coalesce(lead(k.frame) OVER (PARTITION BY k.video ORDER BY k.frame), b.past) AS "end" FROM k JOIN b USING (video)""")
def scene_cuts(spark, d):
    """events as frames, by type, with their values as differences: cuts from 75 on, at least 200 frames apart."""
    frames = table(spark, d, "events").select(F.col("event_type").alias("video"), F.col("event_id").alias("frame"), F.col("value").alias("difference"))
    return scenes.scenes(frames, threshold=75, shortest=200)


# ---------------------------------------------------------------- duplicates


@query("SELECT content_hash, n, doc_id FROM (SELECT sha256(text) AS content_hash, doc_id, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 1")
def exact_duplicates(spark, d):
    return dedup.duplicate_members(table(spark, d, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id"), key="doc_id")


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark, d):
    return dedup.exact_duplicates(table(spark, d, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id"), key="doc_id")


_COUNTED = [f"CAST(('0x' || left(md5(CAST((length(text) - length(replace(text, '{c}', ''))) // 4 AS VARCHAR)), 4)) AS BIGINT)" for c in "aenr"]


@query(f"""WITH h AS (SELECT h, min(doc_id) AS k FROM (SELECT doc_id, {_COUNTED[0]} + {_COUNTED[1]} * 65536 + {_COUNTED[2]} * 4294967296 + ({_COUNTED[3]} - 32768) * 281474976710656 AS h FROM documents WHERE text IS NOT NULL) GROUP BY h)
SELECT a.k AS a, b.k AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM h a JOIN h b ON a.k < b.k AND bit_count(xor(a.h, b.h)) < 8""")
def hamming_near_dups(spark, d):
    """Stands in for hashes of media: 16 bits for the number of each of four letters in the whole text."""
    parts = []
    for c in "aenr":
        n = F.floor((F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))) / 4).cast("bigint")
        parts.append(F.conv(F.left(F.md5(n.cast("string").cast("binary")), F.lit(4)), 16, 10).cast("bigint"))
    whole = parts[0] + parts[1] * 65536 + parts[2] * 4294967296 + (parts[3] - 32768) * 281474976710656
    return dedup.hamming_pairs(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", whole.alias("phash")), "doc_id")


# ---------------------------------------------------------------- search


@query(f"""SELECT path, CAST(i AS INTEGER) AS line_number, line FROM (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM ({DOC})) WHERE regexp_matches(line, '(?i)licensed? +under')""")
def grep_regex_lines(spark, d):
    return search.grep(documents(spark, d), "licensed? +under")


@query(f"""WITH l AS (SELECT path, string_split(text, chr(10)) AS a FROM ({DOC})), m AS (SELECT path, CASE WHEN a[len(a)] = '' THEN a[1 : len(a) - 1] ELSE a END AS a FROM l),
e AS (SELECT path, a, unnest(range(1, len(a) + 1)) AS i FROM m) SELECT path, CAST(i AS INTEGER) AS line_number, a[i] AS line, array_to_string(a[greatest(1, i - 2) : i + 2], chr(10)) AS around FROM e WHERE regexp_matches(a[i], 'Apache')""")
def grep_context_lines(spark, d):
    found = search.grep(documents(spark, d), "Apache", context=2)
    return found.select("path", "line_number", "line", F.array_join("context", "\n").alias("around"))


@query(f"""SELECT path, count(*) AS matches FROM (SELECT path, unnest(string_split(text, chr(10))) AS line FROM ({DOC})) WHERE regexp_matches(line, '(?i)\\bthe\\b') GROUP BY path""")
def grep_count(spark, d):
    return search.grep_counts(documents(spark, d), r"\bthe\b")


@query(f"WITH {CHUNKS} SELECT '/corpus/' || path AS path, CAST(chunk_idx AS INTEGER) AS \"index\", CAST(0 AS DOUBLE) AS rank, chunk_text AS match FROM c WHERE contains({FOLD.format('chunk_text')}, 'the ap')")
def fts_substring(spark, d):
    return search.substring_search(stored_chunks(spark, d), "THE Ap")


def _indexed(spark, rows, text, order, find):
    """What find gives of an index of rows; the index is removed."""
    folder = lineage.scratch(spark, "grams")
    index = trigrams.TrigramIndex(spark, folder)
    index.build(rows, text, order)
    found = lineage.cut(find(index))
    lineage.removed(spark, folder)
    return found


@query(ORACLE_SQL["fts_substring"])
def trigram_substring(spark, d):
    """As fts_substring, through the trigram index."""
    return _indexed(spark, stored_chunks(spark, d), "chunk_text", ["file_uri", "chunk_idx"], lambda x: x.substring_search("THE Ap"))


@query(ORACLE_SQL["grep_regex_lines"])
def trigram_grep(spark, d):
    """As grep_regex_lines, through the trigram index."""
    return _indexed(spark, documents(spark, d), "text", ["path"], lambda x: x.grep("licensed? +under"))


@query(f"""WITH {CHUNKS}, f AS (SELECT path, chunk_idx, replace(chunk_text, chr(10), ' ') AS raw, strpos(chunk_text, 'Apache') AS p FROM c WHERE contains({FOLD.format('chunk_text')}, 'apache'))
SELECT '/corpus/' || path AS path, CAST(chunk_idx AS INTEGER) AS line_number, CASE WHEN p > 0 THEN (CASE WHEN p > 41 THEN '...' ELSE '' END) || substr(raw, greatest(1, p - 40), least(length(raw), p + 45) - greatest(0, p - 41)) || (CASE WHEN p + 45 < length(raw) THEN '...' ELSE '' END)
 WHEN length(raw) > 140 THEN left(raw, 90) || '...' || right(raw, 50) ELSE left(raw, 140) END AS line FROM f""")
def fts_snippet(spark, d):
    return search.hit_lines(search.substring_search(stored_chunks(spark, d), "apache"), "Apache")


def _query_vector(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]  # one row


KNN = "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 0), k AS (SELECT vec_id, label, list_distance(CAST(embedding AS DOUBLE[]), e) AS distance FROM embeddings, q)"


@query(f"{KNN} SELECT vec_id, round(distance, 4) AS distance FROM k ORDER BY k.distance, vec_id LIMIT 10")
def knn_topk(spark, d):
    return search.nearest(table(spark, d, "embeddings"), _query_vector(spark, d), 10, digits=4).select("vec_id", "distance")


@query(f"{KNN} SELECT vec_id, label, round(distance, 4) AS distance FROM k WHERE label = 3 ORDER BY k.distance, vec_id LIMIT 5")
def knn_filtered(spark, d):
    return search.nearest(table(spark, d, "embeddings"), _query_vector(spark, d), 5, where=F.col("label") == 3, digits=4).select("vec_id", "label", "distance")


@query(f"{KNN} SELECT vec_id, round(distance, 4) AS distance FROM k WHERE distance <= 1.2 ORDER BY k.distance, vec_id LIMIT 100")
def knn_cutoff(spark, d):
    return search.nearest(table(spark, d, "embeddings"), _query_vector(spark, d), 100, cutoff=1.2, digits=4).select("vec_id", "distance")


@query("""WITH q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0), k AS (SELECT query, vec_id, list_distance(CAST(embedding AS DOUBLE[]), e) AS distance FROM embeddings JOIN q ON vec_id <> query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS rank FROM k) SELECT query, vec_id, round(distance, 4) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def knn_queries(spark, d):
    vectors = table(spark, d, "embeddings")
    return search.nearest_to_rows(vectors, vectors.where("vec_id % 50 = 0"), 3).withColumn("distance", F.round("distance", 4))


@query(ORACLE_SQL["knn_queries"])
def knn_pivot(spark, d):
    """As knn_queries, by the pivot index."""
    vectors = table(spark, d, "embeddings")
    return metric.PivotIndex(vectors).nearest(vectors.where("vec_id % 50 = 0"), 3).withColumn("distance", F.round("distance", 4))


@query(f"""WITH {CHUNKS}, g AS (SELECT path, CAST(i AS INTEGER) AS line_number, line FROM (SELECT '/corpus/' || path AS path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d) WHERE contains(line, 'Apache')),
s AS (SELECT '/corpus/' || path AS path, CAST(chunk_idx AS INTEGER) AS line_number FROM c WHERE contains({FOLD.format('chunk_text')}, 'apache') ORDER BY 1, 2 LIMIT 5),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, list_distance(CAST(embedding AS DOUBLE[]), e) AS distance FROM embeddings, q ORDER BY 2, 1 LIMIT 5),
n AS (SELECT '/corpus/' || path AS path, CAST(0 AS INTEGER) AS line_number FROM d JOIN v ON doc_id = vec_id)
SELECT path, line_number, 0 AS source_rank FROM g UNION ALL SELECT path, line_number, 1 FROM s UNION ALL SELECT path, line_number, 2 FROM n WHERE (path, line_number) NOT IN (SELECT path, line_number FROM s)""")
def search_merge_dedup(spark, d):
    docs = documents(spark, d).withColumn("path", F.concat(F.lit("/corpus/"), "path"))
    lines = search.grep(docs, "Apache")
    parts = search.hit_lines(search.substring_search(stored_chunks(spark, d), "apache"), "Apache")
    best = search.nearest(table(spark, d, "embeddings"), _query_vector(spark, d), 5).select("vec_id", "distance")
    near = docs.join(best, F.col("doc_id") == F.col("vec_id")).select("path", F.lit(0).alias("line_number"), text.preview(F.col("text"), 80).alias("line"), "distance")
    return search.merged(lines, parts, near).select("path", "line_number", "source_rank")


@query("""SELECT d.doc_id AS uri, CASE WHEN e.vec_id IS NOT NULL THEN 'indexed' WHEN l.doc_id IS NOT NULL THEN 'chunked_only' ELSE 'unprocessed' END AS status FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = l.doc_id""")
def index_status(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("uri"))
    parts = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("file_uri"))
    return search.index_status(docs, parts, table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id")))


# ---------------------------------------------------------------- context

ITEMS = "SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('system', 'developer', 'user')"


@query(f"""WITH i AS ({ITEMS}), c AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS ch FROM i WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c) SELECT conv_id, CAST(run AS BIGINT) AS run, role, string_agg(text, chr(10) ORDER BY turn) AS content FROM r GROUP BY conv_id, run, role""")
def messages_role_runs(spark, d):
    items = table(spark, d, "conversations").where(F.col("role").isin("system", "developer", "user"))
    return context.messages(items).withColumn("content", F.array_join("content", "\n"))


@query(f"""SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN text ELSE '[role=' || role || ']' || chr(10) || text END, chr(10) ORDER BY turn) AS parts FROM ({ITEMS}) GROUP BY conv_id""")
def messages_single_turn(spark, d):
    items = table(spark, d, "conversations").where(F.col("role").isin("system", "developer", "user"))
    return context.single_turn(items).withColumn("parts", F.array_join("parts", "\n"))


REFS = "SELECT 'txt_' || left(sha256('s1' || chr(31) || conv_id || '-' || turn || chr(31) || '0'), 6) AS ref_id, conv_id * 1000 + turn AS pos, conv_id, turn FROM conversations"


@query(f"SELECT conv_id || '-' || turn AS path, CASE WHEN turn % 2 = 0 THEN ref_id END AS ref_id, 's1' AS session_id FROM ({REFS})")
def refs_column(spark, d):
    items = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("path"), "turn")
    refs = items.where("turn % 2 = 0").select("path", ids.ref_id(F.lit("text"), F.lit("s1"), F.col("path")).alias("ref_id"))
    return context.refs_column(items.select("path"), refs, "s1")


@query(f"SELECT conv_id, turn, ref_id FROM ({REFS})")
def ref_ids(spark, d):
    key = F.concat_ws("-", "conv_id", "turn")
    return table(spark, d, "conversations").select("conv_id", "turn", ids.ref_id(F.lit("text"), F.lit("s1"), key).alias("ref_id"))


@query(f"""WITH r AS ({REFS}), w AS (SELECT left(ref_id, 9) || 'z' AS wanted FROM r WHERE conv_id % 50 = 0 AND turn = 0), d AS (SELECT wanted, ref_id, pos, levenshtein(wanted, ref_id) AS dist FROM w, r)
SELECT wanted, min_by(ref_id, dist * 1000000000 + pos) AS suggestion FROM d WHERE dist <= 4 GROUP BY wanted""")
def closest_ref(spark, d):
    key = F.concat_ws("-", "conv_id", "turn")
    refs = table(spark, d, "conversations").select(ids.ref_id(F.lit("text"), F.lit("s1"), key).alias("ref_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "conv_id", "turn")
    wanted = refs.where("conv_id % 50 = 0 AND turn = 0").select(F.concat(F.left("ref_id", F.lit(9)), F.lit("z")).alias("wanted")).distinct()
    return context.closest_refs(refs, wanted)


@query(ORACLE_SQL["closest_ref"])
def closest_ref_pieces(spark, d):
    """As closest_ref, joined by pieces of the refs, least distances first."""
    key = F.concat_ws("-", "conv_id", "turn")
    refs = table(spark, d, "conversations").select(ids.ref_id(F.lit("text"), F.lit("s1"), key).alias("ref_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "conv_id", "turn")
    wanted = refs.where("conv_id % 50 = 0 AND turn = 0").select(F.concat(F.left("ref_id", F.lit(9)), F.lit("z")).alias("wanted"))
    return editjoin.suggested(refs, wanted)


@query(f"WITH r AS (SELECT conv_id, turn, 'sess_' || conv_id || '/' || ref_id || CASE WHEN turn % 3 = 2 THEN 'x' ELSE '' END AS g FROM ({REFS})) SELECT conv_id, turn, CASE WHEN turn % 3 <> 2 THEN 'sess_' || conv_id END AS session, CASE WHEN turn % 3 <> 2 THEN split_part(g, '/', 2) END AS ref FROM r")
def ref_parse(spark, d):
    ref = ids.ref_id(F.lit("text"), F.lit("s1"), F.concat_ws("-", "conv_id", "turn"))
    given = F.concat(F.lit("sess_"), "conv_id", F.lit("/"), ref, F.when(F.col("turn") % 3 == 2, "x").otherwise(""))
    return table(spark, d, "conversations").select("conv_id", "turn", ids.ref_session(given).alias("session"), ids.ref_local(given).alias("ref"))


@query("""SELECT conv_id, turn, '[ref=txt_' || conv_id || ']' || CASE WHEN turn % 2 = 0 THEN ' note ' || turn ELSE '' END || ' (role=' || role || ', n=' || turn || ')' AS line FROM conversations""")
def metadata_line(spark, d):
    extras = F.array(F.struct(F.lit("role").alias("k"), F.col("role").alias("v")), F.struct(F.lit("n").alias("k"), F.col("turn").cast("string").alias("v")))
    note = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("note "), "turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", context.metadata_line(F.concat(F.lit("txt_"), "conv_id"), note, F.lit(None).cast("string"), extras).alias("line"))


# ---------------------------------------------------------------- plans


@query("""WITH m AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' WHEN 2 THEN 'image' ELSE 'document' END AS kind, CASE p_partkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' ELSE '.docx' END AS ext,
 CAST(p_retailprice * 20000 AS BIGINT) AS size, p_size * 60.0 AS dur, p_size % 2 = 0 AS snd, p_size * 100 AS w, p_partkey % 2500 AS h, p_size * 3 - 10 AS pages, p_brand AS cr FROM part)
SELECT k, kind, CASE kind WHEN 'video' THEN (CASE WHEN dur <= 600 AND size <= 26214400 THEN 'mosaic' WHEN dur <= 2100 AND size <= 104857600 THEN 'keyframes' ELSE 'summary' END) || (CASE WHEN snd THEN '-w-transcript' ELSE '' END)
 WHEN 'audio' THEN (CASE WHEN dur <= 300 AND size <= 10485760 THEN 'transcribe' ELSE 'native' END)
 WHEN 'image' THEN (CASE WHEN (least(w, h) > 0 AND greatest(w, h) > 3 * least(w, h)) OR w > 3840 OR h > 2160 OR size > 10485760 OR (ext = '.png' AND (w > 1920 OR h > 1080)) THEN 'tile' ELSE 'resize' END)
 ELSE (CASE WHEN ext <> '.pdf' OR pages > 100 OR NOT (CASE WHEN pages <> 0 AND pages > 0 THEN size > pages * 512000 ELSE size > 5242880 END) THEN 'page-text' ELSE 'rasterize-text' END) END AS strategy FROM m""")
def auto_strategy(spark, d):
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("video", "audio", "image", "document"))), (k % 4 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, (".pdf", ".png", ".docx"))), (k % 3 + 1).cast("int"))
    rows = table(spark, d, "part").select(k.alias("k"), kind.alias("kind"), ext.alias("ext"), F.round(F.col("p_retailprice") * 20000).cast("bigint").alias("size"), (F.col("p_size") * 60.0).alias("dur"), (F.col("p_size") % 2 == 0).alias("snd"), (F.col("p_size") * 100).alias("w"), (k % 2500).alias("h"), (F.col("p_size") * 3 - 10).alias("pages"), F.col("p_brand").alias("cr"))
    c = {x: F.col(x) for x in rows.columns}
    chosen = strategy.auto_strategy(c["kind"], c["ext"], c["size"], duration=c["dur"], has_audio=c["snd"], width=c["w"], height=c["h"], pages=c["pages"], creator=c["cr"], producer=F.lit(None).cast("string"))
    return rows.select("k", "kind", chosen.alias("strategy"))


@query("""WITH e AS (SELECT event_id, floor(abs(value)) AS dur FROM events), w AS (SELECT event_id, dur, unnest(range(0, CAST(ceil(dur / 55.0) AS BIGINT))) * 55 AS s FROM e WHERE dur > 0)
SELECT event_id, CAST(s AS DOUBLE) AS "start", CAST(least(s + 60, dur) AS DOUBLE) AS "end" FROM w""")
def media_windows(spark, d):
    rows = table(spark, d, "events").select("event_id", F.floor(F.abs("value")).cast("double").alias("dur"))
    return rows.select("event_id", F.inline(media.windows(F.col("dur"), 60, 5)))


@query("""WITH m AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' ELSE 'document' END AS media, s_suppkey * 10.0 AS sec, s_suppkey * 1000 AS chars FROM supplier),
t AS (SELECT s_suppkey, media, CAST(CASE media WHEN 'video' THEN floor(sec * 0.5) * (85 + 4 * 3 * 170) WHEN 'audio' THEN floor(sec * 25) ELSE floor(chars * 0.75) END AS BIGINT) AS tokens FROM m), p AS (SELECT * FROM (VALUES ('a', 0.8), ('b', 0.15)) x(provider, per))
SELECT s_suppkey, media, tokens, provider, round(CAST(tokens * CAST(per AS DOUBLE) / 1e6 AS DOUBLE), 6) AS cost FROM t, p""")
def cost_model(spark, d):
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("video", "audio", "document"))), (k % 3 + 1).cast("int"))
    rows = table(spark, d, "supplier").select("s_suppkey", kind.alias("media"))
    rows = rows.withColumn("tokens", strategy.media_cost_tokens(F.col("media"), k * 10.0, F.lit(0.5), F.lit(1920), F.lit(1080), k * 1000))
    prices = spark.createDataFrame([("a", 0.8), ("b", 0.15)], "provider string, per_mtok double")
    return strategy.priced(rows, prices).select("s_suppkey", "media", "tokens", "provider", "cost")


@query("""WITH f AS (SELECT p_partkey AS uri, CAST(p_size AS DOUBLE) AS d FROM part), t AS (SELECT uri, unnest(range(0, CAST(ceil(d) AS BIGINT))) AS n FROM f)
SELECT uri, CAST(n // 16 AS INTEGER) AS message, CAST(n % 16 AS INTEGER) AS part, CAST(n AS DOUBLE) AS time FROM t""")
def frame_batches(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("uri"), F.col("p_size").cast("double").alias("duration_s"))
    return media_plans.frame_rows(rows, "video/frames")


@query("""WITH f AS (SELECT p_partkey AS uri, p_size * 40 AS w, p_partkey % 1500 + 1 AS h FROM part), a AS (SELECT uri, w, h, CAST(ceil(w / 512.0) AS INTEGER) AS nx, CAST(ceil(h / 512.0) AS INTEGER) AS ny FROM f),
c AS (SELECT uri, 0 AS part, 0 AS "left", 0 AS top, w AS "right", h AS bottom FROM a UNION ALL
 SELECT uri, y * nx + x + 1, x * 512, y * 512, least((x + 1) * 512, w), least((y + 1) * 512, h) FROM (SELECT *, unnest(range(0, nx)) AS x FROM (SELECT *, unnest(range(0, ny)) AS y FROM a WHERE nx * ny > 1)))
SELECT uri, CAST(part AS INTEGER) AS part, CAST("left" AS INTEGER) AS "left", CAST(top AS INTEGER) AS top, CAST("right" AS INTEGER) AS "right", CAST(bottom AS INTEGER) AS bottom FROM c""")
def image_tiles(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("uri"), (F.col("p_size") * 40).alias("width"), (F.col("p_partkey") % 1500 + 1).cast("int").alias("height"))
    return media_plans.tile_rows(rows)


@query("""WITH f AS (SELECT p_partkey AS uri, p_size - 5 AS n FROM part) SELECT uri, CAST(m AS INTEGER) AS message, CAST(m * 4 + 1 AS INTEGER) AS first_page, CAST(least((m + 1) * 4, n) AS INTEGER) AS last_page FROM (SELECT uri, n, unnest(range(0, CAST(ceil(n / 4.0) AS BIGINT))) AS m FROM f WHERE n > 0)""")
def document_pages(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("uri"), (F.col("p_size") - 5).alias("pages"))
    return media_plans.page_rows(rows, "document/rasterize")


@query("""SELECT p_partkey, 'Describe ' || p_name || ' as ' || p_brand || '; .' AS prompt FROM part""")
def render_prompts(spark, d):
    return table(spark, d, "part").select("p_partkey", strategy.rendered_prompts("Describe {name} as {brand}; {none}.", {"name": F.col("p_name"), "brand": F.col("p_brand")}).alias("prompt"))


@query("""SELECT o_orderkey, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0) WHEN s < 1073741824 THEN printf('%.1f MB', s / 1048576.0) ELSE printf('%.1f GB', s / 1073741824.0) END AS shown FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 1000) // 7 AS s FROM orders)""")
def human_sizes(spark, d):
    size = F.floor((F.floor("o_totalprice") * (F.col("o_orderkey") % 1000)) / 7).cast("bigint")
    return table(spark, d, "orders").select("o_orderkey", text.human_size(size).alias("shown"))


@query("""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    found = watch.sessions(table(spark, d, "events"), gap="30 minutes")
    return found.withColumns({"total": F.round("total", 4)} | {c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("""WITH k AS (SELECT doc_id, n_chars + CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 2 = 0), c AS (SELECT doc_id, n_chars AS size FROM documents WHERE doc_id % 3 <> 0)
SELECT 'doc/' || coalesce(c.doc_id, k.doc_id) AS uri, CASE WHEN k.doc_id IS NULL THEN 'new' WHEN c.doc_id IS NULL THEN 'gone' ELSE 'stale' END AS change, coalesce(c.size, k.size) AS size
FROM k FULL JOIN c USING (doc_id) WHERE k.doc_id IS NULL OR c.doc_id IS NULL OR k.size <> c.size""")
def watched_documents(spark, d):
    """Half of the documents as known files, two thirds as a stream of sightings two hours later: new, stale and gone, from keyed state."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before, folder = spark.conf.get(key), lineage.scratch(spark, "watch")
    sighting = lambda df, hours, more: df.select(F.concat(F.lit("doc/"), "doc_id").alias("uri"), F.lit(1).cast("bigint").alias("modified"), (F.col("n_chars") + more).alias("size"), F.timestamp_seconds(F.lit(3600 * hours)).alias("seen_at"))
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("toxic", F.lit(1))
    known = sighting(docs.where("doc_id % 2 = 0").join(toxic, "doc_id", "left"), 0, F.coalesce("toxic", F.lit(0)))
    sighting(docs.where("doc_id % 3 <> 0"), 2, F.lit(0)).write.parquet(f"{folder}/scans")
    found = watch.watched(ingest.stream_of(spark, f"{folder}/scans", watch.SEEN), after="1 hour", late="1 minute", stored=known).select("uri", "change", "size")
    try:
        watch.with_state(spark)
        query = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    rows = lineage.cut(spark.read.schema("uri string, change string, size bigint").parquet(f"{folder}/out"))
    lineage.removed(spark, folder)
    return rows


@query("""SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_activity(spark, d):
    return ingest.activity(table(spark, d, "events")).withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "total": F.round("total", 4)})


# ---------------------------------------------------------------- SQL by delegation

SQL = {
    "sql_inner_join": "SELECT n.n_name, count(*) AS customers, round(sum(c.c_acctbal), 2) AS balance FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "sql_right_join": "SELECT n.n_name, count(c.c_custkey) AS customers FROM customer c RIGHT JOIN nation n ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9000 GROUP BY n.n_name",
    "sql_full_join": "SELECT coalesce(c.k, s.k) AS k, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey > 3 GROUP BY c_nationkey) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) s ON c.k = s.k",
    "sql_cross_join": "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b",
    "sql_natural_join": "SELECT doc_id, source, toxic FROM documents NATURAL JOIN labels",
    "sql_glob": "SELECT p_partkey, p_brand FROM part WHERE p_brand GLOB 'Brand#[1-3]?' AND NOT p_brand GLOB '*2'",
    "sql_left_anti": "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL",
    "sql_having": "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) > 10",
    "sql_case_buckets": "SELECT CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 300000 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1",
    "sql_count_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag",
    "sql_union_all": "SELECT 'customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier",
    "sql_set_operations": "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1",
    "sql_window_rank": "SELECT * FROM (SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS BIGINT) AS r FROM part) t WHERE r <= 3",
    "sql_scalar_subquery": "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) * 1.2 FROM part)",
    "sql_cte": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15) SELECT c.c_mktsegment, count(*) AS customers FROM big JOIN customer c ON c.c_custkey = big.o_custkey GROUP BY c.c_mktsegment",
    "sql_recursive": """WITH RECURSIVE leaf AS (SELECT coalesce(source, 'unknown') || '/' || coalesce(lang, 'und') AS dir, count(*) AS m, CAST(sum(n_chars) AS BIGINT) AS n FROM documents GROUP BY 1),
up(dir, m, n) AS (SELECT dir, m, n FROM leaf UNION ALL SELECT CASE WHEN position('/' IN dir) > 0 THEN left(dir, position('/' IN dir) - 1) ELSE '' END, m, n FROM up WHERE dir <> '')
SELECT dir, CAST(sum(m) AS BIGINT) AS files, CAST(sum(n) AS BIGINT) AS chars FROM up GROUP BY dir""",
    "sql_group_concat": "SELECT r.r_name, GROUP_CONCAT(n.n_name, '; ') WITHIN GROUP (ORDER BY n.n_name) AS nations FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
    "sql_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
}


def _delegated(name: str, statement: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in statement.lower():
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return sqlview.sql(spark, statement)

    run.__name__ = name
    return query(statement)(run)


for _name, _statement in SQL.items():
    _delegated(_name, _statement)
ORACLE_SQL["sql_group_concat"] = "SELECT r.r_name, string_agg(n.n_name, '; ' ORDER BY n.n_name) AS nations FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name"
