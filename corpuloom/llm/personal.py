"""Personal data, and the terms that give it away.

Four kinds are found by pattern.  A find's value (letters lower-cased, of numbers
the digits) is a protected entity.  Around each find lies a context of ``reach``
words to either side.  Over the whole corpus the pointwise mutual information of a
term and an entity's contexts says how strongly the term reveals the entity:
log2(P(context | term) / P(context)).  A term whose information reaches
``disclosure`` of the most it could be (the information content of the entity's
contexts), with enough support in ``spread`` different texts, gives the entity away:
wherever it stands outside a find, in any document, it is a span of kind ``term``
and is generalised together with the data.  Words that stand beside many entities
("mail", "call") tell little of each and stay.

Terms and entities are counted per task before they are shuffled.  Only terms with
enough support are counted over the corpus, and only those that reveal are looked
for in the documents, each through a broadcast of checked size or else a shuffled join.

Defined results: a null text counts as empty; finds of one kind never overlap,
leftmost first, and a match that fails its check is passed over whole; rows
that repeat have the same result; offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_ALNUM, U64, cut, prepared, signed, sized, slices, sorted_unique, text_of, words_of
from .spans import Span, digest, joined, passes_luhn

KINDS = ("email", "ip", "card", "phone")
TERM = "term"

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits fails at its first digit if it fails at all, so later starts need no try.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Terms up to which their hashes are broadcast.
BROADCAST_TERMS = 500_000
_LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

_ITEMS = "array<struct<h:bigint,entity:bigint>>"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local+@domain: all starts in the run before an @ meet the same domain, so the first is tried."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Pattern finds by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and passes_luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def entity_of(kind: str, found: str) -> int:
    """A hash of what a find stands for, however it is written."""
    value = found.translate(_LOWERED) if kind == "email" else re.sub("[^0-9.]" if kind == "ip" else "[^0-9]", "", found)
    return xxhash.xxh3_64_intdigest(f"{kind}:{value}") - (1 << 63)


def _contexts(text: str, spans: list[Span], reach: int) -> list[tuple[int, int]]:
    """(hash, entity) of each word within reach of a find and outside all finds, once an entity and place."""
    coded = text_of(pa.array([text]))
    words = words_of(coded, NON_ALNUM)
    if not len(words.starts):
        return []
    point = np.zeros(len(coded.data) + 1, np.int64)  # code points before a byte
    np.cumsum((coded.data & 0xC0) != 0x80, out=point[1:])
    start, end = point[words.starts], point[words.ends]
    free = np.ones(len(start), bool)
    near = []
    for kind, a, b in spans:
        first, past = int(np.searchsorted(end, a, "right")), int(np.searchsorted(start, b))
        free[first:past] = False
        entity = entity_of(kind, text[a:b])
        near += [(entity, i) for i in (*range(max(0, first - reach), first), *range(past, min(len(start), past + reach)))]
    h = words.hashes.view(np.int64)
    return [(int(h[i]), e) for e, i in sorted(set(near)) if free[i]]


def _finder(reach: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums, spans, near, words = [], [], [], [], []
            for text in batch["text"].to_pylist():
                found = base_spans(text or "")
                counts.append([sum(k == kind for k, _, _ in found) for kind in KINDS])
                sums.append(digest(found))
                spans.append(joined(found))
                near.append([{"h": h, "entity": e} for h, e in _contexts(text, found, reach)] if found else [])
            for _, _, part in slices(text_of(batch["text"])):
                words.append(np.diff(words_of(part, NON_ALNUM).first))
            columns = [*(pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))), pa.array(sums), pa.array(spans), signed(np.concatenate(words)) if words else pa.array([], pa.int64())]
            kind = pa.list_(pa.struct([("h", pa.int64()), ("entity", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], *columns, pa.array(near, kind)], ["doc_id", "row", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "n_words", "near"])

    return find


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [words_of(part, NON_ALNUM).hashes for _, _, part in slices(text_of(batch["text"]))]
        if hashes:
            h, n = np.unique(np.concatenate(hashes), return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(h), signed(n)], ["h", "n"])


def _free_words(known: np.ndarray | None):
    """(doc_id, row, h, start, end) of each word outside all finds, only of the known hashes if there are some (sorted)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part in slices(text_of(batch["text"])):
                words = words_of(part, NON_ALNUM)
                at = np.arange(len(words.hashes))
                if known is not None:
                    at = at[known[np.minimum(np.searchsorted(known, words.hashes), len(known) - 1)] == words.hashes]
                rows = words.rows()[at]
                point = np.zeros(len(part.data) + 1, np.int64)  # code points before a byte
                np.cumsum((part.data & 0xC0) != 0x80, out=point[1:])
                base = point[part.offsets[:-1][rows]]
                start, end = point[words.starts[at]] - base, point[words.ends[at]] - base
                free = np.ones(len(at), bool)
                for row in sorted_unique(rows):
                    a, b = np.searchsorted(rows, [row, row + 1])
                    for _, first, past in base_spans(batch["text"][lo + int(row)].as_py() or ""):
                        free[a + np.searchsorted(end[a:b], first, "right") : a + np.searchsorted(start[a:b], past)] = False
                if free.any():
                    of = pa.array(lo + rows[free])
                    columns = [batch["doc_id"].take(of), batch["row"].take(of), signed(words.hashes[at[free]]), pa.array(start[free].astype(np.int32)), pa.array(end[free].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "h", "start", "end"])

    return find


def _revealing(docs: DataFrame, found: DataFrame, disclosure: float, support: int, spread: int) -> DataFrame:
    """(h, entity) of the terms that reveal an entity."""
    near = found.where(F.size("near") > 0).select("row", F.explode("near").alias("x")).select("row", "x.h", "x.entity")
    each = near.groupBy("h", "entity", "row").agg(F.count("*").alias("c"))
    terms = cut(each.groupBy("h", "entity").agg(F.sum("c").alias("both"), F.count("*").alias("texts")).where((F.col("both") >= support) & (F.col("texts") >= spread)))
    words = found.agg(F.sum("n_words")).first()[0] or 0
    held = near.groupBy("entity").agg(F.count("*").alias("held"))
    hashes = cut(terms.select("h").distinct())
    counted = docs.select("text").mapInArrow(_count_terms, "h bigint, n bigint")
    n = counted.join(sized(hashes, BROADCAST_TERMS), "h", "left_semi").groupBy("h").agg(F.sum("n").alias("n"))
    content = -F.log2(F.col("held") / F.lit(max(1, words)))
    information = F.log2(F.col("both") / F.col("n")) + content
    return terms.join(n, "h").join(held, "entity").where(information >= disclosure * content).select("h", "entity")


def find_personal_data(docs: DataFrame, *, reach: int = 5, disclosure: float = 0.9, support: int = 5, spread: int = 3) -> DataFrame:
    """One row per document: doc_id, row (xxhash64 of text), n_<kind>, base_sha256, base (its spans, joined), terms (start, end)."""
    prepared(docs.sparkSession)
    slim = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    shape = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, row bigint, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, base string, n_words bigint, near {_ITEMS}"
    found = cut(slim.mapInArrow(_finder(reach), shape))
    telling = cut(_revealing(docs, found, disclosure, support, spread).select("h").distinct())
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    shape = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, row bigint, h bigint, start int, end int"
    n = telling.count()
    if not n:
        return found.drop("near", "n_words").withColumn("terms", empty)
    if n <= BROADCAST_TERMS:
        marked = slim.mapInArrow(_free_words(np.sort(telling.toArrow()["h"].to_numpy().view(U64))), shape)
    else:
        marked = slim.mapInArrow(_free_words(None), shape).join(telling, "h", "left_semi")
    terms = marked.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("terms"))
    right = terms.withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    both = found.drop("near", "n_words").join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left").drop("_id", "_row")
    return both.withColumn("terms", F.coalesce("terms", empty))


def all_spans(base: Column, terms: Column) -> Column:
    """Base spans, then terms, joined as kind:start:end."""
    more = F.array_join(F.transform(terms, lambda x: F.concat(F.lit(f"{TERM}:"), x["start"], F.lit(":"), x["end"])), ",")
    return F.concat_ws(",", F.when(base != "", base), F.when(F.size(terms) > 0, more))


def redact(text: str, spans: list[Span]) -> str:
    """Each span generalised to its kind; where spans meet, the earliest and then the longest goes first."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """doc_id and text with personal data and revealing terms generalised; a null text stays null."""
    found = find_personal_data(docs, **options)
    marked = found.select("doc_id", "row", all_spans(F.col("base"), F.col("terms")).alias("spans")).dropDuplicates()
    left = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_row"), "text")
    both = left.join(marked, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_row") == F.col("row")), "left").select(F.col("_id").alias("doc_id"), "text", "spans")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                parts = [x.split(":") for x in (spans or "").split(",") if x]
                out.append(None if text is None else redact(text, [(k, int(a), int(b)) for k, a, b in parts]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.string())], ["doc_id", "text"])

    return both.mapInArrow(apply, f"doc_id {both.schema['doc_id'].dataType.simpleString()}, text string")
