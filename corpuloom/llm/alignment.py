"""Cross-tokenizer alignment: where two tokenizers cut alike, and how often their tokens meet.

Python only tokenises.  No token of either vocabulary goes across a space between two characters that are none
(checked on the vocabularies), so a batch's texts are cut there, each distinct word is tokenised once and the texts'
tokens are put together from their words'.  Each text gives the ids of its tokens and the byte offsets where they end,
for both tokenizers.  All else is higher-order functions.  Ends of both are sorted together, each with its place in its
own list in the low bits; as j entries stand before the j-th, its place in one list says how many of the other stand
before it, so every stretch between two neighbouring ends is a link of one token of each, found by arithmetic alone, and
two equal ends are where both lists of ends intersect, which cuts the tokens into groups.

The lists of links are written once to the shared folder, as columns of packed numbers;
corpus-wide counts of documents are added up before they are shuffled.  The table of counts
has at most a row for each pair of ids; it is broadcast up to MOST_PAIRS rows and joined by
shuffling beyond.

Defined results: a null or empty text, or one whose joined token bytes are not a space and
the text, has no tokens and zeros, and its groups_sha256 is empty; rows that share a doc_id
or a text are documents by themselves; an empty table gives none.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import arrow_map
from .common import Text, cut, list_array, prepared, shared_folder, sized, slices, text_of

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Rows of pair counts that are broadcast, of 17 bytes each.
MOST_PAIRS = 1 << 21
#: Bits of the second id in a packed pair; ids of both are below 2**SECOND.
SECOND = 20
#: In a packed end: the bits below it, of which the highest says which tokenizer's it is and the others the token's place.
END = 31
#: Bytes of text whose distinct words are tokenised together.
BOOK_BYTES = 1 << 22
#: Characters without a break beyond which a text goes to the slower encoder, which takes them in one go; words up to here are encoded in runs of about so many bytes.
LONG_RUN = 1000

# Fixed value: how byte-level BPE splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Pieces(NamedTuple):
    """The bytes of each id of a vocabulary: data[starts[i] : starts[i] + sizes[i]]."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray


def _pieces(tokens: list[bytes]) -> Pieces:
    sizes = np.array([len(t) for t in tokens], np.int64)
    return Pieces(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes)


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(2)
def byte_bpe(path: str):
    """An encoder of lists of texts to id arrays, and its pieces.

    Where ids follow the order of merges, ranks are ids, and texts without very long runs go through the
    quicker of two libraries, which then gives the same ids.
    """
    import tiktoken
    from tokenizers import Tokenizer

    model = json.load(open(path))["model"]
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    letters = _byte_letters()
    tokens = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
    pieces = _pieces([tokens.get(i, b"") for i in range(max(tokens) + 1)])
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    in_order = all(model["vocab"][m] == 256 + i for i, m in enumerate(merged)) and len(merged) + 256 == len(tokens)
    quick = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks={t: i for i, t in tokens.items()}, special_tokens={}) if in_order else None

    def long_run(text: str) -> bool:
        return len(text) > LONG_RUN and (max(map(len, text.split()), default=0) > LONG_RUN or re.search(rf"\s{{{LONG_RUN}}}", text) is not None)

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(whole.encode(t, add_special_tokens=False).ids, np.int64) if quick is None or long_run(t) else quick.encode_to_numpy(t).astype(np.int64) for t in texts]

    return encode, pieces


@lru_cache(2)
def piece_bpe(path: str):
    """As byte_bpe(), for a model of pieces with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    pieces = _pieces([bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in names])
    return (lambda texts: [np.array(x, np.int64) for x in model.encode(texts, num_threads=1)]), pieces


def _spelled(ids: np.ndarray, pieces: Pieces) -> np.ndarray:
    """The joined bytes of the tokens."""
    sizes = pieces.sizes[ids]
    ends = np.cumsum(sizes)
    return pieces.data[np.repeat(pieces.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _may_be_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at each byte may be white space, in Unicode too; some others count as such."""
    x, y, z = data[at], data[at - 1], data[at - 2]
    return (x <= 0x20) | (y == 0xC2) & ((x == 0x85) | (x == 0xA0)) | ((y == 0x80) | (y == 0x81) | (y == 0x9A)) & (z >= 0xE1) & (z <= 0xE3)


def _apart(pieces: Pieces) -> bool:
    """Whether no token holds a space after a character that is no white space, so that words can be cut by themselves."""
    tokens = (pieces.data[i : i + n] for i, n in zip(pieces.starts, pieces.sizes, strict=True))
    return not any((~_may_be_space(t, np.flatnonzero(t[1:] == 0x20))).any() for t in tokens if len(t) > 1)


@lru_cache(2)
def _sides(first: str, second: str) -> tuple[list, bool]:
    """Encoder, pieces and how much of a space and a text it is given, for both; and whether words can be cut by themselves."""
    sides = [(*byte_bpe(first), 0), (*piece_bpe(second), 1)]
    return sides, all(_apart(pieces) for _, pieces, _ in sides)


def _words(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where words start: at starts, and at each space between two characters that are no white space."""
    at = np.flatnonzero(data[:-1] == 0x20)
    at = at[(data[at + 1] > 0x20) & ~_may_be_space(data, at - 1)]
    edge = np.zeros(len(data), bool)
    edge[at] = edge[starts] = True
    return np.flatnonzero(edge)


def _tokens(words: Text, edges: np.ndarray, sides: list) -> list[list[np.ndarray] | None]:
    """The ids of both for each run of words, edges[k] to edges[k + 1]; None where its bytes differ or a word ends within a token."""
    at = words.offsets[edges]
    texts = [words.data[i:j].tobytes() for i, j in itertools.pairwise(at)]
    found = [encode([t.decode()[skip:] for t in texts]) for encode, _, skip in sides]

    def fit(lo: int, hi: int) -> bool:
        """Whether runs lo to hi do."""
        ends = words.offsets[edges[lo] + 1 : edges[hi] + 1] - at[lo]
        each = [(np.concatenate(f[lo:hi]), p) for f, (_, p, _) in zip(found, sides, strict=True)]
        return all(_spelled(x, p).tobytes() == words.data[at[lo] : at[hi]].tobytes() and np.isin(ends, np.cumsum(p.sizes[x]), assume_unique=True).all() for x, p in each)

    whole = fit(0, len(texts))
    return [ids if whole or fit(k, k + 1) else None for k, ids in enumerate(map(list, zip(*found, strict=True)))]


def _distinct(column: pa.Array, sides: list, apart: bool) -> tuple[np.ndarray, list, np.ndarray]:
    """Of words: whether each has tokens; the ids of those that have, in runs; and their sizes in bytes.  In the order of the column."""
    words = text_of(column)
    n = len(column)
    alone = np.diff(words.offsets) > LONG_RUN
    if n:
        alone |= _may_be_space(words.data, words.offsets[1:] - 1)
    if not apart:
        alone[:] = True
    # A run ends after about LONG_RUN bytes, and on both sides of a word that is encoded alone.
    step = words.offsets[:-1] // LONG_RUN
    edge = np.ones(n + 1, bool)
    edge[1:n] = (step[1:] != step[:-1]) | alone[1:] | alone[:-1]
    edges = np.flatnonzero(edge)
    kept, runs = np.ones(n, bool), []
    for k, ids in enumerate(_tokens(words, edges, sides) if n else []):
        lo, hi = edges[k], edges[k + 1]
        each = [ids] if ids is not None or hi - lo == 1 else _tokens(words, np.arange(lo, hi + 1), sides)
        kept[lo:hi] = [x is not None for x in each] if len(each) == hi - lo else True
        runs += [x for x in each if x is not None]
    return kept, runs, np.diff(words.offsets)[kept]


class Book(NamedTuple):
    """Distinct words of some texts, side by side.

    ids: their tokens; words: of each text, the numbers of its words, one text after the other; counts: how many
    each text has; sizes: the words' bytes.
    """

    ids: tuple[np.ndarray, np.ndarray]
    sizes: np.ndarray
    words: np.ndarray
    counts: np.ndarray


def _book(texts: list[str], sides: list, apart: bool) -> Book:
    """A text with a word whose bytes differ is one word; if its own differ too, it has none."""
    spaced = [b" " + t.encode() if t else b"" for t in texts]
    sizes = np.array([len(s) for s in spaced], np.int64)
    data = np.frombuffer(b"".join(spaced), np.uint8)
    starts = np.cumsum(sizes) - sizes
    some = starts[sizes > 0]
    first = _words(data, some) if apart and len(some) else some
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(first, np.append(starts, len(data)))))
    coded = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.append(first, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64)
    kept, runs, lengths = _distinct(coded.dictionary, sides, apart)
    if not kept.all():
        odd = np.unique(row[~kept[number]])
        fit, more, extra = _distinct(pa.array([spaced[i] for i in odd], pa.large_binary()), sides, False)
        use = ~np.isin(row, odd)
        row, number = np.append(row[use], odd[fit]), np.append((np.cumsum(kept) - 1)[number[use]], kept.sum() + np.arange(fit.sum()))
        order = np.argsort(row, kind="stable")
        row, number, runs, lengths = row[order], number[order], runs + more, np.append(lengths, extra)
    ids = tuple(np.concatenate([np.empty(0, np.int64), *(r[i] for r in runs)]) for i in (0, 1))
    return Book(ids, lengths, number, np.bincount(row, minlength=len(texts)))


def _laid_out(ids: np.ndarray, pieces: Pieces, side: int, book: Book) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: ids, ends with the side and the token's place in the low bits, and how many tokens each text has."""
    upto = np.searchsorted(np.cumsum(pieces.sizes[ids]), np.cumsum(book.sizes)) + 1
    each = np.diff(upto, prepend=0)[book.words]
    past = np.cumsum(each)
    ids = ids[np.repeat(upto[book.words] - past, each) + np.arange(past[-1] if len(past) else 0)]
    edges = np.append(0, past)[np.append(0, np.cumsum(book.counts))]
    counts = np.diff(edges)
    ends = np.append(0, np.cumsum(pieces.sizes[ids]))
    packed = ((ends[1:] - np.repeat(ends[edges[:-1]], counts)) << END) + (np.arange(len(ids)) - np.repeat(edges[:-1], counts))
    return ids, packed | side << END - 1, counts


def _tokeniser(first: str, second: str, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, apart = _sides(first, second)
        for batch in batches:
            for lo, hi, _ in slices(text_of(batch["text"]), BOOK_BYTES):
                book = _book([t or "" for t in batch["text"][lo:hi].to_pylist()], sides, apart)
                columns = []
                for side, (ids, (_, pieces, _)) in enumerate(zip(book.ids, sides, strict=True)):
                    ids, ends, counts = _laid_out(ids, pieces, side, book)
                    columns += [list_array(pa.array(x), counts) for x in (ids.astype(np.int32), ends)]
                yield pa.RecordBatch.from_arrays([*(batch[k][lo:hi] for k in keys), *columns], [*keys, "a_ids", "a_ends", "b_ids", "b_ends"])

    return run


def tokenised(docs: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """keys (of documents, under any names), and for both tokenizers a_ids, b_ids: token ids, and a_ends, b_ends: the byte
    offset where each ends, with a bit for the second tokenizer and the token's place in the END bits below."""
    prepared(docs.sparkSession)
    rows = docs.select(*keys, "text")
    schema = ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes)
    return arrow_map(rows, _tokeniser(first, second, keys), f"{schema}, a_ids array<int>, a_ends array<bigint>, b_ids array<int>, b_ends array<bigint>")


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def aligned(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_a, n_b, n_groups, groups_sha256 and links: an array of packed pairs of ids, one for each pair of tokens that overlap.

    Lambdas are evaluated node by node, so each does little: an entry of the sorted ends is turned into the pair of
    its link or, where it is the second of two equal ends, into a mark of its place, which is where a group ends.
    Groups of one token of each, by far the most, are written without a list.
    """
    call, big = F.call_function, lambda x: F.lit(x).cast("bigint")
    place = lambda x: x.bitwiseAND(big((1 << END - 1) - 1)).cast("int")
    text = lambda ids: F.col(ids).cast("array<string>")

    def entries(m: Column, a_ids: Column, b_ids: Column) -> Column:
        """The pair of the link that ends at each entry; -1 - j at the j-th if it is the second of two equal ends.

        As j entries stand before the j-th, the places of both tokens of its link add up to j.
        """
        pair = lambda a, b: call("shiftleft", F.get(a_ids, a).cast("bigint"), F.lit(SECOND)).bitwiseOR(F.get(b_ids, b).cast("bigint"))

        def entry(x: Column, j: Column) -> Column:
            same = call("shiftright", x, F.lit(END)) == call("shiftright", F.get(m, j - 1), F.lit(END))
            link = call("if", x.bitwiseAND(big(1 << END - 1)) == 0, pair(place(x), j - place(x)), pair(j - place(x), place(x)))
            return call("if", same, (-1 - j).cast("bigint"), link)

        return F.transform(m, entry)

    def groups(m: Column, marks: Column, a_text: Column, b_text: Column) -> Column:
        """Tokens up to each shared end."""

        def group(j: Column, g: Column) -> Column:
            b = place(F.get(m, j))
            before = F.coalesce(F.get(marks, g - 1), F.lit(-1))
            b0 = F.coalesce(place(F.get(m, before)), F.lit(-1)) + 1
            # Not slice(), which copies the whole array each time.
            listed = lambda of, i, k: F.array_join(F.transform(F.sequence(i, k), lambda x: F.get(of, x)), ",")
            several = F.concat(listed(a_text, before + 1 - b0, j - 1 - b), F.lit("|"), listed(b_text, b0, b))
            return call("if", j - F.get(marks, g - 1) == 2, F.concat(F.get(a_text, j - 1 - b), F.lit("|"), F.get(b_text, b)), several)

        return F.sha2(F.array_join(F.transform(marks, group), ";"), 256)

    def made(m: Column, of: Column) -> Column:
        def put(marks: Column) -> Column:
            # What a lambda is given is worked out once, unlike a column that is made in an earlier select.
            sha = _let(text("a_ids"), lambda a: _let(text("b_ids"), lambda b: groups(m, marks, a, b)))
            return F.struct(F.size(marks).cast("bigint").alias("n"), sha.alias("sha"))

        marks = F.transform(F.filter(of, lambda x: x < 0), lambda x: (-1 - x).cast("int"))
        return F.struct(F.filter(of, lambda x: x >= 0).alias("links"), _let(marks, put).alias("groups"))

    # Sorted in a select of its own, in which they are compiled code on plain numbers; within a lambda they are sorted as objects.
    together = tokens.select(*keys, "a_ids", "b_ids", F.sort_array(F.concat("a_ends", "b_ends")).alias("_ends"))
    whole = _let(F.col("_ends"), lambda m: _let(_let(F.col("a_ids"), lambda a: _let(F.col("b_ids"), lambda b: entries(m, a, b))), lambda of: made(m, of)))
    found = together.select(*keys, F.size("a_ids").cast("bigint").alias("n_a"), F.size("b_ids").cast("bigint").alias("n_b"), F.when(F.size("_ends") > 0, whole).alias("_m"))
    return found.select(*keys, "n_a", "n_b", F.coalesce("_m.groups.n", big(0)).alias("n_groups"), F.coalesce("_m.groups.sha", F.lit("")).alias("groups_sha256"), F.coalesce("_m.links", F.expr("cast(array() as array<bigint>)")).alias("links"))


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and best (whether n is the highest of its first id)."""
    counts = cut(linked.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    of = F.call_function("shiftright", F.col("pair"), F.lit(SECOND))
    # A row for each id of the first vocabulary, whose size is fixed.
    highest = counts.groupBy(of.alias("_a")).agg(F.max("n").alias("_top"))
    return cut(counts.join(F.broadcast(highest), of == F.col("_a")).select("pair", "n", (F.col("n") == F.col("_top")).alias("best")))


def align(docs: DataFrame, keys: list[str], folder: str = TOKENIZERS) -> DataFrame:
    """keys, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    spark = docs.sparkSession
    named = [f"_k{i}" for i in range(len(keys))]
    rows = docs.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keys, named, strict=True)), "text")
    at = f"{shared_folder(spark)}/links-{uuid.uuid4().hex}"
    made = aligned(tokenised(rows, named, f"{folder}/{BYTE_BPE}", f"{folder}/{PIECE_BPE}"), named)
    made.withColumn("_row", F.monotonically_increasing_id()).write.option("compression", "zstd").option("parquet.dictionary.page.size", str(1 << 23)).parquet(at)
    linked = spark.read.parquet(at)
    counts = sized(pair_counts(linked), MOST_PAIRS)
    each = linked.select("_row", F.explode("links").alias("pair")).join(counts, "pair")
    sums = each.groupBy("_row").agg(F.count("*").alias("n_links"), F.count(F.when(F.col("best"), 1)).alias("n_best"), F.sum("n").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    out = cut(linked.drop("links").join(sums, "_row", "left").select(*(F.col(n).alias(k) for k, n in zip(keys, named, strict=True)), "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256"))
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out
