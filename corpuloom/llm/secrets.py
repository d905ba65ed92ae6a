"""Secrets, by pattern and by a battery of randomness tests.

Besides three patterns, every run of at least ``min_length`` token characters is
a candidate.  Its encoding is inferred from its characters (hex, base32,
base62, base64), and three tests ask how well its symbols go with being uniformly
random in that encoding: chi-squared uniformity of the alphabet, runs about the
middle symbol, and serial correlation.  Fisher's method combines them into one
score.

How random ordinary text looks is measured, not assumed: all short words of every
document, as they stand, run together or joined as in names and paths, are laid end to
end and cut into strings of each class of lengths, so that every word is in a string of
each.  A document counts as one, by the shares of its strings.  A candidate's p-value is
the share of the ordinary strings of its length class that look as random.  Within each class the
Benjamini-Hochberg procedure over all candidates of the corpus makes discoveries at a
false-discovery rate of ``rate``: these are secrets of kind ``random``.  Small corpora
can give no small p-values and make no discovery.

The procedure needs only two histograms of scores by class, over all candidates and all
ordinary strings; they are pre-aggregated, and the documents are read once and never shuffled.

Defined results: a null text counts as empty; finds of one kind never overlap;
a candidate that meets a pattern's find is counted in the corpus but not
reported; rows that repeat have the same result; offsets are code points.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, prepared
from .spans import Span, digest

KINDS = ("assign", "access", "hex")
RANDOM = "random"

KEYWORD = re.compile("passw|secret|token|api", re.I | re.A)
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WORD = re.compile(r"[A-Za-z0-9]+")
#: What stands between the words of names and paths.
JOINTS = ("", "_", "-", "/", "")

ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
_VALUES = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}
_VALUES["base64"] |= {"-": 62, "_": 63}
#: Lower bounds of the length classes.
LENGTHS = (20, 24, 32, 48)
#: Bins of -log10 p.
BINS, BIN = 400, 0.05
#: A document's weight in the histogram of ordinary strings; whole numbers, so that sums do not depend on their order.
WHOLE = 1 << 30
#: Ordinary strings that are scored at a time.
STRINGS = 1 << 14


def base_spans(text: str) -> list[Span]:
    """Pattern finds by start, then kind as listed."""
    out = []
    if KEYWORD.search(text):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def inferred(token: str) -> str:
    used = set(token)
    for name in ("hex", "base32", "base62"):
        if used <= _VALUES[name].keys():
            return name
    return "hex" if used <= set("0123456789ABCDEF") else "base64"


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _uniform(n: int, squares: int, k: int) -> float:
    """Of n symbols of k, whose counts have this sum of squares."""
    x = squares * k / n - n
    d = k - 1  # Wilson and Hilferty's cube root
    return _upper_normal(((max(x, 0.0) / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))


def _uniformity(values: list[int], k: int) -> float:
    return _uniform(len(values), sum(c * c for c in Counter(values).values()), k)


def _runs_of(n: int, a: int, runs: int) -> float:
    """Of n symbols, a of them high, in so many runs."""
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    expected = 2 * a * b / n + 1
    spread = math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9))
    return min(1.0, 2 * _upper_normal(abs(runs - expected) / spread))


def _runs(values: list[int], k: int) -> float:
    high = [2 * v >= k for v in values]
    return _runs_of(len(high), sum(high), 1 + sum(x != y for x, y in zip(high, high[1:], strict=False)))


def _serial(values: list[int]) -> float:
    n = len(values)
    mean = sum(values) / n
    centred = [v - mean for v in values]
    power = sum(v * v for v in centred)
    if power <= 0:
        return 2.0 ** (1 - n)
    r = sum(x * y for x, y in zip(centred, centred[1:], strict=False)) / power
    return min(1.0, 2 * _upper_normal(abs(r + 1 / n) * math.sqrt(n)))


def randomness(token: str) -> float:
    """The chance that uniformly random symbols look no more random than these."""
    name = inferred(token)
    known = _VALUES[name]
    symbols = token.rstrip("=") if name == "base64" else token.lower() if name == "hex" else token
    values = [known[c] for c in symbols if c in known]
    if len(values) < 8:
        return 0.0
    k = len(ALPHABETS[name])
    tests = (_uniformity(values, k), _runs(values, k), _serial(values))
    half = -sum(math.log(max(p, 1e-30)) for p in tests)
    return math.exp(-half) * (1 + half + half * half / 2)


def _bin(p: float) -> int:
    return min(BINS - 1, int(-math.log10(max(p, 1e-30)) / BIN))


def _class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def ordinary(text: str) -> list[np.ndarray]:
    """The strings of each length class that hold all of the text's short words; none if these are too few.

    An array of bytes for each class, a column for each string: its length is that of its strings.
    """
    words = [w for w in WORD.findall(text) if len(w) < LENGTHS[0]]
    if not words:
        return []
    seed = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    parts = words * 2
    parts[::2] = words
    parts[1::2] = itertools.islice(itertools.cycle(JOINTS[(seed + i) % len(JOINTS)] for i in range(len(JOINTS))), len(words))
    line = np.frombuffer("".join(parts[:-1]).encode(), np.uint8)
    out = []
    for a, b in zip(LENGTHS, (*LENGTHS[1:], 2 * LENGTHS[-1]), strict=True):
        n = a + seed // 7 % (b - a)  # a class holds strings from its least length to the next one's; all of them are drawn
        if len(line) >= n:
            upto = len(line) // n * n
            strings = line[:upto].reshape(-1, n)
            # What is left at the end goes with what stands before it.
            out.append((strings if upto == len(line) else np.concatenate([strings, line[None, -n:]])).T)
    return out


@cache
def _codes() -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """For each byte, a bit for each encoding that knows it; and its symbol in each."""
    known, symbols = np.zeros(256, np.uint8), {}
    for i, name in enumerate(ALPHABETS):
        symbols[name] = np.zeros(256, np.uint8)
        for c, v in _VALUES[name].items():
            known[ord(c)] |= 1 << i
            symbols[name][ord(c)] = v
    return known, symbols


def _by_value(f, x: np.ndarray) -> np.ndarray:
    """f of whole numbers, once for each."""
    each, at = np.unique(x, return_inverse=True)
    return np.array([f(int(v)) for v in each])[at]


def _columns(values: np.ndarray, k: int) -> np.ndarray:
    """randomness() of columns of symbols."""
    n, m = values.shape
    counts = np.bincount((values + np.arange(m) * k).ravel(), minlength=m * k).reshape(m, k)
    uniform = _by_value(lambda x: _uniform(n, x, k), np.einsum("ij,ij->i", counts, counts))
    high = values >= k // 2
    pair = high.sum(0) * (n + 1) + 1 + (high[1:] != high[:-1]).sum(0)
    runs = _by_value(lambda x: _runs_of(n, *divmod(x, n + 1)), pair)
    v = values.astype(np.float32)  # sums of whole numbers, exact below 2^24
    total, square, lagged = (x.astype(np.float64) for x in (v.sum(0), np.einsum("ij,ij->j", v, v), np.einsum("ij,ij->j", v[1:], v[:-1])))
    mean, power = total / n, square - total * total / n
    flat = power <= 0
    r = (lagged - mean * (2 * total - v[0] - v[-1]) + (n - 1) * mean * mean) / np.where(flat, 1, power)
    serial = np.array([math.erfc(z) for z in (np.abs(r + 1 / n) * math.sqrt(n / 2)).tolist()])
    serial[flat] = 2.0 ** (1 - n)
    half = -sum(np.log(np.maximum(p, 1e-30)) for p in (uniform, runs, serial))
    return np.exp(-half) * (1 + half + half * half / 2)


def string_bins(strings: np.ndarray) -> np.ndarray:
    """_bin(randomness()) of strings of one length, a column each."""
    known, symbols = _codes()
    out = np.empty(strings.shape[1], np.int64)
    for lo in range(0, strings.shape[1], STRINGS):
        some = strings[:, lo : lo + STRINGS]
        fits = np.bitwise_and.reduce(known[some], 0)
        first = np.select([(fits >> i) & 1 == 1 for i in range(len(ALPHABETS))], range(len(ALPHABETS)), len(ALPHABETS) - 1)
        for i, (name, alphabet) in enumerate(ALPHABETS.items()):
            at = np.flatnonzero(first == i)
            if len(at):
                p = _columns(symbols[name][some[:, at]], len(alphabet))
                out[lo + at] = np.minimum(BINS - 1, (-np.log10(np.maximum(p, 1e-30)) / BIN).astype(np.int64))
    return out


def ordinary_weights(texts: list[str]) -> np.ndarray:
    """By class and bin, the weight of all ordinary strings of texts; a text's weigh WHOLE in each class that it reaches."""
    by_length: dict[int, list[np.ndarray]] = {}
    for text in texts:
        for strings in ordinary(text):
            by_length.setdefault(len(strings), []).append(strings)
    out = np.zeros((len(LENGTHS), BINS), np.int64)
    for n, made in by_length.items():
        each = np.array([x.shape[1] for x in made])
        bins = string_bins(np.concatenate(made, 1))
        cell, count = np.unique(np.repeat(np.arange(len(made)), each) * BINS + bins, return_counts=True)
        np.add.at(out[_class(n)], cell % BINS, count * WHOLE // each[cell // BINS])
    return out


def _overlaps(spans: list[Span], candidates: list[tuple[int, int]]) -> list[bool]:
    """Whether each candidate meets a span; both in order of their starts."""
    starts = [a for _, a, _ in spans]
    reach = list(itertools.accumulate((b for _, _, b in spans), max))
    return [bool(k := bisect.bisect_left(starts, b)) and reach[k - 1] > a for a, b in candidates]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    candidate = pa.struct([("class", pa.int32()), ("bin", pa.int32()), ("free", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())])
    weighed = pa.struct([("x", pa.int32()), ("n", pa.int64())])
    for batch in batches:
        counts, sums, spans, tokens = [], [], [], []
        texts = [text or "" for text in batch["text"].to_pylist()]
        for text in texts:
            found = base_spans(text)
            counts.append([sum(k == kind for k, _, _ in found) for kind in KINDS])
            sums.append(digest(found))
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            at = [m.span() for m in CANDIDATE.finditer(text)]
            tokens.append([{"class": _class(b - a), "bin": _bin(randomness(text[a:b])), "free": not met, "start": a, "end": b} for (a, b), met in zip(at, _overlaps(found, at), strict=True)])
        # The histogram of a batch goes with its first row.
        weights = ordinary_weights(texts).ravel()
        plain = [[{"x": int(i), "n": int(weights[i])} for i in np.flatnonzero(weights)], *([] for _ in texts[1:])][: len(texts)]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], *(pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))), pa.array(sums), pa.array(spans, pa.list_(span)), pa.array(tokens, pa.list_(candidate)), pa.array(plain, pa.list_(weighed))],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "candidates", "ordinary"],
        )


def limits(candidates: dict[tuple[int, int], int], plain: dict[tuple[int, int], float], rate: float) -> list[int]:
    """For each length class, the last bin that Benjamini-Hochberg discovers (-1 if none).

    candidates and plain: how many candidates and documents' worth of ordinary strings have a (class, bin).
    """
    out = []
    for c in range(len(LENGTHS)):
        found, null = ({b: n for (k, b), n in x.items() if k == c} for x in (candidates, plain))
        total, every, limit, upto, as_random = sum(found.values()), sum(null.values()), -1, 0, 0
        for b in range(BINS):  # from the most random on
            upto += found.get(b, 0)
            as_random += null.get(b, 0)
            if upto and (1 + as_random) / (1 + every) <= rate * upto / total:
                limit = b
        out.append(limit)
    return out


def find_secrets(docs: DataFrame, *, rate: float = 0.05) -> DataFrame:
    """One row per document: doc_id, n_<kind>, base_sha256, base and random (spans of kind, start, end)."""
    prepared(docs.sparkSession)
    slim = docs.select("doc_id", "text")
    span = "struct<kind:string,start:int,end:int>"
    shape = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, base array<{span}>, candidates array<struct<class:int,bin:int,free:boolean,start:int,end:int>>, ordinary array<struct<x:int,n:bigint>>"
    found = cut(slim.mapInArrow(_find, shape))
    seen = found.select(F.explode("candidates").alias("x")).groupBy("x.class", "x.bin").agg(F.count("*").alias("n")).collect()  # at most BINS rows a class
    plain = found.select(F.explode("ordinary").alias("x")).groupBy("x.x").agg(F.sum("x.n").alias("n")).collect()
    last = limits({(r["class"], r["bin"]): r["n"] for r in seen}, {divmod(r["x"], BINS): r["n"] / WHOLE for r in plain}, rate)
    passed = F.filter("candidates", lambda x: x["free"] & (x["bin"] <= F.element_at(F.array(*map(F.lit, last)), x["class"] + 1)))
    random = F.transform(passed, lambda x: F.struct(F.lit(RANDOM).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return found.withColumn("random", random).drop("candidates", "ordinary")


def all_spans() -> Column:
    """Base and random spans by start, then kind as listed, joined as kind:start:end."""
    rank = F.create_map(*(x for i, k in enumerate((*KINDS, RANDOM)) for x in (F.lit(k), F.lit(i))))
    keyed = F.transform(F.concat("base", "random"), lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat(x["kind"], F.lit(":"), x["start"], F.lit(":"), x["end"])), ",")
