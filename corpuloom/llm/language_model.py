"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A text is coded token by token: lower-cased words and then one end.  A token is
coded by binary decisions, each of which several predictors guess; a mixer adds
their log odds under gated weights, and a last refining stage corrects the guess
by its gate and quantised odds.

1. Where the previous word has stood in the text before, one decision says whether
   the word that followed it there follows again.  Its contexts reach across words:
   whether the two previous words agree, how long the match has held, how far back
   it lies, the last decisions, and the word that is expected.
2. Else the word is spelled, byte by byte, with a space at its end.  A byte is a few
   decisions down a tree of the corpus's byte counts.  Contexts are the place, one,
   two and three bytes before, hashed into slots, and all of the word so far, whose
   counts are exact: the model grows with the vocabulary.

Predictors, weights and refining tables learn online from all training text.  Each
task starts from the same weights, and what the tasks learn is averaged by gate, each
for the tokens that it stood for.  A word is spelled out of itself when it teaches.

Words are counted per task before they are shuffled, and then dealt into sorted
ranges, so that a prefix's words stand together; prefixes that go across the edge
of a range are counted over all ranges.  What is broadcast is bounded: tables of a
fixed size, the prefixes at the edges, and scores of at most ``HEAD`` words, the most
frequent ones (all others are joined).

Defined results: a null or empty text is the end alone; only the first WHOLE bytes
of a word have the context of the word so far; repeated rows count each time and
score alike; a null doc_id counts as training; without training documents the score
comes from untrained predictors and the base from N = V = 0.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _ODD, LOWER, U64, WHITESPACE, Text, Words, _power_tables, cut, list_array, mix, prepared, signed, slices, sorted_unique, text_of, words_of

#: log2 of the slots of the hashed contexts of a byte: its place, 1, 2 and 3 bytes before.
SLOT_BITS = (12, 16, 18, 20)
#: Bytes of a word that have the word so far as a context.
WHOLE = 32
#: Words in a range at most, on average.
RANGE_WORDS = 30_000
#: Ranges at least, and words drawn for the bounds of each.
LEAST_RANGES, BOUND_SAMPLE = 8, 32
#: Decisions that a step of scoring works on; steps of an epoch of learning, and epochs.
STEP, STEPS, EPOCHS = 1 << 18, 64, 2
HEAD = 1 << 20
SMOOTH, RATE, PRIOR = 0.4, 0.5, 50.0
LEVELS, WIDTH = 33, 0.5
#: Slots of the contexts of a match: its length, its distance, the last decisions, the expected word.
MATCH_BITS = (5, 5, 6, 16)
#: Learned numbers go through the sums of counts as whole numbers of this unit.
UNIT = 1 << 16
#: Rows of learned numbers among the counted words begin with what no word holds.
MARK = b" "


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 2 modulo 7."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


# ---------------------------------------------------------------- mixing


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + SMOOTH) / (n0 + SMOOTH))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def _seen(n: np.ndarray) -> np.ndarray:
    """0 for never, then by powers of four."""
    return np.minimum(7, np.ceil(np.log2(1 + n) / 2)).astype(np.int64)


class Mixer(NamedTuple):
    """Weights by gate and input; refine: final probabilities by gate and quantised odds."""

    weights: np.ndarray
    refine: np.ndarray

    @staticmethod
    def start(gates: int, inputs: int) -> Mixer:
        weights = np.full((gates, inputs + 1), 1.0 / inputs)
        weights[:, -1] = 0.0
        return Mixer(weights, np.tile(_squash((np.arange(LEVELS) - (LEVELS - 1) / 2) * WIDTH), gates))

    def guess(self, inputs: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", inputs, self.weights[gate]), -15, 15)

    def places(self, x: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lower of the two cells of the refining table between which x lies, and the share of the upper one."""
        place = np.clip(x / WIDTH + (LEVELS - 1) / 2, 0, LEVELS - 1.001)
        return gate * LEVELS + place.astype(np.int64), place - np.floor(place)

    def refined(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        at, share = self.places(x, gate)
        q = self.refine[at] * (1 - share) + self.refine[at + 1] * share
        return np.clip((_squash(x) + q) / 2, 1e-6, 1 - 1e-6)


class Learner:
    """A mixer that learns step by step, and what it takes to average it with others."""

    def __init__(self, mixer: Mixer) -> None:
        self.mixer = Mixer(mixer.weights.copy(), mixer.refine)
        self.gates = np.zeros(len(mixer.weights))
        self.power = np.zeros_like(mixer.weights)
        self.mass, self.goal = np.zeros(len(mixer.refine)), np.zeros(len(mixer.refine))

    def step(self, inputs: np.ndarray, gate: np.ndarray, bit: np.ndarray, times: np.ndarray, refine: bool = True) -> None:
        """Moves the weights of each gate by its mean gradient, at a rate that falls with the gradients so far."""
        x = self.mixer.guess(inputs, gate)
        n = len(self.gates)
        total = np.bincount(gate, times, n)
        if refine:
            self.gates += total
            at, share = self.mixer.places(x, gate)
            for cell, part in ((at, 1 - share), (at + 1, share)):
                self.mass += np.bincount(cell, times * part, len(self.mass))
                self.goal += np.bincount(cell, times * part * bit, len(self.mass))
        error = (bit - _squash(x)) * times
        for k in range(inputs.shape[1]):
            slope = np.bincount(gate, error * inputs[:, k], n) / np.maximum(total, 8)
            self.power[:, k] += slope * slope
            self.mixer.weights[:, k] += RATE * slope / np.sqrt(self.power[:, k] + 0.1)

    def sums(self) -> np.ndarray:
        return np.concatenate([self.gates, (self.mixer.weights * self.gates[:, None]).ravel(), self.mass, self.goal])


def averaged(start: Mixer, sums: np.ndarray) -> Mixer:
    """The mixer that many learners' sums() add up to."""
    n, (gates, inputs) = len(start.refine), start.weights.shape
    if not sums.any():
        return start
    seen, weights = sums[:gates], sums[gates : gates * (1 + inputs)].reshape(gates, inputs)
    weights = np.where(seen[:, None] > 0, weights / np.maximum(seen, 1e-9)[:, None], start.weights)
    mass, goal = sums[-2 * n : -n], sums[-n:]
    return Mixer(weights, (start.refine * PRIOR + goal) / (PRIOR + mass))


# ---------------------------------------------------------------- matches within a text

MATCH_BASE = np.cumsum([0, *(1 << b for b in MATCH_BITS)])
MATCH_START = Mixer.start(8, len(MATCH_BITS))


class Matches(NamedTuple):
    """The tokens at which a word is expected (an end counts as one more token of its row), whether it came, and the contexts' slots."""

    token: np.ndarray
    row: np.ndarray
    hit: np.ndarray
    slots: list[np.ndarray]
    gate: np.ndarray


def _matches(words: Words) -> Matches:
    n_rows, rows = len(words.first) - 1, words.rows()
    size = len(words.hashes) + n_rows
    row = np.repeat(np.arange(n_rows), np.diff(words.first) + 1)
    h = np.zeros(size, U64)
    h[np.arange(len(rows)) + rows] = words.hashes
    key = mix(h ^ row.astype(U64) * _ODD)
    order = np.argsort(key, kind="stable")
    before = np.full(size, -1)
    same = key[order[1:]] == key[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    t = np.arange(1, size)
    t = t[(row[1:] == row[:-1]) & (before[:-1] >= 0)]
    p = before[t - 1]
    expected = h[p + 1]
    hit = expected == h[t]
    two = (t >= 2) & (p >= 1)
    agree = two & (h[np.maximum(p - 1, 0)] == h[np.maximum(t - 2, 0)]) & (row[np.maximum(p - 1, 0)] == row[t]) & (row[np.maximum(t - 2, 0)] == row[t])
    came, asked = np.zeros(size + 3, bool), np.zeros(size + 3, bool)
    came[t + 3], asked[t + 3] = hit, True
    missed = np.maximum.accumulate(np.where(came[3:], -1, np.arange(size)))
    run = np.minimum(15, t - 1 - missed[t - 1])
    away = np.minimum(15, np.log2(t - p)).astype(np.int64)
    last = sum((came[t + 3 - k].astype(np.int64) << (k - 1)) | (asked[t + 3 - k].astype(np.int64) << (k + 2)) for k in (1, 2, 3))
    contexts = [run << 1 | agree, away << 1 | agree, last, (expected >> U64(64 - MATCH_BITS[3])).astype(np.int64)]
    return Matches(t, row[t], hit, [c + b for c, b in zip(contexts, MATCH_BASE, strict=False)], np.minimum(run, 3) << 1 | agree)


class MatchModel(NamedTuple):
    odds: np.ndarray
    mixer: Mixer

    def inputs(self, m: Matches) -> np.ndarray:
        return np.stack([*(self.odds[x] for x in m.slots), np.ones(len(m.hit))], 1)

    def score(self, m: Matches) -> np.ndarray:
        """log10 probability of each decision."""
        p = self.mixer.refined(self.mixer.guess(self.inputs(m), m.gate), m.gate)
        return np.log10(np.where(m.hit, p, 1 - p))


class MatchLearner:
    """Counts and weights, online: each slice is guessed from what came before it in the task."""

    def __init__(self) -> None:
        self.counts = np.zeros((2, MATCH_BASE[-1]))
        self.learner = Learner(MATCH_START)

    def learn(self, m: Matches, teaches: np.ndarray) -> None:
        some = teaches[m.row]
        m = Matches(m.token[some], m.row[some], m.hit[some], [x[some] for x in m.slots], m.gate[some])
        bit = m.hit.astype(np.float64)
        for at in np.array_split(np.arange(len(bit)), max(1, len(bit) >> 14)):
            part = Matches(m.token[at], m.row[at], m.hit[at], [x[at] for x in m.slots], m.gate[at])
            odds = [_stretch(self.counts[0][x], self.counts[1][x]) for x in part.slots]
            self.learner.step(np.stack([*odds, np.ones(len(at))], 1), part.gate, bit[at], np.ones(len(at)))
            for x in part.slots:
                self.counts[1] += np.bincount(x, bit[at], self.counts.shape[1])
                self.counts[0] += np.bincount(x, 1 - bit[at], self.counts.shape[1])

    def sums(self) -> np.ndarray:
        return np.concatenate([self.counts.ravel(), self.learner.sums()])


def _match_model(sums: np.ndarray) -> MatchModel:
    n = 2 * MATCH_BASE[-1]
    if not len(sums):
        sums = np.zeros(n)
    return MatchModel(_stretch(*sums[:n].reshape(2, -1)), averaged(MATCH_START, sums[n:]))


# ---------------------------------------------------------------- spelling

SLOT_BASE = np.cumsum([0, *(1 << b for b in SLOT_BITS)])
_FACTORS = [mix(np.array([k + 11], U64))[0] | U64(1) for k in range(4)]
SPELL_START = Mixer.start(8 * 8, len(SLOT_BITS) + 1)


class Code(NamedTuple):
    """Byte b is length[b] decisions: at node[b, d] the outcome bit[b, d]."""

    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def byte_code(counts: np.ndarray) -> Code:
    """A Huffman tree of all 256 bytes; rare ones count for more than they do, so that no path is long."""
    floor = counts.sum() / (1 << 14) + 1
    heap = [(max(float(c), floor), i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    children, made = {}, 256
    while len(heap) > 1:
        (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        children[made] = left, right
        heapq.heappush(heap, (a + b, made, made))
        made += 1
    paths, todo = {}, [(made - 1, ())]
    while todo:
        at, path = todo.pop()
        if at < 256:
            paths[at] = path
        else:
            todo += [(child, (*path, (at - 255, bit))) for bit, child in enumerate(children[at])]
    length = np.array([len(paths[b]) for b in range(256)])
    node, bit = np.zeros((256, length.max()), np.int64), np.zeros((256, length.max()), np.int64)
    for b, path in paths.items():
        node[b, : len(path)], bit[b, : len(path)] = zip(*path, strict=True)
    return Code(length, node, bit)


class Decisions(NamedTuple):
    """The decisions that spell some words: the word, the outcome, the slots of the hashed contexts, a key of the word so far (0 beyond WHOLE), the depth."""

    word: np.ndarray
    bit: np.ndarray
    slots: list[np.ndarray]
    whole: np.ndarray
    depth: np.ndarray


class Bytes(NamedTuple):
    """The bytes of words, each with a space after it; place: a byte's place in its word; sofar: a hash of the word before it."""

    flat: np.ndarray
    word: np.ndarray
    place: np.ndarray
    sofar: np.ndarray


def _bytes(words: pa.Array) -> Bytes:
    text = text_of(words)
    n = np.diff(text.offsets)
    begin = text.offsets[:-1] - text.offsets[0] + np.arange(len(n))
    flat = np.full(int(n.sum()) + len(n), 0x20, np.uint8)
    inside = np.ones(len(flat), bool)
    inside[begin + n] = False
    flat[inside] = text.data[text.offsets[0] : text.offsets[-1]]
    word = np.repeat(np.arange(len(n)), n + 1)
    place = np.arange(len(flat)) - begin[word]
    powers, inverse = _power_tables(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, U64)
    np.cumsum(mix(flat.astype(U64) + U64(1)) * powers[: len(flat)], out=sums[1:])
    sofar = mix((sums[:-1] - sums[begin[word]]) * inverse[begin[word]] + place.astype(U64) * _ODD) | U64(1)
    return Bytes(flat, word, place, np.where(place < WHOLE, sofar, U64(0)))


def _decisions(b: Bytes, code: Code, lo: int, hi: int) -> Decisions:
    """The decisions of the bytes lo..hi."""
    byte, place = b.flat[lo:hi], b.place[lo:hi]
    n = code.length[byte]
    at = np.repeat(np.arange(hi - lo), n)
    depth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    node = code.node[byte[at], depth].astype(U64)
    back = [np.where(place >= k, b.flat[np.maximum(np.arange(lo, hi) - k, 0)].astype(U64) + U64(1), U64(0)) for k in (1, 2, 3)]
    one, two = back[0], (back[0] * U64(257) + back[1]) * _FACTORS[0]
    three = (two + back[2]) * _FACTORS[1]
    slots = [np.minimum(place, 15)[at] << 8 | node.astype(np.int64)]
    for k, context in enumerate((one, two, three), 1):
        mixed = (context[at] * _FACTORS[2] + node) * _FACTORS[3]
        mixed ^= mixed >> U64(29)
        slots.append((mixed * _FACTORS[k] >> U64(64 - SLOT_BITS[k])).astype(np.int64) + SLOT_BASE[k])
    sofar = b.sofar[lo:hi][at]
    whole = np.where(sofar != 0, (sofar ^ node) * _FACTORS[2], U64(0))
    return Decisions(b.word[lo:hi][at].astype(np.int32), code.bit[byte[at], depth].astype(np.int8), [x.astype(np.int32) for x in slots], whole, depth.astype(np.int16))


class Speller(NamedTuple):
    """odds of the slots; edge: keys, n0 and n1 of the word-so-far contexts that several ranges share."""

    code: Code
    counts: np.ndarray
    edge: tuple[np.ndarray, np.ndarray, np.ndarray]
    mixer: Mixer


def _whole_counts(d: Decisions, times: np.ndarray, edge: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """n0 and n1 of each decision's word-so-far context, over all words of the range, and where it is shared, of all ranges."""
    known, inverse = np.unique(d.whole, return_inverse=True)
    w = times[d.word]
    n1 = np.bincount(inverse, w * d.bit, len(known))
    n0 = np.bincount(inverse, w, len(known)) - n1
    keys, all0, all1 = edge
    if len(keys):
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        here = known[at] == keys
        n0[at[here]], n1[at[here]] = all0[here], all1[here]
    n0[known == 0] = n1[known == 0] = 0
    return n0[inverse], n1[inverse]


def _gate(depth: np.ndarray, held: np.ndarray) -> np.ndarray:
    return np.minimum(depth, 7).astype(np.int64) * 8 + _seen(held)


def _inputs(counts: np.ndarray, d: Decisions, whole: tuple[np.ndarray, np.ndarray], own: float, at: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of every predictor, each without own times the decision itself, and the gates."""
    bit = d.bit[at]
    pairs = [(counts[0][x[at]], counts[1][x[at]]) for x in d.slots] + [(whole[0][at], whole[1][at])]
    out = np.ones((len(bit), len(pairs) + 1))
    for k, (n0, n1) in enumerate(pairs):
        if own:
            n0, n1 = np.maximum(0, n0 - own * (1 - bit)), np.maximum(0, n1 - own * bit)
        out[:, k] = _stretch(n0, n1)
    return out, _gate(d.depth[at], n0 + n1)


def learn_words(speller: Speller, words: pa.Array, times: np.ndarray) -> np.ndarray:
    """The sums() of a learner of a range's words, each of which counts for its times and is guessed from counts without one of it."""
    learner = Learner(speller.mixer)
    b = _bytes(words)
    d = _decisions(b, speller.code, 0, len(b.flat))
    whole = _whole_counts(d, times, speller.edge)
    weight = times[d.word].astype(np.float64)
    taught = weight > 0
    turn = (mix(np.arange(len(words), dtype=np.uint64)) >> U64(56)).astype(np.int64) % STEPS
    order = np.argsort(turn[d.word].astype(np.uint8), kind="stable")
    order = order[taught[order]]
    for epoch in range(EPOCHS):
        for at in np.array_split(order, STEPS):
            if len(at):
                inputs, gate = _inputs(speller.counts, d, whole, 1.0, at)
                learner.step(inputs, gate, d.bit[at].astype(np.float64), weight[at], epoch == EPOCHS - 1)
    return learner.sums()


def score_words(speller: Speller, words: pa.Array, times: np.ndarray) -> np.ndarray:
    """log10 probability of each word of a range and the space after it; times: how often each word of the range teaches."""
    b = _bytes(words)
    d = _decisions(b, speller.code, 0, len(b.flat))
    whole = _whole_counts(d, times, speller.edge)
    total = np.zeros(len(words))
    for lo in range(0, len(d.bit), STEP):
        at = slice(lo, lo + STEP)
        inputs, gate = _inputs(speller.counts, d, whole, 0.0, at)
        q = speller.mixer.refined(speller.mixer.guess(inputs, gate), gate)
        total += np.bincount(d.word[at], np.log10(np.where(d.bit[at] == 1, q, 1 - q)), len(words))
    return total


# ---------------------------------------------------------------- corpus


def _taken(text: Text, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The lower-cased bytes of some spans as a binary array."""
    n = ends - starts
    offsets = np.zeros(len(n) + 1, np.int32)
    np.cumsum(n, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], n) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[text.data[at]])])


def _rows_of(words: Words, limit: int = 1 << 17) -> Iterator[tuple[int, int, Words]]:
    """Runs of rows of at most limit words, or of one row."""
    n, lo = len(words.first) - 1, 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(words.first, words.first[lo] + limit, "right")) - 1))
        a, b = words.first[lo], words.first[hi]
        yield lo, hi, Words(words.starts[a:b], words.ends[a:b], words.hashes[a:b], words.first[lo : hi + 1] - a, words.sums)
        lo = hi


def _marked(kind: bytes, sums: np.ndarray) -> pa.RecordBatch:
    """Learned numbers as rows to be summed like counts."""
    at = np.flatnonzero(sums)
    names = pa.array([MARK + kind + int(i).to_bytes(4, "big") for i in at], pa.binary())
    values = pa.array(np.round(sums[at] * UNIT).astype(np.int64))
    return pa.RecordBatch.from_arrays([names, values, values], ["word", "c", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c, n): how often each word stands in training rows and in all; and what training rows say of bytes and matches."""
    learner, letters = MatchLearner(), np.zeros(256)
    for batch in batches:
        held = batch["held_out"]
        # Apart, so that not even the steps of learning depend on rows that are held out.
        for teaches, part in ((True, batch.filter(pc.invert(held))), (False, batch.filter(held))):
            for _, _, text in slices(text_of(part["text"]), 3 << 20):
                words = words_of(text)
                _, at, which = np.unique(words.hashes, return_index=True, return_inverse=True)
                n = np.bincount(which, minlength=len(at))
                if teaches:
                    letters += np.bincount(np.where(WHITESPACE, 0x20, LOWER)[text.data], minlength=256)
                    for a, b, rows in _rows_of(words):
                        learner.learn(_matches(rows), np.ones(b - a, bool))
                yield pa.RecordBatch.from_arrays([_taken(text, words.starts[at], words.ends[at]), signed(n * teaches), signed(n)], ["word", "c", "n"])
    yield _marked(b"b", letters)
    yield _marked(b"m", learner.sums())


def _summed(rows: pa.Table, kind: bytes, size: int) -> np.ndarray:
    """What _marked() rows of a kind add up to."""
    out = np.zeros(size)
    for word, value in zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True):
        if word[1:2] == kind:
            out[int.from_bytes(word[2:], "big")] = value / UNIT
    return out


def _joined(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.Table]:
    """The batches as tables of some rows, or as one."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if rows and n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    return table[name].chunk(0)


CHUNK = 1 << 12
_BLOB = "chunk int, key binary, n0 binary, n1 binary"


def _blobs(chunk: int, key: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (key.astype(np.int64), n0.astype(np.float64), n1.astype(np.float64)))], ["chunk", "key", "n0", "n1"])


def _slot_counter(shared):
    """Counts decisions by slot (chunk by chunk), and by the word-so-far contexts that ranges share (chunk -1)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, prefixes = shared.value
        counts = np.zeros(2 * SLOT_BASE[-1])
        for words in _joined(batches, 10_000):
            times = words["c"].to_numpy().astype(np.float64)
            b = _bytes(_column(words, "word"))
            d = _decisions(b, code, 0, len(b.flat))
            w = times[d.word]
            for at in d.slots:
                np.add.at(counts, at.astype(np.int64) * 2 + d.bit, w)
            own = np.repeat(np.isin(b.sofar, prefixes), code.length[b.flat])
            if own.any():
                known, inverse = np.unique(d.whole[own], return_inverse=True)
                yield _blobs(-1, known.view(np.int64), *(np.bincount(inverse, w[own] * (d.bit[own] == k), len(known)) for k in (0, 1)))
        n0, n1 = counts[0::2], counts[1::2]
        for lo in range(0, len(n0), CHUNK):
            some = np.flatnonzero(n0[lo : lo + CHUNK] + n1[lo : lo + CHUNK]) + lo
            if len(some):
                yield _blobs(lo // CHUNK, some, n0[some], n1[some])

    return count


def _sum_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One blob for each chunk, summed as they come."""
    held: dict[int, tuple] = {}
    for batch in batches:
        for chunk, *parts in zip(*(batch[x].to_pylist() for x in ("chunk", "key", "n0", "n1")), strict=True):
            new = [np.frombuffer(x, t) for x, t in zip(parts, (np.int64, np.float64, np.float64), strict=True)]
            key, n0, n1 = (np.concatenate(x) for x in zip(held.get(chunk, tuple(x[:0] for x in new)), new, strict=True))
            known, inverse = np.unique(key, return_inverse=True)
            held[chunk] = known, np.bincount(inverse, n0, len(known)), np.bincount(inverse, n1, len(known))
    for chunk, parts in held.items():
        yield _blobs(chunk, *parts)


def _shared_prefixes(ranges: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Hashes of the words so far that stand in more than one of the sorted ranges (first and last word of each)."""
    found = set()
    for (_, last), (first, _) in zip(ranges, ranges[1:], strict=False):
        n = 0
        while n < min(len(last), len(first), WHOLE - 1) and last[n] == first[n]:
            n += 1
        found |= {last[:k] for k in range(n + 1)}
    b = _bytes(pa.array(sorted(found), pa.binary()))
    return sorted_unique(b.sofar[np.append(b.place[1:] == 0, True)]) if found else np.zeros(0, U64)


def _speller(ranged: DataFrame, code: Code) -> Speller:
    """Counts of all training words; the mixer has learned nothing yet."""
    spark = ranged.sparkSession
    # Two rows of driver data for each range.
    ends = ranged.groupBy(F.spark_partition_id().alias("at")).agg(F.min("word").alias("first"), F.max("word").alias("last")).collect()
    prefixes = _shared_prefixes(sorted((bytes(r["first"]), bytes(r["last"])) for r in ends))
    shared = spark.sparkContext.broadcast((code, prefixes))
    tasks = 2 * spark.sparkContext.defaultParallelism
    blobs = ranged.where("c > 0").coalesce(tasks).mapInArrow(_slot_counter(shared), _BLOB)
    summed = blobs.repartition(tasks, "chunk").mapInArrow(_sum_blobs, _BLOB).toArrow()  # tables of fixed size
    counts, edge = np.zeros((2, SLOT_BASE[-1]), np.float32), (np.zeros(0, U64), np.zeros(0), np.zeros(0))
    for chunk, *parts in zip(*(summed[x].to_pylist() for x in ("chunk", "key", "n0", "n1")), strict=True):
        key, n0, n1 = (np.frombuffer(x, t) for x, t in zip(parts, (np.int64, np.float64, np.float64), strict=True))
        if chunk >= 0:
            counts[0, key], counts[1, key] = n0, n1
        else:
            edge = key.view(U64), n0, n1
    return Speller(code, counts, edge, SPELL_START)


def _learned(ranged: DataFrame, speller: Speller) -> Speller:
    """speller with a mixer that has learned from all training words, range by range."""
    shared = ranged.sparkSession.sparkContext.broadcast(speller)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _joined(batches):
            sums = learn_words(shared.value, _column(words, "word"), words["c"].to_numpy())
            yield pa.RecordBatch.from_arrays([list_array(pa.array(sums), np.array([len(sums)]))], ["x"])

    sums = ranged.where("c > 0").mapInArrow(learn, "x array<double>").select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.round(F.col("x") * UNIT).cast("bigint")).alias("x")).toArrow()
    if not sums.num_rows:
        return speller
    flat = np.zeros(sums.num_rows)
    flat[sums["i"].to_numpy()] = sums["x"].to_numpy() / UNIT
    return speller._replace(mixer=averaged(SPELL_START, flat))


def _ranged(vocabulary: DataFrame, n: int) -> DataFrame:
    """The words in sorted ranges of about RANGE_WORDS, whose bounds are words themselves.

    What a range learns depends on its bounds, so these are drawn by hash from the n words of training rows,
    BOUND_SAMPLE for each range: equal vocabularies have equal ranges, whatever the partitions.
    """
    ranges = max(LEAST_RANGES, -(-n // RANGE_WORDS))
    every = max(1, n // (ranges * BOUND_SAMPLE))
    drawn = sorted(bytes(r["word"]) for r in vocabulary.where((F.col("c") > 0) & (F.pmod(F.xxhash64("word"), F.lit(every)) == 0)).select("word").collect())
    bounds = sorted({drawn[len(drawn) * k // ranges] for k in range(1, ranges)}) if drawn else []
    shared = vocabulary.sparkSession.sparkContext.broadcast(bounds)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(shared.value, w) for w in batch["word"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], [*batch.schema.names, "range"])

    dealt = vocabulary.mapInArrow(placed, "word binary, c bigint, n bigint, range int").repartitionById(len(bounds) + 1, F.col("range"))
    return cut(dealt.sortWithinPartitions("word").drop("range"))


class Scorer(NamedTuple):
    """tokens: N; words: V; scored: (h, c, n, score) of every word of the corpus, h its hash, n how often it stands; matches: of words expected again."""

    tokens: int
    words: int
    end_count: int
    scored: DataFrame
    end_score: float
    matches: MatchModel


def train(docs: DataFrame) -> Scorer:
    """Counts docs (held_out, text), fits the model and scores every distinct word."""
    spark = prepared(docs.sparkSession)
    rows = docs.select("held_out", "text")
    counted = cut(rows.mapInArrow(_count_words, "word binary, c bigint, n bigint").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")))
    marked = F.substring("word", 1, 1) == F.lit(bytearray(MARK))
    learned = counted.where(marked).select("word", "n").toArrow()  # numbers of tables of fixed size
    letters = _summed(learned, b"b", 256)
    matches = _match_model(_summed(learned, b"m", 2 * int(MATCH_BASE[-1]) + len(Learner(MATCH_START).sums())))
    vocabulary = counted.where(~marked)
    known = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("c") > 0).cast("int")), F.lit(0)).alias("v")).first()
    ends = rows.where(~F.col("held_out")).count()
    tokens, words = int(known["n"]) + ends, int(known["v"]) + (ends > 0)
    # The end is the empty word.
    whole = vocabulary.unionByName(spark.createDataFrame([(bytearray(), ends, ends)], "word binary, c bigint, n bigint"))
    ranged = _ranged(whole, known["v"])
    speller = _learned(ranged, _speller(ranged, byte_code(letters)))
    shared = spark.sparkContext.broadcast(speller)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _joined(batches):
            c = found["c"].to_numpy()
            value = score_words(shared.value, _column(found, "word"), c)
            yield pa.RecordBatch.from_arrays([signed(_word_hashes(text_of(_column(found, "word")))), pa.array(c), _column(found, "n"), pa.array(value)], ["h", "c", "n", "score"])

    scored = cut(ranged.mapInArrow(score, "h bigint, c bigint, n bigint, score double"))
    end = scored.where(F.col("h") == 0).first()
    return Scorer(tokens, words, ends, scored.where(F.col("h") != 0), float(end["score"]), matches)


def _word_hashes(text: Text) -> np.ndarray:
    """The words' hashes; 0 for the empty one."""
    out = np.zeros(len(text.offsets) - 1, U64)
    for lo, hi, part in slices(text):
        some = np.flatnonzero(np.diff(part.offsets))
        out[lo + some] = words_of(part).hashes
    return out


def _head(scored: DataFrame, most: int) -> tuple[int, pa.Table]:
    """The lowest n that at most that many words reach, to three binary digits, and those words; none if too many share the highest."""
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2("n")) - 2, F.lit(0)))
    by_count = scored.groupBy((F.floor(F.col("n") / unit) * unit).cast("bigint").alias("low")).agg(F.count("*").alias("m")).collect()  # at most 4 rows for each binary place
    total, limit = 0, 1 << 62
    for r in sorted(by_count, key=lambda r: -r["low"]):
        total += r["m"]
        if total > most:
            break
        limit = r["low"]
    return limit, scored.where(F.col("n") >= limit).toArrow()


_TAIL = "array<struct<h:bigint,n:int,spelled:int>>"


def _document_scorer(shared, end: tuple[float, float, bool]):
    kind = pa.struct([("h", pa.int64()), ("n", pa.int32()), ("spelled", pa.int32())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_h, known_base, known_score, known_c, matches = shared.value
        for batch in batches:
            for lo, hi, text in slices(text_of(batch["text"])):
                words = words_of(text)
                rows, n = words.rows(), hi - lo
                m = _matches(words)
                ends = np.append(words.first[1:] + np.arange(n), -1)[m.row] == m.token
                total = np.bincount(m.row, matches.score(m), n)
                spelled = np.ones(len(rows))
                spelled[(m.token - m.row)[m.hit & ~ends]] = 0
                unique, which = np.unique(words.hashes, return_inverse=True)
                at = np.minimum(np.searchsorted(known_h, unique), max(0, len(known_h) - 1))
                found = known_h[at] == unique if len(known_h) else np.zeros(len(unique), bool)
                base, model, taught = np.zeros(len(unique)), np.zeros(len(unique)), np.zeros(len(unique))
                base[found], model[found], taught[found] = known_base[at[found]], known_score[at[found]], known_c[at[found]]
                tail = ~found[which]
                pairs, back, each = np.unique(rows[tail] * len(unique) + which[tail], return_inverse=True, return_counts=True)
                items = pa.StructArray.from_arrays([signed(unique[pairs % max(1, len(unique))]), pa.array(each, pa.int32()), pa.array(np.bincount(back, spelled[tail], len(pairs)).astype(np.int32))], fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch[x][lo:hi] for x in ("doc_id", "row", "held_out")),
                        signed(np.diff(words.first) + 1),
                        pa.array(np.bincount(rows, taught[which], n).astype(np.int64) + end[2]),
                        pa.array(np.bincount(rows, base[which], n) + end[0]),
                        pa.array(np.bincount(rows, model[which] * spelled, n) + total + end[1]),
                        list_array(items, np.bincount(pairs // max(1, len(unique)), minlength=n)),
                        signed(np.diff(text.offsets)),
                    ],
                    ["doc_id", "row", "held_out", "n_tokens", "n_known", "base_score", "score", "tail", "n_bytes"],
                )

    return score


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each whole text.

    bits_per_byte: -log2 of the probability over the text's bytes (null without bytes).
    """
    spark = prepared(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), held_out(F.col("doc_id")).alias("held_out"), "text")
    trained = train(rows)
    whole = np.log10(trained.tokens + trained.words + 1)
    limit, head = _head(trained.scored, HEAD)
    h = head["h"].to_numpy().view(U64)
    order = np.argsort(h)
    c = head["c"].to_numpy()[order]
    shared = spark.sparkContext.broadcast((h[order], np.log10(c + 1.0) - whole, head["score"].to_numpy()[order], c > 0, trained.matches))
    end = float(np.log10(trained.end_count + 1.0) - whole), trained.end_score, bool(trained.end_count)
    kind = rows.schema["doc_id"].dataType.simpleString()
    first = cut(rows.mapInArrow(_document_scorer(shared, end), f"doc_id {kind}, row bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, tail {_TAIL}, n_bytes bigint"))
    rare = trained.scored.where(F.col("n") < limit).select("h", (F.log10(F.col("c") + 1.0) - F.lit(float(whole))).alias("b"), F.col("score").alias("s"), (F.col("c") > 0).cast("int").alias("k"))
    # Rows of equal ids and texts have equal tails: one stands for all.
    distinct = first.where(F.size("tail") > 0).groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.first("tail").alias("tail"))
    each = distinct.select("_id", "_row", F.explode("tail").alias("x")).select("_id", "_row", "x.h", "x.n", "x.spelled")
    more = each.join(rare, "h").groupBy("_id", "_row").agg(F.sum(F.col("b") * F.col("n")).alias("b"), F.sum(F.col("s") * F.col("spelled")).alias("s"), F.sum(F.col("k") * F.col("n")).alias("k"))
    both = first.drop("tail").join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    zero = F.lit(0)
    total = F.col("score") + F.coalesce("s", zero)
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", zero)).alias("n_known"),
        F.lit(trained.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", zero)).alias("base_score"),
        total.alias("score"),
        F.when(F.col("n_bytes") > 0, -total * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
