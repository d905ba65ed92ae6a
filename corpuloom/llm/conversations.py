"""Repair of conversation structure: the cheapest edits that make roles alternate.

A conversation's rows must give role initials (s?(ua)+)?.  Each row is kept (0), given the
role that is due (3) or deleted (4; blank and repeated rows must be), rows without text may
be inserted (3), and what stays without a sentence's end costs 3 more.  Of the cheapest
edits those stand whose initials in order are ASCII-least.

The search runs over the states of the pattern.  A run of inserted rows and the edit of the
row behind it are one macro edit; its code (such as IK) ends at its only letter but I, so
codes are prefix-free and comparing strings of codes is comparing code by code.  A path then
needs no string: after each row the best paths to each state are ranked by the rank before
and the rank of the code, and a pointer to the state before is kept.  Edits are read back
along the pointers.

A conversation of any length is cut into segments of at most SEGMENT rows.  Each is folded
for every state that it may be entered in, which gives a small matrix of costs and ranks;
the matrices of a conversation's segments are folded in the same way, and each segment then
learns where it is entered and left.  Only a row for each SEGMENT rows and, as a SHA-256 is
sequential, the repaired text of conversations of several segments go through one task,
in a stream.

Defined results: a null role or text is one space; rows are taken by turn (nulls first), then
by role, text and, of long texts with the same first 64 characters, a hash; repeated rows are
rows by themselves; null conv_ids are one conversation; a conversation without rows has
zeros, no edits and the hash of nothing; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import arrow_map
from .common import cut, partitions, prepared

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: log2 of the rows of a segment.
SEGMENT_BITS = 12
#: Bytes of repaired text in an Arrow batch.
BATCH_BYTES = 1 << 22

#: State 0: no row yet; 1: a system row; 2: a user row; 3: an assistant row.  What may follow, and what is due when a row is made to fit.
FOLLOWS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
DUE = {0: "u", 1: "u", 2: "a", 3: "u"}
ENDS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
STATES = range(4)
INITIALS = "sua?"
NEVER = 1 << 60

Matrix = tuple[tuple[int, ...], tuple[int, ...]]


def _runs(state: int) -> Iterator[tuple[str, int]]:
    """Runs of inserted rows that return to no state, and the state after each."""
    run, seen = "", {state}
    yield run, state
    while (state := FOLLOWS[state][DUE[state]]) not in seen:
        run += "I"
        seen.add(state)
        yield run, state


@lru_cache(None)
def macros(kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """The cheapest macro edit, (cost, code), of a kind of row between two states."""
    initial, must_go, truncated = INITIALS[kind >> 2], kind >> 1 & 1, kind & 1
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for state in STATES:
        for run, at in _runs(state):
            edits = [("D", at, DELETE)]
            if not must_go:
                edits.append(("R", FOLLOWS[at][DUE[at]], REROLE + TRUNCATED * truncated))
                if initial in FOLLOWS[at]:
                    edits.append(("K", FOLLOWS[at][initial], KEEP + TRUNCATED * truncated))
            for letter, to, cost in edits:
                made = INSERT * len(run) + cost, run + letter
                best[state, to] = min(best.get((state, to), made), made)
    return best


CODES = sorted({code for kind in range(16) for _, code in macros(kind).values()})


@lru_cache(None)
def of_row(kind: int) -> Matrix:
    """A row's costs and ranks from state i to state j, at 4 * i + j."""
    found = macros(kind)
    pairs = [(i, j) for i in STATES for j in STATES]
    return tuple(found[p][0] if p in found else NEVER for p in pairs), tuple(CODES.index(found[p][1]) if p in found else 0 for p in pairs)


NOTHING: Matrix = tuple(0 if i == j else NEVER for i in STATES for j in STATES), (0,) * 16


@lru_cache(1 << 16)
def _step(before: Matrix, item: Matrix) -> tuple[int, Matrix, tuple[int, ...]]:
    """What all cost more, the paths after one more item, and the state that each came through."""
    (cost, rank), (more, code) = before, item
    best = []
    for i in range(0, 16, 4):
        for to in STATES:
            best.append(min((cost[i + by] + more[4 * by + to], rank[i + by], code[4 * by + to], by) if cost[i + by] < NEVER and more[4 * by + to] < NEVER else (NEVER, 0, 0, 0) for by in STATES))
    order = {key: n for n, key in enumerate(sorted({b[1:3] for b in best if b[0] < NEVER}))}
    base = min(b[0] for b in best)
    return base, (tuple(b[0] - base if b[0] < NEVER else NEVER for b in best), tuple(order[b[1:3]] if b[0] < NEVER else 0 for b in best)), tuple(b[3] for b in best)


def folded(items: Iterable[Matrix]) -> tuple[Matrix, list[tuple[int, ...]]]:
    """The matrix of all items in a row, and pointers to go back by."""
    paths, total, pointers = NOTHING, 0, []
    for item in items:
        base, paths, back = _step(paths, item)
        total += base
        pointers.append(back)
    return (tuple(c + total if c < NEVER else NEVER for c in paths[0]), paths[1]), pointers


def states_between(pointers: list[tuple[int, ...]], entry: int, leave: int) -> list[int]:
    """The states before the first item, between items and after the last."""
    states = [leave]
    for back in reversed(pointers):
        states.append(back[4 * entry + states[-1]])
    return states[::-1]


def ending(whole: Matrix) -> tuple[int, int, str]:
    """Cost, last state and the rows inserted behind it, of the best way through."""
    found = []
    for state in STATES:
        for run, at in _runs(state):
            if at in ENDS and whole[0][state] < NEVER:
                found.append((whole[0][state] + INSERT * len(run), whole[1][state], run, state))
    cost, _, run, state = min(found)
    return cost, state, run


def inserted(state: int, run: str) -> Iterator[tuple[str, int]]:
    """The role of each inserted row, and the state after it."""
    for _ in run:
        role = DUE[state]
        state = FOLLOWS[state][role]
        yield NAMES[role], state


# ---------------------------------------------------------------- rows


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of rows with faults made by a checksum of conv_id:turn."""
    text_of_ = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", text_of_("conv_id"), text_of_("turn"))) % 20
    text = text_of_("text")
    changed = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.array_repeat(F.lit(0), F.when(F.col("_fault") == 3, 2).otherwise(1))
    made = rows.withColumn("_fault", fault).where("_fault <> 0").select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(text_of_("role")).alias("role"), changed.alias("text"), F.explode(copies).alias("_copy"))
    return made.drop("_copy")


def _dealt(rows: DataFrame) -> DataFrame:
    """rows in order, numbered by _pos: over ranges, which may divide a conversation."""
    order = ["conv_id", "turn", "role", F.left("text", F.lit(64)), F.xxhash64("text"), "_id"]
    numbered = rows.withColumn("_id", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return cut(ranged.drop("_id").withColumn("_pos", F.monotonically_increasing_id()))


def _segment() -> Column:
    return F.shiftright("_pos", SEGMENT_BITS)


def _stream(rows: DataFrame, firsts: DataFrame, *extra: DataFrame) -> DataFrame:
    """rows with the marks of those that repeat none before them, by segment and in order; marks stand before their rows."""
    marks = firsts.select("_pos", F.lit(1).alias("_kind"))
    all_of = rows.withColumn("_kind", F.lit(2)).unionByName(marks, allowMissingColumns=True)
    for more in extra:
        all_of = all_of.unionByName(more.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    segment = _segment()
    return all_of.withColumn("_segment", segment).repartition(partitions(rows.sparkSession), "_segment").sortWithinPartitions("_segment", "_pos", "_kind")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, list[dict]]]:
    """What is known of each segment of a conversation, and its rows, each with its kind."""
    known, first_of, held = None, None, []
    for row in _rows(batches):
        if row["_kind"] == 0:
            known_next = row
            if held:
                yield known, held
            known, held = known_next, []
            continue
        if row["_kind"] == 1:
            first_of = row["_pos"]
            continue
        if held and (held[0]["conv_id"], held[0]["_segment"]) != (row["conv_id"], row["_segment"]):
            yield known, held
            known, held = None, []
        repeated = first_of != row["_pos"]
        fault = "blank" if row["blank"] else "duplicate" if repeated else "truncated" if row["open"] else None
        row["fault"] = fault
        row["kind"] = INITIALS.index(row["initial"]) << 2 | (fault in ("blank", "duplicate")) << 1 | (fault == "truncated")
        held.append(row)
    if held:
        yield known, held


_LEGAL = {"su", "ua", "au"}
_FOUND = "conv_id bigint, _pos bigint, _last bigint, first string, last string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost array<bigint>, rank array<int>"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each segment: its faults, edges and matrix."""
    schema = pa.schema([("conv_id", pa.int64()), ("_pos", pa.int64()), ("_last", pa.int64()), ("first", pa.string()), ("last", pa.string()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("cost", pa.list_(pa.int64())), ("rank", pa.list_(pa.int32()))])
    made: list[dict] = []
    for _, rows in _segments(batches):
        (cost, rank), _ = folded(of_row(r["kind"]) for r in rows)
        initials = [r["initial"] for r in rows]
        faults = [r["fault"] for r in rows]
        made.append({"conv_id": rows[0]["conv_id"], "_pos": rows[0]["_pos"], "_last": rows[-1]["_pos"], "first": initials[0], "last": initials[-1], "cost": cost, "rank": rank, "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)), **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")}})
        if len(made) >= 1000:
            yield pa.RecordBatch.from_pylist(made, schema)
            made = []
    yield pa.RecordBatch.from_pylist(made, schema)


_PLANNED = "conv_id bigint, _pos bigint, entry int, leave int, ends string, segments int, blank bigint, duplicate bigint, truncated bigint, illegal bigint, total bigint"


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each segment is entered and left; the last of a conversation has its sums and what is inserted at the end."""
    schema = pa.schema([("conv_id", pa.int64()), ("_pos", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("ends", pa.string()), ("segments", pa.int32()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "total"))])
    made: list[dict] = []
    for conv, group in groupby(_rows(batches), key=lambda r: r["conv_id"]):
        places, items, faults, illegal, last = [], [], [0, 0, 0], 0, None
        for r in group:
            places.append(r["_pos"])
            items.append((tuple(r["cost"]), tuple(r["rank"])))
            faults = [n + r[f] for n, f in zip(faults, ("blank", "duplicate", "truncated"), strict=True)]
            illegal += r["illegal"] + (last is not None and last + r["first"] not in _LEGAL)
            last = r["last"]
        whole, pointers = folded(items)
        total, leave, run = ending(whole)
        states = states_between(pointers, 0, leave)
        for n, place in enumerate(places):
            row = {"conv_id": conv, "_pos": place, "entry": states[n], "leave": states[n + 1], "segments": len(places)}
            if n == len(places) - 1:
                row |= {"ends": run, "illegal": illegal, "total": total} | dict(zip(("blank", "duplicate", "truncated"), faults, strict=True))
            made.append(row)
            if len(made) >= 1000:
                yield pa.RecordBatch.from_pylist(made, schema)
                made = []
    yield pa.RecordBatch.from_pylist(made, schema)


def repaired_segment(known: dict, rows: list[dict]) -> tuple[str, list[tuple[str, str]]]:
    """The initials of the edits, and the role and text of each row after them."""
    _, pointers = folded(of_row(r["kind"]) for r in rows)
    states = states_between(pointers, known["entry"], known["leave"])
    audit, lines = [], []
    for row, a, b in zip(rows, states, states[1:], strict=False):
        code = macros(row["kind"])[a, b][1]
        audit.append(code)
        for role, a in inserted(a, code[:-1]):  # noqa: B020, PLW2901
            lines.append((role, ""))
        if code[-1] != "D":
            lines.append((row["role"] if code[-1] == "K" else NAMES[DUE[a]], row["text"]))
    if known["ends"]:
        audit.append(known["ends"])
        lines += [(role, "") for role, _ in inserted(states[-1], known["ends"])]
    return "".join(audit), lines


_PIECES = "conv_id bigint, _pos bigint, segments int, audit string, lines bigint, repaired string"


def _repaired(hashed: bool):
    """Pieces of repaired conversations; hashed: those of one segment as their SHA-256."""
    schema = pa.schema([("conv_id", pa.int64()), ("_pos", pa.int64()), ("segments", pa.int32()), ("audit", pa.string()), ("lines", pa.int64()), ("repaired", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for known, rows in _segments(batches):
            audit, lines = repaired_segment(known, rows)
            text = "\n".join(f"{role}:{t}" for role, t in lines)
            if hashed and known["segments"] == 1:
                text = hashlib.sha256(text.encode()).hexdigest()
            made.append({"conv_id": rows[0]["conv_id"], "_pos": rows[0]["_pos"], "segments": known["segments"], "audit": audit, "lines": len(lines), "repaired": text})
            size += len(text)
            if len(made) >= 1000 or size > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(made, schema)
                made, size = [], 0
        yield pa.RecordBatch.from_pylist(made, schema)

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, audit and hash of conversations of several segments, whose pieces come in order."""
    for conv, group in groupby(_rows(batches), key=lambda r: r["conv_id"]):
        audit, digest, any_line = [], hashlib.sha256(), False
        for r in group:
            audit.append(r["audit"])
            if r["lines"]:
                digest.update((("\n" if any_line else "") + r["repaired"]).encode())
                any_line = True
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]))


class Repair:
    """Conversations of rows (conv_id, turn, role, text) and their cheapest repair."""

    def __init__(self, rows: DataFrame):
        self.spark = prepared(rows.sparkSession)
        whole = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
        self.rows = _dealt(rows.select("conv_id", "turn", whole("role"), whole("text")))
        initial = F.left("role", F.lit(1))
        self._flags = {"initial": F.when(initial.isin("s", "u", "a"), initial).otherwise("?"), "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "open": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")}
        self._firsts = cut(self.rows.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("_pos").alias("_pos")).select("_pos"))
        slim = self.rows.select("conv_id", "_pos", *(c.alias(n) for n, c in self._flags.items()))
        found = arrow_map(_stream(slim, self._firsts), _summaries, _FOUND)
        n = partitions(self.spark)
        self.plan = cut(arrow_map(found.repartition(n, "conv_id").sortWithinPartitions("conv_id", "_pos"), _planned, _PLANNED))

    def totals(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal and cost of each conversation that has rows."""
        turns = self.rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0).cast("bigint")).alias("gaps"))
        sums = self.plan.where(F.col("total").isNotNull()).select(F.col("conv_id").alias("_c"), "blank", "duplicate", "truncated", "illegal", F.col("total").alias("cost"))
        return turns.join(sums, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")

    def _pieces(self, hashed: bool) -> DataFrame:
        rows = self.rows.select("conv_id", "_pos", "role", "text", *(c.alias(n) for n, c in self._flags.items()))
        known = self.plan.select("conv_id", "_pos", "entry", "leave", "ends", "segments")
        return arrow_map(_stream(rows, self._firsts, known), _repaired(hashed), _PIECES)

    def texts(self) -> DataFrame:
        """conv_id, _pos (order of the pieces), audit and repaired, the rows as role:text lines, of each segment."""
        return self._pieces(False).select("conv_id", "_pos", "audit", "repaired")

    def digests(self) -> DataFrame:
        """conv_id, audit and repaired_sha256 of each conversation that has rows."""
        pieces = cut(self._pieces(True))
        single = pieces.where("segments = 1").select("conv_id", "audit", F.col("repaired").alias("repaired_sha256"))
        several = pieces.where("segments > 1").repartition(partitions(self.spark), "conv_id").sortWithinPartitions("conv_id", "_pos")
        return single.unionByName(arrow_map(several, _joined, "conv_id bigint, audit string, repaired_sha256 string"))


def repair_report(original: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id of original, and gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of the repair of rows."""
    repair = Repair(rows)
    same = lambda c: F.col("conv_id").eqNullSafe(F.col(c))
    totals = repair.totals().withColumnRenamed("conv_id", "_c1")
    digests = repair.digests().withColumnRenamed("conv_id", "_c2")
    both = original.select("conv_id").distinct().join(totals, same("_c1"), "left").join(digests, same("_c2"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return both.select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
