"""Answers of a model for the messages of each file, the model being a function that the caller injects."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import arrow_map

# What stands between the answers of one file, and how a failed one begins.
SEPARATOR = "\n\n---\n\n"
ERROR = "[LLM error"
THREADS = 8

Call = Callable[[list[dict]], "str | tuple[str, int, int]"]


def answered(parts: DataFrame, call: Call) -> DataFrame:
    """uri, message, answer, prompt_tokens and completion_tokens of each message of encoded parts.

    call takes a message's parts (type, text) in order and gives its answer, or that and the tokens of
    prompt and answer; a call that raises is answered by a text that begins with ERROR.  Calls of a batch
    run in up to THREADS threads.  A task that is run again calls again: write the answers (or keep them in
    a Cache) before they are used twice.
    """

    def one(message: list[dict]) -> tuple[str, int, int]:
        try:
            got = call([{"type": p["type"], "text": p["text"]} for p in message])
        except Exception as e:
            return f"{ERROR}: {e}]", 0, 0
        return (got or "", 0, 0) if isinstance(got, str) or got is None else got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(THREADS) as pool:
            for batch in batches:
                answers = list(pool.map(one, batch["parts"].to_pylist()))
                columns = [pa.array([a[i] for a in answers], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch["uri"], batch["message"], *columns], ["uri", "message", "answer", "prompt_tokens", "completion_tokens"])

    messages = parts.groupBy("uri", "message").agg(F.array_sort(F.collect_list(F.struct("part", "type", "text"))).alias("parts"))
    return arrow_map(messages, run, "uri string, message int, answer string, prompt_tokens bigint, completion_tokens bigint")


def merged_json(answers: list[str]) -> str:
    """One array of all answers: arrays one after the other, other values as they are, what is no JSON as a string."""
    out = []
    for answer in answers:
        try:
            value = json.loads(answer)
        except json.JSONDecodeError:
            value = answer
        out += value if isinstance(value, list) else [value]
    return json.dumps(out)


def joined_answers(answers: DataFrame, *, separator: str = SEPARATOR, json_mode: bool = False) -> DataFrame:
    """uri, text, errors and the tokens of each file: its good answers in order, joined; failed ones are listed in errors.

    In JSON mode the answers become one array.  Empty answers are left out; without a good one the text is empty.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("message", "answer"))), lambda x: F.coalesce(x["answer"], F.lit("")))
    bad = lambda x: x.startswith(ERROR)
    each = answers.groupBy("uri").agg(ordered.alias("_all"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    split = each.select("uri", F.filter("_all", lambda x: (x != "") & ~bad(x)).alias("good"), F.filter("_all", bad).alias("errors"), "prompt_tokens", "completion_tokens")
    if not json_mode:
        return split.select("uri", F.array_join("good", separator).alias("text"), "errors", "prompt_tokens", "completion_tokens")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([merged_json(g) if g else "" for g in batch["good"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch["uri"], texts, *(batch[c] for c in ("errors", "prompt_tokens", "completion_tokens"))], ["uri", "text", "errors", "prompt_tokens", "completion_tokens"])

    return arrow_map(split, merge, "uri string, text string, errors array<string>, prompt_tokens bigint, completion_tokens bigint")
