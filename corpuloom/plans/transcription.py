"""A registry of transcribers: functions of a file's bytes that give (start, end, text) segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import arrow_map

Transcribe = Callable[[bytes, dict], "list[tuple[float, float, str]]"]


@dataclass(frozen=True)
class Backend:
    """available tells whether the backend can run here; settings go to every call."""

    name: str
    transcribe: Transcribe
    available: Callable[[], bool] = lambda: True
    settings: dict = field(default_factory=dict)


_BACKENDS: dict[str, Backend] = {}
#: The only backend that is taken without being asked for.
DEFAULT = "openai"


def register(backend: Backend) -> None:
    """Adds a backend in place of any of the same name."""
    _BACKENDS[backend.name] = backend


def unregister(name: str) -> bool:
    """Whether there was one."""
    return _BACKENDS.pop(name, None) is not None


def backends() -> list[tuple[str, bool]]:
    """Names, in order of registration, and whether each is available."""
    return [(b.name, b.available()) for b in _BACKENDS.values()]


def chosen(name: str | None = None, **settings: object) -> Backend | None:
    """The backend of a name, available or not, with the settings that are not None laid over its own; without a name the default, if available."""
    if name is None:
        found = _BACKENDS.get(DEFAULT)
        return found if found is not None and found.available() else None
    found, given = _BACKENDS.get(name), {k: v for k, v in settings.items() if v is not None}
    return Backend(found.name, found.transcribe, found.available, found.settings | given) if found is not None and given else found


def transcribed(files: DataFrame, backend: Backend, data: str = "content") -> DataFrame:
    """path and segments (start, end, text) of each file's bytes; files without bytes have none."""
    run, given = backend.transcribe, backend.settings
    shape = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64()), ("text", pa.string())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("start", "end", "text"), s, strict=True)) for s in run(d, given)] if d else [] for d in batch["data"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(rows, shape)], ["path", "segments"])

    return arrow_map(files.selectExpr("path", f"`{data}` AS data"), read, "path string, segments array<struct<start: double, end: double, text: string>>")
