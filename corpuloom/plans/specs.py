"""Pipeline specifications from files: JSON, TOML, and YAML where a reader is installed."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

try:
    import yaml
except ImportError:
    yaml = None


def loaded(path: str | Path) -> list[dict]:
    """The documents of a file: several in YAML or JSON lists, one otherwise."""
    path = Path(path)
    if path.suffix == ".toml":
        return [tomllib.loads(path.read_text())]
    if path.suffix == ".json":
        found = json.loads(path.read_text())
        return found if isinstance(found, list) else [found]
    if yaml is None:
        raise ImportError(f"reading {path.name} takes a YAML reader; use .json or .toml")
    return [x for x in yaml.safe_load_all(path.read_text()) if x]


def located(name: str, *folders: str | Path) -> Path:
    """The first of a path as it is, or name with a known suffix in one of the folders."""
    if Path(name).is_file():
        return Path(name)
    for folder in folders:
        for suffix in (".toml", ".yaml", ".yml", ".json"):
            if (found := Path(folder) / f"{name}{suffix}").is_file():
                return found
    raise FileNotFoundError(name)


def by_kind(documents: list[dict]) -> dict[str, dict]:
    """Specifications keyed by kind; a later one of the same kind wins."""
    out = {}
    for d in documents:
        if "kind" not in d:
            raise ValueError("a pipeline needs a kind")
        out[d["kind"]] = d
    return out
