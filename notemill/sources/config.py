"""Settings from YAML: processing options, word lists and spellings. They are small and read on the driver.

A file's path is looked for in order: the one given, the environment variable named, the
working directory. Environment variables override single settings.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

VARIABLE = "NOTEMILL_CONFIG"


@dataclass(frozen=True)
class Config:
    """What a run may set; what a file does not name keeps its default."""

    include: tuple[str, ...] = ("**/*.md",)
    exclude: tuple[str, ...] = ("**/.obsidian/**", "**/node_modules/**", "**/.git/**")
    max_links: int = 50
    exclude_tables: bool = False
    threshold: float = 0.7
    stop_words: tuple[str, ...] = ()
    spellings: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())


def located(path: str | None = None, name: str = "notemill.yaml") -> str | None:
    """The first of the given path, the one in VARIABLE, and name in the working directory that is a file; None if there is none. A given path must be one."""
    if path is not None and not os.path.isfile(path):
        raise FileNotFoundError(path)
    return next((p for p in (path, os.environ.get(VARIABLE), name) if p and os.path.isfile(p)), None)


def _typed(kind: Any, value: Any) -> Any:
    if isinstance(kind, bool):
        return value if isinstance(value, bool) else str(value).lower() in ("true", "yes", "1", "on")
    if isinstance(kind, tuple):
        return tuple((k, tuple(v)) for k, v in value.items()) if isinstance(value, dict) else tuple(value) if isinstance(value, list) else tuple(x.strip() for x in str(value).split(","))
    return type(kind)(value)


def load(path: str | None = None, environment: Mapping[str, str] | None = None) -> Config:
    """The settings of a file, then those of the environment (NOTEMILL_MAX_LINKS=10); an unknown name in a file is an error."""
    import yaml

    found = located(path)
    data = {}
    if found:
        with open(found, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
    known = {x.name: x.default for x in fields(Config)}
    if unknown := set(data) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    environment = os.environ if environment is None else environment
    data |= {n: environment[f"NOTEMILL_{n.upper()}"] for n in known if f"NOTEMILL_{n.upper()}" in environment}
    return Config(**{n: _typed(known[n], v) for n, v in data.items()})
