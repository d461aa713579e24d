"""Settings: a JSON file, with ``${NAME}`` replaced by environment variables, overridden by LOREKILN_<SETTING>."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

TRUE = ("1", "true")


def resolve(value: object, env: Mapping[str, str]) -> object:
    """``${NAME}`` in texts, at any depth, becomes the variable's value, or nothing if it is not set."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], ""), value)
    if isinstance(value, dict):
        return {k: resolve(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve(v, env) for v in value]
    return value


def as_bool(value: object) -> bool:
    return value if isinstance(value, bool) else str(value).lower() in TRUE


@dataclass(frozen=True)
class Settings:
    """``snapshot_every``: a backup after that many saves, 0 for none. ``skew_ms``: how far clocks may be apart."""

    root: str = "data"
    dimension: int = 64
    snapshot_every: int = 50
    skew_ms: int = 300_000
    chunk_size: int = 1_000_000
    compress: bool = True
    require_encryption: bool = False
    least_confidence: float = 0.5
    pull_interval: str = "5 minutes"


def load(path: str | None = None, env: Mapping[str, str] | None = None) -> Settings:
    """Unknown names in the file are an error; a value of the wrong type as well."""
    env = os.environ if env is None else env
    given = resolve(json.loads(Path(path).read_text()), env) if path else {}
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    if extra := sorted(set(given) - set(kinds)):
        raise ValueError("unknown settings: " + ", ".join(extra))
    given |= {n: env[key] for n in kinds if (key := f"LOREKILN_{n.upper()}") in env}
    return Settings(**{n: as_bool(v) if kinds[n] is bool else kinds[n](v) for n, v in given.items()})
