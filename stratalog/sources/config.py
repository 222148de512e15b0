"""Strict JSON configuration with environment placeholders."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path
from typing import Any

PLACEHOLDER = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}")


class ConfigError(ValueError):
    pass


def resolve(value: Any, env: dict[str, str] | None = None) -> Any:
    """Replace strings that are one placeholder as a whole; others stay."""
    env = dict(os.environ) if env is None else env
    if isinstance(value, dict):
        return {k: resolve(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve(v, env) for v in value]
    if isinstance(value, str) and (m := PLACEHOLDER.fullmatch(value)):
        if m[1] not in env:
            raise ConfigError(f"environment variable {m[1]} is not set")
        return env[m[1]]
    return value


def check_fields(value: dict, allowed: dict[str, Any], at: str = "") -> None:
    """allowed: field -> type or a nested mapping; unknown fields and wrong types are errors."""
    for name, given in value.items():
        if name not in allowed:
            raise ConfigError(f"unknown field {at}{name}")
        want = allowed[name]
        if isinstance(want, dict):
            if not isinstance(given, dict):
                raise ConfigError(f"{at}{name} must be an object")
            check_fields(given, want, f"{at}{name}.")
        elif not isinstance(given, want) or isinstance(given, bool) and want is int:
            raise ConfigError(f"{at}{name} has the wrong type")


def load(path: str, allowed: dict[str, Any], env: dict[str, str] | None = None) -> dict:
    def once(pairs: list[tuple[str, Any]]) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ConfigError("repeated field")
        return out

    value = json.loads(Path(path).read_text(encoding="utf-8"), object_pairs_hook=once)
    if not isinstance(value, dict):
        raise ConfigError("the top level must be an object")
    value = resolve(value, env)
    check_fields(value, allowed)
    return value
