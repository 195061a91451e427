"""Settings objects to and from JSON, and the short hash that names runs and stages."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, fields, is_dataclass
from typing import get_type_hints


def to_dict(cfg) -> dict:
    return asdict(cfg)


def from_dict(cls, data: dict):
    """Builds ``cls`` from a dictionary; unknown keys are ignored, nested settings and tuples restored."""
    hints, values = get_type_hints(cls), {}
    for f in fields(cls):
        if f.name not in data:
            continue
        value, kind = data[f.name], hints[f.name]
        if is_dataclass(kind) and isinstance(value, dict):
            value = from_dict(kind, value)
        elif isinstance(value, list):
            value = tuple(value)
        elif kind is float and isinstance(value, (int, str)) and not isinstance(value, bool):
            value = float(value)
        elif kind is int and isinstance(value, (float, str)):
            value = int(float(value))
        values[f.name] = value
    return cls(**values)


def settings_hash(cfg) -> str:
    """Twelve hexadecimal digits fixed by the settings."""
    data = asdict(cfg) if is_dataclass(cfg) else cfg
    return hashlib.sha256(json.dumps(data, sort_keys=True, default=str).encode()).hexdigest()[:12]


def save(cfg, path: str) -> None:
    with open(path, "w") as f:
        json.dump(asdict(cfg), f, indent=2, sort_keys=True)


def load(cls, path: str):
    with open(path) as f:
        return from_dict(cls, json.load(f))
