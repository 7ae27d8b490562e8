"""Settings: defaults, then a TOML file, then the environment (DOSSIERKIT_...), then what the caller gives."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    store: str = "archive"
    source: str = "records"
    objects: str = ""  # folder of artifact files; empty: none
    object_prefix: str = "artifacts"
    fanout: int = 4
    chunk_bytes: int = 2048
    chunk_overlap: int = 256
    embed_dimensions: int = 64
    text_in_raw: bool = True

    def __post_init__(self) -> None:
        if not 0 <= self.chunk_overlap < self.chunk_bytes:
            raise ValueError("chunk_overlap must be smaller than chunk_bytes")
        if self.fanout < 0 or self.embed_dimensions < 1:
            raise ValueError("fanout must not be negative, embed_dimensions must be positive")


def _typed(name: str, value: object) -> object:
    kind = type(getattr(Config, name))
    if kind is bool and isinstance(value, str):
        return value.strip().lower() in ("1", "true", "yes", "on")
    return kind(value)


def load(path: str | None = None, env: dict[str, str] | None = None, **given: object) -> Config:
    """The settings in force; keys that no setting has are refused in the file and the call."""
    names = {f.name for f in fields(Config)}
    layers: list[dict] = []
    if path:
        with open(path, "rb") as f:
            layers.append(tomllib.load(f))
    env = dict(os.environ) if env is None else env
    layers.append({n: env[f"DOSSIERKIT_{n.upper()}"] for n in names if f"DOSSIERKIT_{n.upper()}" in env})
    layers.append({k: v for k, v in given.items() if v is not None})
    out = Config()
    for layer in layers:
        if unknown := set(layer) - names:
            raise ValueError(f"no such setting: {', '.join(sorted(unknown))}")
        out = replace(out, **{k: _typed(k, v) for k, v in layer.items()})
    return out
