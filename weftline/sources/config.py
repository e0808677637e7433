"""Settings from a file of ``key: value`` lines in sections, a ``.env`` file, and the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass
class Config:
    project_root: str = "."
    embedder: str = "hashing"
    embed_dimension: int = 64
    embed_batch: int = 64
    embed_url: str = ""
    embed_model: str = ""
    embed_key: str = ""
    writer: str = "none"
    writer_url: str = ""
    writer_model: str = ""
    writer_key: str = ""
    #: Parquet table of a type checker's references, and whether names resolve within their package first.
    typed_refs: str = ""
    package_first: bool = False
    #: Whether declared types decide before names, and how many buckets the tables of a new store have.
    types: bool = False
    store_buckets: int = 16
    max_embed_chunks: int = 80
    max_llm_sections: int = 2
    max_llm_routes: int = 2
    max_hops: int = 2
    min_confidence: float = 0.0
    enable_semantic_match: bool = True
    enable_llm_routing: bool = False


def parse_bool(text: str) -> bool:
    return text.strip().lower() in ("1", "true", "yes", "on")


def _cast(name: str, text: str):
    kind = next(f.type for f in fields(Config) if f.name == name)
    return parse_bool(text) if kind == "bool" else int(text) if kind == "int" else float(text) if kind == "float" else text


def _lines(path: str, separator: str) -> dict[str, str]:
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        pairs = (line.split("#")[0].partition(separator) for line in f)
        return {k.strip().lower(): v.strip().strip("\"'") for k, s, v in pairs if s and v.strip()}


def load(path: str = "config.yaml", env_file: str = ".env", env: Mapping[str, str] | None = None, prefix: str = "WEFTLINE_") -> Config:
    """Later sources win: file, ``.env``, environment (prefix and upper-case names)."""
    env = os.environ if env is None else env
    named = {f.name for f in fields(Config)}
    found = {k: v for k, v in _lines(path, ":").items() if k in named}
    for source in (_lines(env_file, "="), {k.lower(): v for k, v in env.items()}):
        found |= {k.removeprefix(prefix.lower()): v for k, v in source.items() if k.startswith(prefix.lower()) and k.removeprefix(prefix.lower()) in named}
    return Config(**{k: _cast(k, v) for k, v in found.items()})
