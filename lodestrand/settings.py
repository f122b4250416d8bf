"""Settings with defaults, from the environment or a file of NAME=value lines."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """What the pipeline can be told; each field is read from LODESTRAND_<FIELD>."""

    data_dir: str = "datademo"
    index_dir: str = "vector_store"
    model: str = ""
    embedding_model: str = "text-embedding-3-small"
    chunk_size: int = 800
    chunk_overlap: int = 120
    only_summary: bool = True
    top_k_summary: int = 3
    top_k_meeting: int = 3
    top_k_chunk: int = 5
    index_prefix: str = "meeting_rag"
    timeout_sec: int = 30
    current_user: str = ""
    app_name: str = "agents"

    @classmethod
    def read(cls, path: str | None = None, env: Mapping[str, str] | None = None) -> Settings:
        """Defaults, over them the file's lines if it is there, over them the environment."""
        given: dict[str, str] = {}
        if path and Path(path).exists():
            rows = [row.split("=", 1) for row in Path(path).read_text(encoding="utf-8").splitlines() if "=" in row and not row.lstrip().startswith("#")]
            given |= {k.strip(): v.strip().strip("'\"") for k, v in rows}
        given |= dict(os.environ if env is None else env)
        found = {}
        for f in fields(cls):
            text = given.get(f"LODESTRAND_{f.name.upper()}")
            if text is not None:
                kind = type(f.default)
                found[f.name] = text.lower() in ("1", "true", "yes", "on") if kind is bool else kind(text)
        return cls(**found)
