"""Settings of an engine, from the environment where it sets them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    parent_size: int = 2000
    child_size: int = 500
    flat_size: int = 1500
    overlap: float = 0.1
    parent_child: bool = True
    fetch_k: int = 5
    passages: int = 3
    rerank: bool = False
    test_limit: int | None = 10
    history_entries: int = 3
    price_days: int = 14
    price_rows: int = 5

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        """REPORTMILL_<NAME> overrides a field; an empty test limit or one of 0 means all files."""
        env = dict(os.environ) if env is None else env
        known = {}
        for f in fields(cls):
            text = env.get(f"REPORTMILL_{f.name.upper()}")
            if text is None:
                continue
            if f.name == "test_limit":
                known[f.name] = int(text or 0) or None
            elif f.type == "bool":
                known[f.name] = text.strip().lower() in ("1", "true", "yes")
            else:
                known[f.name] = float(text) if f.type == "float" else int(text)
        return cls(**known)
