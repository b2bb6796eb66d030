"""Settings from the environment, clamped."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from typing import ClassVar


def _bool(v: str) -> bool:
    return v.strip().lower() in {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class Settings:
    top_k: int = 8
    min_tokens: int = 200
    max_tokens: int = 800
    target_tokens: int = 500
    dimension: int = 64
    batch: int = 256
    rerank_enabled: bool = False
    rerank_candidates: int = 10
    rewrite_enabled: bool = False
    summaries_enabled: bool = False
    selector_enabled: bool = False
    threshold: float = 0.85
    timeout: float = 2.0
    cache_size: int = 256
    summary_chars: int = 400
    route_boost: float = 1.3
    noise_penalty: float = 0.7
    intent_boost: float = 1.2
    provider: str = "gemini"

    #: Least and largest values.
    LIMITS: ClassVar[dict] = {"threshold": (0.0, 1.0), "timeout": (0.1, None), "cache_size": (1, None), "summary_chars": (64, None),
              "route_boost": (0.1, None), "noise_penalty": (0.1, None), "intent_boost": (0.1, None), "rerank_candidates": (1, None), "top_k": (1, 50)}

    @classmethod
    def from_env(cls, prefix: str = "LODESTAR_", env: dict[str, str] | None = None) -> Settings:
        """A value that does not parse gives way to the default; numbers are clamped; an unknown provider is the default one."""
        env = dict(os.environ) if env is None else env
        out = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is None:
                continue
            kind = type(f.default)
            try:
                v = _bool(raw) if kind is bool else kind(raw)
            except ValueError:
                continue
            low, high = cls.LIMITS.get(f.name, (None, None))
            if low is not None:
                v = max(low, v)
            if high is not None:
                v = min(high, v)
            out[f.name] = v
        if out.get("provider") not in (None, "gemini", "openai"):
            out.pop("provider")
        return cls(**out)


