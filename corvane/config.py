"""Settings, passed explicitly; nothing reads the environment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

EXTENSIONS = (".js", ".json", ".md", ".py", ".ts", ".txt", ".yaml", ".yml")


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 500
    chunk_overlap: int = 50
    #: Size and overlap for an extension without its dot, e.g. ``{"md": (800, 80)}``.
    chunk_configs: Mapping[str, tuple[int, int]] = field(default_factory=dict)
    rrf_k: int = 60
    top_k: int = 10
    default_results: int = 5
    oversample: int = 3
    min_relevant: int = 3
    max_broaden: int = 2
    answer_chunk_size: int = 10_000
    extensions: tuple[str, ...] = EXTENSIONS

    def chunk_params(self, extension: str) -> tuple[int, int]:
        return self.chunk_configs.get(extension.lower().lstrip("."), (self.chunk_size, self.chunk_overlap))
