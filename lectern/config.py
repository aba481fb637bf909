"""Defaults shared by the operators. Every operator takes them as arguments."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Budget:
    """Token limits of the context fusion; ``None`` means no limit for that source."""

    total: int = 6000
    rag: int | None = 4000
    cag: int | None = 1500
    mag: int | None = 1000
    conversation: int | None = 1000
    min_score: float = 0.0

    def of(self, source: str) -> int | None:
        return {"rag": self.rag, "cag": self.cag, "mag": self.mag, "conversation": self.conversation}[source]


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 512
    chunk_overlap: int = 64
    chunk_strategy: str = "sentence_aware"
    lines_per_page: int = 60
    page_chars: int = 3000
    max_upload_mb: int = 25
    embedding_dim: int = 384
    top_k: int = 5
    candidates: int = 20
    threshold: float = 0.3
    alpha: float = 0.7
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    memory_window: int = 100
    memory_top_k: int = 5
    conflict_window: int = 20
    cache_chars: int = 4000
    context_chars: int = 12000
    history_messages: int = 10
    prompt_turns: int = 6
    budget: Budget = field(default_factory=Budget)


DEFAULTS = Settings()
