"""Parameters of the engine, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class ChunkParams:
    """Line chunking: ``size`` lines per chunk, ``overlap`` lines shared with the next."""

    size: int = 5
    overlap: int = 2

    def __post_init__(self) -> None:
        if self.size < 1:
            raise ValueError(f"chunk size must be at least 1, got {self.size}")
        if not 0 <= self.overlap <= self.size - 1:
            raise ValueError(
                f"chunk overlap must be between 0 and size - 1 = {self.size - 1}, got {self.overlap}"
            )

    @property
    def stride(self) -> int:
        return self.size - self.overlap


@dataclass(frozen=True)
class SearchParams:
    """Request limits. An empty ``kinds`` means that no kind is filtered out."""

    hits_per_query: int = 10
    symbols_per_pattern: int = 32
    kinds: tuple[str, ...] = ()
    metric: str = "l2"
    name_mode: str = "subsequence"
    max_edits: int = 2
    probes: int = 8

    def __post_init__(self) -> None:
        if self.hits_per_query < 1 or self.symbols_per_pattern < 1:
            raise ValueError("search limits must be at least 1")
        if self.metric not in ("l2", "cosine", "dot"):
            raise ValueError(f"unknown metric {self.metric!r}")
        if self.name_mode not in ("substring", "subsequence", "levenshtein"):
            raise ValueError(f"unknown name mode {self.name_mode!r}")


@dataclass(frozen=True)
class PlacerParams:
    kinds: tuple[str, ...] = ("Class", "Enum", "Struct")
    use_max_distance: bool = True


@dataclass(frozen=True)
class EngineConfig:
    chunks: ChunkParams = field(default_factory=ChunkParams)
    search: SearchParams = field(default_factory=SearchParams)
    placer: PlacerParams = field(default_factory=PlacerParams)
    globs: tuple[str, ...] = ("**/*",)
    embed_batch: int = 100
    model: str = "hash-64"
    index_embeddings: bool = False
    debounce: str = "1 second"
    response: str = "prompt"
    rules: str | None = None

    def __post_init__(self) -> None:
        if self.embed_batch < 1:
            raise ValueError("embed_batch must be at least 1")
        if self.response not in ("prompt", "json"):
            raise ValueError(f"unknown response type {self.response!r}")


def _at(data: Any, keys: str, default: Any) -> Any:
    for key in keys.split("."):
        if not isinstance(data, dict) or key not in data:
            return default
        data = data[key]
    return default if data is None else data


def load_config(path: str | Path) -> EngineConfig:
    """Read the data-processing settings of a YAML configuration; other keys are ignored."""
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    default = EngineConfig()
    limit = "search.fuzzy.server_options.workspace.symbol.search.limit"
    seconds = _at(data, "debounce_sec", 1)
    return EngineConfig(
        chunks=ChunkParams(
            _at(data, "search.semantic.chunk_size", default.chunks.size),
            _at(data, "search.semantic.overlap_size", default.chunks.overlap),
        ),
        search=SearchParams(
            hits_per_query=_at(data, "search.semantic.search_limit", default.search.hits_per_query),
            symbols_per_pattern=_at(data, limit, default.search.symbols_per_pattern),
        ),
        placer=PlacerParams(
            tuple(_at(data, "placer.final_symbol_kinds", default.placer.kinds)),
            _at(data, "placer.use_max_distance", default.placer.use_max_distance),
        ),
        globs=(_at(data, "search.semantic.pattern", default.globs[0]),),
        embed_batch=_at(data, "search.semantic.batch_size", default.embed_batch),
        model=_at(data, "search.semantic.model", default.model),
        index_embeddings=_at(data, "search.semantic.index_embeddings", False),
        debounce=f"{seconds} seconds",
        response=str(_at(data, "response", default.response)).lower(),
        rules=_at(data, "rules", None),
    )
