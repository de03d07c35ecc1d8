"""Retrieval-corpus engine on Spark: chunk, embed, keep fresh, search, place."""

from chunkloom.config import ChunkParams, EngineConfig, PlacerParams, SearchParams

__all__ = ["ChunkParams", "EngineConfig", "PlacerParams", "SearchParams"]
