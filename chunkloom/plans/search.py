"""The code-reuse search: by meaning and by name, with the rules that apply."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.config import SearchParams
from chunkloom.functions.paths import path_to_uri
from chunkloom.operators.chunking import verify_chunks
from chunkloom.operators.embedding import Embedder, check_model, embed_queries
from chunkloom.operators.names import search_names
from chunkloom.operators.render import prompt_blocks, symbol_json
from chunkloom.operators.rules import rules_for_request
from chunkloom.operators.symbols import attach_code, attach_hover, filter_kinds, next_symbols, of_few_paths
from chunkloom.operators.vectors import nearest, nearest_in_cells
from chunkloom.session import materialize
from chunkloom.sources.rules import Ruleset

SYMBOL_COLUMNS = [
    "symbol_id", "path", "uri", "name", "kind", "container_name", "start_line", "start_character",
    "end_line", "end_character", "name_line", "name_character", "hover", "code",
]


@dataclass(frozen=True)
class Corpus:
    """What a search runs on: the chunk table, documents with ``lines``, symbols and hovers."""

    chunks: DataFrame
    docs: DataFrame
    symbols: DataFrame
    hovers: DataFrame


@dataclass(frozen=True)
class SearchResult:
    """Two lists of symbols, each with its rules, which are matched when first asked for."""

    semantic: DataFrame
    fuzzy: DataFrame
    ruleset: Ruleset

    @cached_property
    def semantic_rules(self) -> DataFrame:
        return rules_for_request(self.semantic, self.ruleset)

    @cached_property
    def fuzzy_rules(self) -> DataFrame:
        return rules_for_request(self.fuzzy, self.ruleset)

    def blocks(self) -> DataFrame:
        """The markdown response in ordered blocks."""
        return prompt_blocks(self.semantic, self.semantic_rules, "semantic", 0).unionByName(
            prompt_blocks(self.fuzzy, self.fuzzy_rules, "fuzzy", 1)
        )

    def response(self, kind: str) -> DataFrame:
        """The response of the configured type, ``prompt`` or ``json``."""
        return self.json() if kind == "json" else self.blocks()

    def json(self) -> DataFrame:
        """The JSON response, one document per rule and symbol."""
        parts = []
        for name, symbols, rules in (
            ("semantic", self.semantic, self.semantic_rules),
            ("fuzzy", self.fuzzy, self.fuzzy_rules),
        ):
            parts.append(rules.select(F.lit(f"{name}_rules").alias("list"), F.to_json(F.struct("position", "text")).alias("json")))
            parts.append(symbols.select(F.lit(f"{name}_symbols").alias("list"), symbol_json(SYMBOL_COLUMNS).alias("json")))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def semantic_hits(
    chunks: DataFrame,
    queries: DataFrame,
    embedder: Embedder,
    params: SearchParams,
    policy: str = "mean",
    centroids: np.ndarray | None = None,
    verify: bool = True,
) -> DataFrame:
    """The nearest chunks of each ``(query_id, text)``; rows with a wrong id are left out unless ``verify`` is off.

    With ``centroids`` the chunks have a ``cell`` and each query probes ``params.probes`` cells:
    less work, and hits in other cells are missed.
    """
    check_model(chunks, embedder)
    sound = verify_chunks(chunks).filter("ok").drop("ok") if verify else chunks
    asked = embed_queries(queries, embedder, policy)
    if centroids is None:
        return nearest(sound, asked, params.hits_per_query, params.metric)
    return nearest_in_cells(sound, asked, centroids, params.hits_per_query, params.probes, params.metric)


def _detailed(found: DataFrame, corpus: Corpus, name: str) -> DataFrame:
    """A request's symbols with code and hover.

    The symbols are few by the request's limits and written first: the documents and hovers
    are then filtered by their paths during the scan instead of being shuffled.
    """
    few = materialize(found, name)
    full = attach_code(few, of_few_paths(corpus.docs, few))
    full = attach_hover(full, of_few_paths(corpus.hovers, few))
    full = full.withColumn("uri", path_to_uri(F.col("path"))).select(*SYMBOL_COLUMNS)
    return materialize(full, f"{name}-detailed")


def semantic_symbols(corpus: Corpus, hits: DataFrame, params: SearchParams) -> DataFrame:
    """The symbols that follow the hit chunks, with code and hover."""
    of_hits = of_few_paths(filter_kinds(corpus.symbols, params.kinds), hits)
    return _detailed(next_symbols(hits, of_hits), corpus, "semantic")


def fuzzy_symbols(corpus: Corpus, patterns: Sequence[str], params: SearchParams) -> DataFrame:
    """The symbols whose names match, with code and hover; one row per pattern that matches."""
    found = search_names(
        filter_kinds(corpus.symbols, params.kinds),
        patterns,
        params.name_mode,
        params.symbols_per_pattern,
        params.max_edits,
    )
    return _detailed(found, corpus, "fuzzy")


def code_reuse_search(
    corpus: Corpus,
    semantic_queries: DataFrame,
    name_patterns: Sequence[str],
    ruleset: Ruleset,
    embedder: Embedder,
    params: SearchParams | None = None,
    policy: str = "mean",
    centroids: np.ndarray | None = None,
) -> SearchResult:
    """Answer one request: nearest chunks to symbols, names to symbols, rules for each list.

    The hits and the two lists are used several times and bounded by the request's limits,
    so each is written once to the shared folder.
    """
    params = params or SearchParams()
    ask = partial(semantic_hits, corpus.chunks, semantic_queries, embedder, params, policy, centroids)
    hits = materialize(ask(verify=False), "hits")
    # Ids are checked on the hits; only if one is wrong are all chunks checked, for those that move up.
    if not verify_chunks(hits).filter(~F.col("ok")).isEmpty():
        hits = materialize(ask(), "hits")
    semantic = semantic_symbols(corpus, hits, params)
    fuzzy = fuzzy_symbols(corpus, name_patterns, params)
    return SearchResult(semantic, fuzzy, ruleset)
