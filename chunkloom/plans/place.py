"""The symbol placer: where the project's symbols should live, and the rules that apply."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.config import PlacerParams
from chunkloom.operators.placement import place_symbols
from chunkloom.operators.render import symbol_json
from chunkloom.operators.rules import match_rules, rule_text_parts
from chunkloom.operators.symbols import attach_code, filter_kinds
from chunkloom.sources.rules import Ruleset


@dataclass(frozen=True)
class PlacerResult:
    """Symbols of the project, places for those that should move, rule texts in parts, which
    are matched when first asked for."""

    symbols: DataFrame
    places: DataFrame
    ruleset: Ruleset

    @cached_property
    def rules(self) -> DataFrame:
        return rule_text_parts(match_rules(self.symbols, self.ruleset), self.ruleset)

    def json(self) -> DataFrame:
        """One JSON document per symbol, place and part of a rule text."""
        return (
            self.rules.select(F.lit("rules").alias("list"), F.to_json(F.struct("*")).alias("json"))
            .unionByName(self.symbols.select(F.lit("symbols").alias("list"), symbol_json(self.symbols.columns).alias("json")))
            .unionByName(self.places.select(F.lit("places").alias("list"), symbol_json(self.places.columns).alias("json")))
        )


def symbols_placer(
    docs: DataFrame,
    symbols: DataFrame,
    references: DataFrame,
    ruleset: Ruleset,
    params: PlacerParams | None = None,
) -> PlacerResult:
    """Place the symbols of the configured kinds by the files that use them."""
    params = params or PlacerParams()
    wanted = attach_code(filter_kinds(symbols, params.kinds), docs)
    places = place_symbols(filter_kinds(symbols, params.kinds), references, params.use_max_distance)
    return PlacerResult(wanted, places, ruleset)
