"""Responses as JSON documents or as markdown.

Both come as rows with an order, so that a response of any length is written by all tasks;
``as_document`` joins the blocks of a bounded request into one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.text import line_span, or_default

# Labels of the response document.
TITLES = {"semantic": "Semantic", "fuzzy": "Fuzzy"}
RULE_TITLE = "## {title} Rules\n"
SYMBOL_TITLE = "## {title} Symbols\n"
NO_RULES = "_No additional {name} rules specified._"
NO_SYMBOLS = "**No {name} symbols found.**"


def symbol_json(symbol_columns: list[str]) -> Column:
    """JSON of one symbol, nulls included."""
    return F.to_json(F.struct(*symbol_columns), {"ignoreNullFields": "false"})


def symbol_markdown() -> Column:
    """Markdown of one symbol: lines and columns 1-based; hover and code only with code."""
    code = F.coalesce(F.col("code"), F.lit(""))
    return F.concat(
        F.lit("---\n\n- **Name:** `"),
        F.col("name"),
        F.lit("`\n- **Kind:** `"),
        F.col("kind"),
        F.lit("`\n- **Container:** "),
        or_default(F.col("container_name")),
        F.lit("\n- **Location:**\n    - URI: `"),
        F.col("uri"),
        F.lit("`\n    - Range: "),
        line_span(F.col("start_line"), F.col("end_line"), F.col("start_character"), F.col("end_character")),
        F.lit("\n"),
        F.when(
            code != "",
            F.concat(
                F.lit("- **Hover:** "), or_default(F.col("hover")), F.lit("\n- **Code:**\n```\n"), code, F.lit("\n```\n")
            ),
        ).otherwise(""),
    )


def _header(df: DataFrame, empty: str, title: str) -> DataFrame:
    """One row: the title, followed by the notice if ``df`` has no rows."""
    return df.limit(1).agg(F.count("*").alias("n")).select(
        F.when(F.col("n") == 0, F.lit(title + "\n" + empty + "\n")).otherwise(F.lit(title)).alias("text")
    )


def prompt_blocks(symbols: DataFrame, rules: DataFrame, list_name: str, section: int = 0) -> DataFrame:
    """Blocks ``(section, block, path, start_line, symbol_id, text)`` of one list.

    ``rules`` has ``position, text``; ``symbols`` has the symbol columns. In the order of the
    columns before ``text`` the blocks are the list's part of the response.
    """
    title = TITLES.get(list_name, list_name.capitalize())
    id_type = symbols.schema["symbol_id"].dataType

    def block(number: int, text: Column, *place: Column) -> list[Column]:
        path, line, symbol = place or (F.lit(""), F.lit(0), F.lit(0))
        return [
            F.lit(section).alias("section"),
            F.lit(number).alias("block"),
            path.alias("path"),
            line.cast("long").alias("start_line"),
            symbol.cast(id_type).alias("symbol_id"),
            text.alias("text"),
        ]

    rule_head = _header(rules, NO_RULES.format(name=list_name), RULE_TITLE.format(title=title))
    symbol_head = _header(symbols, NO_SYMBOLS.format(name=list_name), SYMBOL_TITLE.format(title=title))
    rule_rows = rules.select(
        *block(1, F.concat(F.lit("- "), F.col("text"), F.lit("\n")), F.lit(""), F.col("position"), F.lit(0))
    )
    symbol_rows = symbols.select(
        *block(3, symbol_markdown(), F.col("path"), F.col("start_line"), F.col("symbol_id"))
    )
    return (
        rule_head.select(*block(0, F.col("text")))
        .unionByName(rule_rows)
        .unionByName(symbol_head.select(*block(2, F.col("text"))))
        .unionByName(symbol_rows)
    )


def as_document(blocks: DataFrame) -> DataFrame:
    """The whole response of one request in one row. Only for responses bounded by request limits."""
    order = ["section", "block", "path", "start_line", "symbol_id"]
    return blocks.agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda b: b["text"]), "\n"
        ).alias("document")
    )
