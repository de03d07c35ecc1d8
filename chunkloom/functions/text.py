"""Small text functions used by the renderers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The HTML entities of auto-escaped output, ampersand first.
HTML_ENTITIES = (
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#x27;"),
    ("/", "&#x2F;"),
)


def html_escape(value: Column) -> Column:
    for char, entity in HTML_ENTITIES:
        value = F.replace(value, F.lit(char), F.lit(entity))
    return value


def or_default(value: Column, default: str = "(none)") -> Column:
    """``default`` for a null or empty text."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def hover_text(hover: Column) -> Column:
    """One text from a hover struct with the fields ``scalar``, ``parts`` and ``markup``.

    ``scalar`` and the elements of ``parts`` are structs ``(language, value)`` with a null
    language for plain strings; parts are joined by newlines.
    """
    return F.coalesce(
        hover["scalar"]["value"],
        F.array_join(F.transform(hover["parts"], lambda part: part["value"]), "\n"),
        hover["markup"],
    )


def line_span(start_line: Column, end_line: Column, start_char: Column, end_char: Column) -> Column:
    """1-based location text of a 0-based range."""
    return F.format_string(
        "lines %d-%d, columns %d-%d", start_line + 1, end_line + 1, start_char + 1, end_char + 1
    )
