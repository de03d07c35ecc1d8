"""Regex lists and path globs as Spark predicates."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Regex syntax that only one of the two dialects (Java, RE2-like) accepts or that
# they read differently. Patterns that use it are refused when they are loaded.
_DIALECT_ONLY = re.compile(r"\\[ZGRXkQE]|\(\?<?[=!]|\(\?>|\(\?P|\[\[:|[*+?}]\+|\\[1-9]")


def check_regex(pattern: str) -> str:
    """Return ``pattern`` if it is a regex of the common dialect, else raise ``ValueError``."""
    # classes of letters and the end of the text are written otherwise in Python, and mean the same
    plain = re.sub(r"\\[pP](?:\{\w+\}|[A-Z])", r"\\w", pattern).replace(r"\z", "$")
    if _DIALECT_ONLY.search(plain):
        raise ValueError(f"regex {pattern!r} uses look-around, back-references, possessive quantifiers or names that only one dialect has")
    try:
        re.compile(plain)
    except re.error as err:
        raise ValueError(f"bad regex {pattern!r}: {err}") from err
    return pattern


def any_of(conditions: Sequence[Column]) -> Column:
    """Disjunction; false for an empty list."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def any_regex(value: Column, patterns: Sequence[str]) -> Column:
    """True if any pattern is found in ``value`` (unanchored). An empty list or a null value is false.

    The patterns are literals, so each is compiled once per task.
    """
    return F.coalesce(any_of([value.rlike(check_regex(p)) for p in patterns]), F.lit(False))


def glob_to_regex(glob: str) -> str:
    """Translate a glob to an anchored regex.

    ``*`` and ``?`` stop at ``/``; ``**`` crosses it; ``**/`` also matches nothing;
    ``{a,b}`` are alternatives and ``[...]`` a character class.
    """
    out, i, depth = [], 0, 0
    while i < len(glob):
        char = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if char == "[" and glob.find("]", i + 2) > 0:
            end = glob.find("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end + 1
            continue
        if char == "*":
            out.append("[^/]*")
        elif char == "?":
            out.append("[^/]")
        elif char == "{":
            depth += 1
            out.append("(?:")
        elif char == "}" and depth:
            depth -= 1
            out.append(")")
        elif char == "," and depth:
            out.append("|")
        elif char == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(char))
        i += 1
    if depth:
        raise ValueError(f"glob {glob!r} has an unclosed brace")
    return "^" + "".join(out) + "$"


def glob_match(path: Column, globs: Sequence[str]) -> Column:
    """True if the whole path matches any of the globs; false for an empty list."""
    return F.coalesce(any_of([path.rlike("(?s)" + glob_to_regex(g)) for g in globs]), F.lit(False))
