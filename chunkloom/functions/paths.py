"""Path and URI arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uri_to_path(uri: Column) -> Column:
    """Absolute path of a ``file:`` URI, percent-decoded; null for anything else."""
    raw = F.regexp_extract(uri, "^file://(?:localhost)?(/[^?#]*)$", 1)
    # url_decode reads "+" as a blank, which a path does not mean.
    return F.when(raw != "", F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))


def path_to_uri(path: Column) -> Column:
    """``file:`` URI of an absolute path; null for a relative one."""
    encoded = F.url_encode(path)
    for code, char in (("%2F", "/"), ("+", "%20"), ("%3A", ":"), ("%40", "@")):
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return F.when(path.startswith("/"), F.concat(F.lit("file://"), encoded))


def absolute_path(root: Column, path: Column) -> Column:
    """``path`` itself if absolute, else below ``root``."""
    return F.when(path.startswith("/"), path).otherwise(
        F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), path)
    )


def parent_path(path: Column) -> Column:
    """Directory of a path; the root is its own child's parent and has none itself."""
    cut = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(path == "/", F.lit(None)).when((cut == "") & path.startswith("/"), F.lit("/")).otherwise(cut)


def components(path: Column) -> Column:
    """Non-empty components of a path."""
    return F.filter(F.split(path, "/"), lambda part: part != "")


def prefixes(path: Column) -> Column:
    """Every leading directory of a path and the path itself, from the root ``""`` on.

    For absolute paths: ``/a/b`` gives ``["", "/a", "/a/b"]``; the element at index ``d`` has
    ``d`` components.
    """
    clean = F.rtrim(F.regexp_replace(path, "/+", "/"), F.lit("/"))
    depth = F.length(clean) - F.length(F.replace(clean, F.lit("/"), F.lit("")))
    return F.transform(
        F.sequence(F.lit(1), depth + 1), lambda d: F.call_function("substring_index", clean, F.lit("/"), d)
    )


def path_distance(left: Column, right: Column) -> Column:
    """Steps up from ``left`` to the deepest common directory and down to ``right``."""
    a, b = components(left), components(right)
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    # The shorter array is padded with nulls, so an equal run stops at its end.
    differ = F.array_position(same, F.lit(False)).cast("int")
    common = F.when(differ > 0, differ - 1).otherwise(F.least(F.size(a), F.size(b)))
    return F.size(a) + F.size(b) - common * 2
