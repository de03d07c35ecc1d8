"""Symbol kinds: code and name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The symbol kinds of the public language-server protocol, codes 1 to 26.
KIND_NAMES = (
    "File", "Module", "Namespace", "Package", "Class", "Method", "Property", "Field",
    "Constructor", "Enum", "Interface", "Function", "Variable", "Constant", "String",
    "Number", "Boolean", "Array", "Object", "Key", "Null", "EnumMember", "Struct",
    "Event", "Operator", "TypeParameter",
)


def kind_name(code: Column) -> Column:
    """Name of a kind code; null for an unknown code. A literal array, so no join is needed."""
    return F.get(F.array(*[F.lit(n) for n in KIND_NAMES]), code.cast("int") - 1)


def kind_code(name: Column) -> Column:
    """Code of a kind name; null for an unknown name."""
    at = F.array_position(F.array(*[F.lit(n) for n in KIND_NAMES]), name)
    return F.when(at > 0, at)
