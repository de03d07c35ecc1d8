"""Rule sets from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from chunkloom.functions.patterns import check_regex, glob_to_regex


def _texts(value: Any, what: str) -> tuple[str, ...]:
    if not isinstance(value, (list, tuple)) or not all(isinstance(v, str) for v in value):
        raise ValueError(f"{what} must be a list of strings")
    return tuple(value)


@dataclass(frozen=True)
class Rule:
    """Texts attached to the symbols that match a kind, a name, a path and a code pattern."""

    kind: tuple[str, ...]
    name: tuple[str, ...]
    path: tuple[str, ...]
    code: tuple[str, ...]
    rules: tuple[str, ...]

    def __post_init__(self) -> None:
        for pattern in (*self.kind, *self.name, *self.code):
            check_regex(pattern)
        for glob in self.path:
            glob_to_regex(glob)


@dataclass(frozen=True)
class Ruleset:
    """Common texts and rules; a rule is known by its position in the list."""

    common: tuple[str, ...] = ()
    depends_on: tuple[Rule, ...] = field(default=())


def parse_rules(data: Any) -> Ruleset:
    """Check a loaded YAML document and compile its patterns."""
    if not isinstance(data, dict) or "common" not in data or "depends_on" not in data:
        raise ValueError("a rule set needs the keys common and depends_on")
    rules = []
    for i, entry in enumerate(data["depends_on"] or ()):
        missing = {"kind", "name", "path", "code", "rules"} - set(entry)
        if missing:
            raise ValueError(f"rule {i} lacks {sorted(missing)}")
        rules.append(Rule(**{k: _texts(entry[k], f"rule {i}: {k}") for k in ("kind", "name", "path", "code", "rules")}))
    return Ruleset(_texts(data["common"] or (), "common"), tuple(rules))


def load_rules(path: str | Path) -> Ruleset:
    """Read a rule file; called per request so that edits take effect at once."""
    import yaml

    try:
        data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except yaml.YAMLError as err:
        raise ValueError(f"bad rule file {path}: {err}") from err
    return parse_rules(data)
