"""Scopes: nested trees that include, exclude and rename schemas, tables, columns, constraints and indexes."""

from __future__ import annotations

from fnmatch import fnmatchcase
from typing import Any


class NotIncluded(Exception):
    """The scope leaves this name out."""


def _rank(key: str, position: int) -> tuple:
    """How specific an entry is: names without ``*`` before all others, then more wildcards, then more other characters, then the later."""
    stars = key.count("*")
    return (stars == 0, stars, len(key) - stars - key.startswith("~"), position)


def merge(a: Any, b: Any) -> Any:
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: merge(a[k], b[k]) if k in a and k in b else b.get(k, a.get(k)) for k in {**a, **b}}
    return b


def _entries(scope: Any, kind: str) -> dict | None:
    """The entries for children of ``kind``; None includes all."""
    if scope is None or scope is True or not isinstance(scope, dict):
        return None
    found = scope.get(kind)
    if found is None or found is True:
        return None
    if isinstance(found, (list, tuple)):
        return {k: True for k in found}
    return found


def find(scope: Any, kind: str, name: str, tag: str | None = None) -> tuple[str, Any]:
    """(alias, child scope) of a real name; raises ``NotIncluded``.

    Entries match by wildcard, a leading ``~`` inverts; an entry's name under ``tag`` replaces its key for matching. All
    that match are merged, the most specific last.
    """
    entries = _entries(scope, kind)
    if entries is None:
        return name, True
    hits = []
    for i, (key, value) in enumerate(entries.items()):
        pattern = value.get(tag, key) if tag and isinstance(value, dict) and isinstance(value.get(tag), str) else key
        invert = pattern.startswith("~")
        if fnmatchcase(name, pattern.lstrip("~")) != invert:
            plain = not invert and not any(c in key for c in "*?[~")
            hits.append((_rank(key, i), key if plain else name, value))
    hits.sort(key=lambda h: h[0])
    out: Any = {}
    for _, _, value in hits:
        out = merge(out, {"enabled": False} if value is False else {"enabled": True, **value} if isinstance(value, dict) else {"enabled": True})
    if not hits or not out.get("enabled", True):
        raise NotIncluded(name)
    return hits[-1][1], out


def translation(scope: Any, kind: str, names: list[str], tag: str | None = None) -> dict[str, tuple[str, Any]]:
    """real name -> (alias, child scope) for the names included."""
    out = {}
    for n in names:
        try:
            out[n] = find(scope, kind, n, tag)
        except NotIncluded:
            continue
    return out


def real_name(scope: Any, kind: str, alias: str, tag: str | None = None) -> str:
    """The name that ``alias`` has in the database ``tag``."""
    entries = _entries(scope, kind) or {}
    value = entries.get(alias)
    return value[tag] if tag and isinstance(value, dict) and isinstance(value.get(tag), str) else alias
