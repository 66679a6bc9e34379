"""Optional check of a JSON statement's outline before it is run."""

from __future__ import annotations

from typing import Any

#: What each command may name. None: its clause is checked by the compiler.
OBJECTS: dict[str, frozenset[str] | None] = {
    "select": None, "insert": None, "update": None, "delete": None, "truncate": None, "explain": None, "set": None,
    "show": frozenset({"tables", "schemas"}),
    "create": frozenset({"database", "schema", "table", "column", "constraint", "index", "sequence"}),
    "alter": frozenset({"table", "column", "constraint", "index", "sequence"}),
    "drop": frozenset({"database", "schema", "table", "column", "constraint", "index", "sequence"}),
}


def problems(statement: Any) -> list[str]:
    """What is wrong with a statement or a list of them; empty if nothing is."""
    if isinstance(statement, list):
        return [f"{i}: {p}" for i, s in enumerate(statement) for p in problems(s)]
    if isinstance(statement, str):
        return [] if statement.strip() else ["empty text"]
    if not isinstance(statement, dict):
        return [f"a statement is an object, a list or text, not {type(statement).__name__}"]
    if len(statement) != 1:
        return [f"a statement has one command, not {len(statement)}"]
    (command, clause), = statement.items()
    if command not in OBJECTS:
        return [f"unknown command: {command}"]
    known = OBJECTS[command]
    if known is None:
        return [f"{command}: empty"] if clause is None else []
    if command == "show" and isinstance(clause, str):
        return [] if clause in known else [f"show: unknown {clause}"]
    out = []
    for part in clause if isinstance(clause, list) else [clause]:
        if not isinstance(part, dict) or not part:
            out.append(f"{command}: names no object")
            continue
        out += [f"{command}: unknown {k}" for k in part if k not in known]
        if command in ("create", "drop", "show") and len(part) > 1:
            out.append(f"{command}: one object at a time, not {len(part)}")
    return out
