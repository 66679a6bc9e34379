"""Symmetric differences of nested documents."""

from __future__ import annotations

from typing import Any

INSERT, DELETE = "+", "-"


def diff(a: Any, b: Any) -> Any:
    """``{}`` if equal; ``+`` holds what only ``b`` has, ``-`` what only ``a`` has; changed leaves are ``[a, b]``.

    Dicts without a common key are a pair, like leaves.
    """
    if a == b:
        return {}
    if not (isinstance(a, dict) and isinstance(b, dict)) or not a or not b or not set(a) & set(b):
        if isinstance(a, dict) and isinstance(b, dict) and (not a or not b):
            return {INSERT: b} if b else {DELETE: a}
        return [a, b]
    out: dict = {}
    for k in a.keys() & b.keys():
        if d := diff(a[k], b[k]):
            out[k] = d
    if more := {k: b[k] for k in b if k not in a}:
        out[INSERT] = more
    if less := {k: a[k] for k in a if k not in b}:
        out[DELETE] = less
    return out


def reverse(d: Any) -> Any:
    """The same difference seen from the other side."""
    if isinstance(d, list):
        return d[::-1]
    if not isinstance(d, dict):
        return d
    swap = {INSERT: DELETE, DELETE: INSERT}
    return {swap.get(k, k): v if k in swap else reverse(v) for k, v in d.items()}
