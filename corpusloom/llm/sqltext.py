"""Small pieces of SQL text."""

from __future__ import annotations


def let(value: str, name: str, body: str) -> str:
    """body with a name for a value, which is computed once: optimizer rules do not inline it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"
