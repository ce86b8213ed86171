"""Names that are free in a table, and the shared folder's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusloom.sources.shared import Tables, fresh_dir, remove, shared_dir, trim, written

__all__ = ["Tables", "fresh_dir", "remove", "shared_dir", "trim", "unused", "written"]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Those names, each with as many underscores before it as make it new to df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
