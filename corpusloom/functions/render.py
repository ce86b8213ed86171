"""Text that documents are rendered from, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chain(steps: Column, index: str = "index", label: str = "label") -> Column:
    """A graph chain over an array of structs: S1[a] --> S2[b]."""
    return F.array_join(F.transform(steps, lambda s: F.concat(F.lit("S"), s[index].cast("string"), F.lit("["), s[label], F.lit("]"))), " --> ")


def section(title: Column, lines: Column, level: int = 2) -> Column:
    return F.concat(F.lit("#" * level + " "), title, F.lit("\n\n"), F.array_join(lines, "\n"))


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.replace(c.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in cells]), F.lit(" |"))
