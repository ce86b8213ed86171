"""Identity by content: hashes of texts and of composite keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNREADABLE = "unreadable"


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text; the fixed word for unreadable content where it is null."""
    return F.coalesce(F.sha2(text.cast("binary"), 256), F.lit(UNREADABLE))


def task_id(*parts: Column) -> Column:
    """SHA-256 over the parts, joined by bars; null counts as empty, as concat_ws would skip it."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


def short_id(text: Column) -> Column:
    """Hex of the 32-bit polynomial string hash (factor 31) over 16-bit units; wide characters are two of them."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), F.lit(1))
    total = F.aggregate(units, F.lit(0).cast("long"), lambda h, c: (h * 31 + F.conv(c, 16, 10).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.hex(total))
