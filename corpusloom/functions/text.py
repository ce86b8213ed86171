"""String functions of the engine, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is redacted, and by which pattern (first to last).
SECRET_PATTERNS = {
    "token": r"""token = "[0-9a-f]{40}\"""",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "digits": r"\b[0-9]{13,19}\b",
}

#: What every match of a pattern contains.
FIXED_PARTS = {"token": 'token = "', "email": "@"}


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def strip_quotes(text: Column) -> Column:
    return F.regexp_replace(text, '^"|"$', "")


def split_list(text: Column) -> Column:
    """A comma-separated list without blanks around its items; null and blank give no items."""
    return F.filter(F.split(F.coalesce(F.trim(text), F.lit("")), r"\s*,\s*"), lambda x: x != "")


def is_expression(text: Column) -> Column:
    return F.coalesce(text.contains("${") | text.contains("*{"), F.lit(False))


def table_hint(sql: Column) -> Column:
    """The first table name after FROM, INTO or UPDATE; empty if there is none."""
    return F.regexp_extract(sql, r"(?i)(?:FROM|INTO|UPDATE)\s+(\w+)", 1)


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def truncate_start(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.lit("…"), F.substring(text, -(most - 1), most - 1))).otherwise(text)


def is_accessor(method: Column) -> Column:
    """A getter or setter by its name."""
    return method.rlike(r"^(get|set|is)\p{Lu}")


def combine_paths(base: Column, path: Column) -> Column:
    """base and path with one slash between; an empty side leaves the other, both give a slash."""
    slashed = lambda c: F.when(c == "", c).when(c.startswith("/"), c).otherwise(F.concat(F.lit("/"), c))
    b = F.regexp_replace(slashed(F.coalesce(base, F.lit(""))), "/+$", "")
    joined = F.concat(b, slashed(F.coalesce(path, F.lit(""))))
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def template_path(path: Column) -> Column:
    """Template link target: expression openers go, a leading slash comes."""
    bare = F.regexp_replace(path, r"[$@]\{", "")
    return F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))


def normal_path(path: Column) -> Column:
    """Slashes collapsed, none at the ends but a leading one; empty is the root."""
    inner = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", "")
    return F.concat(F.lit("/"), inner)


def url_path(url: Column) -> Column:
    """The path of an http or https url; other strings are taken for paths."""
    rest = F.regexp_replace(url, r"^(?i:https?)://[^/?#]*", "")
    bare = F.regexp_replace(rest, r"[?#].*$", "")
    return F.when(url.rlike(r"^(?i:https?)://"), bare).otherwise(url)


def feature_name(path: Column) -> Column:
    """The last path segment that is no variable, capitalised; General if there is none."""
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.startswith("{"))
    last = F.when(F.size(segments) > 0, F.element_at(segments, -1))
    return F.coalesce(F.concat(F.upper(F.substring(last, 1, 1)), F.substring(last, 2, 1_000_000)), F.lit("General"))


def call_owner(call: Column) -> Column:
    """The segment before the last dot of a call; null without a dot."""
    parts = F.split(call, r"\.")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2))


def guessed_test_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("/main/"), F.lit("/test/")), r"\.java$", "Test.java")


def source_lines(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last, counted from 1, joined again."""
    return F.array_join(F.slice(F.split(text, "\n"), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def redact(text: Column) -> Column:
    """Every kind replaced, first to last; a text without a kind's fixed part is not searched for it."""
    for kind, pattern in SECRET_PATTERNS.items():
        put = F.regexp_replace(text, pattern, f"[REDACTED:{kind}]")
        text = F.when(text.contains(FIXED_PARTS[kind]), put).otherwise(text) if kind in FIXED_PARTS else put
    return text


def redaction_counts(text: Column) -> list[Column]:
    """How often each kind is found, one column each, in the text as earlier kinds leave it."""
    out = []
    for kind, pattern in SECRET_PATTERNS.items():
        out.append(F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast("long").alias(kind))
        text = F.regexp_replace(text, pattern, f"[REDACTED:{kind}]")
    return out


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, rounded up; blank texts have none."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(0)).otherwise(F.ceil(F.length(text) / 4)).cast("long")


def over_budget(tokens: Column, window: int = 128_000, share: float = 0.80) -> Column:
    return tokens > F.lit(int(window * share))


def api_cost(tokens: Column, each: float = 0.000002) -> Column:
    return tokens * F.lit(each)


def byte_size(n: Column) -> Column:
    """B, KB or MB, the latter two with one decimal."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.format_number(n / 1024, 1), F.lit(" KB")))
        .otherwise(F.concat(F.format_number(n / 1024 / 1024, 1), F.lit(" MB")))
    )


def component_by_path(path: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The component of the first rule (part of the lower-cased path, component) that fits."""
    low, out = F.lower(path), None
    for part, component in rules:
        out = F.when(low.contains(part), component) if out is None else out.when(low.contains(part), component)
    return out.otherwise(otherwise)


def source_ref(path: Column, first: Column, last: Column) -> Column:
    return F.when(first.isNull() | (first <= 0), path).otherwise(F.concat(path, F.lit(":"), first.cast("string"), F.lit("-"), F.coalesce(last, first).cast("string")))


def flow_key(kind: Column, path: Column, class_name: Column, method: Column) -> Column:
    """TYPE:file:class:method, the key under which a flow's analysis is kept; null counts as empty."""
    return F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in (kind, path, class_name, method)])


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))


def class_header(text: Column, line: Column) -> Column:
    """The nearest line at or above that opens a type, with the annotation lines right above it; null if there is none."""
    lines = F.slice(F.split(text, "\n"), F.lit(1), line)
    opens = F.transform(lines, lambda x, i: F.when(x.rlike(r"\b(?:class|interface|enum|record)\s+\w+"), i + 1).otherwise(0))
    at = F.array_max(opens)
    above = F.reverse(F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0))))
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    marked = F.aggregate(above, start, lambda s, x: F.struct(F.when(s.on & F.trim(x).startswith("@"), s.n + 1).otherwise(s.n).alias("n"), (s.on & F.trim(x).startswith("@")).alias("on")), lambda s: s.n)
    return F.when(at > 0, F.array_join(F.slice(lines, at - marked, marked + 1), "\n"))


def enrichment_context(flow: Column, summary: Column, calls: Column) -> Column:
    """What a prompt is told of a flow: its name, its summary and its outgoing calls (structs of method and url)."""
    listed = F.array_join(F.transform(calls, lambda c: F.concat_ws(" ", c.method, c.url)), ", ")
    parts = [F.concat(F.lit("Flow "), flow), F.when(summary != "", F.concat(F.lit("Enrichment: "), summary)), F.when(F.size(calls) > 0, F.concat(F.lit("Calls: "), listed))]
    return F.concat_ws("\n", *parts)
