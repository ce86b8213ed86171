"""Scores of links, entry points and flows, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL, STANDARD, MINIMAL = "FULL", "STANDARD", "MINIMAL"


def segments(path: Column) -> Column:
    """The parts between slashes; trailing slashes add none, a leading one adds an empty first part."""
    return F.split(F.regexp_replace(path, "/+$", ""), "/")


def is_variable(segment: Column) -> Column:
    return segment.rlike(r"^\{[^}]+\}$")


def url_confidence(url: Column, path: Column) -> Column:
    """How well a called url fits an endpoint path, in steps from 0 to 1.

    Equal strings give 1.  With as many segments each counts 1 if equal, 0.8 against a
    variable, 0.6 if it is an expression, and a mismatch makes the whole 0; the mean falls
    into steps.  With different numbers, a common beginning over the shorter one, of more
    than one segment, gives 0.4.
    """
    a, b = segments(url), segments(path)
    step = lambda x, y: F.when(x == y, 1.0).when(is_variable(y), 0.8).otherwise(0.0)
    fits = lambda x, y: F.when(x == y, 1.0).when(is_variable(y), 0.8).when(x.contains("${") | y.contains("${"), 0.6).otherwise(0.0)
    least = F.least(F.size(a), F.size(b))
    front = F.zip_with(F.slice(a, 1, least), F.slice(b, 1, least), step)
    every = F.zip_with(a, b, fits)
    mean = F.round(F.aggregate(every, F.lit(0.0), lambda s, x: s + x) / F.size(every), 9)
    stepped = F.when(mean >= 0.9, 1.0).when(mean >= 0.7, 0.8).when(mean >= 0.5, 0.6).when(mean >= 0.3, 0.4).otherwise(0.0)
    same = F.when(F.exists(every, lambda x: x == 0.0), 0.0).otherwise(stepped)
    short = F.when((least > 1) & F.forall(front, lambda x: x > 0.0), 0.4).otherwise(0.0)
    return F.when(url == path, 1.0).when(F.size(a) == F.size(b), same).otherwise(short)


def template_confidence(link: Column, path: Column) -> Column:
    """1 if equal, 0.8 if only variables of the path differ, 0.5 if the longer ends with the shorter, else 0."""
    inner = lambda p: F.split(F.regexp_replace(p, "^/+|/+$", ""), "/")
    a, b = inner(link), inner(path)
    alike = F.forall(F.zip_with(a, b, lambda x, y: is_variable(y) | (x == y)), lambda x: x) & F.exists(b, is_variable)
    ends = link.endswith(path) | path.endswith(link)
    return F.when(link == path, 1.0).when((F.size(a) == F.size(b)) & alike, 0.8).when((F.size(a) != F.size(b)) & ends, 0.5).otherwise(0.0)


def path_matches(path: Column, template: Column) -> Column:
    """Segment by segment; a variable of the template fits anything."""
    a, b = segments(path), segments(template)
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: (x == y) | is_variable(y)), lambda x: x)


def path_shape(template: Column) -> Column:
    """A sign for each segment of a template: v for a variable, - for any other."""
    return F.array_join(F.transform(segments(template), lambda s: F.when(is_variable(s), "v").otherwise("-")), "")


def path_key(path: Column, shape: Column) -> Column:
    """The shape and the segments where it has no variable.

    A path matches a template (path_matches) if it has as many segments as the template's
    shape and both have the same key by that shape, so the match is an equi-join.
    """
    kept = F.transform(segments(path), lambda s, i: F.when(shape.substr(i + 1, F.lit(1)) == "v", "").otherwise(s))
    return F.concat(shape, F.lit("/"), F.array_join(kept, "/"))


def priority(enriched: Column, out_degree: Column, is_http: Column, has_test: Column) -> Column:
    return F.when(enriched, 0.3).otherwise(0.0) + 0.3 * F.least(out_degree / 10, F.lit(1.0)) + 0.2 * F.when(is_http, 1.0).otherwise(0.5) + F.when(has_test, 0.2).otherwise(0.0)


def complexity(steps: Column, external: Column, database: Column) -> Column:
    score = F.least(steps / 5, F.lit(1.0)) * 0.4 + F.when(external, 0.3).otherwise(0.0) + F.when(database, 0.3).otherwise(0.0)
    return F.when(score >= 0.7, FULL).when(score >= 0.3, STANDARD).otherwise(MINIMAL)


def flow_confidence(steps: Column, unresolved: Column) -> Column:
    return 1 - unresolved / (steps + unresolved)


def quarantine(steps: Column, unresolved: Column, quarantined: Column, most: int = 3, least: float = 0.7) -> tuple[Column, Column]:
    """(whether a flow is set aside, its confidence)."""
    sure = F.when(steps == 0, 0.1).when(quarantined, 0.2).when(unresolved > most, 0.4).otherwise(flow_confidence(steps, unresolved))
    return (steps == 0) | quarantined | (unresolved > most) | (sure < least), sure
