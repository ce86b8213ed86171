"""Call resolution: call sites joined with declarations, by name and number of arguments."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESOLVED, AMBIGUOUS, UNRESOLVED = "RESOLVED", "AMBIGUOUS", "UNRESOLVED"


def by_cardinality(calls: DataFrame, declared: DataFrame, key: list[str], target: str, candidate: str | None = None) -> DataFrame:
    """calls with n_found, resolved_status, the target if it is the only one, and candidates if there are several.

    declared is aggregated by key first, so a call meets one row at most.
    """
    shown = candidate or target
    grouped = declared.groupBy(*key).agg(F.count("*").alias("n_found"), F.min(target).alias("_target"), F.array_sort(F.collect_set(shown)).alias("_candidates"))
    joined = calls.join(grouped, key, "left")
    n = F.coalesce("n_found", F.lit(0))
    status = F.when(n == 1, RESOLVED).when(n > 1, AMBIGUOUS).otherwise(UNRESOLVED)
    return joined.select(*calls.columns, n.cast("long").alias("n_found"), status.alias("resolved_status"), F.when(n == 1, F.col("_target")).alias("target"), F.when(n > 1, F.col("_candidates")).otherwise(F.array().cast("array<string>")).alias("candidates"))


def signature() -> Column:
    return F.concat(F.col("class_name"), F.lit("."), F.col("method_name"), F.lit("("), F.array_join("param_types", ","), F.lit(")"))


def call_edges(call_sites: DataFrame, declarations: DataFrame, supertypes: DataFrame) -> DataFrame:
    """Call edges: a unique declaration, several, an inherited one, a repository's, or none.

    The nearest supertypes with a unique declaration win; cycles in the hierarchy are cut.
    Equal edges are one; if the sites have an ordinal, the edge has the first.  What is
    declared is aggregated once, into a table that all other lookups are made from.
    """
    from corpusloom.operators.graph import closure
    from corpusloom.sources.shared import written

    d = declarations.withColumn("arg_count", F.size("param_types")).withColumn("signature", signature())
    by_args = d.groupBy(F.col("class_name").alias("target_type"), "method_name", "arg_count").agg(F.count("*").alias("n"), F.first("file_path").alias("_file"), F.min("start_line").alias("_start"), F.min("end_line").alias("_end"), F.array_sort(F.collect_list("signature")).alias("_all"), F.min("file_path").alias("_least"))
    by_args = written(by_args, "declared")
    by_name = by_args.groupBy("target_type", "method_name").agg(F.lit(True).alias("_named"))
    classes = by_args.groupBy("target_type").agg(F.min("_least").alias("_class_file"))
    by_args = by_args.drop("_least")
    up = closure(supertypes, "class_name", "super_simple_name")
    only = by_args.where("n = 1").select(F.col("target_type").alias("target"), "method_name", "arg_count", F.col("_file").alias("_up_file"), F.col("_start").alias("_up_start"), F.col("_end").alias("_up_end"))
    inherited = up.join(only, "target").groupBy(F.col("source").alias("target_type"), "method_name", "arg_count").agg(F.min(F.struct("depth", F.col("target").alias("class"), "_up_file", "_up_start", "_up_end")).alias("_up"))
    spring = supertypes.where(F.col("super_fqn").startswith("org.springframework.data.")).select("class_name").distinct()
    data = up.join(spring, up.target == spring.class_name).select("source").union(spring).distinct().select(F.col("source").alias("target_type"), F.lit(True).alias("_data"))
    e = call_sites.join(by_args, ["target_type", "method_name", "arg_count"], "left").join(by_name, ["target_type", "method_name"], "left").join(classes, "target_type", "left").join(inherited, ["target_type", "method_name", "arg_count"], "left").join(data, "target_type", "left")
    n = F.coalesce("n", F.lit(0))
    from_super = (n == 0) & F.col("_named").isNull() & F.col("_up").isNotNull()
    repository = (n == 0) & F.col("_named").isNull() & F.col("_up").isNull() & F.col("_data").isNotNull() & F.col("_class_file").isNotNull()
    status = F.when(n == 1, RESOLVED).when(n > 1, AMBIGUOUS).when(from_super | repository, RESOLVED).otherwise(UNRESOLVED)
    pick = lambda own, above, none: F.when(n == 1, own).when(from_super, above).otherwise(none)
    made = e.select(
        "source_class", "source_method", F.col("file_path").alias("source_file"),
        F.when(from_super, F.col("_up.class")).otherwise(F.col("target_type")).alias("target_class"), F.col("method_name").alias("target_method"),
        F.when(repository, F.col("_class_file")).otherwise(pick(F.col("_file"), F.col("_up._up_file"), F.lit(None))).alias("target_file"),
        "arg_count", status.alias("resolved_status"),
        F.when(n > 1, F.col("_all")).otherwise(F.array().cast("array<string>")).alias("ambiguous_candidates"),
        pick(F.col("_start"), F.col("_up._up_start"), F.lit(0)).alias("target_start_line"), pick(F.col("_end"), F.col("_up._up_end"), F.lit(0)).alias("target_end_line"),
        *(["ordinal"] if "ordinal" in call_sites.columns else []),
    )
    same = [c for c in made.columns if c != "ordinal"]
    return made.groupBy(*same).agg(F.min("ordinal").alias("ordinal")) if "ordinal" in made.columns else made.dropDuplicates()


def without_framework(calls: DataFrame, imports: DataFrame, owner: str, file: str, prefixes: list[str]) -> DataFrame:
    """calls without those of a library: written with its prefix, or imported from it by name or wildcard.

    A wildcard import of a library stands for every simple name, as nothing tells which
    package holds it.
    """
    starts = lambda c: reduce(or_, [c.startswith(p) for p in prefixes], F.lit(False))
    library = imports.where(starts(F.col("fqn")))
    named = library.where("fqn NOT LIKE '%.*'").select(F.col("file_path").alias(file), F.element_at(F.split("fqn", r"\."), -1).alias(owner)).distinct()
    wild = library.where("fqn LIKE '%.*'").select(F.col("file_path").alias(file), F.lit(True).alias("_wild")).distinct()
    rest = calls.where(~F.coalesce(starts(F.col(owner)), F.lit(False))).join(named, [file, owner], "left_anti").join(wild, file, "left")
    return rest.where(F.col("_wild").isNull() | F.coalesce(F.col(owner).contains("."), F.lit(False))).drop("_wild").select(calls.columns)
