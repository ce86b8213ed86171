"""Rule-based qualification: named boolean columns become a list of reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "NONE"
ENRICH_PENDING, SKIPPED = "ENRICH_PENDING", "SKIPPED"


def reasons(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in their order; a null rule does not hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))


def qualify(tasks: DataFrame, rules: dict[str, Column], status: str = "status", pending: str = ENRICH_PENDING) -> DataFrame:
    """tasks with reasons, qualified and the next status.

    A task that is pending already stays so, with no reasons given; others qualify if a
    rule holds, and get the reason NONE if none does.
    """
    waiting = F.col(status) == pending
    found = tasks.withColumn("reasons", F.when(waiting, F.array().cast("array<string>")).otherwise(reasons(rules)))
    found = found.withColumn("qualified", waiting | (F.size("reasons") > 0))
    found = found.withColumn("reasons", F.when(F.col("qualified"), F.col("reasons")).otherwise(F.array(F.lit(NONE))))
    return found.withColumn("next_status", F.when(F.col("qualified"), pending).otherwise(SKIPPED))


def finding_flags(findings: DataFrame, task: str, kind: str, wanted: dict[str, list[str]], resolved: str = "resolved", counted: dict[str, str] | None = None) -> DataFrame:
    """One row per task: whether it has a finding of the wanted types, and counts of unresolved ones.

    One grouped aggregate stands for a query per task and rule.
    """
    flags = [F.bool_or(F.col(kind).isin(types)).alias(name) for name, types in wanted.items()]
    counts = [F.count_if((F.col(kind) == t) & ~F.col(resolved)).alias(name) for name, t in (counted or {}).items()]
    return findings.groupBy(task).agg(*flags, *counts)


#: Finding types by kind of database access.
GRANULAR_TYPES = {"SPRING_DATA": "SPRING_DATA_INTERFACE", "STORED_PROCEDURE": "DATABASE_PROCEDURE_CALL", "NATIVE_SQL": "NATIVE_SQL_QUERY", "JPQL_HQL": "JPQL_HQL_QUERY"}


def reclassified(accesses: DataFrame, validators: DataFrame) -> DataFrame:
    """(file_path, class_name, finding_type): finding types that facts get besides their own.

    Only some kinds of access have one; a validator does if it is no framework's own and
    its isValid has a body.
    """
    kind = F.col("type")
    mapped = F.coalesce(*[F.when(kind == k, v) for k, v in GRANULAR_TYPES.items()]).alias("finding_type")
    own = validators.where("NOT is_built_in AND trim(is_valid_body) <> ''")
    return accesses.where(kind.isin(*GRANULAR_TYPES)).select("file_path", "class_name", mapped).unionByName(own.select("file_path", "class_name", F.lit("CONSTRAINT_VALIDATOR").alias("finding_type")))


#: The finding types that make a task a flow.
FLOW_TYPES = ["ENDPOINT", "SCHEDULED_TASK", "EVENT_LISTENER", "KAFKA_LISTENER", "RABBITMQ_LISTENER", "ACTIVEMQ_LISTENER", "SERVLET", "TEMPLATE_FORM"]


def enrichment_rules(unresolved_limit: int = 5) -> dict[str, Column]:
    """The engine's own rules over finding_flags joined with test and link flags."""
    return {
        "UNRESOLVED_SIGNATURES": F.col("unresolved_calls") > unresolved_limit,
        "STORED_PROCEDURE_CALL": F.col("has_procedure"),
        "CUSTOM_CONSTRAINT_VALIDATOR": F.col("has_constraint"),
        "DTO_VALIDATION": F.col("has_validator") & F.col("has_flow"),
        "TEST_ASSERTIONS_PRESENT": F.col("has_test"),
        "UNRESOLVED_FLOATING_LINK": F.col("has_pending_link"),
    }
