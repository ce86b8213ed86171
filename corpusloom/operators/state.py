"""A keyed table of tasks: upsert, transitions, recovery, resume, lookups, deletes.

State is plain Parquet: every operator returns the new table, and the writer puts it in a
new folder; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: All statuses of a task, in the order of the state machine.
STATUSES = ["PENDING", "INDEXED", "ENRICH_PENDING", "ENRICHING", "ENRICHED", "ENRICH_FAILED", "SKIPPED", "FAILED", "AWAITING_HUMAN_REVIEW"]
#: Statuses that a resumed scan does not read again.
DONE = ["INDEXED", "ENRICH_PENDING", "ENRICHING", "ENRICHED", "ENRICH_FAILED"]
TERMINAL = ["SKIPPED", "ENRICHED", "INDEXED"]


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by order, as an aggregate: it is combined before the shuffle."""
    others = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return rows.groupBy(*key).agg(best).select(*key, *[F.col(f"_row.{c}").alias(c) for c in others]).select(rows.columns)


def upsert(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """changes replace rows of the table with their key; columns missing on a side are null."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, key, [F.col("_new")]).drop("_new")


def count_by_status(tasks: DataFrame, status: str = "status", statuses: list[str] | None = None) -> DataFrame:
    """(status, n) for every status, those without tasks too."""
    every = tasks.sparkSession.createDataFrame([(s,) for s in statuses or STATUSES], f"{status} string")
    counted = tasks.groupBy(status).agg(F.count("*").alias("n"))
    return every.join(counted, status, "left").select(status, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def without_finding(tasks: DataFrame, findings: DataFrame, key: str, statuses: list[str], status: str = "status") -> DataFrame:
    return tasks.where(F.col(status).isin(statuses)).join(findings.select(key), key, "left_anti")


def resume(files: DataFrame, tasks: DataFrame, key: str = "task_id", status: str = "status", done: list[str] | None = None) -> DataFrame:
    """Files whose task is not done: new content gives a new id, so changed files come again."""
    return files.join(tasks.where(F.col(status).isin(done or DONE)).select(key), key, "left_anti")


def delete_findings(findings: DataFrame, tasks: DataFrame, key: str, kind: str, type_: str, statuses: list[str], status: str = "status") -> DataFrame:
    """findings without those of one type whose task has one of the statuses."""
    hit = tasks.where(F.col(status).isin(statuses)).select(key, F.lit(type_).alias(kind))
    return findings.join(hit, [key, kind], "left_anti")


def transition(status: Column, moves: list[tuple[list[str], str]]) -> Column:
    """Passes applied one after another: a later pass sees what an earlier one has set."""
    for sources, target in moves:
        status = F.when(status.isin(sources), target).otherwise(status)
    return status


def recovered(status: Column, has_findings: Column) -> Column:
    """Status after a resumed enrichment: the passes chain, in this order."""
    first = F.when(status == "FAILED", F.when(has_findings, "ENRICHED").otherwise("INDEXED")).otherwise(status)
    return transition(first, [(["ENRICHING"], "ENRICH_PENDING"), (["ENRICH_PENDING"], "INDEXED"), (["PENDING"], "INDEXED"), (["ENRICH_FAILED"], "ENRICH_PENDING")])


def orphans_recovered(tasks: DataFrame, findings: DataFrame, key: str = "task_id", status: str = "status") -> tuple[DataFrame, DataFrame]:
    """Tasks left ENRICHING go back to ENRICH_PENDING and lose their findings."""
    stuck = tasks.where(F.col(status) == "ENRICHING").select(key)
    moved = tasks.withColumn(status, transition(F.col(status), [(["ENRICHING"], "ENRICH_PENDING")]))
    return moved, findings.join(stuck, key, "left_anti")


def find_by_prefix(tasks: DataFrame, prefix: str, key: str = "task_id") -> dict:
    """The task with this id, or the only one whose id starts so; an error if there is none or several."""
    rows = tasks.where(F.col(key).startswith(prefix)).limit(2).collect()
    exact = tasks.where(F.col(key) == prefix).limit(1).collect()
    if exact:
        return exact[0].asDict()
    if len(rows) != 1:
        raise LookupError(f"{'no task' if not rows else 'several tasks'} with prefix {prefix}")
    return rows[0].asDict()


def all_terminal(tasks: DataFrame, status: str = "status") -> bool:
    return tasks.where(~F.col(status).isin(TERMINAL)).limit(1).count() == 0


def set_status(tasks: DataFrame, findings: DataFrame, where: Column, status: str, key: str = "task_id", delete: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks, findings, the rows that change): a dry run takes the last alone."""
    hit = tasks.where(where)
    moved = tasks.withColumn("status", F.when(where, F.lit(status)).otherwise(F.col("status")))
    return moved, findings.join(hit.select(key), key, "left_anti") if delete else findings, hit


def split_cached(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows the cache answers, rows still to be computed)."""
    return wanted.select(key).join(cache, key), wanted.join(cache.select(key), key, "left_anti")


def preview(rows: DataFrame, by: str, item: str, n: int = 3) -> DataFrame:
    """(by, first, n): the first n items of each group, sorted, and how many there are.

    Groups stay small on the way: each task hands on the least n items of a group.
    """
    numbered = rows.withColumn("_task", F.spark_partition_id()).groupBy(by, "_task").agg(F.slice(F.array_sort(F.collect_list(item)), 1, n).alias("_least"), F.count("*").alias("_n"))
    return numbered.groupBy(by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("_least"))), 1, n).alias("first"), F.sum("_n").alias("n"))


def group_key(rows: DataFrame, by: str, item: str) -> DataFrame:
    """(by, cache_key): SHA-256 of the group's sorted items, comma-joined, whatever order they come in."""
    ordered = F.array_join(F.array_sort(F.collect_list(F.col(item).cast("string"))), ",")
    return rows.groupBy(by).agg(F.sha2(ordered.cast("binary"), 256).alias("cache_key"))


def merged(rows: DataFrame, key: list[str], keep_first: dict[str, str], collect: list[str]) -> DataFrame:
    """One row per key: of columns in keep_first the value with the least order column, of the others all values."""
    kept = [F.min_by(c, order).alias(c) for c, order in keep_first.items()]
    return rows.groupBy(*key).agg(*kept, *(F.collect_list(c).alias(c) for c in collect))
