"""Commands: scan, plan, enrich, extract, generate, run, status, task-list, task-findings, set-status, snapshot-*, clean, validate."""

from __future__ import annotations

import argparse
import datetime
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import state
from corpusloom.plans import pipeline
from corpusloom.sources import documents, files

COMMANDS = ["scan", "plan", "enrich", "extract", "generate", "run", "status", "task-list", "task-findings", "set-status", "snapshot-create", "snapshot-list", "snapshot-restore", "clean", "validate"]


def options(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--manifest", default="manifest.yaml")
    p.add_argument("--state", default="state")
    p.add_argument("--out", default="output")
    p.add_argument("--snapshots", default="snapshots")
    p.add_argument("--name", default=datetime.datetime.now().strftime("%Y%m%d%H%M%S"))
    p.add_argument("--resume", action="store_true", help="scan: parse new content alone; enrich: recover interrupted tasks first; extract: go on with what is stored")
    p.add_argument("--force", action="store_true", help="extract although tasks are not done")
    p.add_argument("--dry-run", action="store_true", help="enrich: stub documents; extract: entry points alone; set-status: show what would change")
    p.add_argument("--delete-findings", action="store_true")
    p.add_argument("--llm-threshold", type=int, default=5, help="unresolved calls that make a file qualify; 0 leaves enrichment out")
    p.add_argument("--task", default="", help="task id or the beginning of one")
    p.add_argument("--type", help="kind of finding")
    p.add_argument("--target", help="part of a target's name")
    p.add_argument("--from", dest="old")
    p.add_argument("--status")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--limit", type=int, default=50)
    a = p.parse_args(argv)
    if a.status and a.status.upper() not in state.STATUSES:
        p.error(f"no such status: {a.status}; there are {', '.join(state.STATUSES)}")
    if a.resume and a.force and a.command == "extract":
        p.error("resume and force exclude each other")
    a.status = a.status and a.status.upper()
    return a


def listed(tasks: DataFrame, a: argparse.Namespace) -> DataFrame:
    """The tasks that the options choose, oldest first."""
    where = F.col("task_id").startswith(a.task)
    if a.status:
        where = where & (F.col("status") == a.status)
    if a.target:
        where = where & F.col("target_name").contains(a.target)
    return tasks.where(where).orderBy("created_at", "file_path")


def shown(tasks: DataFrame, verbose: bool) -> DataFrame:
    path = F.col("file_path") if verbose else text.truncate_start(F.col("file_path"), 48)
    task = F.col("task_id") if verbose else F.concat(F.substring("task_id", 1, 12), F.lit("..."))
    return tasks.select(task.alias("task_id"), path.alias("file_path"), "status", "target_name")


def main(argv: list[str] | None = None) -> int:
    a = options(argv)
    manifest = None
    if a.command in ("validate", "scan", "run"):
        with open(a.manifest, encoding="utf-8") as f:
            manifest = files.parse_manifest(f.read())
        faults = files.validate_manifest(manifest, lambda p: "://" in p or os.path.isdir(p))
        for level, message in faults:
            print(f"{level}: {message}")
        if a.command == "validate" or any(level == "ERROR" for level, _ in faults):
            return int(any(level == "ERROR" for level, _ in faults))
    if a.command == "snapshot-list":
        for name, n, size in documents.snapshots(a.snapshots):
            print(name, n, size)
        return 0
    if a.command == "snapshot-create":
        print(documents.snapshot(a.state, a.snapshots, a.name))
        return 0
    if a.command == "snapshot-restore":
        documents.restore(a.state, a.snapshots, a.name)
        return 0
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    ws, now = pipeline.Workspace(spark, a.state), datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
    if a.command == "scan":
        print(pipeline.scan(ws, files.targets_of(manifest), a.resume))
    elif a.command == "plan":
        pipeline.plan(ws, a.llm_threshold).groupBy("next_status").agg(F.count("*").alias("n")).show()
    elif a.command == "enrich":
        if a.llm_threshold:
            print(f"{pipeline.enrich(ws, resume=a.resume).count()} tasks")
    elif a.command == "extract":
        found = pipeline.extract(ws, a.force or a.resume, dry_run=a.dry_run)
        print("nothing to extract" if found is None else f"{found.count()} {'entry points' if a.dry_run else 'flows'}")
    elif a.command == "generate":
        print(*pipeline.generate(ws, a.out, now), sep="\n")
    elif a.command == "run":
        print(*pipeline.run_all(spark, a.manifest, a.state, a.out, now, a.resume, a.force, a.dry_run, a.llm_threshold), sep="\n")
    elif a.command == "status":
        counts, hint = pipeline.status(ws)
        counts.where(F.col("status") == a.status if a.status else F.lit(True)).show()
        if a.verbose:
            shown(listed(ws.read("tasks"), a), True).show(a.limit, truncate=False)
        print(f"Next step: {hint}")
    elif a.command == "task-list":
        tasks = listed(ws.read("tasks"), a)
        print(f"{min(a.limit, n := tasks.count())} of {n}")
        shown(tasks.limit(a.limit), a.verbose).show(a.limit, truncate=False)
    elif a.command == "task-findings":
        task = state.find_by_prefix(ws.read("tasks"), a.task)
        found = pipeline.findings(ws).where(F.col("task_id") == task["task_id"]).where(F.upper("finding_type") == a.type.upper() if a.type else F.lit(True))
        print(f"{task['task_id'][:12]} {task['file_path']} ({task['target_name']}): {found.count()} findings")
        found.orderBy("finding_type", "ordinal").select("finding_type", "finding_json").limit(a.limit).show(a.limit, truncate=not a.verbose)
    elif a.command == "set-status":
        tasks = ws.read("tasks")
        where = F.col("task_id").startswith(a.task) & (F.col("status") == a.old if a.old else F.lit(True))
        moved, facts, hit = state.set_status(tasks, ws.read("facts"), where, a.status, delete=a.delete_findings)
        n, first = hit.count(), [r.file_path for r in hit.orderBy("created_at", "file_path").limit(3).collect()]
        print(f"{n} tasks: {', '.join(first)}{' ...' if n > 3 else ''}")
        if not a.dry_run:
            ws.write("tasks", moved)
            if a.delete_findings:
                ws.write("facts", facts)
    elif a.command == "clean":
        pipeline.clean(ws, a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
