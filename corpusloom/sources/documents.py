"""Sinks: the JSON index, the manifest, the Markdown spec, findings, snapshots."""

from __future__ import annotations

import hashlib
import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import render

MANIFEST_VERSION = "3.0.0"


def to_findings(relation: DataFrame, kind: str, task: str = "task_id", resolved=None) -> DataFrame:
    """Rows of a typed relation as tagged JSON findings."""
    body = [c for c in relation.columns if c != task]
    return relation.select(F.col(task).alias("task_id"), F.lit(kind).alias("finding_type"), F.to_json(F.struct(*body)).alias("finding_json"), (F.lit(True) if resolved is None else resolved).alias("resolved"))


def from_findings(findings: DataFrame, kind: str, schema: str) -> DataFrame:
    """The findings of one type, typed again; rows that are not readable are dropped."""
    read = findings.where(F.col("finding_type") == kind).select("task_id", "resolved", F.from_json("finding_json", schema).alias("f"))
    return read.where("f IS NOT NULL").select("task_id", "resolved", "f.*")


def write_findings(findings: DataFrame, path: str) -> None:
    """One folder per type, so that reading a type reads nothing else; only written types are replaced."""
    findings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("finding_type").parquet(path)


def nested_validators(validators: DataFrame) -> DataFrame:
    """(file_path, class_name, constraints) from flat validator rows."""
    return validators.groupBy("file_path", "class_name").agg(F.array_sort(F.collect_list(F.struct("element_name", "annotation_type", "is_built_in", "is_valid_body"))).alias("constraints"))


def append_metric(metric: DataFrame, path: str) -> None:
    """Metrics are only ever added."""
    metric.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def metrics(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path)


def index_rows(relations: dict[str, DataFrame], target: str = "target_name") -> DataFrame:
    """(target, relation, body): a row of JSON for each fact that lies in a target; nulls are left out."""
    out = None
    for name, df in relations.items():
        body = F.to_json(F.struct(*[c for c in df.columns if c != target])).alias("body")
        one = df.where(F.col(target).isNotNull()).select(F.col(target).alias("target_name"), F.lit(name).alias("relation"), body)
        out = one if out is None else out.unionByName(one)
    return out


def write_index(relations: dict[str, DataFrame], links: dict[str, DataFrame], path: str, generated_at: str) -> None:
    """One JSON document: targets with an array for each relation that has rows, and arrays of links; empty ones are left out.

    Rows come sorted from the executors, one partition at a time, and are written as they come.
    """
    rows = index_rows(relations).orderBy("target_name", "relation", "body")
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'{{"version": {json.dumps(MANIFEST_VERSION)}, "generated_at": {json.dumps(generated_at)}, "targets": [')
        at: tuple = (None, None)
        for r in rows.toLocalIterator():
            if r.target_name != at[0]:
                f.write(("" if at[0] is None else "]},\n") + f'{{"name": {json.dumps(r.target_name)}')
            if (r.target_name, r.relation) != at:
                f.write(("]" if r.target_name == at[0] else "") + f', {json.dumps(r.relation)}: [{r.body}')
            else:
                f.write(",\n" + r.body)
            at = r.target_name, r.relation
        f.write("]" if at[0] is None else "]}]")
        for name, df in links.items():
            first = True
            for r in df.select(F.to_json(F.struct(*df.columns)).alias("body")).orderBy("body").toLocalIterator():
                f.write((f', {json.dumps(name)}: [' if first else ",\n") + r.body)
                first = False
            if not first:
                f.write("]")
        f.write("}\n")


def manifest(features: DataFrame, flows: DataFrame, nodes: DataFrame, edges: DataFrame, relationships: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """One row per feature: its part of the manifest as JSON, with empty strings as null.

    relationships: with the feature they are attached to; rules: (flow_id, rules, edge_cases).
    """
    by_flow = nodes.groupBy("flow_id").agg(F.array_sort(F.collect_list(F.struct("node", "component_type", "label", "source_ref"))).alias("nodes"))
    linked = edges.groupBy("flow_id").agg(F.array_sort(F.collect_list(F.struct("source", "target", "link_type"))).alias("edges"))
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    each = flows.join(by_flow, "flow_id", "left").join(linked, "flow_id", "left").join(features.select("flow_id", "feature_id"), "flow_id")
    said = [] if rules is None else ["rules", "edge_cases"]
    if rules is not None:
        each = each.join(rules, "flow_id", "left")
    flow = F.struct("flow_id", *said, "ep_type", blank("http_method"), blank("path"), blank("class_name"), blank("method_name"), "complexity", "confidence", F.coalesce("nodes", F.array().cast(by_flow.schema["nodes"].dataType)).alias("nodes"), F.coalesce("edges", F.array().cast(linked.schema["edges"].dataType)).alias("edges"))
    grouped = each.groupBy("feature_id").agg(F.min("feature").alias("name"), F.collect_list(flow).alias("flows")).withColumn("flows", F.array_sort("flows", lambda a, b: F.when(a.flow_id < b.flow_id, -1).when(a.flow_id > b.flow_id, 1).otherwise(0)))
    related = []
    if relationships is not None:
        by_feature = relationships.groupBy(F.col("feature").alias("name")).agg(F.array_sort(F.collect_list(F.struct("source_flow", "target_flow", "type", "via"))).alias("relationships"))
        grouped, related = grouped.join(by_feature, "name", "left"), ["relationships"]
    return grouped.select("feature_id", F.to_json(F.struct(F.lit(MANIFEST_VERSION).alias("version"), "feature_id", "name", "flows", *related)).alias("document"))


def markdown(features: DataFrame, flows: DataFrame, steps: DataFrame, orphans: DataFrame, relationships: DataFrame) -> str:
    """The spec: contents, features with their flows and steps, relationships, orphans, flows set aside."""
    row = render.table_row(F.col("step_index"), F.col("component_type"), F.concat_ws(".", "class_name", "method_name"), F.col("source_file"))
    label = F.concat_ws(".", "class_name", "method_name")
    ordered = steps.where("NOT unresolved").groupBy("flow_id").agg(F.array_sort(F.collect_list(F.struct("step_index", row.alias("row"), label.alias("label")))).alias("rows"))
    tables = ordered.select("flow_id", F.array_join(F.col("rows.row"), "\n").alias("table"), render.chain(F.col("rows"), "step_index").alias("chain"))
    each = flows.join(tables, "flow_id", "left")
    title = F.coalesce(F.when(F.col("ep_type") == "HTTP", F.concat_ws(" ", "http_method", "path")), F.concat_ws(".", "class_name", "method_name"))
    body = F.concat(F.lit("### "), title, F.lit("\n\nComplexity: "), F.col("complexity"), F.lit("\n\n| # | Component | Call | Source |\n|-|-|-|-|\n"), F.coalesce("table", F.lit("")), F.coalesce(F.concat(F.lit("\n\n```mermaid\ngraph LR\n"), "chain", F.lit("\n```")), F.lit("")))
    parts = {r.feature: r.text for r in each.where("NOT quarantined").withColumn("_t", title).groupBy("feature").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_t", body.alias("b")))), lambda x: x.b), "\n\n").alias("text")).collect()}
    lines = ["# Specification", "", *[f"- {f}" for f in sorted(parts)], ""]
    for f in sorted(parts):
        lines += [f"## {f}", "", parts[f], ""]
    listed = lambda head, rows: [f"## {head}", "", *[f"- {r}" for r in rows], ""] if rows else []
    lines += listed("Relationships", sorted(f"{r.source_flow} {r.type} {r.target_flow} ({r.via})" for r in relationships.collect()))
    lines += listed("Orphaned methods", sorted(f"{r.class_name}.{r.method_name} in {r.file_path}" for r in orphans.collect()))
    lines += listed("Set aside", sorted(f"{r.flow_id} (confidence {r.confidence:.2f})" for r in flows.where("quarantined").select("flow_id", "confidence").collect()))
    return "\n".join(lines)


def snapshot(state_dir: str, snapshots_dir: str, name: str) -> str:
    """Copies the state to a new snapshot; its manifest holds size and SHA-256 of every file."""
    target, temporary = os.path.join(snapshots_dir, name), os.path.join(snapshots_dir, f".{name}.new")
    if os.path.exists(target):
        raise FileExistsError(f"snapshot {name} exists")
    shutil.rmtree(temporary, ignore_errors=True)
    shutil.copytree(state_dir, temporary)
    files = {}
    for folder, _, names in os.walk(temporary):
        for n in names:
            p = os.path.join(folder, n)
            with open(p, "rb") as f:
                files[os.path.relpath(p, temporary)] = {"size": os.path.getsize(p), "sha256": hashlib.file_digest(f, "sha256").hexdigest()}
    with open(os.path.join(temporary, "snapshot.json"), "w") as f:
        json.dump({"name": name, "files": files}, f, indent=2, sort_keys=True)
    os.rename(temporary, target)
    return target


def snapshots(snapshots_dir: str) -> list[tuple[str, int, int]]:
    """(name, files, bytes) of all snapshots by name."""
    out = []
    for name in sorted(os.listdir(snapshots_dir)) if os.path.isdir(snapshots_dir) else []:
        p = os.path.join(snapshots_dir, name, "snapshot.json")
        if not name.startswith(".") and os.path.exists(p):
            with open(p) as f:
                files = json.load(f)["files"]
            out.append((name, len(files), sum(x["size"] for x in files.values())))
    return out


def restore(state_dir: str, snapshots_dir: str, name: str) -> None:
    """Puts a snapshot in the state's place, after checking every file; the old state goes only then."""
    source, fresh, old = os.path.join(snapshots_dir, name), f"{state_dir}.new", f"{state_dir}.old"
    with open(os.path.join(source, "snapshot.json")) as f:
        files = json.load(f)["files"]
    for rel, want in files.items():
        with open(os.path.join(source, rel), "rb") as f:
            if hashlib.file_digest(f, "sha256").hexdigest() != want["sha256"]:
                raise ValueError(f"{rel} of snapshot {name} has changed")
    shutil.rmtree(fresh, ignore_errors=True)
    shutil.copytree(source, fresh, ignore=shutil.ignore_patterns("snapshot.json"))
    if os.path.exists(state_dir):
        shutil.rmtree(old, ignore_errors=True)
        os.rename(state_dir, old)
    os.rename(fresh, state_dir)
    shutil.rmtree(old, ignore_errors=True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)
