"""The phases over a file corpus: scan, plan, enrich, extract, generate.

State lives in one folder of Parquet tables; a phase reads what earlier ones have
written and replaces only its own tables.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.extract import markup, rules, run
from corpusloom.functions import hashing, text
from corpusloom.operators import enrich as enrichment
from corpusloom.operators import flows, graph, links, pairing, planner, resolve, state
from corpusloom.sources import documents, files
from corpusloom.sources.workers import importable


class Workspace:
    """The state folder, on any file system that Spark writes to.

    A table is written aside; then the old one is renamed, the new one takes its name, and
    only then the old one goes.  A crash between the renames leaves the old table, and the
    next reader puts it back.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = importable(spark), folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(self.folder))

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _exists(self, name: str) -> bool:
        return self.fs.exists(self._path(self.path(name)))

    def _rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self._path(self.path(old)), self._path(self.path(new))):
            raise OSError(f"{old} cannot be renamed to {new}")

    def _delete(self, name: str) -> None:
        self.fs.delete(self._path(self.path(name)), True)

    def has(self, name: str) -> bool:
        if not self._exists(name) and self._exists(f".{name}.old"):
            self._rename(f".{name}.old", name)
        return self._exists(name)

    def read(self, name: str) -> DataFrame:
        self.has(name)
        return documents.read_table(self.spark, self.path(name))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        fresh, old = f".{name}.{uuid.uuid4().hex}", f".{name}.old"
        df.write.parquet(self.path(fresh))
        if self.has(name):
            self._delete(old)
            self._rename(name, old)
        self._rename(fresh, name)
        self._delete(old)
        self.spark.catalog.refreshByPath(self.path(name))
        return self.read(name)

    def clear(self) -> None:
        self.fs.delete(self._path(self.folder), True)


def scan(ws: Workspace, targets: list[files.ScanTarget], resume: bool = False) -> dict[str, int]:
    """Files to facts to links.  With resume, only files whose content is new are parsed again."""
    spark = ws.spark
    corpus = files.read_files(spark, targets)
    corpus = corpus.withColumn("task_id", hashing.task_id(F.col("target_name"), F.col("path"), F.col("content_hash"))).withColumn("content", text.redact(F.col("content")))
    wanted = state.resume(corpus, ws.read("tasks")) if resume and ws.has("tasks") else corpus
    wanted = ws.write("scanned", wanted)
    contents = wanted.select("task_id", "content")
    ws.write("contents", state.upsert(ws.read("contents"), contents, ["task_id"]) if ws.has("contents") else contents)
    facts = run.extract(wanted).join(wanted.select(F.col("path").alias("file_path"), "target_name", "task_id"), "file_path")
    if resume and ws.has("facts"):
        current = corpus.select("task_id")
        facts = facts.unionByName(ws.read("facts").join(wanted.select(F.col("path").alias("file_path")), "file_path", "left_anti").join(current, "task_id", "left_semi"))
    facts = ws.write("facts", facts)
    failed = facts.where("kind = 'error' AND fact LIKE '%\"stage\": \"read\"%'").select("task_id", F.lit(True).alias("_failed"))
    fresh = wanted.join(failed, "task_id", "left").select("task_id", F.col("path").alias("file_path"), F.when(F.col("_failed"), "FAILED").otherwise("INDEXED").alias("status"), F.lit("java").alias("content_type"), "content_hash", "target_name", F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"))
    if ws.has("tasks"):
        fresh = fresh.join(ws.read("tasks").select("task_id", F.col("created_at").alias("_since")), "task_id", "left").withColumn("created_at", F.coalesce("_since", "created_at")).drop("_since")
    ws.write("tasks", state.upsert(ws.read("tasks"), fresh, ["task_id"]) if ws.has("tasks") else fresh)
    for kind in run.SCHEMAS:
        typed = run.relation(facts, kind).join(facts.select("file_path", "target_name", "task_id").distinct(), "file_path")
        ws.write(kind, typed)
    edges = resolve.call_edges(ws.read("call_site"), ws.read("declaration"), ws.read("supertype"))
    ws.write("call_edges", edges)
    ws.write("topic_links", topic_links(ws.read("broker_publisher"), ws.read("broker_listener")))
    endpoints = ws.read("endpoint")
    xml = _others(spark, targets, files.any_case(".xml"))
    if xml is not None:
        beans = ws.write("xml_bean", files.assign_target(markup.apply(xml, markup.beans, markup.BEAN_SCHEMA), targets, "file_path"))
        ws.write("xml_import", markup.import_closure(beans))
        web = xml.where("lower(path) LIKE '%/web.xml'")
        served = files.assign_target(markup.apply(web, markup.servlets, markup.SERVLET_SCHEMA), targets, "file_path")
        endpoints = endpoints.unionByName(served, allowMissingColumns=True)
    endpoints = ws.write("endpoints", flows.ranked(endpoints, [F.asc("file_path"), F.asc("ordinal")]))
    calls = ws.read("http_call").select(F.upper("method").alias("method"), "url_pattern", "is_expression", "client_type", F.col("file_path").alias("source_file"), F.col("encapsulated_in").alias("source_method"))
    ends = endpoints.select(F.upper("http_method").alias("http_method"), F.col("path").alias("endpoint_path"), "rank")
    ws.write("floating_links", links.best_match(calls, ends, "url_pattern", "endpoint_path", [F.col("method") == F.col("http_method")], _url_score(), "rank", keys=links.segment_keys(F.col("url_pattern"), F.col("endpoint_path"))))
    pages = _others(spark, targets, "{" + files.any_case(".jsp") + "," + files.any_case(".html") + "}")
    if pages is not None:
        forms = ws.write("template_form", markup.apply(pages, markup.forms, markup.FORM_SCHEMA))
        ws.write("template_links", template_links(forms, endpoints))
    index = pairing.test_index(ws.read("file_type"), ws.read("import"), rules.LIBRARY_PREFIXES)
    imported = pairing.first_tests(ws.read("file_type"), index)
    rest = ws.read("file_type").where(~pairing.is_test_class(F.col("file_path"), F.col("fqn"))).select(F.col("file_path").alias("source_file")).distinct().join(imported, "source_file", "left_anti")
    named = pairing.first_existing(rest, pairing.test_candidates(F.col("source_file")), corpus, "path", "test_file").where("test_file IS NOT NULL")
    ws.write("test_pairs", imported.unionByName(named.select("source_file", "test_file")))
    metrics = scan_metrics(ws)
    documents.append_metric(_metric_row(spark, 1, metrics["files"], metrics["files"], metrics["edges_resolved"], metrics["edges_unresolved"], metrics["topic_links"], metrics["floating_links"], 0, 0.0), ws.path("metrics"))
    return metrics


def _metric_row(spark: SparkSession, phase: int, *values) -> DataFrame:
    return spark.createDataFrame([(uuid.uuid4().hex, phase, *values)], "run_id string, phase int, files_scanned long, files_analyzed long, edges_resolved long, edges_unresolved long, topic_links_resolved long, floating_links long, tokens long, cost double")


def _url_score():
    from corpusloom.functions.scoring import url_confidence

    return url_confidence(F.col("url_pattern"), F.col("endpoint_path"))


def _others(spark: SparkSession, targets: list[files.ScanTarget], pattern: str) -> DataFrame | None:
    try:
        return files.read_files(spark, targets, pattern).select("path", "content")
    except Exception as e:  # a pattern that fits no file at all is no fault
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return None
        raise


def _by_topic(publishers: DataFrame, listeners: DataFrame) -> DataFrame:
    return links.match_links(publishers, listeners, "file_path", "file_path", pattern="is_pattern")


#: How producers and consumers of a broker are linked; more brokers can be added.
TOPIC_STRATEGIES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "KAFKA": _by_topic,
    "RABBITMQ": lambda publishers, listeners: _by_topic(links.rabbit_producers(publishers), listeners),
    "ACTIVEMQ": _by_topic,
}


def topic_links(publishers: DataFrame, listeners: DataFrame) -> DataFrame:
    """Links of all brokers: each broker's producers meet its own consumers."""
    out = None
    for broker, resolve_ in TOPIC_STRATEGIES.items():
        one = resolve_(publishers.where(F.col("broker") == broker), listeners.where(F.col("broker") == broker)).withColumn("broker", F.lit(broker))
        out = one if out is None else out.unionByName(one)
    return out


def template_links(forms: DataFrame, endpoints: DataFrame) -> DataFrame:
    from corpusloom.functions.scoring import template_confidence

    usable = forms.where("trim(url_pattern) <> '' AND NOT url_pattern LIKE '${%' AND NOT url_pattern LIKE '@{%'")
    left = usable.select(F.col("file_path").alias("template_path"), F.col("http_method").alias("verb"), F.col("url_pattern").alias("form_action"), "link_type", text.template_path(F.col("url_pattern")).alias("action"))
    right = endpoints.select(F.col("http_method").alias("endpoint_verb"), F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), "path")).alias("endpoint_path"), "rank")
    return links.best_match(left, right, "action", "endpoint_path", [F.upper("verb") == F.upper("endpoint_verb")], template_confidence(F.col("action"), F.col("endpoint_path")), "rank", least=0.5, keys=links.segment_keys(F.col("action"), F.col("endpoint_path"), ends=True))


def scan_metrics(ws: Workspace) -> dict[str, int]:
    edges = ws.read("call_edges").agg(F.count_if(F.col("resolved_status") == "RESOLVED").alias("resolved"), F.count_if(F.col("resolved_status") != "RESOLVED").alias("open")).first()
    return {"files": ws.read("tasks").count(), "facts": ws.read("facts").count(), "edges_resolved": edges.resolved, "edges_unresolved": edges.open, "topic_links": ws.read("topic_links").where("status = 'RESOLVED'").count(), "floating_links": ws.read("floating_links").count()}


def plan(ws: Workspace, unresolved_limit: int = 5) -> DataFrame:
    """Qualifies the indexed tasks: reasons, and the status that follows."""
    tasks = ws.read("tasks")
    waiting = tasks.where(F.col("status").isin("INDEXED", "ENRICH_PENDING"))
    if ws.has("enrichment"):
        waiting = waiting.join(ws.read("enrichment").select("task_id"), "task_id", "left_anti")
    flag = lambda df, column, name, where="true": df.where(where).select(F.col(column).alias("file_path")).distinct().withColumn(name, F.lit(True))
    calls = ws.read("call_edges").groupBy(F.col("source_file").alias("file_path")).agg(F.count_if(F.col("resolved_status") != "RESOLVED").alias("unresolved_calls"))
    flow = None
    for kind in ("endpoint", "scheduled_task", "event_listener", "broker_listener"):
        one = ws.read(kind).select("file_path")
        flow = one if flow is None else flow.unionByName(one)
    both = waiting.join(calls, "file_path", "left")
    for df in (
        flag(ws.read("db_access"), "file_path", "has_procedure", "type = 'STORED_PROCEDURE'"),
        flag(ws.read("validator"), "file_path", "has_constraint", "NOT is_built_in AND trim(is_valid_body) <> ''"),
        flag(ws.read("validator"), "file_path", "has_validator"),
        flag(flow, "file_path", "has_flow"),
        flag(ws.read("test_pairs"), "source_file", "has_test"),
        flag(ws.read("floating_links"), "source_file", "has_pending_link", "status = 'PENDING'"),
    ):
        both = both.join(df, "file_path", "left")
    decided = planner.qualify(both, planner.enrichment_rules(unresolved_limit)).select("task_id", "file_path", "reasons", "qualified", "next_status")
    decided = ws.write("decisions", decided)
    moved = tasks.join(decided.select("task_id", "next_status"), "task_id", "left").withColumn("status", F.coalesce("next_status", "status")).drop("next_status")
    ws.write("tasks", moved)
    return decided


def recover(ws: Workspace) -> dict[str, int]:
    """What a resumed enrichment does first: interrupted and failed tasks go back a step, their enrichment findings go.

    Facts of the scan stay.  Returns how many tasks each status has moved.
    """
    tasks = ws.read("tasks")
    found = ws.read("enrichment").where("document IS NOT NULL").select("task_id", F.lit(True).alias("_found")).distinct() if ws.has("enrichment") else tasks.where("false").select("task_id", F.lit(True).alias("_found"))
    moved = tasks.join(found, "task_id", "left").withColumn("_next", state.recovered(F.col("status"), F.coalesce("_found", F.lit(False))))
    changed = {r.status: r.n for r in moved.where("_next <> status").groupBy("status").agg(F.count("*").alias("n")).collect()}
    stuck = ws.write("stuck_tasks", tasks.where(F.col("status").isin("ENRICHING", "ENRICH_PENDING", "ENRICH_FAILED")).select("task_id"))
    ws.write("tasks", moved.withColumn("status", F.col("_next")).drop("_next", "_found"))
    if ws.has("enrichment"):
        ws.write("enrichment", ws.read("enrichment").join(stuck, "task_id", "left_anti"))
    return changed


def enrich(ws: Workspace, service: Callable[[str], str] | None = None, hops: int = 3, resume: bool = False) -> DataFrame:
    """Documents for the tasks that are due, wave by wave: the stub's, or the service's for redacted content.

    Dependencies that a wave's documents name and that no wave has had are the next wave;
    those more than ``hops`` away wait for review.  Answers of an earlier run for the same
    task are taken again instead of asking the service.
    """
    if resume:
        recover(ws)
        plan(ws)
    tasks = ws.read("tasks")
    latest = ws.write("latest_tasks", state.latest(tasks, ["file_path"], [F.col("created_at"), F.col("task_id")]).select("task_id", "file_path"))
    known = latest.select(F.col("file_path").alias("path"))
    earlier = ws.write("earlier_enrichment", ws.read("enrichment")) if ws.has("enrichment") else None
    due = ws.write("wave", tasks.where("status = 'ENRICH_PENDING'").select("task_id", "file_path").withColumn("depth", F.lit(0)))
    every, waiting = due, None
    done = None
    while not due.isEmpty():
        tasks = ws.write("tasks", tasks.join(due.select("task_id", F.lit("ENRICHING").alias("_now")), "task_id", "left").withColumn("status", F.coalesce("_now", "status")).drop("_now"))
        if service is None:
            answered = enrichment.stub(due)
        else:
            wanted, cached = due, None
            if earlier is not None:
                cached, wanted = state.split_cached(due, earlier.where("document IS NOT NULL").select("task_id", "document"), "task_id")
                cached = due.join(cached, "task_id")
            answered = enrichment.parse(enrichment.call(wanted.join(ws.read("contents"), "task_id", "left"), service)).drop("answer", "error")
            answered = answered if cached is None else answered.unionByName(cached)
        number = due.first().depth
        answered = ws.write(f"wave_{number}", answered)
        done = answered if done is None else done.unionByName(answered)
        named = answered.where("document IS NOT NULL").select(F.explode("document.dependencies.path").alias("name")).distinct()
        found = pairing.resolve_paths(named, "name", known).where("resolved_path IS NOT NULL").select(F.col("resolved_path").alias("file_path")).distinct()
        fresh = latest.join(found, "file_path", "left_semi").join(every.select("task_id"), "task_id", "left_anti").select("task_id", "file_path").withColumn("depth", F.lit(number + 1))
        if number >= hops:
            waiting = ws.write("waiting", fresh.withColumn("status", F.lit("AWAITING_HUMAN_REVIEW")))
            break
        due = ws.write(f"due_{number + 1}", fresh)
        every = every.unionByName(due)
    if done is None:
        return tasks.where("false")
    planned = every.withColumn("status", F.lit("PLANNED"))
    ws.write("waves", planned if waiting is None else planned.unionByName(waiting))
    kept = earlier.select("task_id", "file_path", "document").join(done.select("task_id"), "task_id", "left_anti") if earlier is not None else None
    fresh = done.select("task_id", "file_path", "document")
    stored = ws.write("enrichment", fresh if kept is None else fresh.unionByName(kept))
    documents.write_findings(documents.to_findings(stored.where("document IS NOT NULL").select("task_id", "document"), "SEMANTIC_ENRICHMENT"), ws.path("findings"))
    outcome = done.select("task_id", F.when(F.col("document").isNotNull(), "ENRICHED").otherwise("ENRICH_FAILED").alias("_next"))
    if waiting is not None:
        outcome = outcome.unionByName(waiting.select("task_id", F.col("status").alias("_next")))
    outcome = outcome.groupBy("task_id").agg(F.min("_next").alias("_next"))
    tasks = ws.write("tasks", tasks.join(outcome, "task_id", "left").withColumn("status", F.coalesce("_next", "status")).drop("_next"))
    used = done.join(ws.read("contents"), "task_id", "left").select(F.when(F.col("document").isNotNull(), "ENRICHED").otherwise("ENRICH_FAILED").alias("status"), (F.lit(0) if service is None else text.token_estimate(F.col("content"))).cast("long").alias("tokens"))
    m = enrichment.metric(used).first()
    documents.append_metric(_metric_row(ws.spark, 2, m.tasks, m.tasks - m.failed, 0, 0, 0, 0, m.tokens, m.cost), ws.path("metrics"))
    for violation in enrichment.violations(stored).where("size(violations) > 0").select("file_path", "violations").limit(20).collect():
        print(f"WARNING: {violation.file_path}: {', '.join(violation.violations)}")
    return done


def extract(ws: Workspace, force: bool = False, max_depth: int = 5, dry_run: bool = False) -> DataFrame | None:
    """Entry points to traced flows, features and relationships; None if there is nothing to extract.

    A dry run stops after the entry points.
    """
    if not force and not state.all_terminal(ws.read("tasks")):
        raise RuntimeError("some tasks are not done; finish enrichment or force")
    entries = flows.entry_points(ws.read("endpoints"), ws.read("scheduled_task"), ws.read("broker_listener"), ws.read("event_listener"))
    if not force and flows.nothing_to_extract(ws.read("floating_links"), ws.read("topic_links"), entries):
        return None
    edges = ws.read("call_edges")
    enriched = ws.read("enrichment") if ws.has("enrichment") else ws.read("tasks").where("false")
    entries = ws.write("entry_points", flows.prioritised(entries, edges, enriched.select("file_path"), ws.read("test_pairs").select(F.col("source_file").alias("file_path"))))
    if dry_run:
        return entries
    parts = ws.read("endpoints").select(F.col("file_path").alias("key"), F.lit("REST_ENDPOINT").alias("type"), F.lit(0).alias("rank"))
    parts = parts.unionByName(ws.read("scheduled_task").select(F.col("file_path").alias("key"), F.lit("SCHEDULED_TASK").alias("type"), F.lit(1).alias("rank")))
    kinds = F.when(F.col("annotation_type").isin("Entity", "MappedSuperclass"), "ENTITY").when(F.col("annotation_type") == "Repository", "REPOSITORY").when(F.col("annotation_type").isin("Controller", "RestController"), "REST_ENDPOINT").otherwise("SERVICE")
    for key in ("file_path", "class_name"):
        parts = parts.unionByName(ws.read("component").select(F.col(key).alias("key"), kinds.alias("type"), F.lit(2).alias("rank")))
    components = parts.groupBy("key").agg(F.min_by("type", "rank").alias("type"))
    calls = ws.read("floating_links").select("source_file", "source_method", "method", "url_pattern")
    steps = ws.write("flow_steps", graph.trace_flows(entries, edges, ws.read("db_access"), calls, components, tuple(rules.LIBRARY_PREFIXES), max_depth))
    found = ws.write("flows", flows.summarised(steps, entries))
    ws.write("orphans", flows.orphaned_methods(flows.known_methods(ws.read("scheduled_task"), ws.read("broker_listener"), ws.read("event_listener")), entries, edges))
    related = flows.http_relationships(ws.read("floating_links"), found, steps).unionByName(flows.topic_relationships(ws.read("topic_links"), found, steps))
    related = ws.write("relationships", related)
    members = flows.feature_members(found)
    ws.write("feature_relationships", flows.attach_to_features(related, members))
    totals = flows.totals(members).first()
    documents.append_metric(_metric_row(ws.spark, 3, totals.flows, totals.features, 0, 0, 0, 0, 0, 0.0), ws.path("metrics"))
    return found


#: Arrays of the index by table; those that are a part of a table.
INDEX_ARRAYS = {"component": "components", "endpoints": "endpoints", "scheduled_task": "scheduled_tasks", "event_listener": "event_listeners", "event_publisher": "event_publishers", "bean_method": "bean_methods", "db_access": "database_access", "http_call": "outbound_http_calls"}
SPLIT_ARRAYS = [(f"{name}_{kind}s", f"broker_{kind}", f"broker = '{broker}'") for broker, name in (("KAFKA", "kafka"), ("RABBITMQ", "rabbitmq"), ("ACTIVEMQ", "activemq")) for kind in ("listener", "publisher")]
SPLIT_ARRAYS += [("xml_beans", "xml_bean", "type IN ('bean', 'alias', 'import')"), ("xml_component_scans", "xml_bean", "type = 'component_scan'"), ("xml_aop_configs", "xml_bean", "type = 'aop'"), ("xml_namespace_beans", "xml_bean", "type = 'namespace'")]


def generate(ws: Workspace, out_dir: str, generated_at: str) -> list[str]:
    """Writes spec.md, manifest.json and index.json from the stored tables alone."""
    import json

    os.makedirs(out_dir, exist_ok=True)
    found, steps = ws.read("flows"), ws.read("flow_steps")
    features = found.where("NOT quarantined").select("flow_id", text.slugify(F.col("feature")).alias("feature_id"), "feature")
    nodes, edges = flows.traceability(steps, found)
    spec = documents.markdown(features, found, steps, ws.read("orphans"), ws.read("relationships"))
    rules_by_flow = flows.rules_of_flows(steps, ws.read("enrichment")) if ws.has("enrichment") else None
    parts = documents.manifest(features, found, nodes, edges, ws.read("feature_relationships"), rules_by_flow).orderBy("feature_id")
    relations = {name: ws.read(k).drop("task_id") for k, name in INDEX_ARRAYS.items() if ws.has(k)}
    for name, table, where in SPLIT_ARRAYS:
        if ws.has(table):
            relations[name] = ws.read(table).where(where).drop("task_id")
    relations["validators"] = documents.nested_validators(ws.read("validator")).join(ws.read("validator").select("file_path", "target_name").distinct(), "file_path")
    sources = ws.read("tasks").select(F.col("file_path").alias("source_file"), "target_name").distinct()
    relations["call_graph_edges"] = ws.read("call_edges").join(sources, "source_file")
    paths = [f"{out_dir}/{n}" for n in ("spec.md", "manifest.json", "index.json")]
    with open(paths[0], "w", encoding="utf-8") as f:
        f.write(spec)
    with open(paths[1], "w", encoding="utf-8") as f:
        f.write(f'{{"version": {json.dumps(documents.MANIFEST_VERSION)}, "generated_at": {json.dumps(generated_at)}, "features": [')
        for k, p in enumerate(parts.toLocalIterator()):
            f.write((",\n" if k else "") + p.document)
        f.write('], "orphans": [')
        for k, o in enumerate(ws.read("orphans").select(F.to_json(F.struct("class_name", "method_name", "file_path")).alias("body")).orderBy("body").toLocalIterator()):
            f.write((",\n" if k else "") + o.body)
        f.write("]}\n")
    links_of = {"topic_links": ws.read("topic_links"), "floating_links": ws.read("floating_links")}
    if ws.has("template_links"):
        links_of["template_links"] = ws.read("template_links")
    documents.write_index(relations, links_of, paths[2], generated_at)
    return paths


def status(ws: Workspace) -> tuple[DataFrame, str]:
    """(count of tasks by status, what to do next)."""
    counts = state.count_by_status(ws.read("tasks"))
    n = {r.status: r.n for r in counts.collect()}
    if n["ENRICHING"] or n["FAILED"]:
        hint = "scan with resume"
    elif n["ENRICH_PENDING"] or n["ENRICH_FAILED"]:
        hint = "enrich"
    elif n["INDEXED"]:
        hint = "plan"
    elif n["ENRICHED"] or n["SKIPPED"]:
        hint = "extract" if not ws.has("flows") else "generate"
    else:
        hint = "scan"
    return counts, hint


def findings(ws: Workspace) -> DataFrame:
    """(task_id, finding_type, finding_json, ordinal): the facts of the scan and the documents of enrichment."""
    found = ws.read("facts").select("task_id", F.col("kind").alias("finding_type"), F.col("fact").alias("finding_json"), "ordinal")
    if ws.has("findings"):
        found = found.unionByName(ws.read("findings").select("task_id", F.col("finding_type").cast("string"), "finding_json", F.lit(0).alias("ordinal")))
    return found


def clean(ws: Workspace, out_dir: str | None = None) -> None:
    ws.clear()
    if out_dir:
        shutil.rmtree(out_dir, ignore_errors=True)


def run_all(spark: SparkSession, manifest_path: str, folder: str, out_dir: str, generated_at: str, resume: bool = False, force: bool = False, dry_run: bool = False, unresolved_limit: int = 5, service: Callable[[str], str] | None = None) -> list[str]:
    """All phases.  A dry run takes the stub for every service; a limit of 0 leaves enrichment out."""
    with open(manifest_path, encoding="utf-8") as f:
        manifest = files.parse_manifest(f.read())
    faults = [m for level, m in files.validate_manifest(manifest) if level == "ERROR"]
    if faults:
        raise ValueError("; ".join(faults))
    ws = Workspace(spark, folder)
    scan(ws, files.targets_of(manifest), resume)
    plan(ws, unresolved_limit)
    if unresolved_limit:
        enrich(ws, None if dry_run else service, resume=resume)
    if extract(ws, force or not unresolved_limit) is None:
        return []
    return generate(ws, out_dir, generated_at)
