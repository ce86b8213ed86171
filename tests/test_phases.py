"""Recovery, waves, links and traces of the phases against plain models."""

import json
import random

from pyspark.sql import functions as F

from corpusloom import __main__ as cli
from corpusloom.functions import scoring
from corpusloom.operators import enrich, flows, graph, links
from corpusloom.plans import pipeline
from corpusloom.sources import documents, files
from tests.test_operators import url_model
from tests.test_pipeline import corpus


def workspace(spark, tmp_path):
    root, manifest = corpus(tmp_path)
    ws = pipeline.Workspace(spark, str(tmp_path / "state"))
    pipeline.scan(ws, files.targets_of(files.parse_manifest(manifest.read_text())))
    pipeline.plan(ws)
    return ws


def test_best_match_by_keys_equals_all_pairs(spark):
    rng = random.Random(3)
    part = lambda: rng.choice(["a", "b", "{id}", "${x}", "7"])
    path = lambda: "/" + "/".join(part() for _ in range(rng.randint(0, 4)))
    calls = spark.createDataFrame([(k, path(), rng.choice(["GET", "PUT"])) for k in range(150)], "call int, url string, verb string")
    ends = spark.createDataFrame([(k, path(), rng.choice(["GET", "PUT"])) for k in range(60)], "ordinal int, path string, method string")
    best = {}
    for c in calls.collect():
        scored = [(-url_model(c.url, e.path), e.ordinal, e.path) for e in ends.collect() if e.method == c.verb]
        best[c.call] = min(scored)
    got = links.best_match(calls, ends, "url", "path", [F.col("verb") == F.col("method")], scoring.url_confidence(F.col("url"), F.col("path")), "ordinal", keys=links.segment_keys(F.col("url"), F.col("path")))
    for r in got.collect():
        score, _, path_ = best[r.call]
        assert (r.confidence, r.endpoint) == (-score, path_ if score < 0 else None), r
    ending = links.best_match(calls, ends, "url", "path", [F.col("verb") == F.col("method")], scoring.template_confidence(F.col("url"), F.col("path")), "ordinal", 0.5, links.segment_keys(F.col("url"), F.col("path"), ends=True))
    plain = links.best_match(calls, ends, "url", "path", [F.col("verb") == F.col("method")], scoring.template_confidence(F.col("url"), F.col("path")), "ordinal", 0.5)
    assert sorted(map(tuple, ending.collect())) == sorted(map(tuple, plain.collect()))


def test_traces_over_joined_parts_equal_those_over_the_whole_graph(spark):
    rng = random.Random(6)
    names = [f"C{i}" for i in range(12)]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(40)})
    edges = [{"source_file": s, "source_class": s, "source_method": "m", "target_file": t, "target_class": t, "target_method": "m", "arg_count": 0, "resolved_status": rng.choice(["RESOLVED"] * 4 + ["UNRESOLVED"]), "target_start_line": 1, "target_end_line": 2} for s, t in pairs]
    db = [{"class_name": "C3", "method_name": "m", "start_line": 1, "end_line": 2, "file_path": "C3", "sql": "x", "param_count": 0}]
    http = [{"source_file": "C5", "source_method": "m", "method": "GET", "url_pattern": "/u"}]
    kind = "source_file string, source_class string, source_method string, target_file string, target_class string, target_method string, arg_count int, resolved_status string, target_start_line int, target_end_line int"
    rows = lambda items, schema: spark.createDataFrame([tuple(x[f.split()[0]] for f in schema.split(", ")) for x in items], schema)
    entries = spark.createDataFrame([(n, n, n, "m", 1, 2) for n in names], "id string, file_path string, class_name string, method_name string, start_line int, end_line int")
    found = graph.trace_flows(entries, rows(edges, kind), rows(db, "class_name string, method_name string, start_line int, end_line int, file_path string, sql string, param_count int"), rows(http, "source_file string, source_method string, method string, url_pattern string"), spark.createDataFrame([("C1", "SERVICE")], "key string, type string")).collect()
    for n in names:
        steps, lost = graph.Tracer(edges, db, http, {"C1": "SERVICE"}).trace(n, n, "m", 1, 2)
        got = sorted((r for r in found if r.flow_id == n), key=lambda r: (r.unresolved, r.step_index))
        assert [(r.component_type, r.class_name) for r in got if not r.unresolved] == [(s["component_type"], s["class_name"]) for s in steps], n
        assert [r.method_name for r in got if r.unresolved] == lost


def test_closure_of_a_graph_with_very_many_paths(spark):
    pairs = [(f"l{i}{a}", f"l{i + 1}{b}") for i in range(16) for a in "xy" for b in "xy"]
    got = graph.closure(spark.createDataFrame(pairs, "s string, t string"), "s", "t")
    assert got.count() == sum(4 * (16 - i) for i in range(16)) and got.agg(F.max("depth")).first()[0] == 16


def test_waves_ask_for_dependencies_and_stop_for_review(spark, tmp_path):
    ws = workspace(spark, tmp_path)
    asked = tmp_path / "asked"
    asked.mkdir()
    next_of = {"OrderController": "OrderRepo", "OrderService": "OrderController", "OrderRepo": "StockController", "StockController": "OrderListener"}

    def service(content: str) -> str:
        import uuid

        name = next(n for n in (*next_of, "OrderListener", "Broken") if f"class {n}" in content or f"interface {n}" in content or n == "Broken")
        (asked / uuid.uuid4().hex).write_text(name)
        needs = [f"shop.{next_of[name]}", "java.util.List"] if name in next_of else []
        return "```json\n" + json.dumps({"task_id": "t", "file_path": name, "summary": "s", "dependencies": needs, "confidence": 0.5})[:-1] + ",}\n```"

    pipeline.enrich(ws, service, hops=1)
    short = lambda r: r.file_path.rsplit("/", 1)[-1].removesuffix(".java")
    status = {short(r): r.status for r in ws.read("tasks").collect()}
    depth = {short(r): (r.depth, r.status) for r in ws.read("waves").collect()}
    assert depth["OrderService"] == (0, "PLANNED")
    assert {s for d, s in depth.values() if d <= 1} == {"PLANNED"} and all(s == "AWAITING_HUMAN_REVIEW" for d, s in depth.values() if d > 1)
    assert all(status[n] == ("ENRICHED" if d <= 1 else "AWAITING_HUMAN_REVIEW") for n, (d, _) in depth.items())
    first = len(list(asked.iterdir()))
    found = pipeline.findings(ws)
    assert found.where("finding_type = 'SEMANTIC_ENRICHMENT'").count() == sum(d <= 1 for d, _ in depth.values()) == first
    ws.write("tasks", ws.read("tasks").withColumn("status", F.when(F.col("status") == "ENRICHED", "ENRICH_PENDING").otherwise(F.col("status"))))
    pipeline.enrich(ws, service, hops=0)
    assert len(list(asked.iterdir())) == first  # the answers are there already
    pipeline.recover(ws)
    assert ws.read("enrichment").count() > 0 and ws.read("tasks").where("status = 'ENRICHING'").isEmpty()
    phases = {r.phase for r in documents.metrics(spark, ws.path("metrics")).collect()}
    assert phases == {1, 2}


def test_recovery_before_a_resumed_enrichment(spark, tmp_path):
    ws = workspace(spark, tmp_path)
    names = [r.task_id for r in ws.read("tasks").orderBy("file_path").collect()]
    states = dict(zip(names, ["ENRICHING", "FAILED", "ENRICH_FAILED", "PENDING", "ENRICHED"], strict=False))
    ws.write("tasks", ws.read("tasks").withColumn("status", F.coalesce(F.create_map(*[F.lit(x) for kv in states.items() for x in kv])[F.col("task_id")], F.col("status"))))
    moved = pipeline.recover(ws)
    after = {r.task_id: r.status for r in ws.read("tasks").collect()}
    assert all(moved[s] >= 1 for s in ("ENRICHING", "FAILED", "ENRICH_FAILED", "PENDING"))
    assert [after[n] for n in names[:5]] == ["INDEXED", "INDEXED", "ENRICH_PENDING", "INDEXED", "ENRICHED"]


def test_a_table_survives_a_crash_between_renames(spark, tmp_path):
    ws = pipeline.Workspace(spark, str(tmp_path / "w"))
    ws.write("t", spark.range(3))
    ws._rename("t", ".t.old")
    assert ws.has("t") and ws.read("t").count() == 3
    ws.write("t", ws.read("t").where("id > 0"))
    assert ws.read("t").count() == 2 and not ws._exists(".t.old")


def test_repair_of_json():
    assert json.loads(enrich.repair('{"a": "x, }" "b": [1 2,]')) == {"a": "x, }", "b": [1, 2]}
    assert json.loads(enrich.repair('```json\n{"a": {"b": [1, {"c": "d\\"e"}')) == {"a": {"b": [1, {"c": 'd"e'}]}}
    assert json.loads(enrich.repair('{"a": 1}}')) == {"a": 1} and enrich.repair(None) is None


def test_ranks_over_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
    got = flows.ranked(df, [F.desc("v")])
    assert got.where("rank <> 4999 - v").count() == 0 and got.count() == 5000


def test_commands(spark, tmp_path, capsys):
    _, manifest = corpus(tmp_path)
    base = ["--manifest", str(manifest), "--state", str(tmp_path / "s"), "--out", str(tmp_path / "o")]
    assert cli.main(["validate", *base]) == 0 and cli.main(["scan", *base]) == 0
    cli.main(["plan", *base])
    cli.main(["enrich", *base, "--dry-run"])
    cli.main(["extract", *base, "--force", "--dry-run"])
    assert "entry points" in capsys.readouterr().out
    cli.main(["status", *base, "--status", "enriched", "--verbose"])
    cli.main(["task-list", *base, "--target", "main", "--limit", "3"])
    assert "3 of " in capsys.readouterr().out
    ws = pipeline.Workspace(spark, str(tmp_path / "s"))
    task = ws.read("tasks").where("file_path LIKE '%OrderController.java'").first().task_id
    cli.main(["task-findings", *base, "--task", task[:20], "--type", "endpoint"])
    assert "2 findings" in capsys.readouterr().out
    cli.main(["set-status", *base, "--task", task, "--status", "FAILED", "--dry-run"])
    assert "1 tasks" in capsys.readouterr().out and ws.read("tasks").where("status = 'FAILED'").count() == 0
    cli.main(["set-status", *base, "--task", task, "--status", "FAILED"])
    assert ws.read("tasks").where("status = 'FAILED'").count() == 1
    cli.main(["clean", *base])
    assert not (tmp_path / "s").exists()


def test_detectors_can_be_added():
    from corpusloom.extract import javaparse, rules

    def graphql(t):
        for m in t.methods:
            if m.annotation("QueryMapping"):
                yield {"http_method": "QUERY", "path": m.name, "controller_name": t.name, "method_name": m.name}

    rules.ENDPOINT_DETECTORS.append(graphql)
    rules.DB_CALL_DETECTORS.append(lambda t, m, c: rules._db("MONGO", t, m) if c.scope == "mongo" else None)
    rules.HTTP_CALL_DETECTORS.append(lambda t, m, c: rules._http("GET", "x", "GRPC", t, m) if c.scope == "stub" else None)
    try:
        unit = javaparse.parse("class A { @QueryMapping String q() { mongo.find(1); stub.call(); return null; } }")
        assert [f["path"] for _, f in rules.endpoints(unit, "")] == ["q"]
        assert [f["type"] for _, f in rules.database(unit, "")] == ["MONGO"]
        assert [f["client_type"] for _, f in rules.http_calls(unit, "")] == ["GRPC"]
    finally:
        for found in (rules.ENDPOINT_DETECTORS, rules.DB_CALL_DETECTORS, rules.HTTP_CALL_DETECTORS):
            found.pop()


def test_files_that_appear_are_taken_once(spark, tmp_path):
    from corpusloom.operators import state
    from corpusloom.streaming import incremental

    store = {"tasks": spark.createDataFrame([], "task_id string, status string, path string")}
    sizes = []

    def handle(batch, number):
        fresh = incremental.new_tasks(batch, store["tasks"], "main").select("task_id", F.lit("INDEXED").alias("status"), "path")
        sizes.append(fresh.count())
        rows = state.upsert(store["tasks"], fresh, ["task_id"]).collect()
        store["tasks"] = spark.createDataFrame(rows, "task_id string, status string, path string")

    for turn, rows in enumerate(([("a", "1"), ("b", "2")], [("a", "1"), ("c", "3")], [("a", "changed")])):
        spark.createDataFrame(rows, "path string, content string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.watch(spark, str(tmp_path / "in"), "path string, content string", str(tmp_path / "check"), handle).awaitTermination()
        assert sum(sizes) == (2, 3, 4)[turn]
