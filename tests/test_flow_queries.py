"""Flow queries parse and trace once, and their cross references equal plain models."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scoring, text
from corpusloom.operators import flows, graph, links
from corpusloom.plans import catalog, extraction_catalog, operator_catalog  # noqa: F401  fills the catalog
from tests.test_phases import test_traces_over_joined_parts_equal_those_over_the_whole_graph as traces_equal

SF = "/root/testdata/sf0.001"


def plan(df, kind: str = "executedPlan") -> str:
    return getattr(df._jdf.queryExecution(), kind)().toString()


@pytest.fixture(scope="module")
def traced(spark):
    return operator_catalog._flows(spark, SF)


@pytest.mark.parametrize("name", ["traced_flows", "unresolved_in_flows", "steps_by_file", "first_line_by_file", "flow_summaries", "traceability_nodes", "traceability_edges", "http_cross_references", "topic_cross_references"])
def test_results_come_from_stored_steps(spark, traced, monkeypatch, name):
    """Parsing and tracing run once before, not again for each use of the steps."""
    monkeypatch.setattr(operator_catalog, "_flows", lambda *_: traced)
    found = plan(catalog.QUERIES[name](spark, SF))
    assert "InPandas" not in found and "MapInArrow" not in found, name


def test_files_to_parse_are_dealt_out(spark):
    """Keys that lie in one small file are more than one task's files."""
    assert extraction_catalog.sources(spark, SF, "class A@k@ {}").rdd.getNumPartitions() > 1


def test_traces_of_roots_that_span_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        traces_equal(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_traces_take_many_entries_a_batch(spark, traced):
    rows = traced[0].__getitem__
    entries = spark.createDataFrame([("e", "f", "C", "m", 1, 2)], "id string, file_path string, class_name string, method_name string, start_line int, end_line int")
    http = spark.createDataFrame([], "source_file string, source_method string, method string, url_pattern string")
    steps = graph.trace_flows(entries, rows("edges"), rows("db_access"), http, spark.createDataFrame([], "key string, type string"))
    assert "FlatMapGroups" not in plan(steps) and [r.class_name for r in steps.collect()] == ["C"]


def test_http_relationships_equal_all_pairs(spark):
    rng = random.Random(8)
    part = lambda: rng.choice(["a", "b", "{id}", "", "7"])
    path = lambda: "/" + "/".join(part() for _ in range(rng.randint(0, 4))) + rng.choice(["", "/"])
    calls = spark.createDataFrame([(f"F{k % 9}", rng.choice(["GET", "PUT"]), path()) for k in range(60)], "source_file string, method string, url_pattern string")
    found = spark.createDataFrame([(f"f{k}", f"F{k % 12}", rng.choice(["HTTP", "HTTP", "KAFKA"]), path(), None) for k in range(40)], "flow_id string, file_path string, ep_type string, path string, topic_or_queue string")
    steps = spark.createDataFrame([(f"f{k}", f"F{rng.randint(0, 12)}", False) for k in range(40)], "flow_id string, source_file string, unresolved boolean")
    touched = {(r.flow_id, r.file_path) for r in found.collect()} | {(r.flow_id, r.source_file) for r in steps.collect()}
    clean = lambda df, c: df.withColumn("p", text.normal_path(text.url_path(F.col(c))))
    pairs = clean(calls, "url_pattern").crossJoin(clean(found.where("ep_type = 'HTTP' AND path <> ''"), "path").withColumnRenamed("p", "t")).where(scoring.path_matches(F.col("p"), F.col("t"))).collect()
    want = {(s, r.flow_id, f"{r.method} {r.url_pattern}") for r in pairs for s, f in touched if f == r.source_file and s != r.flow_id}
    got = flows.http_relationships(calls, found, steps)
    assert sorted((r.source_flow, r.target_flow, r.via) for r in got.collect()) == sorted(want) and want
    assert "forall" not in plan(got), "paths are compared pair by pair"


def test_topic_relationships_equal_a_plain_model(spark):
    rng = random.Random(9)
    produced = [(f"t{rng.randint(0, 4)}", f"F{rng.randint(0, 5)}") for _ in range(20)]
    listening = [(f"F{k}", [f"t{rng.randint(0, 6)}" for _ in range(2)], k == 3) for k in range(6)]
    left, right = spark.createDataFrame(produced, "topic string, file_path string"), spark.createDataFrame(listening, "file_path string, topics array<string>, is_pattern boolean")
    every = links.match_links(left, right, "file_path", "file_path", pattern="is_pattern")
    once = links.producer_links(left, right, "file_path", pattern="is_pattern")
    assert sorted(map(tuple, once.collect())) == sorted({(r.topic, r.producer, r.status) for r in every.collect() if r.producer})
    found = spark.createDataFrame([(f"f{k}", f"F{k % 6}", rng.choice([None, "t1", "t1,t1", "t2,t3"])) for k in range(30)], "flow_id string, file_path string, topic_or_queue string")
    steps = spark.createDataFrame([(f"f{k}", f"F{rng.randint(0, 5)}", False) for k in range(30)], "flow_id string, source_file string, unresolved boolean")
    touched = {(r.flow_id, r.file_path) for r in found.collect()} | {(r.flow_id, r.source_file) for r in steps.collect()}
    read = {(r.flow_id, t) for r in found.collect() for t in (r.topic_or_queue or "").split(",") if t}
    want = {(s, f, t) for t, p, status in map(tuple, once.collect()) if status == "RESOLVED" for s, file in touched if file == p for f, u in read if u == t and s != f}
    for made in (every, once):
        got = flows.topic_relationships(made, found, steps)
        assert sorted((r.source_flow, r.target_flow, r.via) for r in got.collect()) == sorted(want) and want
        assert not plan(got, "optimizedPlan").startswith("Aggregate"), "pairs are not shuffled to be made distinct"


def test_entries_of_a_file_share_one_part(spark, monkeypatch):
    """What a file's entries reach is gathered once for the file; equal outgoing calls stay as many as they are."""
    kept, keep = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, label: kept.append((label, keep(df, label))) or kept[-1][1])
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    entries = made([(f"e{k}", "F", "C", f"m{k}", 1, 2) for k in range(20)], "id string, file_path string, class_name string, method_name string, start_line int, end_line int")
    edges = made([("F", "C", f"m{k}", "G", "D", "help", 0, "RESOLVED", 3, 4) for k in range(20)] + [("G", "D", "help", None, "X", "gone", 0, "UNRESOLVED", 0, 0)], "source_file string, source_class string, source_method string, target_file string, target_class string, target_method string, arg_count int, resolved_status string, target_start_line int, target_end_line int")
    db = made([], "class_name string, method_name string, start_line int, end_line int, file_path string, sql string, param_count int")
    http = made([("G", "help", "GET", "/u")] * 2, "source_file string, source_method string, method string, url_pattern string")
    got = graph.trace_flows(entries, edges, db, http, made([], "key string, type string")).collect()
    assert [df.count() for label, df in kept if label == "trace-frontier"] == [1, 0]
    want = [("C", False), ("D", False), ("D", False), ("D", False), (None, True)]
    for k in range(20):
        assert [(r.class_name, r.unresolved) for r in sorted((r for r in got if r.flow_id == f"e{k}"), key=lambda r: (r.unresolved, r.step_index))] == want


def test_links_of_steps_need_no_summaries(spark, traced, monkeypatch):
    monkeypatch.setattr(operator_catalog, "_flows", lambda *_: traced)
    for name in ("traceability_edges", "traceability_nodes"):
        assert "bool_or" not in plan(catalog.QUERIES[name](spark, SF), "optimizedPlan") and "Aggregate" not in plan(catalog.QUERIES[name](spark, SF), "optimizedPlan")
