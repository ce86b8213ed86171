import random

from pyspark.sql import functions as F

from corpusloom.extract import javaparse, markup, rules
from corpusloom.functions import hashing, scoring, text
from corpusloom.operators import enrich, flows, graph, links, pairing, resolve, state
from corpusloom.sources import documents, files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def url_model(url, path):
    """The score in plain Python."""
    import re

    if url == path:
        return 1.0
    a, b = re.sub("/+$", "", url).split("/"), re.sub("/+$", "", path).split("/")
    var = lambda s: re.fullmatch(r"\{[^}]+\}", s)
    if len(a) != len(b):
        n = min(len(a), len(b))
        return 0.4 if n > 1 and all(x == y or var(y) for x, y in zip(a, b, strict=False)) else 0.0
    points = [1.0 if x == y else 0.8 if var(y) else 0.6 if "${" in x or "${" in y else 0.0 for x, y in zip(a, b, strict=True)]
    if 0.0 in points:
        return 0.0
    mean = round(sum(points) / len(points), 9)
    return next((v for t, v in ((0.9, 1.0), (0.7, 0.8), (0.5, 0.6), (0.3, 0.4)) if mean >= t), 0.0)


def test_url_confidence_equals_a_plain_model(spark):
    random.seed(1)
    part = lambda: random.choice(["api", "orders", "{id}", "${x}", "7", ""])
    rows = [("/" + "/".join(part() for _ in range(random.randint(0, 4))), "/" + "/".join(part() for _ in range(random.randint(0, 4)))) for _ in range(400)]
    df = spark.createDataFrame(rows, "u string, p string")
    for r in df.select("u", "p", scoring.url_confidence(F.col("u"), F.col("p")).alias("s")).collect():
        assert r.s == url_model(r.u, r.p), (r.u, r.p)


def test_hashing_of_nulls_and_short_ids(spark):
    import hashlib

    assert one(spark, hashing.task_id(F.lit("a"), F.lit(None), F.lit("b"))) == hashlib.sha256(b"a||b").hexdigest()
    assert one(spark, hashing.content_hash(F.lit(None).cast("string"))) == "unreadable"
    assert one(spark, hashing.short_id(F.lit("abc"))) == "17862"
    assert one(spark, hashing.short_id(F.lit(""))) == "0"


def test_text_functions(spark):
    assert one(spark, text.normal_path(F.lit("//a///b/"))) == "/a/b"
    assert one(spark, text.normal_path(F.lit(""))) == "/"
    assert one(spark, text.url_path(F.lit("HTTP://h:1/a?b#c"))) == "/a"
    assert one(spark, text.table_hint(F.lit("delete from  Orders where"))) == "Orders"
    assert one(spark, text.feature_name(F.lit("/api/orders/{id}"))) == "Orders"
    assert one(spark, text.combine_paths(F.lit("api/"), F.lit("x"))) == "/api/x"
    assert one(spark, text.token_estimate(F.lit("  "))) == 0
    assert one(spark, text.redact(F.lit("mail a.b@c.org"))) == "mail [REDACTED:email]"
    assert one(spark, text.split_list(F.lit(" a , b,"))) == ["a", "b"]
    assert one(spark, text.is_accessor(F.lit("getName"))) and not one(spark, text.is_accessor(F.lit("gets")))


def test_consumer_level_orphans(spark):
    producers = spark.createDataFrame([("t1", "P1"), ("t9", "P2")], "topic string, producer string")
    consumers = spark.createDataFrame([("C1", ["t1", "t2"], False), ("C2", ["t3", "t4"], False), ("C3", ["t.*"], True)], "consumer string, topics array<string>, p boolean")
    got = {tuple(r) for r in links.match_links(producers, consumers, "producer", "consumer", pattern="p").collect()}
    assert got == {("t1", "P1", "C1", "RESOLVED"), ("t9", "P2", None, "PENDING"), ("t3", None, "C2", "PENDING"), ("t4", None, "C2", "PENDING"), ("t.*", None, "C3", "PENDING")}


def test_state(spark):
    old = spark.createDataFrame([("a", "INDEXED", 1), ("b", "ENRICHING", 1)], "task_id string, status string, v int")
    new = spark.createDataFrame([("b", "INDEXED", 2), ("c", "FAILED", 2)], "task_id string, status string, v int")
    assert sorted(map(tuple, state.upsert(old, new, ["task_id"]).collect())) == [("a", "INDEXED", 1), ("b", "INDEXED", 2), ("c", "FAILED", 2)]
    df = spark.createDataFrame([(s, f) for s in state.STATUSES for f in (True, False)], "status string, found boolean")
    got = {(r.status, r.found): r.x for r in df.select("status", "found", state.recovered(F.col("status"), F.col("found")).alias("x")).collect()}
    assert got["ENRICHING", True] == "INDEXED" and got["FAILED", True] == "ENRICHED" and got["FAILED", False] == "INDEXED" and got["ENRICH_FAILED", True] == "ENRICH_PENDING"
    assert {r.status: r.n for r in state.count_by_status(old).collect()}["FAILED"] == 0
    assert state.find_by_prefix(old, "a")["v"] == 1
    for prefix in ("", "zz"):
        try:
            state.find_by_prefix(old, prefix)
            raise AssertionError
        except LookupError:
            pass


def plain_trace(edges, entry, depth=5):
    steps, seen = [], set()

    def walk(node, d):
        if d >= depth or node in seen:
            return
        seen.add(node)
        for s, t in edges:
            if s == node:
                steps.append(t)
                walk(t, d + 1)

    walk(entry, 0)
    return steps


def test_trace_equals_a_plain_search_on_random_graphs(spark):
    random.seed(4)
    for _ in range(20):
        names = [f"C{i}" for i in range(8)]
        pairs = sorted({(random.choice(names), random.choice(names)) for _ in range(16)})
        edges = [{"source_file": s, "source_class": s, "source_method": "m", "target_file": t, "target_class": t, "target_method": "m", "arg_count": 0, "resolved_status": "RESOLVED", "target_start_line": 1, "target_end_line": 2} for s, t in pairs]
        steps, lost = graph.Tracer(edges, [], [], {}).trace("C0", "C0", "m")
        assert [s["class_name"] for s in steps[1:]] == plain_trace(pairs, "C0") and not lost


def test_levels_and_closure_stop_at_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "x")], "s string, t string")
    got = {(r.node, r.depth) for r in graph.levels(spark.createDataFrame([("a",)], "r string"), edges, "s", "t", 5).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {(r.target, r.depth) for r in graph.closure(edges, "s", "t").where("source = 'a'").collect()} == {("b", 1), ("c", 2), ("d", 3)}


def test_call_resolution_through_supertypes(spark):
    sites = spark.createDataFrame([("A", "m", "A.java", "B", "f", 0), ("A", "m", "A.java", "B", "g", 1), ("A", "m", "A.java", "B", "h", 2), ("A", "m", "A.java", "R", "anything", 0), ("A", "m", "A.java", "X", "y", 0)], "source_class string, source_method string, file_path string, target_type string, method_name string, arg_count int")
    declared = spark.createDataFrame([("B", "<clinit>", [], "B.java", 1, 9), ("B", "g", ["int"], "B.java", 2, 3), ("B", "g", ["long"], "B.java", 4, 5), ("B", "h", [], "B.java", 6, 7), ("P", "f", [], "P.java", 2, 3), ("R", "<clinit>", [], "R.java", 1, 1)], "class_name string, method_name string, param_types array<string>, file_path string, start_line int, end_line int")
    supers = spark.createDataFrame([("B", "P", "p.P"), ("P", "B", "p.B"), ("R", "JpaRepository", "org.springframework.data.jpa.repository.JpaRepository")], "class_name string, super_simple_name string, super_fqn string")
    got = {r.target_method: r for r in resolve.call_edges(sites, declared, supers).collect()}
    assert (got["f"].resolved_status, got["f"].target_class, got["f"].target_file) == ("RESOLVED", "P", "P.java")
    assert got["g"].ambiguous_candidates == ["B.g(int)", "B.g(long)"] and got["h"].resolved_status == "UNRESOLVED"
    assert (got["anything"].resolved_status, got["anything"].target_file) == ("RESOLVED", "R.java") and got["y"].resolved_status == "UNRESOLVED"


def test_pairing_and_paths(spark):
    src = spark.createDataFrame([("p/src/main/java/a/B.java",), ("p/src/main/java/a/C.java",)], "source_file string")
    found = pairing.first_existing(src, pairing.test_candidates(F.col("source_file")), spark.createDataFrame([("p/src/test/java/a/BIT.java",), ("p/src/test/java/a/BTest.java",)], "path string"), "path")
    assert {r.source_file[-6:]: r.found for r in found.collect()} == {"B.java": "p/src/test/java/a/BTest.java", "C.java": None}
    names = spark.createDataFrame([("a.B",), ("B",), ("zzz",)], "name string")
    got = {r.name: r.resolved_path for r in pairing.resolve_paths(names, "name", spark.createDataFrame([("x/a/B.java",)], "path string")).collect()}
    assert got == {"a.B": "x/a/B.java", "B": "x/a/B.java", "zzz": None}


def test_manifest_globs_and_targets(spark):
    m = files.parse_manifest("version: 1\ntargets:\n  - name: one\n    path: /a\n    exclude: [gen/**, '**/x.java']\n  - name: two\n    path: /a/b\n    odd: 1\n")
    assert [t.exclude for t in files.targets_of(m)] == [("gen/**", "**/x.java"), ()]
    assert files.validate_manifest(m) == [("WARNING", "targets[1].odd is not known")]
    assert files.validate_manifest({}) and files.validate_manifest({"targets": [{"name": "x"}]})[0][0] == "ERROR"
    df = spark.createDataFrame([("target/x.java",), ("a/target/y.java",), ("src/z.java",)], "r string")
    kept, out, n = files.split_excluded(df, "r", files.DEFAULT_EXCLUDES)
    assert kept.count() == 1 and out.count() == 2
    assert [r.target_name for r in files.assign_target(spark.createDataFrame([("/a/b/c",), ("/z",)], "path string"), files.targets_of(m)).collect()] == ["one", None]
    assert [files.language_level(v) for v in ("1.8", "11", "21", None)] == [8, 11, 17, 17]


def test_templates_and_xml():
    html = '<form th:action="@{/save/{id}(id=${o.id})}" th:method="put"><input th:field="*{name}"/><input th:field="*{name}"/></form><a th:href="@{/x}">'
    got = list(markup.forms("a.html", html))
    assert [(g["http_method"], g["field_names"], g["link_type"]) for g in got] == [("PUT", ["name"], "FORM"), ("GET", [], "LINK")]
    jsp = '<form method="post" action="/a"></form><form action="/b"><input name="q"></form><a href="http://x">'
    assert [(g["http_method"], g["url_pattern"]) for g in markup.forms("a.jsp", jsp)] == [("POST", "/a"), ("GET", "/b")]
    web = '<web-app xmlns="urn:x"><servlet><servlet-name>s</servlet-name><servlet-class>C</servlet-class></servlet><servlet-mapping><servlet-name>s</servlet-name><url-pattern>/u</url-pattern></servlet-mapping></web-app>'
    assert [(s["path"], s["controller_name"]) for s in markup.servlets("web.xml", web)] == [("/u", "C")]
    beans = '<beans xmlns="http://www.springframework.org/schema/beans" xmlns:util="http://www.springframework.org/schema/util"><bean id="a" class="A"/><import resource="b.xml"/><util:list id="l"/></beans>'
    assert [b["type"] for b in markup.beans("a.xml", beans)] == ["bean", "import", "namespace"]
    assert not list(markup.beans("a.xml", "<other/>"))


def facts(source, kind):
    unit = javaparse.parse(source)
    return [f for rule in rules.EXTRACTORS for k, f in rule(unit, "X.java") if k == kind]


def test_database_rules():
    src = """import org.springframework.data.repository.CrudRepository;
    @NamedQuery(name = "n", query = "select o from Order o") class A {
      EntityManager em; Session session; Connection conn;
      @Transactional public void a() { em.createNativeQuery("select 1"); session.createQuery("from X"); em.persist(o); conn.prepareStatement("UPDATE stock SET n = 1"); statement.executeQuery("SELECT * FROM t"); }
      @Procedure(name = "proc") void p() {}
    }
    interface R extends CrudRepository<Order, Long> { Order findByName(String s); void other(); }"""
    got = [(f["type"], f["table_hint"] or f["procedure_name"] or f["entity_type"]) for f in facts(src, "db_access")]
    assert sorted(got) == sorted([("JPQL_HQL", ""), ("TRANSACTION", ""), ("NATIVE_SQL", ""), ("JPQL_HQL", ""), ("ENTITY_MANAGER", ""), ("RAW_JDBC", "stock"), ("RAW_JDBC", "t"), ("STORED_PROCEDURE", "proc"), ("SPRING_DATA", "Order")])


def test_http_client_rules():
    src = """class A { void a() {
      restTemplate.exchange("/r", HttpMethod.PUT, e, X.class); webClient.post().uri("/w").retrieve(); restClient.get().uri("/c").retrieve();
      httpClient.send(HttpRequest.newBuilder(URI.create("http://j")).build(), h); new HttpGet("/apache");
    } void u() { HttpURLConnection c = new URL("http://u/x").openConnection(); c.setRequestMethod("DELETE"); }
    void o() { OkHttpClient k; k.newCall(new Request.Builder().url("/ok").post(b).build()); } }
    @FeignClient(name = "f", path = "/base") interface F { @GetMapping("/f") String f(); }
    @HttpExchange("/e") interface E { @PostExchange("/p") void p(); }"""
    got = {(f["client_type"], f["method"], f["url_pattern"]) for f in facts(src, "http_call")}
    assert got == {("REST_TEMPLATE", "PUT", "/r"), ("WEB_CLIENT", "POST", "/w"), ("REST_CLIENT", "GET", "/c"), ("JAVA_NET_HTTP_CLIENT", "GET", "http://j"), ("APACHE_HTTP_CLIENT", "GET", "/apache"), ("HTTP_URL_CONNECTION", "DELETE", "http://u/x"), ("OK_HTTP", "POST", "/ok"), ("FEIGN", "GET", "/base/f"), ("HTTP_EXCHANGE", "POST", "/e/p")}


def test_messages_events_and_views():
    src = """@Controller class A { @RabbitListener(queues = {"q1", "q2"}) void r(Msg m) {} @JmsListener(destination = "d") void j(String s) {} @KafkaListener(topicPattern = "t.*") void k(String s) {}
      @EventListener void on(Paid p) { helper.go(x.y()); publisher.publishEvent(new Done(p)); rabbitTemplate.convertAndSend("ex", "key", p); }
      @GetMapping("/v") String v() { return name(); } private String name() { return "view"; } }"""
    assert [(f["broker"], f["topics"], f["is_pattern"]) for f in facts(src, "broker_listener")] == [("RABBITMQ", ["q1", "q2"], False), ("ACTIVEMQ", ["d"], False), ("KAFKA", ["t.*"], True)]
    assert facts(src, "event_publisher")[0]["event_type"] == "Done" and facts(src, "event_listener")[0]["payload_type"] == "Paid"
    assert (facts(src, "broker_publisher")[0]["exchange"], facts(src, "broker_publisher")[0]["routing_key"]) == ("ex", "key")
    assert facts(src, "endpoint")[0]["view_name"] == "view"


def test_grouping_and_enrichment(spark):
    assert flows.group_by_claims([("f1", "a"), ("f2", "b"), ("f3", "c")], [("X", ["b"])]) == [("X", ["f2"]), ("Ungrouped Flows", ["f1", "f3"])]
    assert flows.group_by_claims([("f1", "a"), ("f2", "b")], [("X", ["zz"]), ("Y", ["a"])]) == [("X", ["f1", "f2"])]
    answers = spark.createDataFrame([("```json\n{'task_id': 't', file_path: 'p', \"summary\": \"s\", \"edge_cases\": [\"x\",],}\n```",), ("no json",)], "answer string")
    docs = enrich.violations(enrich.parse(answers)).collect()
    assert docs[0].document.summary == "s" and docs[0].document.dependencies == [] and docs[0].violations == []
    assert docs[1].violations


def test_snapshots(spark, tmp_path):
    (tmp_path / "s" / "t").mkdir(parents=True)
    (tmp_path / "s" / "t" / "a").write_text("1")
    documents.snapshot(str(tmp_path / "s"), str(tmp_path / "n"), "one")
    (tmp_path / "s" / "t" / "a").write_text("2")
    assert documents.snapshots(str(tmp_path / "n")) == [("one", 1, 1)]
    documents.restore(str(tmp_path / "s"), str(tmp_path / "n"), "one")
    assert (tmp_path / "s" / "t" / "a").read_text() == "1"
