"""Queries of the relational operators over the star schema, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import hashing, scoring, text
from corpusloom.operators import graph, links, pairing, planner, resolve, state
from corpusloom.plans.registry import ORACLES, QUERIES, joined, query, table  # noqa: F401  read by the entry

# --- identity and text -----------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS content_hash, sha256(coalesce(source, '') || '|' || CAST(doc_id AS VARCHAR) || '|' || sha256(text)) AS task_id FROM documents")
def task_ids(spark, sf):
    docs = table(spark, sf, "documents").withColumn("content_hash", hashing.content_hash(F.col("text")))
    return docs.select("doc_id", "content_hash", hashing.task_id(F.col("source"), F.col("doc_id"), F.col("content_hash")).alias("task_id"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def dedup_by_content(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", hashing.content_hash(F.col("text")).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, ceil(length(text) / 4.0) > 1000 AS over_budget, round(ceil(length(text) / 4.0) * 0.000002, 9) AS cost FROM documents")
def token_budget(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))
    return docs.select("doc_id", "tokens", text.over_budget(F.col("tokens"), 1250, 0.8).alias("over_budget"), F.round(text.api_cost(F.col("tokens")), 9).alias("cost"))


def _redact_sql(column: str, upto: int | None = None) -> str:
    for kind, pattern in [*text.SECRET_PATTERNS.items()][:upto]:
        column = f"regexp_replace({column}, '{pattern}', '[REDACTED:{kind}]', 'g')"
    return column


@query(f"SELECT doc_id, sha256({_redact_sql('text')}) AS redacted_hash FROM documents")
def redact_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.redact(F.col("text")).cast("binary"), 256).alias("redacted_hash"))


@query("SELECT " + ", ".join(f"CAST(sum(len(regexp_extract_all({_redact_sql('text', i)}, '{p}'))) AS BIGINT) AS {k}" for i, (k, p) in enumerate(text.SECRET_PATTERNS.items())) + " FROM documents")
def redaction_counts(spark, sf):
    counted = table(spark, sf, "documents").select(*text.redaction_counts(F.col("text")))
    return counted.agg(*[F.sum(k).alias(k) for k in text.SECRET_PATTERNS])


@query("SELECT DISTINCT p_name, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slugify(spark, sf):
    return table(spark, sf, "part").select("p_name", text.slugify(F.col("p_name")).alias("slug")).distinct()


@query("SELECT p_partkey, lower(to_hex(list_reduce(list_concat([CAST(0 AS BIGINT)], list_transform(string_split(p_name, ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda h, x: (h * 31 + x) % 4294967296))) AS short_id FROM part")
def short_id(spark, sf):
    return table(spark, sf, "part").select("p_partkey", hashing.short_id(F.col("p_name")).alias("short_id"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_lookup(spark, sf):
    parsed = table(spark, sf, "events").select("event_id", F.from_json("props", "k long", {"mode": "PERMISSIVE", "allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"}).alias("p"))
    return parsed.where("p.k IS NOT NULL").select("event_id", F.col("p.k").alias("k"))


@query("SELECT doc_id, source, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS head, CASE WHEN length(text) > 40 THEN '…' || right(text, 39) ELSE text END AS tail FROM documents")
def truncated(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", "source", text.truncate(t, 40).alias("head"), text.truncate_start(t, 40).alias("tail"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS part FROM documents")
def line_slices(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.source_lines(F.col("text"), F.lit(2), F.lit(3)).alias("part"))


# --- pages ---------------------------------------------------------------------------------

_HREF = '<a href="([^"]*)"'


@query(f"SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS href FROM pages) GROUP BY page_id, href")
def anchor_links(spark, sf):
    found = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("href"))
    return found.groupBy("page_id", "href").agg(F.count("*").alias("n"))


_PATH_SQL = "regexp_replace(regexp_replace({0}, '^https?://[^/?#]*', ''), '[?#].*$', '')"
_NORMAL_SQL = "'/' || regexp_replace(regexp_replace({0}, '/+', '/', 'g'), '^/|/$', '', 'g')"


@query(f"SELECT page_id, {_PATH_SQL.format('url')} AS raw_path, {_NORMAL_SQL.format(_PATH_SQL.format('url'))} AS path FROM pages")
def page_paths(spark, sf):
    raw = table(spark, sf, "pages").select("page_id", text.url_path(F.col("url")).alias("raw_path"))
    return raw.select("page_id", "raw_path", text.normal_path(F.col("raw_path")).alias("path"))


@query("SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_matches(url, '/(de|fr)/') AS excluded, count(*) AS n FROM pages GROUP BY 1, 2")
def exclude_globs(spark, sf):
    from corpusloom.sources.files import glob_regex

    excluded = F.col("url").rlike(glob_regex("**/de/**")) | F.col("url").rlike(glob_regex("**/fr/**"))
    return table(spark, sf, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), excluded.alias("excluded")).groupBy("host", "excluded").agg(F.count("*").alias("n"))


#: Endpoint templates for the match queries: one per language and kind, made from a rule.
def _endpoint_rows() -> list[tuple[int, str]]:
    kinds = ["/{lang}/{id}", "/en/{id}", "/de/{id}", "/fr/{id}/comments", "/es", "/en/{id}/edit", "/es/{id}"]
    return list(enumerate(kinds))


_ENDPOINTS_SQL = "(VALUES " + ", ".join(f"({k}, '{p}')" for k, p in _endpoint_rows()) + ") AS e(ordinal, path)"
_IS_VAR = "regexp_matches({0}, '^\\{{[^}}]+\\}}$')"


def _scores_sql(kind: str) -> str:
    paths = f"SELECT page_id, {_NORMAL_SQL.format(_PATH_SQL.format('url'))} AS url FROM pages"
    strip = "^/+|/+$" if kind == "template" else "/+$"
    both = f"SELECT page_id, url, ordinal, path, string_split(regexp_replace(url, '{strip}', '', 'g'), '/') AS a, string_split(regexp_replace(path, '{strip}', '', 'g'), '/') AS b FROM ({paths}), {_ENDPOINTS_SQL}"
    var = _IS_VAR.format("b[i]")
    if kind == "template":
        alike = f"len(list_filter(range(1, len(a) + 1), lambda i: NOT ({var} OR a[i] = b[i]))) = 0 AND len(list_filter(range(1, len(b) + 1), lambda i: {var})) > 0"
        score = f"CASE WHEN url = path THEN 1.0 WHEN len(a) = len(b) THEN CASE WHEN {alike} THEN 0.8 ELSE 0.0 END WHEN ends_with(url, path) OR ends_with(path, url) THEN 0.5 ELSE 0.0 END"
    else:
        fit = f"CASE WHEN a[i] = b[i] THEN 1.0 WHEN {var} THEN 0.8 WHEN contains(a[i], '${{') OR contains(b[i], '${{') THEN 0.6 ELSE 0.0 END"
        fits = f"list_transform(range(1, len(a) + 1), lambda i: {fit})"
        front = f"len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: NOT (a[i] = b[i] OR {var}))) = 0"
        mean = f"round(list_sum({fits}) / len(a), 9)"
        stepped = f"CASE WHEN list_min({fits}) = 0 THEN 0.0 WHEN {mean} >= 0.9 THEN 1.0 WHEN {mean} >= 0.7 THEN 0.8 WHEN {mean} >= 0.5 THEN 0.6 WHEN {mean} >= 0.3 THEN 0.4 ELSE 0.0 END"
        score = f"CASE WHEN url = path THEN 1.0 WHEN len(a) = len(b) THEN {stepped} WHEN least(len(a), len(b)) > 1 AND {front} THEN 0.4 ELSE 0.0 END"
    return f"SELECT page_id, url, ordinal, path, CAST({score} AS DOUBLE) AS score FROM ({both})"


def _page_calls(spark, sf) -> tuple[DataFrame, DataFrame]:
    calls = table(spark, sf, "pages").select("page_id", text.normal_path(text.url_path(F.col("url"))).alias("url"), F.lit("GET").alias("verb"))
    ends = spark.createDataFrame(_endpoint_rows(), "ordinal int, path string").withColumn("http_method", F.lit("get"))
    return calls, F.broadcast(ends)


@query(f"SELECT page_id, url, CASE WHEN score > 0 THEN path END AS endpoint, score AS confidence, CASE WHEN score > 0 THEN 'RESOLVED' ELSE 'PENDING' END AS status FROM ({_scores_sql('url')}) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ordinal) = 1")
def best_link_match(spark, sf):
    calls, ends = _page_calls(spark, sf)
    found = links.best_match(calls, ends, "page_id", "path", [F.upper("verb") == F.upper("http_method")], scoring.url_confidence(F.col("url"), F.col("path")), "ordinal", keys=links.segment_keys(F.col("url"), F.col("path")))
    return found.drop("verb")


@query(f"SELECT page_id, url, score AS confidence, path AS endpoint FROM ({_scores_sql('template')}) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ordinal) = 1 AND score >= 0.5")
def template_match(spark, sf):
    calls, ends = _page_calls(spark, sf)
    return links.best_match(calls, ends, "page_id", "path", [F.upper("verb") == F.upper("http_method")], scoring.template_confidence(F.col("url"), F.col("path")), "ordinal", least=0.5, keys=links.segment_keys(F.col("url"), F.col("path"), ends=True)).drop("verb")


# --- links ----------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT s_suppkey AS producer, s_suppkey * 2 AS topic FROM supplier),
c AS (SELECT c_custkey AS consumer, unnest(list_distinct([c_custkey // 15, c_custkey // 7])) AS topic FROM customer),
linked AS (SELECT DISTINCT consumer FROM c WHERE topic IN (SELECT topic FROM p))
SELECT topic, producer, consumer, 'RESOLVED' AS status FROM p JOIN c USING (topic)
UNION ALL SELECT topic, producer, NULL, 'PENDING' FROM p WHERE topic NOT IN (SELECT topic FROM c)
UNION ALL SELECT topic, NULL, consumer, 'PENDING' FROM c WHERE consumer NOT IN (SELECT consumer FROM linked)""")
def topic_links(spark, sf):
    producers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("producer"), (F.col("s_suppkey") * 2).alias("topic"))
    consumers = table(spark, sf, "customer").select(F.col("c_custkey").alias("consumer"), F.expr("array_distinct(array(c_custkey DIV 15, c_custkey DIV 7))").alias("topics"))
    return links.match_links(producers, consumers, "producer", "consumer")


@query("""
WITH p AS (SELECT DISTINCT p_brand AS producer, split_part(p_type, ' ', 1) AS topic FROM part),
c AS (SELECT p_partkey AS consumer, unnest(list_distinct(string_split(p_type, ' ')[1 + p_partkey % 2:3])) AS topic FROM part),
linked AS (SELECT DISTINCT consumer FROM c WHERE topic IN (SELECT topic FROM p))
SELECT topic, producer, consumer, 'RESOLVED' AS status FROM p JOIN c USING (topic)
UNION ALL SELECT topic, producer, NULL, 'PENDING' FROM p WHERE topic NOT IN (SELECT topic FROM c)
UNION ALL SELECT topic, NULL, consumer, 'PENDING' FROM c WHERE consumer NOT IN (SELECT consumer FROM linked)""")
def multi_topic_links(spark, sf):
    part = table(spark, sf, "part")
    producers = part.select(F.col("p_brand").alias("producer"), F.split("p_type", " ")[0].alias("topic")).distinct()
    consumers = part.select(F.col("p_partkey").alias("consumer"), F.array_distinct(F.slice(F.split("p_type", " "), (1 + F.col("p_partkey") % 2).cast("int"), F.lit(3))).alias("topics"))
    return links.match_links(producers, consumers, "producer", "consumer")


@query("SELECT conv_id, turn, role AS source, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations QUALIFY target IS NOT NULL")
def consecutive_edges(spark, sf):
    return links.consecutive_edges(table(spark, sf, "conversations"), "conv_id", "turn", "role")


@query("SELECT l.url AS page, m.url AS target FROM (SELECT DISTINCT path AS url FROM (SELECT " + _NORMAL_SQL.format(_PATH_SQL.format("url")) + " AS path FROM pages)) l JOIN (VALUES ('/en/{id}'), ('/de/{id}')) m(url) ON len(string_split(l.url, '/')) = len(string_split(m.url, '/')) AND string_split(l.url, '/')[2] = string_split(m.url, '/')[2]")
def segment_matches(spark, sf):
    calls, _ = _page_calls(spark, sf)
    templates = spark.createDataFrame([("/en/{id}",), ("/de/{id}",)], "target string")
    pages = calls.select(F.col("url").alias("page")).distinct()
    near = pages.join(F.broadcast(templates), F.size(F.split("page", "/")) == F.size(F.split("target", "/")))
    return near.where(scoring.path_matches(F.col("page"), F.col("target"))).select("page", "target")


# --- state ---------------------------------------------------------------------------------


@query("SELECT s.status, CAST(count(o.o_orderkey) AS BIGINT) AS n FROM (VALUES ('O'), ('F'), ('P'), ('X'), ('Z')) s(status) LEFT JOIN orders o ON o.o_orderstatus = s.status GROUP BY s.status")
def status_counts(spark, sf):
    tasks = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"))
    return state.count_by_status(tasks, statuses=["O", "F", "P", "X", "Z"])


@query("SELECT l_orderkey AS task_id, l_returnflag AS finding_type, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'O') AS open FROM lineitem GROUP BY 1, 2")
def finding_counts(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_returnflag").alias("finding_type"), "l_linestatus")
    return li.groupBy("task_id", "finding_type").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("open"))


@query("SELECT o_orderkey, o_orderstatus FROM orders o WHERE o_orderstatus IN ('O', 'F') AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def tasks_without_finding(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task"), "o_orderstatus")
    findings = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("task"))
    return state.without_finding(orders, findings, "task", ["O", "F"], "o_orderstatus").withColumnRenamed("task", "o_orderkey")


@query("SELECT o_orderkey, bool_or(l_returnflag = 'R') AS has_r, bool_or(l_returnflag IN ('A', 'N')) AS has_an, count(*) FILTER (WHERE l_returnflag = 'N' AND l_linestatus <> 'F') AS open_n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def has_finding_type(spark, sf):
    findings = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task"), "l_returnflag", (F.col("l_linestatus") == "F").alias("resolved"))
    known = findings.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("task")), "task", "left_semi")
    return planner.finding_flags(known, "task", "l_returnflag", {"has_r": ["R"], "has_an": ["A", "N"]}, counted={"open_n": "N"}).withColumnRenamed("task", "o_orderkey")


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n, bool_or(o_orderstatus = 'P') AS has_p FROM orders GROUP BY o_custkey),
r AS (SELECT c_custkey, list_filter([CASE WHEN coalesce(n, 0) > 12 THEN 'MANY_ORDERS' END, CASE WHEN has_p THEN 'PARTIAL' END, CASE WHEN c_acctbal < 0 THEN 'NEGATIVE' END], lambda x: x IS NOT NULL) AS reasons FROM customer LEFT JOIN o ON o_custkey = c_custkey)
SELECT c_custkey, CASE WHEN len(reasons) = 0 THEN 'NONE' ELSE array_to_string(reasons, '|') END AS reasons, len(reasons) > 0 AS qualified, CASE WHEN len(reasons) > 0 THEN 'ENRICH_PENDING' ELSE 'SKIPPED' END AS next_status FROM r""")
def qualification(spark, sf):
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.bool_or(F.col("o_orderstatus") == "P").alias("has_p"))
    tasks = table(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("status", F.lit("INDEXED"))
    rules = {"MANY_ORDERS": F.coalesce("n", F.lit(0)) > 12, "PARTIAL": F.col("has_p"), "NEGATIVE": F.col("c_acctbal") < 0}
    return planner.qualify(tasks, rules).select("c_custkey", joined(F.col("reasons")).alias("reasons"), "qualified", "next_status")


@query("SELECT event_type, event_id, ts, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_metric(spark, sf):
    return state.latest(table(spark, sf, "events").select("event_type", "event_id", "ts", "user_id"), ["event_type"], [F.col("ts"), F.col("event_id")])


@query("""
WITH old AS (SELECT user_id, max(event_id) AS event_id, 'old' AS origin FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
new AS (SELECT user_id, max(event_id) AS event_id, 'new' AS origin FROM events WHERE event_id % 2 = 1 GROUP BY user_id)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM new)""")
def upsert_tasks(spark, sf):
    events = table(spark, sf, "events")
    side = lambda rest, name: events.where(F.col("event_id") % 2 == rest).groupBy("user_id").agg(F.max("event_id").alias("event_id")).withColumn("origin", F.lit(name))
    return state.upsert(side(0, "old"), side(1, "new"), ["user_id"])


_STATUS_SQL = "(CASE o_orderkey % 9 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'INDEXED' WHEN 2 THEN 'ENRICH_PENDING' WHEN 3 THEN 'ENRICHING' WHEN 4 THEN 'ENRICHED' WHEN 5 THEN 'ENRICH_FAILED' WHEN 6 THEN 'SKIPPED' WHEN 7 THEN 'FAILED' ELSE 'AWAITING_HUMAN_REVIEW' END)"


@query(f"""
WITH t AS (SELECT o_orderkey, {_STATUS_SQL} AS status, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS found FROM orders)
SELECT o_orderkey, status, CASE status WHEN 'FAILED' THEN CASE WHEN found THEN 'ENRICHED' ELSE 'INDEXED' END WHEN 'ENRICHING' THEN 'INDEXED' WHEN 'ENRICH_PENDING' THEN 'INDEXED' WHEN 'PENDING' THEN 'INDEXED' WHEN 'ENRICH_FAILED' THEN 'ENRICH_PENDING' ELSE status END AS recovered FROM t""")
def recovery_transition(spark, sf):
    found = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.lit(True).alias("found"))
    tasks = table(spark, sf, "orders").select("o_orderkey", F.element_at(F.array(*[F.lit(s) for s in state.STATUSES]), (F.col("o_orderkey") % 9 + 1).cast("int")).alias("status"))
    both = tasks.join(found, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.select("o_orderkey", "status", state.recovered(F.col("status"), F.coalesce("found", F.lit(False))).alias("recovered"))


@query("SELECT doc_id, sha256(text) AS task_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source IN ('src0', 'src1', 'src2'))")
def resume_filter(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", hashing.content_hash(F.col("text")).alias("task_id"))
    done = docs.where(F.col("source").isin("src0", "src1", "src2")).select("task_id", F.lit("INDEXED").alias("status"))
    return state.resume(docs.select("doc_id", "task_id"), done)


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))")
def delete_by_type_and_status(spark, sf):
    findings = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    tasks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return state.delete_findings(findings, tasks, "l_orderkey", "l_returnflag", "R", ["F"], "o_orderstatus").select("l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value > 50) AS resolved, count(*) FILTER (WHERE NOT value > 50) AS pending, round(CAST(sum(CAST(round(value) AS BIGINT)) AS DOUBLE) * CAST(0.000002 AS DOUBLE), 9) AS cost FROM events WHERE value IS NOT NULL GROUP BY event_type")
def run_metrics(spark, sf):
    e = table(spark, sf, "events").where("value IS NOT NULL")
    return e.groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(F.col("value") > 50).alias("resolved"), F.count_if(~(F.col("value") > 50)).alias("pending"), F.round(text.api_cost(F.sum(F.round("value").cast("long"))), 9).alias("cost"))


# --- graphs --------------------------------------------------------------------------------


@query("""
WITH RECURSIVE walk AS (SELECT conv_id, turn, 0 AS depth FROM conversations WHERE turn = 0
UNION ALL SELECT w.conv_id, c.turn, w.depth + 1 FROM walk w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn + 1 WHERE w.depth < 4)
SELECT DISTINCT conv_id, turn, CAST(depth AS BIGINT) AS depth FROM walk""")
def flow_trace_turns(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn").distinct()
    node = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    edges = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit(True).alias("_next")), ["conv_id", "turn"]).select(node(F.col("turn")).alias("s"), node(F.col("turn") + 1).alias("t"))
    found = graph.levels(c.where("turn = 0").select(node(F.col("turn")).alias("root")), edges, "s", "t", 4)
    part = lambda i, name: F.split("node", ":")[i].cast(c.schema[name].dataType).alias(name)
    return found.select(part(0, "conv_id"), part(1, "turn"), "depth")


@query("""
WITH e AS (SELECT 'c' || c_custkey AS s, 'n' || c_nationkey AS t FROM customer
 UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders
 UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
w1 AS (SELECT s AS root, t AS node FROM e WHERE s LIKE 'o%'), w2 AS (SELECT DISTINCT root, t AS node FROM w1 JOIN e ON s = node), w3 AS (SELECT DISTINCT root, t AS node FROM w2 JOIN e ON s = node)
SELECT DISTINCT s AS root, s AS node, CAST(0 AS BIGINT) AS depth FROM e WHERE s LIKE 'o%' UNION ALL SELECT DISTINCT root, node, CAST(1 AS BIGINT) FROM w1 UNION ALL SELECT root, node, CAST(2 AS BIGINT) FROM w2 UNION ALL SELECT root, node, CAST(3 AS BIGINT) FROM w3""")
def flow_trace_typed(spark, sf):
    pair = lambda name, s, sk, t, tk: table(spark, sf, name).select(F.concat(F.lit(s), F.col(sk).cast("string")).alias("s"), F.concat(F.lit(t), F.col(tk).cast("string")).alias("t"))
    edges = pair("customer", "c", "c_custkey", "n", "c_nationkey").unionByName(pair("orders", "o", "o_orderkey", "c", "o_custkey")).unionByName(pair("nation", "n", "n_nationkey", "r", "n_regionkey")).distinct()
    return graph.levels(edges.where("s LIKE 'o%'").select("s"), edges, "s", "t", 5)


@query("""
WITH RECURSIVE e AS (SELECT n_name AS s, r_name AS t FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, 'WORLD' FROM region UNION SELECT 'WORLD', 'UNIVERSE'),
walk AS (SELECT s, t, 1 AS depth FROM e UNION ALL SELECT w.s, e.t, w.depth + 1 FROM walk w JOIN e ON w.t = e.s)
SELECT s AS source, t AS target, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY s, t""")
def supertype_closure(spark, sf):
    region, nation = table(spark, sf, "region"), table(spark, sf, "nation")
    first = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("s"), F.col("r_name").alias("t"))
    edges = first.unionByName(region.select(F.col("r_name").alias("s"), F.lit("WORLD").alias("t"))).unionByName(spark.createDataFrame([("WORLD", "UNIVERSE")], "s string, t string"))
    return graph.closure(edges, "s", "t")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 49 AND l_discount >= 0.09) AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def orphans(spark, sf):
    known = table(spark, sf, "supplier").join(table(spark, sf, "nation").where("n_regionkey = 0"), F.col("s_nationkey") == F.col("n_nationkey"), "left_anti").select("s_suppkey", "s_name")
    reached = table(spark, sf, "lineitem").where("l_quantity >= 49 AND l_discount >= 0.09").select("l_suppkey").distinct()
    return graph.orphans(known, "s_suppkey", reached)


@query("""
WITH d AS (SELECT p_brand AS brand, p_size AS size, count(*) AS n, min(p_name) AS target, array_to_string(list_sort(list_distinct(list(p_name))), '|') AS candidates FROM part GROUP BY 1, 2)
SELECT c_custkey, brand, size, CAST(coalesce(n, 0) AS BIGINT) AS n_found, CASE WHEN n = 1 THEN 'RESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS resolved_status, CASE WHEN n = 1 THEN target END AS target, CASE WHEN n > 1 THEN candidates ELSE '' END AS candidates
FROM (SELECT c_custkey, 'Brand#' || CAST(c_custkey % 5 + 1 AS VARCHAR) || CAST(c_nationkey % 5 + 1 AS VARCHAR) AS brand, CAST(c_custkey % 55 + 1 AS INTEGER) AS size FROM customer) LEFT JOIN d USING (brand, size)""")
def call_resolution(spark, sf):
    calls = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Brand#"), (F.col("c_custkey") % 5 + 1).cast("string"), (F.col("c_nationkey") % 5 + 1).cast("string")).alias("brand"), (F.col("c_custkey") % 55 + 1).cast("int").alias("size"))
    declared = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), "p_name")
    return resolve.by_cardinality(calls, declared, ["brand", "size"], "p_name").withColumn("candidates", joined(F.col("candidates")))


# --- scores --------------------------------------------------------------------------------


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n, bool_or(o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY o_custkey)
SELECT c_custkey, round(CASE WHEN coalesce(urgent, false) THEN 0.3 ELSE 0 END + 0.3 * least(coalesce(n, 0) / 10.0, 1.0) + 0.2 * CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.5 END + CASE WHEN c_acctbal > 0 THEN 0.2 ELSE 0 END, 6)::DOUBLE AS priority FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def priority_score(spark, sf):
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    both = table(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    score = scoring.priority(F.coalesce("urgent", F.lit(False)), F.coalesce("n", F.lit(0)), F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") > 0)
    return both.select("c_custkey", F.round(score, 6).alias("priority"))


@query("""
WITH s AS (SELECT l_orderkey, count(*) AS steps, bool_or(l_returnflag = 'R') AS ext, bool_or(l_quantity > 45) AS db FROM lineitem GROUP BY l_orderkey),
c AS (SELECT l_orderkey, steps, least(steps / 5.0, 1.0) * 0.4 + CASE WHEN ext THEN 0.3 ELSE 0 END + CASE WHEN db THEN 0.3 ELSE 0 END AS score FROM s)
SELECT l_orderkey, steps, CASE WHEN round(score, 9) >= 0.7 THEN 'FULL' WHEN round(score, 9) >= 0.3 THEN 'STANDARD' ELSE 'MINIMAL' END AS level FROM c""")
def complexity_level(spark, sf):
    flows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("steps"), F.bool_or(F.col("l_returnflag") == "R").alias("ext"), F.bool_or(F.col("l_quantity") > 45).alias("db"))
    return flows.select("l_orderkey", "steps", scoring.complexity(F.col("steps"), F.col("ext"), F.col("db")).alias("level"))


@query("""
WITH f AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> 'R') AS steps, count(*) FILTER (WHERE l_returnflag = 'R') AS unresolved FROM lineitem GROUP BY l_orderkey),
c AS (SELECT *, CASE WHEN steps = 0 THEN 0.1 WHEN unresolved > 3 THEN 0.4 ELSE 1 - unresolved / (steps + unresolved)::DOUBLE END AS confidence FROM f)
SELECT l_orderkey, steps, unresolved, round(confidence, 6)::DOUBLE AS confidence, steps = 0 OR unresolved > 3 OR confidence < 0.7 AS quarantined FROM c""")
def quarantine(spark, sf):
    flows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("steps"), F.count_if(F.col("l_returnflag") == "R").alias("unresolved"))
    aside, sure = scoring.quarantine(F.col("steps"), F.col("unresolved"), F.lit(False))
    return flows.select("l_orderkey", "steps", "unresolved", F.round(sure, 6).alias("confidence"), aside.alias("quarantined"))


@query("SELECT item_id, min(c) AS found, CAST(min(r) AS BIGINT) AS rank FROM (SELECT item_id, item_id * 7 + 3 AS c, 0 AS r FROM benchmark UNION ALL SELECT item_id, item_id * 5 + 900, 1 FROM benchmark UNION ALL SELECT item_id, item_id, 2 FROM benchmark) x JOIN (SELECT doc_id FROM documents WHERE lang = 'de') d ON d.doc_id = x.c WHERE r = (SELECT min(y.r) FROM (SELECT item_id, item_id * 7 + 3 AS c, 0 AS r FROM benchmark UNION ALL SELECT item_id, item_id * 5 + 900, 1 FROM benchmark UNION ALL SELECT item_id, item_id, 2 FROM benchmark) y JOIN documents z ON z.doc_id = y.c AND z.lang = 'de' WHERE y.item_id = x.item_id) GROUP BY item_id")
def pairing_ranked(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id")
    i = F.col("item_id")
    found = pairing.first_existing(items, F.array(i * 7 + 3, i * 5 + 900, i), table(spark, sf, "documents").where("lang = 'de'"), "doc_id")
    return found.where("found IS NOT NULL")


# --- documents -----------------------------------------------------------------------------


@query("SELECT n_name, count(*) AS suppliers, array_to_string(list(s_name ORDER BY s_name), '|') AS names, round(max(s_acctbal), 2) AS best FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def index_document(spark, sf):
    both = table(spark, sf, "nation").join(table(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    nested = both.groupBy("n_name").agg(F.array_sort(F.collect_list(F.struct("s_name", "s_acctbal"))).alias("entries"))
    return nested.select("n_name", F.size("entries").cast("long").alias("suppliers"), joined(F.col("entries.s_name")).alias("names"), F.round(F.array_max(F.transform("entries", lambda e: e.s_acctbal)), 2).alias("best"))


@query("SELECT l_orderkey, array_to_string(list('S' || CAST(l_linenumber AS VARCHAR) || '[' || CAST(l_partkey AS VARCHAR) || ']' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)), ' --> ') AS mermaid FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def mermaid_chains(spark, sf):
    from corpusloom.functions import render

    steps = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("index"), F.col("l_partkey").cast("string").alias("label")))).alias("steps"))
    return steps.where(F.size("steps") > 1).select("l_orderkey", render.chain(F.col("steps")).alias("mermaid"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS task_id, '{"task_id":"' || doc_id || '","file_path":"src/main/java/Doc' || doc_id || '.java","summary":"Dry run: no analysis was made.","business_rules":[{"id":"BR-1","text":"Placeholder rule"}],"dependencies":[],"http_calls":[],"edge_cases":[],"test_file":"src/test/java/Doc' || doc_id || 'Test.java","confidence":0.5}' AS document FROM documents""")
def enriched_stub(spark, sf):
    from corpusloom.operators import enrich

    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("task_id"), F.concat(F.lit("src/main/java/Doc"), F.col("doc_id").cast("string"), F.lit(".java")).alias("file_path"))
    return enrich.stub(docs).select("task_id", F.to_json("document").alias("document"))


# The other catalogues register their queries when they are loaded.
from corpusloom.plans import extraction_catalog, operator_catalog  # noqa: E402, F401
