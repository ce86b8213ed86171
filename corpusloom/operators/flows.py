"""Entry points, flows, features and how flows refer to each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import scoring, text
from corpusloom.sources.shared import written

#: Paths that no flow is made of, and parts of class names likewise.
TRIVIAL_PATHS = ["/actuator", "/actuator/health", "/actuator/info", "/actuator/metrics", "/health", "/info", "/metrics", "/env", "/beans", "/configprops", "/mappings", "/trace", "/httptrace"]
TRIVIAL_CLASSES = ["Health", "Metrics", "Info"]


def is_trivial(path: Column, class_name: Column) -> Column:
    flag = F.coalesce(path.isin(TRIVIAL_PATHS), F.lit(False))
    for part in TRIVIAL_CLASSES:
        flag = flag | F.coalesce(class_name.contains(part), F.lit(False))
    return flag


_ENTRY = ["id", "ep_type", "class_name", "method_name", "file_path", "http_method", "path", "schedule", "topic_or_queue", "is_pattern", "payload_type", "start_line", "end_line"]


def entry_points(endpoints: DataFrame, scheduled: DataFrame, listeners: DataFrame, events: DataFrame) -> DataFrame:
    """One wide relation of all kinds: HTTP, SCHEDULED, KAFKA, RABBITMQ, ACTIVEMQ, EVENT."""
    none = F.lit(None).cast("string")

    def shaped(df: DataFrame, kind: Column, key: Column, **columns: Column) -> DataFrame:
        base = {"http_method": none, "path": none, "schedule": none, "topic_or_queue": none, "is_pattern": F.lit(False), "payload_type": none, "start_line": F.lit(0), "end_line": F.lit(0)}
        made = {"id": key, "ep_type": kind, "file_path": F.col("file_path")} | base | columns
        return df.select(*[made[c].alias(c) for c in _ENTRY])

    kind = F.col("broker")
    http = shaped(endpoints, F.lit("HTTP"), F.concat_ws(":", F.lit("HTTP"), "http_method", "path", "controller_name", "method_name"), class_name=F.col("controller_name"), method_name=F.col("method_name"), http_method=F.col("http_method"), path=F.col("path"), start_line=F.col("start_line"), end_line=F.col("end_line"))
    timed = shaped(scheduled, F.lit("SCHEDULED"), F.concat_ws(":", F.lit("SCHEDULED"), "class_name", "method_name"), class_name=F.col("class_name"), method_name=F.col("method_name"), schedule=F.coalesce("cron", F.col("fixed_rate").cast("string"), F.col("fixed_delay").cast("string")), start_line=F.col("start_line"), end_line=F.col("end_line"))
    topics = F.array_join("topics", ",")
    queued = shaped(listeners, kind, F.concat_ws(":", kind, topics, F.col("class_name"), F.col("method_name")), class_name=F.col("class_name"), method_name=F.col("method_name"), topic_or_queue=topics, is_pattern=F.col("is_pattern"), payload_type=F.col("payload_type"))
    fired = shaped(events, F.lit("EVENT"), F.concat_ws(":", F.lit("EVENT"), "payload_type", "class_name", "method_name"), class_name=F.col("class_name"), method_name=F.col("method_name"), payload_type=F.col("payload_type"))
    return http.unionByName(timed).unionByName(queued).unionByName(fired)


def known_methods(scheduled: DataFrame, listeners: DataFrame, events: DataFrame) -> DataFrame:
    cols = ["class_name", "method_name", "file_path"]
    return scheduled.select(cols).unionByName(listeners.select(cols)).unionByName(events.select(cols))


def prioritised(entries: DataFrame, edges: DataFrame, enriched: DataFrame, tested: DataFrame) -> DataFrame:
    """Entries that are not trivial with their priority and rank, highest first; equal ones by id."""
    out = edges.where("resolved_status = 'RESOLVED'").groupBy(F.col("source_file").alias("file_path")).agg(F.count("*").alias("out_degree"))
    flag = lambda df, name: df.select("file_path").distinct().withColumn(name, F.lit(True))
    both = entries.join(out, "file_path", "left").join(flag(enriched, "_enriched"), "file_path", "left").join(flag(tested, "_tested"), "file_path", "left")
    score = scoring.priority(F.coalesce("_enriched", F.lit(False)), F.coalesce("out_degree", F.lit(0)), F.col("ep_type") == "HTTP", F.coalesce("_tested", F.lit(False)))
    scored = both.where(~is_trivial(F.col("path"), F.col("class_name"))).withColumn("priority_score", score).drop("out_degree", "_enriched", "_tested")
    return ranked(scored, [F.desc("priority_score"), F.asc("id")], "priority_rank")


def orphaned_methods(known: DataFrame, entries: DataFrame, edges: DataFrame) -> DataFrame:
    """Known methods whose file no entry point and no resolved edge names."""
    from corpusloom.operators.graph import orphans

    return orphans(known, "file_path", entries.select("file_path"), edges.where("resolved_status = 'RESOLVED'").select("target_file"))


def summarised(steps: DataFrame, entries: DataFrame, most_unresolved: int = 3, least: float = 0.7) -> DataFrame:
    """One row per flow: counts, complexity, confidence and whether it is set aside."""
    real, lost = F.when(~F.col("unresolved"), 1), F.when(F.col("unresolved"), 1)
    counted = steps.groupBy("flow_id").agg(F.count(real).alias("steps"), F.count(lost).alias("unresolved_calls"), F.bool_or(F.coalesce(F.col("component_type") == "EXTERNAL_CALL", F.lit(False))).alias("external"), F.bool_or(F.coalesce(F.col("component_type") == "DATABASE", F.lit(False))).alias("database"))
    flows = entries.join(counted, F.col("id") == F.col("flow_id"), "left").drop("flow_id").fillna({"steps": 0, "unresolved_calls": 0, "external": False, "database": False}).withColumnRenamed("id", "flow_id")
    aside, sure = scoring.quarantine(F.col("steps"), F.col("unresolved_calls"), F.col("steps") == 0, most_unresolved, least)
    return flows.withColumns({"complexity": scoring.complexity(F.col("steps"), F.col("external"), F.col("database")), "confidence": sure, "quarantined": aside, "feature": F.when(F.col("ep_type") == "HTTP", text.feature_name(F.col("path"))).otherwise(F.col("class_name"))})


def http_relationships(links: DataFrame, flows: DataFrame, steps: DataFrame) -> DataFrame:
    """(source_flow, target_flow, type, via): flows that touch a calling file, and flows of the path it calls.

    Paths meet templates by keys: one for each shape of a template (which segments are
    variables) with as many segments.  Shapes are few and are broadcast.
    """
    path = text.normal_path(text.url_path(F.col("url_pattern")))
    calls = links.select("source_file", F.concat_ws(" ", "method", "url_pattern").alias("via"), path.alias("_path")).distinct().withColumn("_n", F.size(scoring.segments(F.col("_path"))))
    targets = flows.where("ep_type = 'HTTP' AND path <> ''").select(F.col("flow_id").alias("target_flow"), text.normal_path(F.col("path")).alias("_template")).withColumn("_shape", scoring.path_shape(F.col("_template")))
    shapes = targets.select("_shape", F.length("_shape").alias("_n")).distinct()
    wanted = calls.join(F.broadcast(shapes), "_n").select("source_file", "via", scoring.path_key(F.col("_path"), F.col("_shape")).alias("_key"))
    offered = targets.select("target_flow", scoring.path_key(F.col("_template"), F.col("_shape")).alias("_key"))
    touched = flows.select("flow_id", F.col("file_path").alias("source_file")).unionByName(steps.where("NOT unresolved AND source_file IS NOT NULL").select("flow_id", "source_file")).distinct().withColumnRenamed("flow_id", "source_flow")
    met = wanted.join(offered, "_key").join(touched, "source_file")
    return met.where("source_flow <> target_flow").select("source_flow", "target_flow", F.lit("CALLS_EXTERNAL").alias("type"), "via").distinct()


#: Parts that the producers of a topic are dealt to, so that no task makes all pairs of a topic.
SALTS = 16


def topic_relationships(topic_links: DataFrame, flows: DataFrame, steps: DataFrame) -> DataFrame:
    """(source_flow, target_flow, type, via): flows that touch a producer's file, and consumers of its topic.

    Both sides are made distinct before they meet, so their pairs are; the pairs, which
    can be very many, are neither shuffled nor kept.
    """
    consumers = flows.where("topic_or_queue IS NOT NULL").select(F.col("flow_id").alias("target_flow"), F.explode(F.split("topic_or_queue", ",")).alias("topic")).distinct()
    touched = flows.select("flow_id", F.col("file_path").alias("producer_file")).unionByName(steps.where("NOT unresolved AND source_file IS NOT NULL").select("flow_id", F.col("source_file").alias("producer_file"))).distinct().withColumnRenamed("flow_id", "source_flow")
    producers = topic_links.where("status = 'RESOLVED'").select("topic", F.col("producer").alias("producer_file")).distinct().join(touched, "producer_file").select("source_flow", "topic").distinct()
    dealt = producers.withColumn("_salt", F.pmod(F.xxhash64("source_flow"), F.lit(SALTS)))
    every = consumers.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = dealt.join(every, ["topic", "_salt"])
    return met.where("source_flow <> target_flow").select("source_flow", "target_flow", F.lit("PUBLISHES_EVENT").alias("type"), F.col("topic").alias("via"))


def attach_to_features(relationships: DataFrame, members: DataFrame) -> DataFrame:
    """Each relationship under the first feature (by ordinal) that holds one of its flows."""
    ends = relationships.withColumn("_flow", F.explode(F.array("source_flow", "target_flow")))
    met = ends.join(members.select(F.col("flow_id").alias("_flow"), "feature", "feature_ordinal"), "_flow")
    return met.groupBy(*relationships.columns).agg(F.min_by("feature", "feature_ordinal").alias("feature"))


def traceability(steps: DataFrame, flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the manifest: a node per step, an edge between a step and the next."""
    kept = steps.where("NOT unresolved")
    node = F.concat_ws("#", "flow_id", F.col("step_index").cast("string"))
    nodes = kept.select("flow_id", node.alias("node"), "component_type", F.concat_ws(".", "class_name", "method_name").alias("label"), text.source_ref(F.col("source_file"), F.col("start_line"), F.col("end_line")).alias("source_ref"))
    w = Window.partitionBy("flow_id").orderBy("step_index")
    following = kept.select("flow_id", node.alias("source"), F.lead(node).over(w).alias("target"), F.lead("component_type").over(w).alias("_to")).where("target IS NOT NULL").join(flows.select("flow_id", "ep_type"), "flow_id")
    kind = F.when(F.col("_to") == "DATABASE", "READS_WRITES").when(F.col("_to") == "EXTERNAL_CALL", "CALLS_EXTERNAL").when((F.col("_to") == "EVENT_PUBLISHER") | F.col("ep_type").isin("KAFKA", "RABBITMQ", "ACTIVEMQ", "EVENT"), "PUBLISHES_EVENT").otherwise("CALLS")
    return nodes, following.select("flow_id", "source", "target", kind.alias("link_type"))


def steps_by_file(steps: DataFrame) -> DataFrame:
    """(flow_id, source_file, steps, first_line): each flow's steps by file, in their order, and the first line they name."""
    kept = steps.where("NOT unresolved AND source_file IS NOT NULL")
    row = F.struct("step_index", "component_type", "class_name", "method_name", "start_line", "end_line")
    return kept.groupBy("flow_id", "source_file").agg(F.array_sort(F.collect_list(row)).alias("steps"), F.min(F.when(F.col("start_line") > 0, F.col("start_line"))).alias("first_line"))


def nothing_to_extract(floating: DataFrame, topics: DataFrame, entries: DataFrame) -> bool:
    """Whether extraction can be skipped: no pending link of either kind and no entry point."""
    return floating.where("status = 'PENDING'").isEmpty() and topics.where("status = 'PENDING'").isEmpty() and entries.isEmpty()


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with the place of each row in the order, from 0.

    Rows are sorted by ranges; only the number of rows of each range comes to the driver.
    """
    placed = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, offsets, n = F.shiftright("_at", 33), [], 0
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        offsets.append((r.part, n))
        n += r.n
    before = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_before", "_at")


def feature_members(flows: DataFrame) -> DataFrame:
    """(flow_id, feature, feature_ordinal) of the flows that are not set aside; features in the order of their names."""
    kept = flows.where("NOT quarantined").select("flow_id", "feature")
    ordinals = ranked(kept.select("feature").distinct(), [F.asc("feature")], "feature_ordinal")
    return kept.join(ordinals, "feature").select("flow_id", "feature", "feature_ordinal")


def rules_of_flows(steps: DataFrame, enrichment: DataFrame) -> DataFrame:
    """(flow_id, rules, edge_cases): what the documents of a flow's files say, the last document of a file counting."""
    files = steps.where("NOT unresolved AND source_file IS NOT NULL").select("flow_id", F.col("source_file").alias("file_path")).distinct()
    last = enrichment.where("document IS NOT NULL").groupBy("file_path").agg(F.max_by("document", "task_id").alias("document"))
    met = files.join(last, "file_path")
    return met.groupBy("flow_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("document.business_rules")))).alias("rules"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("document.edge_cases")))).alias("edge_cases"))


def totals(members: DataFrame) -> DataFrame:
    """One row: number of features and of their flows."""
    return members.agg(F.count_distinct("feature").alias("features"), F.count("flow_id").alias("flows"))


def group_by_claims(flows: list[tuple[str, str]], claims: list[tuple[str, list[str]]]) -> list[tuple[str, list[str]]]:
    """Features from an outside grouping: (name, short ids) claims over (flow id, short id), in order.

    A claim that names no flow takes all that are left; what no claim takes is one more
    group.  Order matters, and features are few, so this runs on the driver.
    """
    left, out = dict(flows), []
    for name, wanted in claims:
        hit = [f for f, s in left.items() if s in wanted] or [*left]
        if hit:
            out.append((name, hit))
            for f in hit:
                del left[f]
    return [*out, ("Ungrouped Flows", [*left])] if left else out
