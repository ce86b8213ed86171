"""Graph operators: bounded traces, closures, reachability by one hop, waves."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.shared import written


def closure(edges: DataFrame, source: str, target: str, depth: int | None = None) -> DataFrame:
    """(source, target, depth) of all pairs of different nodes joined by a path; depth is the shortest one's.

    Breadth first to a fixed point: each round joins the pairs found last with the edges
    and takes off those that are known, so cycles end by themselves and no path is walked
    twice.  Rounds are tables in the shared folder.  depth bounds the rounds; None is no bound.
    """
    steps = edges.select(F.col(source).alias("_from"), F.col(target).alias("_to")).where("_from IS NOT NULL AND _to IS NOT NULL AND _from <> _to").distinct()
    steps = written(steps, "closure-edges")
    seen = frontier = steps.select(F.col("_from").alias("source"), F.col("_to").alias("target"), F.lit(1).cast("long").alias("depth"))
    d = 1
    while depth is None or d < depth:
        d += 1
        further = frontier.join(steps, F.col("target") == F.col("_from")).where("source <> _to").select("source", F.col("_to").alias("target"), F.lit(d).cast("long").alias("depth")).distinct()
        frontier = written(further.join(seen.select("source", "target"), ["source", "target"], "left_anti"), "closure-frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def orphans(known: DataFrame, key: str, *reached: DataFrame) -> DataFrame:
    """known rows whose key is in none of the reached tables (their first columns): one hop, no search."""
    every = reached[0].select(F.col(reached[0].columns[0]).alias(key))
    for r in reached[1:]:
        every = every.union(r.select(r.columns[0]))
    return known.join(every, key, "left_anti")


def callers(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges that lead into one of the files (a table of one column)."""
    return edges.join(files.select(F.col(files.columns[0]).alias("target_file")), "target_file", "left_semi")


def callees(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges that start in one of the files."""
    return edges.join(files.select(F.col(files.columns[0]).alias("source_file")), "source_file", "left_semi")


def flow_candidates(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("resolved_status") == "RESOLVED").select("source_file").distinct()


def levels(roots: DataFrame, edges: DataFrame, source: str, target: str, depth: int) -> DataFrame:
    """(root, node, depth) of nodes within depth steps, each once per root with its first level.

    Breadth first: each wave joins the frontier with the edges and takes off what is seen.
    """
    frontier = roots.select(F.col(roots.columns[0]).alias("root"), F.col(roots.columns[0]).alias("node"), F.lit(0).cast("long").alias("depth")).distinct()
    seen = frontier
    steps = edges.select(F.col(source).alias("node"), F.col(target).alias("_next")).distinct()
    for d in range(1, depth + 1):
        frontier = frontier.join(steps, "node").select("root", F.col("_next").alias("node"), F.lit(d).cast("long").alias("depth")).distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti")
        seen = seen.unionByName(frontier)
    return seen


#: Parts of a file's path that tell its component, first match first.
SOURCE_PARTS = [("Controller", "REST_ENDPOINT"), ("Service", "SERVICE"), ("Repository", "REPOSITORY"), ("Repo", "REPOSITORY"), ("Scheduler", "SCHEDULED_TASK"), ("Job", "SCHEDULED_TASK"), ("Listener", "EVENT_PUBLISHER"), ("Consumer", "EVENT_PUBLISHER")]
TARGET_PARTS = [("Controller", "REST_ENDPOINT"), ("Service", "SERVICE"), ("Repository", "REPOSITORY"), ("Repo", "REPOSITORY"), ("Client", "EXTERNAL_CALL"), ("Feign", "EXTERNAL_CALL"), ("Listener", "EVENT_PUBLISHER"), ("Consumer", "EVENT_PUBLISHER"), ("Scheduler", "SCHEDULED_TASK"), ("Job", "SCHEDULED_TASK")]


def component_of(name: str | None, known: dict[str, str], parts: list[tuple[str, str]], *others: str) -> str:
    for key in (name, *others):
        if key in known:
            return known[key]
    return next((c for part, c in parts if part in (name or "")), "SERVICE")


def is_accessor(method: str | None) -> bool:
    return any((method or "").startswith(p) and (method or "")[len(p) : len(p) + 1].isupper() for p in ("get", "is", "set"))


class Tracer:
    """Depth-first traces over one set of facts; visited nodes count for the whole flow.

    edges, db, http: lists of dicts.  Each resolved edge of an expanded node makes a step,
    even where its target has been visited or lies at the depth limit; only expansion
    stops there.
    """

    def __init__(self, edges: list[dict], db: list[dict], http: list[dict], components: dict[str, str], framework: tuple[str, ...] = (), max_depth: int = 5):
        self.by_file, self.by_class, self.db, self.http = {}, {}, {}, {}
        for k, e in enumerate(edges):
            for index, name in ((self.by_file, e["source_file"]), (self.by_class, e["source_class"])):
                if name is not None:
                    index.setdefault((name, e["source_method"]), []).append((k, e))
        for d in db:
            self.db.setdefault(d["class_name"], []).append(d)
        for h in http:
            self.http.setdefault((h["source_file"], h["source_method"]), []).append(h)
        self.components, self.framework, self.max_depth = components, framework, max_depth

    def trace(self, file: str, cls: str, method: str, start: int = 0, end: int = 0) -> tuple[list[dict], list[str]]:
        """(steps, unresolved calls) of the flow that starts at the method."""
        steps, unresolved, visited = [], [], set()

        def step(component, c, m, f, a, b, notes=()):
            steps.append({"step_index": len(steps), "component_type": component, "class_name": c, "method_name": m, "source_file": f, "start_line": a, "end_line": b, "enrichments": [*notes]})

        def walk(file, cls, method, depth):
            if depth >= self.max_depth or (file, cls, method) in visited:
                return
            visited.add((file, cls, method))
            if depth == 0:
                step(component_of(file, self.components, SOURCE_PARTS), cls, method, file, start, end)
            found = dict(self.by_file.get((file, method), ())) | dict(self.by_class.get((cls, method), ()))
            for _, e in sorted(found.items()):
                if e["resolved_status"] != "RESOLVED":
                    call = f"{e['target_class']}.{e['target_method']}"
                    if not call.startswith(self.framework or ("\0",)):
                        unresolved.append(call)
                    continue
                kind = component_of(e["target_file"], self.components, TARGET_PARTS, e["target_class"])
                same = [d for d in self.db.get(e["target_class"], ()) if ((d["start_line"], d["end_line"]) == (e["target_start_line"], e["target_end_line"]) if (e["target_start_line"] or 0) > 0 else (d["method_name"], d["param_count"]) == (e["target_method"], e["arg_count"]))]
                if not same and not (kind == "ENTITY" and is_accessor(e["target_method"])):
                    step(kind, e["target_class"], e["target_method"], e["target_file"], e["target_start_line"], e["target_end_line"])
                seen = set()
                for d in same:
                    key = d["class_name"], d["method_name"], d["start_line"], d["end_line"]
                    if key not in seen:
                        seen.add(key)
                        step("DATABASE", d["class_name"], d["method_name"], d["file_path"], d["start_line"], d["end_line"], [x for x in (d["sql"], kind) if x is not None])
                walk(e["target_file"], e["target_class"], e["target_method"], depth + 1)
            if depth == 0:
                for d in self.db.get(cls, ()):
                    step("DATABASE", d["class_name"], d["method_name"], d["file_path"], d["start_line"], d["end_line"], [d["sql"]] if d["sql"] is not None else [])
            for h in self.http.get((file, method), ()):
                step("EXTERNAL_CALL", cls, None, file, 0, 0, [f"{h['method']} {h['url_pattern']}"])

        walk(file, cls, method, 0)
        return steps, unresolved


STEP_SCHEMA = "flow_id string, step_index int, component_type string, class_name string, method_name string, source_file string, start_line int, end_line int, enrichments array<string>, unresolved boolean"
_STEP = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[t]) for n, t in (f.split() for f in STEP_SCHEMA.split(", "))])
#: Rows of a batch of steps that a task hands over.
STEP_ROWS = 4096


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[str]]]:
    """The bodies by kind of each part of rows that are sorted by part; a part can span batches."""
    part, bodies = None, {}
    for batch in batches:
        for p, kind, body in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "body")), strict=True):
            if bodies and p != part:
                yield bodies
                bodies = {}
            part = p
            bodies.setdefault(kind, []).append(body)
    if bodies:
        yield bodies


def _hashed(df: DataFrame, *key: str) -> DataFrame:
    """df with a hash of the key: joins on both sort by the number, as names share long beginnings."""
    return df.withColumn("_hash", F.xxhash64(*key))


def _by_name(df: DataFrame, file: str, cls: str, method: str) -> DataFrame:
    """Each row under its method's file and under its class: (_by, _name, _method) are one key of joins."""
    names = F.array(F.struct(F.lit("file").alias("by"), F.col(file).alias("name")), F.struct(F.lit("class").alias("by"), F.col(cls).alias("name")))
    both = df.withColumn("_names", F.explode(names)).select("*", F.col("_names.by").alias("_by"), F.col("_names.name").alias("_name"), F.col(method).alias("_method"))
    return _hashed(both.drop("_names").where("_name IS NOT NULL AND _method IS NOT NULL"), "_by", "_name", "_method")


_NAMED = ["_hash", "_by", "_name", "_method"]


def _reached(starts: DataFrame, edges: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """(part, file, class, method) of the nodes that traces of a part's entries can expand, and of those and all that they call."""
    calls = _by_name(edges.where("resolved_status = 'RESOLVED'"), "source_file", "source_class", "source_method").select(*_NAMED, "target_file", "target_class", "target_method")
    frontier = seen = starts.select("part", F.col("file_path").alias("file"), F.col("class_name").alias("class"), F.col("method_name").alias("method")).distinct()
    inner = seen
    node = ["part", "file", "class", "method"]
    for _ in range(max_depth):
        met = _by_name(frontier, "file", "class", "method").select("part", *_NAMED).join(calls, _NAMED)
        further = met.select("part", F.col("target_file").alias("file"), F.col("target_class").alias("class"), F.col("target_method").alias("method")).distinct()
        frontier = written(_hashed(further, *node).join(_hashed(seen, *node), ["_hash", *node], "left_anti").select(node), "trace-frontier")
        inner = seen
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return inner, seen


def trace_flows(entries: DataFrame, edges: DataFrame, db: DataFrame, http: DataFrame, components: DataFrame, framework: tuple[str, ...] = (), max_depth: int = 5) -> DataFrame:
    """Flow steps and, with unresolved set, the unresolved calls of every entry point.

    Depth-first order with a visited set for the whole flow is no relational operation.
    So joins first gather what the entries of each file can reach within max_depth calls,
    and every entry is then traced over its file's part of the graph.  A task takes the
    parts one after another from sorted rows and holds one at a time.
    """
    starts = entries.select(F.coalesce("file_path", "id").alias("part"), F.col("id").alias("root"), "file_path", "class_name", "method_name", F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line"))
    starts = written(starts, "trace-entries")
    inner, every = _reached(starts, edges, max_depth)
    order = [c for c in ("source_file", "source_class", "source_method", "ordinal", "target_class", "target_method", "arg_count") if c in edges.columns]
    near = _by_name(inner, "file", "class", "method").select("part", *_NAMED).distinct()
    read = ["source_file", "source_class", "source_method", "target_file", "target_class", "target_method", "arg_count", "resolved_status", "target_start_line", "target_end_line"]
    e = edges.select(*dict.fromkeys([*order, *read]))
    own = _by_name(e, "source_file", "source_class", "source_method").join(near, _NAMED).drop(*_NAMED)
    met = lambda keys, df, name: _hashed(keys, name).join(_hashed(df, name), ["_hash", name]).drop("_hash")
    accesses = met(every.select("part", F.col("class").alias("class_name")).distinct(), db, "class_name")
    at = inner.select("part", F.col("file").alias("source_file"), F.col("method").alias("source_method")).distinct()
    calls = _hashed(at, "source_file", "source_method").join(_hashed(http, "source_file", "source_method"), ["_hash", "source_file", "source_method"]).drop("_hash")
    names = every.select("part", F.explode(F.array("file", "class")).alias("key")).distinct()
    kinds = met(names, components.select(F.col(components.columns[0]).alias("key"), F.col(components.columns[1]).alias("type")), "key")
    parts = None
    for kind, df in (("entry", starts), ("edge", own), ("db", accesses), ("http", calls), ("component", kinds)):
        one = df.select("part", F.lit(kind).alias("kind"), F.to_json(F.struct(*[c for c in df.columns if c != "part"]), {"ignoreNullFields": "false"}).alias("body"))
        parts = one if parts is None else parts.unionByName(one)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, out = json.JSONEncoder(sort_keys=True).encode, []
        for part in _by_part(batches):
            read = lambda kind: json.loads(f"[{','.join(part.get(kind, ()))}]")
            of = {k: sorted(read(k), key=text) for k in ("entry", "db", "http", "component")}
            # An edge comes twice where its method is known by file and by class.
            part["edge"] = sorted({*part.get("edge", ())})
            found = sorted(read("edge"), key=lambda x: [(v is not None, v) for v in map(x.get, order)])
            tracer = Tracer(found, of["db"], of["http"], {c["key"]: c["type"] for c in of["component"]}, framework, max_depth)
            for entry in of["entry"]:
                steps, unresolved = tracer.trace(entry["file_path"], entry["class_name"], entry["method_name"], entry["start_line"], entry["end_line"])
                out += [{"flow_id": entry["root"], "unresolved": False, **s} for s in steps]
                out += [{"flow_id": entry["root"], "unresolved": True, "step_index": k, "component_type": None, "class_name": None, "method_name": call, "source_file": entry["file_path"], "start_line": 0, "end_line": 0, "enrichments": []} for k, call in enumerate(unresolved)]
            if len(out) >= STEP_ROWS:
                yield pa.RecordBatch.from_pylist(out, schema=_STEP)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=_STEP)

    return _hashed(parts, "part").repartition("_hash", "part").sortWithinPartitions("_hash", "part").select("part", "kind", "body").mapInArrow(trace, STEP_SCHEMA)


def waves(roots: DataFrame, dependencies: DataFrame, task: str, needs: str, hops: int = 3) -> DataFrame:
    """(root, node, depth, status): dependencies up to ``hops`` are taken, those one further wait for review."""
    found = levels(roots, dependencies, task, needs, hops + 1)
    return found.withColumn("status", F.when(F.col("depth") > hops, "AWAITING_HUMAN_REVIEW").otherwise("PLANNED"))
