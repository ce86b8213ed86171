"""Rules that turn a parsed Java file into facts: (kind, fact) pairs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from corpusloom.extract.javaparse import Annotation, Call, Method, Type, Unit, split_top, unquote

Fact = tuple[str, dict]

#: Names that frameworks give meaning to.
STEREOTYPES = ["Component", "Service", "Repository", "Controller", "RestController", "Entity", "MappedSuperclass"]
CONSTRAINTS = [
    "NotNull", "NotEmpty", "NotBlank", "Size", "Min", "Max", "Email", "Pattern", "Positive", "PositiveOrZero", "Negative", "NegativeOrZero",
    "Past", "PastOrPresent", "Future", "FutureOrPresent", "AssertTrue", "AssertFalse", "DecimalMin", "DecimalMax", "Digits", "Valid", "Validated",
]
MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
EXCHANGES = {"GetExchange": "GET", "PostExchange": "POST", "PutExchange": "PUT", "DeleteExchange": "DELETE", "PatchExchange": "PATCH"}
SERVLET_METHODS = {"doGet": "GET", "doPost": "POST", "doPut": "PUT", "doDelete": "DELETE", "doPatch": "PATCH", "doHead": "HEAD", "doOptions": "OPTIONS", "doTrace": "TRACE"}
JDK_TYPES = [
    "String", "Integer", "Long", "Double", "Float", "Boolean", "Short", "Byte", "Character", "List", "Map", "Set", "Queue", "Deque", "ArrayList", "HashMap", "HashSet",
    "LinkedList", "Optional", "Stream", "Collection", "Iterator", "Iterable", "Comparable", "Object", "Runnable", "Callable", "Supplier", "Consumer", "Function", "Predicate",
    "BigDecimal", "BigInteger", "LocalDate", "LocalTime", "LocalDateTime", "Instant", "Date", "Calendar", "UUID", "Path", "File", "Pattern", "Matcher", "StringBuilder",
    "StringBuffer", "Throwable", "Exception", "RuntimeException",
]
LIBRARY_PREFIXES = ["java.", "javax.", "jakarta.", "org.springframework.", "org.slf4j.", "org.apache.", "com.fasterxml.", "lombok."]
JDBC_VERBS = ["query", "queryForObject", "queryForList", "queryForMap", "queryForRowSet", "update", "batchUpdate", "execute"]
STATEMENT_VERBS = ["executeQuery", "executeUpdate", "execute", "executeLargeUpdate", "addBatch"]
ENTITY_MANAGER_VERBS = ["persist", "merge", "find", "remove", "refresh", "detach", "clear", "createQuery", "createNamedQuery", "createNativeQuery", "createStoredProcedureQuery"]
SESSION_VERBS = ["save", "saveOrUpdate", "update", "merge", "persist", "get", "load", "find", "byId", "byNaturalId", "delete", "remove", "replicate", "createQuery", "createNativeQuery", "createSQLQuery", "createCriteria"]
DERIVED_EXACT = ["findAll", "findById", "save", "saveAll", "delete", "deleteById", "deleteAll", "count"]
DERIVED_PREFIXES = ["findBy", "readBy", "getBy", "queryBy", "countBy", "existsBy", "deleteBy"]
REST_TEMPLATE = {"getForObject": "GET", "getForEntity": "GET", "postForObject": "POST", "postForEntity": "POST", "put": "PUT", "patchForObject": "PATCH", "delete": "DELETE", "exchange": "EXCHANGE", "execute": "EXECUTE"}
HTTP_VERBS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]
APACHE_REQUESTS = {f"Http{v.capitalize()}": v for v in HTTP_VERBS}


def simple(type_name: str) -> str:
    return re.sub(r"<.*|\[\]|\.\.\.", "", type_name, flags=re.S).rsplit(".", 1)[-1]


def join_path(base: str, path: str) -> str:
    parts = [p.strip("/") for p in (base, path)]
    return "/" + "/".join(p for p in parts if p)


def first_string(call: Call) -> str:
    return next((unquote(a) for a in call.args[:1] if a.startswith('"')), "")


def declarations(unit: Unit, path: str) -> Iterator[Fact]:
    names = {n.rsplit(".", 1)[-1]: n for n, static, wild in unit.imports if not static and not wild}
    for t in unit.all_types():
        yield "declaration", {"class_name": t.name, "method_name": "<clinit>", "param_types": [], "start_line": t.start, "end_line": t.end}
        for m in t.methods:
            yield "declaration", {"class_name": t.name, "method_name": m.name, "param_types": [p.type for p in m.params], "start_line": m.start, "end_line": m.end}
        for up in (*t.extends, *t.implements):
            s = simple(up)
            yield "supertype", {"class_name": t.name, "super_simple_name": s, "super_fqn": names.get(s, f"{unit.package}.{s}" if unit.package else s)}
    for name, static, wild in unit.imports:
        if not static:
            yield "import", {"fqn": name + ".*" * wild}
    if unit.types:
        yield "file_type", {"fqn": f"{unit.package}.{unit.types[0].name}" if unit.package else unit.types[0].name}


def components(unit: Unit, path: str) -> Iterator[Fact]:
    for t in unit.all_types():
        if t.kind == "class":
            found = next((s for s in STEREOTYPES if t.annotation(s)), None)
            if found:
                yield "component", {"annotation_type": found, "class_name": t.name, "package_name": unit.package}
            if t.annotation("Configuration", "SpringBootApplication") and "abstract" not in t.modifiers:
                for m in t.methods:
                    if bean := m.annotation("Bean"):
                        yield "bean_method", {"bean_name": bean.text("name", "value") or m.name, "return_type": m.type, "configuration_class": t.name}


def _mapping(annotations: list[Annotation]) -> tuple[str, list[str]] | None:
    for a in annotations:
        if a.name in MAPPINGS or a.name == "RequestMapping":
            verb = MAPPINGS.get(a.name) or re.sub(r"^.*\.", "", a.text("method"))
            return verb, (a.text("value", "path") or "").split(",")
    return None


def view_name(t: Type, m: Method, seen: frozenset = frozenset()) -> str:
    """The string a body returns, by itself, in a ModelAndView, or through a method of its class."""
    for r in m.returns:
        if re.fullmatch(r'"(?:\\.|[^"\\])*"', r):
            return unquote(r)
        if got := re.match(r'new (?:\w+\.)*ModelAndView\("([^"]*)"', r):
            return got[1]
        if (got := re.match(r"(?:this\.)?(\w+)\((.*)\)$", r, re.S)) and (got[1], len(split_top(got[2]))) not in seen:
            key = got[1], len(split_top(got[2]))
            for other in t.methods:
                if (other.name, len(other.params)) == key and (name := view_name(t, other, seen | {key})):
                    return name
    return ""


def spring_endpoints(t: Type) -> Iterator[dict]:
    controller = t.annotation("Controller", "RestController")
    if not controller:
        return
    base = (_mapping(t.annotations) or ("", [""]))[1][0]
    for m in t.methods:
        if not (mapped := _mapping(m.annotations)):
            continue
        of = lambda name, m=m: [p for p in m.params if any(a.name == name for a in p.annotations)]
        named = lambda p, name: next(a for a in p.annotations if a.name == name).text("value", "name") or p.name
        view = controller.name == "Controller" and not m.annotation("ResponseBody") and simple(m.type) in ("ModelAndView", "String", "View", "void")
        for one in mapped[1]:
            yield {
                "http_method": mapped[0], "path": join_path(base, one), "controller_name": t.name, "method_name": m.name,
                "path_variables": [named(p, "PathVariable") for p in of("PathVariable")], "query_parameters": [named(p, "RequestParam") for p in of("RequestParam")],
                "serves_view": view, "view_name": view_name(t, m) if view else "", "request_bodies": [p.type for p in of("RequestBody")], "start_line": m.start, "end_line": m.end,
            }


def servlet_endpoints(t: Type) -> Iterator[dict]:
    if not any(simple(x) == "HttpServlet" for x in t.extends):
        return
    at = t.annotation("WebServlet")
    for m in t.methods:
        if m.name in SERVLET_METHODS and len(m.params) == 2:
            for one in (at.text("urlPatterns", "value") if at else "").split(","):
                yield {"http_method": SERVLET_METHODS[m.name], "path": one, "controller_name": t.name, "method_name": m.name, "path_variables": [], "query_parameters": [], "serves_view": False, "view_name": "", "request_bodies": [], "start_line": m.start, "end_line": m.end}


#: Endpoint detectors, asked for each type; more can be added.
ENDPOINT_DETECTORS: list[Callable[[Type], Iterator[dict]]] = [spring_endpoints, servlet_endpoints]


def endpoints(unit: Unit, path: str) -> Iterator[Fact]:
    for t in unit.all_types():
        for detect in ENDPOINT_DETECTORS:
            for fact in detect(t):
                yield "endpoint", fact


def schedules(unit: Unit, path: str) -> Iterator[Fact]:
    for t in unit.all_types():
        for m in t.methods:
            if a := m.annotation("Scheduled"):
                number = lambda name, a=a: int(x) if (x := re.sub(r"[_lL]", "", a.text(name))).isdigit() else None
                rate, delay = number("fixedRate"), number("fixedDelay")
                kind = "cron" if "cron" in a.values else "fixedRate" if "fixedRate" in a.values else "fixedDelay" if "fixedDelay" in a.values else "unknown"
                yield "scheduled_task", {"method_name": m.name, "class_name": t.name, "cron": a.text("cron") or None, "fixed_rate": rate, "fixed_delay": delay, "type": kind, "start_line": m.start, "end_line": m.end}


def events(unit: Unit, path: str) -> Iterator[Fact]:
    for t in unit.all_types():
        for m in t.methods:
            if a := m.annotation("EventListener"):
                payload = a.text("classes", "value").replace(".class", "") or (m.params[0].type if m.params else "")
                chain = [{"target_type": c.scope or t.name, "method_name": c.name, "depth": c.depth + 1} for c in m.calls if not c.created and c.depth < 3]
                yield "event_listener", {"payload_type": payload, "method_name": m.name, "class_name": t.name, "call_chain": chain}
            for c in m.calls:
                if c.name == "publishEvent" and c.args:
                    made = re.match(r"new ([\w.]+)", c.args[0])
                    typed = {p.name: p.type for p in m.params} | {f.name: f.type for f in t.fields}
                    yield "event_publisher", {"class_name": t.name, "event_type": made[1] if made else typed.get(c.args[0], c.args[0])}


#: Broker, listener annotation, its topic attributes, part of the sender's name, sending methods.
BROKERS = [
    ("KAFKA", "KafkaListener", ("topics", "value"), "kafkatemplate", ("send",)),
    ("RABBITMQ", "RabbitListener", ("queues", "value"), "rabbittemplate", ("convertAndSend", "send")),
    ("ACTIVEMQ", "JmsListener", ("destination",), "jmstemplate", ("convertAndSend",)),
]


def brokers(unit: Unit, path: str) -> Iterator[Fact]:
    for t in unit.all_types():
        for m in t.methods:
            for broker, listener, where, sender, verbs in BROKERS:
                if a := m.annotation(listener):
                    pattern = a.text("topicPattern")
                    inner = re.findall(r'topic="([^"]*)"', a.values.get("topicPartitions", ""))
                    topics = [pattern] if pattern else [x.strip() for x in (a.text(*where) or ",".join(inner)).split(",") if x.strip()]
                    yield "broker_listener", {"broker": broker, "topics": topics, "is_pattern": bool(pattern), "method_name": m.name, "class_name": t.name, "payload_type": m.params[0].type if m.params else ""}
                for c in m.calls:
                    if c.name in verbs and sender in c.scope.lower() and c.args:
                        rabbit = broker == "RABBITMQ"
                        yield "broker_publisher", {"broker": broker, "topic": None if rabbit else unquote(c.args[0]), "exchange": unquote(c.args[0]) if rabbit else None, "routing_key": unquote(c.args[1]) if rabbit and len(c.args) > 2 else "" if rabbit else None, "method_name": m.name, "class_name": t.name}


def validators(unit: Unit, path: str) -> Iterator[Fact]:
    for t in unit.all_types():
        for m in t.methods:
            if m.name == "isValid":
                yield "validator", {"class_name": t.name, "annotation_type": "", "element_name": m.name, "is_valid_body": m.text, "is_built_in": False}
        for v in (*t.fields, *t.components):
            for a in v.annotations:
                if a.name in CONSTRAINTS:
                    yield "validator", {"class_name": t.name, "annotation_type": a.name, "element_name": v.name, "is_valid_body": "", "is_built_in": True}


def _table(sql: str) -> str:
    found = re.search(r"(?:FROM|INTO|UPDATE)\s+(\w+)", sql, re.I)
    return found[1] if found else ""


def _db(kind: str, t: Type, m: Method | None, sql: str = "", table: str = "", procedure: str = "", entity: str = "", root: bool = False, count: int = 0) -> Fact:
    return "db_access", {"type": kind, "sql": sql, "table_hint": table, "procedure_name": procedure, "method_name": m.name if m else "", "class_name": t.name, "entity_type": entity, "is_transaction_root": root, "start_line": m.start if m else t.start, "end_line": m.end if m else t.end, "param_count": count}


def named_queries(t: Type, unit: Unit) -> Iterator[Fact]:
    for a in t.annotations:
        if a.name in ("NamedQuery", "NamedNativeQuery"):
            yield _db("NATIVE_SQL" if "Native" in a.name else "JPQL_HQL", t, None, a.text("query"))
        elif a.name in ("NamedQueries", "NamedNativeQueries"):
            for q in re.findall(r'query="((?:\\.|[^"\\])*)"', a.values.get("value", "")):
                yield _db("NATIVE_SQL" if "Native" in a.name else "JPQL_HQL", t, None, q)


def spring_data(t: Type, unit: Unit) -> Iterator[Fact]:
    data = {n.rsplit(".", 1)[-1] for n, _, wild in unit.imports if n.startswith("org.springframework.data") and not wild}
    by_jdbc = any(n == "org.springframework.data.jdbc.repository.query.Query" for n, _, _ in unit.imports)
    repository = next((x for x in t.extends if simple(x) in data), None) if t.kind == "interface" else None
    if not repository:
        return
    args = split_top(repository.partition("<")[2].rpartition(">")[0])
    entity = args[0] if args else ""
    for m in t.methods:
        if q := m.annotation("Query"):
            native = q.values.get("nativeQuery") == "true" or by_jdbc
            yield _db("NATIVE_SQL" if native else "JPQL_HQL", t, m, q.text("value"), entity=entity, count=len(m.params))
        elif m.name in DERIVED_EXACT or m.name.startswith(tuple(DERIVED_PREFIXES)):
            yield _db("SPRING_DATA", t, m, entity=entity, count=len(m.params))


def transactions(t: Type, unit: Unit) -> Iterator[Fact]:
    own = t.annotation("Transactional")
    for m in t.methods:
        if m.annotation("Transactional") or own and "public" in m.modifiers:
            yield _db("TRANSACTION", t, m, root=True, count=len(m.params))


def procedures(t: Type, unit: Unit) -> Iterator[Fact]:
    for m in t.methods:
        if p := m.annotation("Procedure"):
            yield _db("STORED_PROCEDURE", t, m, procedure=p.text("name", "value", "procedureName"), count=len(m.params))


def jdbc_template(t: Type, m: Method, c: Call) -> Fact | None:
    scope, sql = c.scope.lower(), first_string(c)
    return _db("JDBC_TEMPLATE", t, m, sql, _table(sql)) if ("jdbctemplate" in scope or "npjt" in scope) and c.name in JDBC_VERBS else None


def raw_jdbc(t: Type, m: Method, c: Call) -> Fact | None:
    scope, sql = c.scope.lower(), first_string(c)
    prepared = c.name in ("prepareStatement", "prepareCall") and "conn" in scope
    run = c.name in STATEMENT_VERBS and c.args and "jdbctemplate" not in scope and ("stmt" in scope or "statement" in scope)
    return _db("RAW_JDBC", t, m, sql, _table(sql)) if prepared or run else None


def _created(t: Type, m: Method, c: Call, native: tuple[str, ...], query: tuple[str, ...], other: str) -> Fact:
    kind = "NATIVE_SQL" if c.name in native else "JPQL_HQL" if c.name in query else other
    return _db(kind, t, m, first_string(c) if c.name.startswith("create") else "")


def entity_manager(t: Type, m: Method, c: Call) -> Fact | None:
    scope = c.scope.lower()
    fits = ("entitymanager" in scope or scope == "em") and c.name in ENTITY_MANAGER_VERBS
    return _created(t, m, c, ("createNativeQuery",), ("createQuery", "createNamedQuery"), "ENTITY_MANAGER") if fits else None


def hibernate_session(t: Type, m: Method, c: Call) -> Fact | None:
    fits = "session" in c.scope.lower() and c.name in SESSION_VERBS
    return _created(t, m, c, ("createNativeQuery", "createSQLQuery"), ("createQuery",), "HIBERNATE_SESSION") if fits else None


#: Database detectors of types, and of calls, of which the first that knows a call counts; more can be added.
DB_TYPE_DETECTORS: list[Callable[[Type, Unit], Iterator[Fact]]] = [named_queries, spring_data, transactions, procedures]
DB_CALL_DETECTORS: list[Callable[[Type, Method, Call], Fact | None]] = [jdbc_template, raw_jdbc, entity_manager, hibernate_session]


def database(unit: Unit, path: str) -> Iterator[Fact]:
    for t in unit.all_types():
        for detect in DB_TYPE_DETECTORS:
            yield from detect(t, unit)
        for m in t.methods:
            for c in m.calls:
                if not c.created and c.scope:
                    found = next((f for detect in DB_CALL_DETECTORS if (f := detect(t, m, c))), None)
                    if found:
                        yield found


def _http(verb: str, url: str, client: str, t: Type, m: Method) -> Fact:
    return "http_call", {"method": verb, "url_pattern": url, "is_expression": "${" in url, "client_type": client, "encapsulated_in": m.name, "class_name": t.name}


def feign(t: Type, m: Method) -> Iterator[Fact]:
    client = t.annotation("FeignClient")
    if client and (mapped := _mapping(m.annotations)):
        verb = "REQUEST" if m.annotation("RequestMapping") else mapped[0]
        at = client.text("url").rstrip("/") + join_path("", mapped[1][0]) if client.text("url") else join_path(client.text("url", "path"), mapped[1][0])
        yield _http(verb, at, "FEIGN", t, m)


def http_exchange(t: Type, m: Method) -> Iterator[Fact]:
    base = t.annotation("HttpExchange")
    for a in m.annotations:
        if a.name in EXCHANGES:
            yield _http(EXCHANGES[a.name], join_path(base.text("url", "value") if base else "", a.text("url", "value")), "HTTP_EXCHANGE", t, m)


def _argument(c: Call) -> str:
    return unquote(c.args[0]) if c.args else ""


def apache_request(t: Type, m: Method, c: Call) -> Fact | None:
    return _http(APACHE_REQUESTS[c.name], _argument(c), "APACHE_HTTP_CLIENT", t, m) if c.created and c.name in APACHE_REQUESTS else None


def rest_template(t: Type, m: Method, c: Call) -> Fact | None:
    if "resttemplate" not in c.scope.lower() or c.name not in REST_TEMPLATE:
        return None
    verb = next((v for v in HTTP_VERBS if len(c.args) > 1 and v in c.args[1]), "EXCHANGE") if c.name == "exchange" else REST_TEMPLATE[c.name]
    return _http(verb, _argument(c), "REST_TEMPLATE", t, m)


def fluent_client(t: Type, m: Method, c: Call) -> Fact | None:
    """WebClient and RestClient: client.verb().uri(...)."""
    low = c.scope.lower()
    if c.name not in ("get", "post", "put", "delete", "patch") or c.args or "webclient" not in low and "restclient" not in low:
        return None
    uri = next((d.args[0] for d in m.calls if d.name == "uri" and d.args and d.scope.startswith(f"{c.scope}.{c.name}()")), "")
    return _http(c.name.upper(), unquote(uri), "WEB_CLIENT" if "webclient" in low else "REST_CLIENT", t, m)


def java_http_client(t: Type, m: Method, c: Call) -> Fact | None:
    if c.name not in ("send", "sendAsync") or "httpclient" not in c.scope.lower():
        return None
    made = re.search(r'HttpRequest\.newBuilder\((?:URI\.create\("([^"]*)"\))?\)(?:.*?\.uri\(URI\.create\("([^"]*)"\)\))?', m.text, re.S)
    verb = next((v for v in HTTP_VERBS if f".{v}(" in m.text), "GET")
    return _http(verb, (made[1] or made[2] or "") if made else "", "JAVA_NET_HTTP_CLIENT", t, m)


def url_connection(t: Type, m: Method, c: Call) -> Fact | None:
    made = re.search(r'new URL\("([^"]*)"', m.text) if c.name == "openConnection" else None
    if not made:
        return None
    methods = [unquote(d.args[0]) for d in m.calls if d.name == "setRequestMethod" and d.args]
    return _http(methods[-1] if methods else "GET", made[1], "HTTP_URL_CONNECTION", t, m)


def apache_execute(t: Type, m: Method, c: Call) -> Fact | None:
    return _http("EXECUTE", _argument(c), "APACHE_HTTP_CLIENT", t, m) if c.name == "execute" and "httpclient" in c.scope.lower() else None


def ok_http(t: Type, m: Method, c: Call) -> Fact | None:
    if c.name != "newCall" or "okhttp" not in m.text.lower():
        return None
    made = re.search(r'\.url\("([^"]*)"', m.text)
    verb = next((v.upper() for v in ("post", "put", "delete", "patch") if f".{v}(" in m.text), "GET")
    return _http(verb, made[1] if made else "", "OK_HTTP", t, m)


#: HTTP detectors of declared clients, and of calls, of which the first that knows a call counts; more can be added.
HTTP_METHOD_DETECTORS: list[Callable[[Type, Method], Iterator[Fact]]] = [feign, http_exchange]
HTTP_CALL_DETECTORS: list[Callable[[Type, Method, Call], Fact | None]] = [apache_request, rest_template, fluent_client, java_http_client, url_connection, apache_execute, ok_http]


def http_calls(unit: Unit, path: str) -> Iterator[Fact]:
    for t in unit.all_types():
        for m in t.methods:
            for detect in HTTP_METHOD_DETECTORS:
                yield from detect(t, m)
            for c in m.calls:
                found = next((f for detect in HTTP_CALL_DETECTORS if (not c.created or detect is apache_request) and (f := detect(t, m, c))), None)
                if found:
                    yield found


def call_sites(unit: Unit, path: str) -> Iterator[Fact]:
    """Calls whose target type is known from the class itself, its fields or the method's parameters."""
    # A wildcard import names no type, so it says nothing about one.
    library = {n.rsplit(".", 1)[-1] for n, _, wild in unit.imports if not wild and n.startswith(tuple(LIBRARY_PREFIXES))}
    for t in unit.all_types():
        fields = {f.name: simple(f.type) for f in (*t.fields, *t.components)}
        for m in t.methods:
            known = fields | {p.name: simple(p.type) for p in m.params}
            for c in m.calls:
                if c.created:
                    continue
                name = c.scope.removeprefix("this.")
                target, kind = (t.name, "own") if c.scope in ("", "this") else (known.get(name), "field" if name in fields and c.scope != name or name not in {p.name for p in m.params} else "parameter")
                if target and (kind == "own" or target not in JDK_TYPES and target not in library):
                    yield "call_site", {"source_class": t.name, "source_method": m.name, "target_type": target, "method_name": c.name, "arg_count": len(c.args), "scope_kind": kind}


#: The extractors, in the order of their facts; more can be passed to run().
EXTRACTORS: list[Callable[[Unit, str], Iterator[Fact]]] = [declarations, components, endpoints, schedules, events, brokers, validators, database, http_calls, call_sites]
