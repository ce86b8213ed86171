"""Facts from templates and XML: forms, links, servlets and Spring beans."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points after a form's tag in which its fields are looked for.
FIELD_WINDOW = 500
_FORM = re.compile(r"<form\b([^>]*)>", re.I)
_LINK = re.compile(r"<a\s([^>]*)>", re.I)
_INPUT = re.compile(r"<(?:input|select|textarea)\b([^>]*)>", re.I)
#: What elements of Spring namespaces stand for; None: no bean of a known type.
NAMESPACES = {
    "util": {"list": "java.util.List", "set": "java.util.Set", "map": "java.util.Map", "properties": "java.util.Properties"},
    "jdbc": {"embedded-database": "javax.sql.DataSource"},
    "task": {"scheduler": "org.springframework.scheduling.concurrent.ThreadPoolTaskScheduler", "executor": "org.springframework.scheduling.concurrent.ThreadPoolTaskExecutor"},
    "tx": {"jta-transaction-manager": "org.springframework.transaction.jta.JtaTransactionManager"},
}
_SPRING = "http://www.springframework.org/schema/"


def attribute(tag: str, name: str) -> str | None:
    found = re.search(rf'(?<![\w:-]){re.escape(name)}\s*=\s*"([^"]*)"', tag, re.I)
    return found[1] if found else None


def thymeleaf_url(value: str | None) -> str | None:
    """The url of @{...}; parameters in round brackets stay, as they are part of the expression."""
    return value[2:-1] if value and value.startswith("@{") and value.endswith("}") else None


def forms(path: str, text: str) -> Iterator[dict]:
    """Forms and links of one template: JSP by plain attributes, HTML by Thymeleaf's or plain ones."""
    html = path.lower().endswith(".html")
    row = lambda verb, url, fields, kind: {"http_method": verb, "url_pattern": url, "is_expression": "${" in url or "*{" in url, "field_names": fields, "link_type": kind}
    if not (html and ("/fragments/" in path.replace("\\", "/") or path.startswith("fragments/"))):
        for m in _FORM.finditer(text):
            tag = m[1]
            action = (thymeleaf_url(attribute(tag, "th:action")) if html else None) or attribute(tag, "action")
            if action is None:
                continue
            verb = (html and attribute(tag, "th:method") or attribute(tag, "method") or "GET").upper()
            end = text.find("</form", m.end())
            inner = text[m.end() : end if end >= 0 else m.end() + FIELD_WINDOW]
            names = []
            for field in _INPUT.finditer(inner):
                if html:
                    expression = attribute(field[1], "th:field") or attribute(field[1], "th:value") or ""
                    name = re.sub(r"^[*$]\{|\}$", "", expression) or attribute(field[1], "name")
                else:
                    name = attribute(field[1], "name")
                if name and name not in names:
                    names.append(name)
            yield row(verb, action, names, "FORM")
    for m in _LINK.finditer(text):
        href = thymeleaf_url(attribute(m[1], "th:href")) if html else attribute(m[1], "href")
        if href and not href.startswith(("http", "#")):
            yield row("GET", href, [], "LINK")


def servlets(path: str, text: str) -> Iterator[dict]:
    """Endpoints of a web.xml: servlets joined with their mappings by name, in any namespace."""
    root = ElementTree.fromstring(text)
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    child = lambda e, name: next(((c.text or "").strip() for c in e if local(c) == name), "")
    classes = {child(e, "servlet-name"): child(e, "servlet-class") for e in root.iter() if local(e) == "servlet"}
    for e in root.iter():
        if local(e) == "servlet-mapping" and child(e, "servlet-name") in classes:
            for pattern in (c for c in e if local(c) == "url-pattern"):
                yield {"http_method": "", "path": (pattern.text or "").strip(), "controller_name": classes[child(e, "servlet-name")], "method_name": ""}


def beans(path: str, text: str) -> Iterator[dict]:
    """Spring beans, aliases, imports, scans, aspects and namespace elements of one XML file."""
    root = ElementTree.fromstring(text)
    if not root.tag.endswith("}beans") and root.tag != "beans":
        return
    for e in root.iter():
        space, _, name = e.tag.rpartition("}")
        space = space[1:].removeprefix(_SPRING) if space.startswith("{" + _SPRING) else space[1:]
        made = {"element": name, "namespace": space, "bean_id": e.get("id") or e.get("name"), "bean_class": e.get("class"), "reference": None, "type": None}
        if name == "bean" and space in ("beans", ""):
            yield made | {"type": "bean"}
        elif name == "alias":
            yield made | {"type": "alias", "bean_id": e.get("alias"), "reference": e.get("name")}
        elif name == "import":
            yield made | {"type": "import", "reference": e.get("resource")}
        elif (space, name) == ("context", "component-scan"):
            yield made | {"type": "component_scan", "reference": e.get("base-package")}
        elif space == "aop":
            yield made | {"type": "aop", "reference": e.get("ref") or e.get("expression") or e.get("pointcut")}
        elif space not in ("beans", "") and e is not root:
            yield made | {"type": "namespace", "bean_class": NAMESPACES.get(space, {}).get(name)}


FORM_SCHEMA = "http_method string, url_pattern string, is_expression boolean, field_names array<string>, link_type string"
SERVLET_SCHEMA = "http_method string, path string, controller_name string, method_name string"
BEAN_SCHEMA = "element string, namespace string, bean_id string, bean_class string, reference string, type string"


def apply(files: DataFrame, rule, schema: str, path: str = "path", content: str = "content") -> DataFrame:
    """file_path, ordinal and the rule's columns for every file; files that are not readable give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, text in zip(batch["file_path"], batch["content"], strict=True):
                try:
                    rows += [(file, k, json.dumps(f)) for k, f in enumerate(rule(file, text or ""))]
                except ElementTree.ParseError:
                    continue
            yield pd.DataFrame(rows, columns=["file_path", "ordinal", "fact"])

    found = files.select(F.col(path).alias("file_path"), F.col(content).alias("content")).mapInPandas(run, "file_path string, ordinal int, fact string")
    return found.select("file_path", "ordinal", F.from_json("fact", schema).alias("f")).select("file_path", "ordinal", "f.*")


def import_closure(found: DataFrame, depth: int | None = None) -> DataFrame:
    """(source, target, depth) of XML files reached by imports; cycles are cut."""
    from corpusloom.operators.graph import closure

    folder = F.regexp_replace("file_path", "[^/]*$", "")
    edges = found.where("type = 'import'").select(F.col("file_path").alias("s"), F.concat(folder, F.regexp_replace("reference", "^(?:classpath\\*?:|file:|\\./)", "")).alias("t"))
    return closure(edges, "s", "t", depth)
