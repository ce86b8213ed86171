"""Enrichment: a hook for an outside service, and the stub that stands in for it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import guessed_test_path, redact

DOCUMENT = """struct<task_id:string,file_path:string,summary:string,business_rules:array<struct<id:string,text:string>>,
 dependencies:array<struct<path:string,reason:string>>,http_calls:array<struct<method:string,url:string>>,
 edge_cases:array<string>,test_file:string,confidence:double>"""


def stub(tasks: DataFrame) -> DataFrame:
    """tasks with the document a dry run gives: the same words for every file, no dependencies."""
    document = F.struct(
        F.col("task_id"),
        F.col("file_path"),
        F.lit("Dry run: no analysis was made.").alias("summary"),
        F.array(F.struct(F.lit("BR-1").alias("id"), F.lit("Placeholder rule").alias("text"))).alias("business_rules"),
        F.array().cast("array<struct<path:string,reason:string>>").alias("dependencies"),
        F.array().cast("array<struct<method:string,url:string>>").alias("http_calls"),
        F.array().cast("array<string>").alias("edge_cases"),
        guessed_test_path(F.col("file_path")).alias("test_file"),
        F.lit(0.5).alias("confidence"),
    )
    return tasks.withColumn("document", document)


def call(tasks: DataFrame, service: Callable[[str], str], content: str = "content") -> DataFrame:
    """tasks with ``answer``, the JSON text that the service gives for the redacted content.

    The service runs once per row on the executors; a row whose call fails keeps a null
    answer and the error's text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for text in batch["_sent"]:
                try:
                    answers.append(service(text or ""))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  one row's failure is that row's result
                    answers.append(None)
                    errors.append(str(e))
            yield batch.drop(columns="_sent").assign(answer=answers, error=errors)

    sent = tasks.withColumn("_sent", redact(F.col(content))).drop(content)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema if f.name != "_sent")
    return sent.mapInPandas(run, f"{fields}, answer string, error string")


_JSON = re.compile(r'"(?:\\.|[^"\\])*"|[{}\[\]:,]|[^\s{}\[\]:,"]+')


def repair(text: str | None) -> str | None:
    """JSON text as a service meant it: fences off, commas put in or taken out, brackets closed, blanks between tokens gone."""
    if text is None:
        return None
    bare = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text)
    out: list[str] = []
    still_open: list[str] = []
    for token in _JSON.findall(bare):
        last = out[-1] if out else ""
        if token in "}]":
            if last == ",":
                out.pop()
            if still_open and still_open[-1] == token:
                still_open.pop()
            else:
                continue
        elif token == ",":
            if last in ("", ",", "{", "[", ":"):
                continue
        elif token != ":" and last not in ("", ",", "{", "[", ":"):
            out.append(",")
        if token in "{[":
            still_open.append("}" if token == "{" else "]")
        out.append(token)
    if out and out[-1] == ",":
        out.pop()
    return "".join([*out, *reversed(still_open)])


def repaired(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """answers with their JSON texts repaired."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{answer: [repair(t) for t in batch[answer]]})

    return answers.mapInPandas(run, answers.schema)


def parse(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """answers with the document they hold, leniently read: texts are repaired, absent lists are empty, a dependency that is a string is its path."""
    fixed = repaired(answers.withColumn("_answer", F.col(answer)), "_answer")
    lenient = {"mode": "PERMISSIVE", "allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"}
    filled = fixed.withColumn("_d", F.from_json("_answer", DOCUMENT, lenient)).withColumn("_names", F.from_json("_answer", "dependencies array<string>", lenient)["dependencies"])
    defaults = {"business_rules": "array<struct<id:string,text:string>>", "http_calls": "array<struct<method:string,url:string>>", "edge_cases": "array<string>"}
    document = F.col("_d")
    for name, kind in defaults.items():
        document = document.withField(name, F.coalesce(F.col(f"_d.{name}"), F.array().cast(kind)))
    plain = F.transform(F.filter(F.coalesce("_names", F.array().cast("array<string>")), lambda n: n.isNotNull() & ~n.startswith("{")), lambda n: F.struct(n.alias("path"), F.lit(None).cast("string").alias("reason")))
    typed = F.filter(F.coalesce("_d.dependencies", F.array().cast("array<struct<path:string,reason:string>>")), lambda d: d.path.isNotNull())
    document = document.withField("dependencies", F.concat(typed, plain))
    read = F.col("_d").isNotNull() & F.coalesce(F.trim("_answer").startswith("{"), F.lit(False))
    return filled.withColumn("document", F.when(read, document)).drop("_d", "_answer", "_names")


def metric(tasks: DataFrame, status: str = "status", tokens: str = "tokens", each: float = 0.000002) -> DataFrame:
    """One row: tasks, those that failed, tokens of those that did not, and their cost."""
    used = F.coalesce(F.sum(F.when(F.col(status) != "ENRICH_FAILED", F.col(tokens)).otherwise(0)), F.lit(0)).cast("long")
    return tasks.agg(F.count("*").alias("tasks"), F.count_if(F.col(status) == "ENRICH_FAILED").alias("failed"), used.alias("tokens"), (used * F.lit(each)).alias("cost"))


def violations(documents: DataFrame, document: str = "document") -> DataFrame:
    """documents with the required parts that are absent or out of range; none means valid."""
    d = document
    checks = [(F.col(d).isNull(), "not readable"), (F.col(f"{d}.task_id").isNull(), "task_id is required"), (F.col(f"{d}.file_path").isNull(), "file_path is required"), (F.col(f"{d}.summary").isNull(), "summary is required"), (~F.coalesce(F.col(f"{d}.confidence").between(0, 1), F.lit(True)), "confidence must lie between 0 and 1")]
    return documents.withColumn("violations", F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for bad, text in checks])))
