"""One pass over source files: each is parsed once, and every rule's facts come out of it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.extract import javaparse, rules

#: The columns of each kind of fact besides file_path and ordinal.
SCHEMAS = {
    "declaration": "class_name string, method_name string, param_types array<string>, start_line int, end_line int",
    "supertype": "class_name string, super_simple_name string, super_fqn string",
    "import": "fqn string",
    "file_type": "fqn string",
    "component": "annotation_type string, class_name string, package_name string",
    "bean_method": "bean_name string, return_type string, configuration_class string",
    "endpoint": "http_method string, path string, controller_name string, method_name string, path_variables array<string>, query_parameters array<string>, serves_view boolean, view_name string, request_bodies array<string>, start_line int, end_line int",
    "scheduled_task": "method_name string, class_name string, cron string, fixed_rate bigint, fixed_delay bigint, type string, start_line int, end_line int",
    "event_listener": "payload_type string, method_name string, class_name string, call_chain array<struct<target_type:string,method_name:string,depth:int>>",
    "event_publisher": "class_name string, event_type string",
    "broker_listener": "broker string, topics array<string>, is_pattern boolean, method_name string, class_name string, payload_type string",
    "broker_publisher": "broker string, topic string, exchange string, routing_key string, method_name string, class_name string",
    "validator": "class_name string, annotation_type string, element_name string, is_valid_body string, is_built_in boolean",
    "db_access": "type string, sql string, table_hint string, procedure_name string, method_name string, class_name string, entity_type string, is_transaction_root boolean, start_line int, end_line int, param_count int",
    "http_call": "method string, url_pattern string, is_expression boolean, client_type string, encapsulated_in string, class_name string",
    "call_site": "source_class string, source_method string, target_type string, method_name string, arg_count int, scope_kind string",
}


def extract(files: DataFrame, path: str = "path", content: str = "content", more: tuple = ()) -> DataFrame:
    """(file_path, kind, ordinal, fact): facts as JSON; a file that is not parsed has one fact, its error.

    A null text gives a read error.  Other files are not touched by one file's failure.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, text in zip(batch["file_path"], batch["content"], strict=True):
                try:
                    if text is None:
                        raise OSError("no content")
                    unit = javaparse.parse(text)
                    found = [f for rule in (*rules.EXTRACTORS, *more) for f in rule(unit, file)]
                except (javaparse.ParseError, OSError, RecursionError) as e:
                    found = [("error", {"stage": "read" if isinstance(e, OSError) else "parse", "message": str(e)})]
                rows += [(file, kind, k, json.dumps(fact)) for k, (kind, fact) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["file_path", "kind", "ordinal", "fact"])

    return files.select(F.col(path).alias("file_path"), F.col(content).alias("content")).mapInPandas(run, "file_path string, kind string, ordinal int, fact string")


def relation(facts: DataFrame, kind: str) -> DataFrame:
    """The facts of one kind as a typed relation with file_path and ordinal; unreadable ones are dropped."""
    typed = facts.where(F.col("kind") == kind).select("file_path", "ordinal", F.from_json("fact", SCHEMAS[kind], {"mode": "PERMISSIVE"}).alias("f"))
    return typed.where("f IS NOT NULL").select("file_path", "ordinal", "f.*")
