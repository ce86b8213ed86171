"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every
stage's result as Parquet in the shared folder and reads it again as the next one's
docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import langid, linededup, packing, secretscan, simhash
from corpusloom.llm.queries import table, vocabulary
from corpusloom.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_length(docs: DataFrame, before: DataFrame) -> DataFrame:
    """docs with n_chars counted anew, as texts have been cut."""
    n = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(before.schema["n_chars"].dataType))
    return docs.withColumn("n_chars", n).select(before.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects: no letters, or far from every centroid."""
    model = langid.train(docs.where(~langid.held_out("doc_id")))
    return langid.keep_known(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that stand earlier, alike or within two edits (one for every twelve characters)."""
    return with_length(linededup.clean(docs, threshold=2), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies: five words, 0.8 or more.

    Texts that hold no words after line dedup are one group.
    """
    return simhash.drop_near_copies(docs, shingle=5, similarity=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by [REDACTED]."""
    return with_length(secretscan.redact(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack(docs, vocabulary(), capacity=1024, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("pack", pack),
]
#: Language ID, SimHash trees, the test battery and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
