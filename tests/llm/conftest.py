import pytest
from pyspark.sql import functions as F

#: Rows that every operator has to bear: nulls, empty and very long texts, ties, repeats.
ODD_TEXTS = [None, "", " ", "\n\n", "a", "7 !!", "word " * 30_000, "Ünïcödé ẞ 😀 中文", "same text here", "same text here", "<|endoftext|> x", "tab\tand\x0bfeed\x0c end"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with extra columns whose names clash with those that operators use."""
    rows = [(i, t, None if i % 3 else "en", None, None) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id at all", None, "s", 3), (8, "same text here", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", F.lit(1).alias("id"), F.lit("x").alias("h"), F.lit("y").alias("spans"), F.lit("z").alias("ids"), F.lit(0).alias("component_id"), F.lit(None).cast("string").alias("base"))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest documents table: (DataFrame, {doc_id: text})."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df, {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
