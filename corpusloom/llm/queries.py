"""The ten operators, each bound to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, embeddings, langid, linededup, media, packing, secretscan, simhash, substring, urlfilter
from corpusloom.sources.workers import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


#: The rules of the url filter.
URL_RULES = [
    urlfilter.Rule("allow", "com", "/"),
    urlfilter.Rule("block", "example.com", "/en/"),
    urlfilter.Rule("allow", "www.example.com", "/en/"),
    urlfilter.Rule("block", "net", "/es/"),
    urlfilter.Rule("block", "net", "/fr/"),
]


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    words = urlfilter.word_model(pages)
    bayes = urlfilter.train(pages, URL_RULES, words)
    return urlfilter.judge(pages, URL_RULES, words, bayes)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), capacity=1024, end_id=0)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.dedup(table(spark, sf_dir, "documents"), size=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.read_payloads(media.read_headers(media.store(table(spark, sf_dir, "documents"))))
    return rows.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "digest", "shard", "offset", "length", "width", "height", "bit_depth",
    )


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.dedup(table(spark, sf_dir, "embeddings"), least=0.98)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.dedup(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(table(spark, sf_dir, "documents"), vocabulary())
    both = bpe.decode(ids, vocabulary())
    return both.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out("doc_id")))
    return langid.predict(docs, model).select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(table(spark, sf_dir, "documents"))
    count = [F.expr(f"CAST(size(filter(base, s -> s.rank = {i})) AS BIGINT)").alias(f"n_{kind}") for i, kind in enumerate(("assign", "access", "hex"))]
    return found.select("doc_id", *count, F.sha2(secretscan.listed("base").cast("binary"), 256).alias("base_sha256"), secretscan.listed("spans").alias("spans"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup(table(spark, sf_dir, "documents"), threshold=2)
    return found.select("doc_id", "n_lines", "n_near", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Every window of 13 words by its text.
SUBSTRINGS_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM d WHERE len(words) >= 13),
k AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS key FROM w),
f AS (SELECT key, min(doc_id) AS least FROM k GROUP BY key HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM k JOIN f USING (key) WHERE least < doc_id),
g AS (SELECT doc_id, list(pos) AS gone, count(*) AS n FROM gone GROUP BY doc_id),
each AS (SELECT d.doc_id, words, coalesce(n, 0) AS n, gone FROM d LEFT JOIN g USING (doc_id)),
kept AS (SELECT doc_id, len(words) AS n_words, n, CASE WHEN n = 0 THEN words ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda p: NOT list_contains(gone, p[2])), lambda p: p[1]) END AS kept FROM each)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept"""

#: Brute force over all pairs of a label; the other operators are not expressible in SQL,
#: or too slow on whole tables, and are tested against plain models.
VECTORS_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.a = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substrings": SUBSTRINGS_SQL, "op5_vectors": VECTORS_SQL}
