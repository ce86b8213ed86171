"""Language ID by nearest centroids of TF-IDF n-gram vectors.

A text is lower-cased, ASCII characters that are no letters become blanks, and its
byte trigrams are hashed into ``DIMENSIONS`` counters.  Counts are damped, weighted by
inverse document frequency and normalised.  Each language has several centroids, found
by spherical k-means; a text gets the language of the centroid with the largest cosine.
A text whose cosine is far below what training texts of its length reach is rejected.

Training takes about ``per_language`` different texts of each of the ``languages`` labels
with the most of them, those with the smallest text hash: a bounded sample of labelled
rows.  Copies of a text count once.  Every text is predicted whole.

The driver holds the sample's counters compressed and opens those of one language, or of
one block, at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.arrowtext import hand_back, in_small_batches, tidy
from corpusloom.llm.shared import trim

DIMENSIONS = 4096
UNKNOWN = "und"
#: Rows of counts that the driver opens at once.
BLOCK = 256
_LETTER = regex.compile(r"\p{L}")
_BLANKS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def counts(text: str) -> np.ndarray:
    """How often each hashed trigram occurs in the whole text."""
    flat = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANKS).split()) + b" "
    a = np.frombuffer(flat, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(DIMENSIONS, np.int64)
    gram = (a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761)
    return np.bincount(gram >> np.uint32(20), minlength=DIMENSIONS)


def packed(tally: np.ndarray) -> bytes:
    return zlib.compress(tally.astype("<i4").tobytes(), 1)


class Packed:
    """Rows of packed counts, opened where an array of row numbers asks for them."""

    def __init__(self, rows: list[bytes]):
        self.rows = rows

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        out = np.empty((len(at), DIMENSIONS), np.int32)
        for to, i in zip(out, at.tolist(), strict=True):
            to[:] = np.frombuffer(zlib.decompress(self.rows[i]), "<i4")
        return out


@dataclass
class CentroidModel:
    languages: list[str]
    centroids: np.ndarray  # one row each
    owner: np.ndarray  # language of each centroid
    idf: np.ndarray
    least: np.ndarray  # smallest accepted cosine by log2 of the number of trigrams

    def vectors(self, tallies: np.ndarray) -> np.ndarray:
        x = tallies.astype(np.float32)
        np.log1p(x, out=x)
        x *= self.idf
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x /= np.where(norm > 0, norm, 1)
        return x

    def judge(self, tallies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, cosine, whether it is rejected) of each row of counts."""
        cosine = self.vectors(tallies) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1)
        size = np.minimum(np.log2(np.maximum(tallies.sum(axis=1), 1)).astype(int), len(self.least) - 1)
        return self.owner[best], score, score < self.least[size]


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    centre = x.mean(axis=0)
    chosen = [int((x @ centre).argmax())]
    while len(chosen) < min(k, len(x)):  # farthest first
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    c = x[chosen]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(languages: list[str], tallies: np.ndarray | Packed, clusters: int = 3, margin: float = 0.6) -> CentroidModel:
    """languages: of each row of tallies.  margin: times a low quantile of the training cosines."""
    blocks = [np.arange(i, min(i + BLOCK, len(languages))) for i in range(0, len(languages), BLOCK)]
    names = sorted(set(languages))
    label = np.array([names.index(x) for x in languages])
    holders = sum((tallies[at] > 0).sum(axis=0) for at in blocks)
    idf = (np.log((1 + len(label)) / (1 + holders)) + 1).astype(np.float32)
    model = CentroidModel(names, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), idf, np.zeros(24))
    found = [_spherical_kmeans(model.vectors(tallies[np.flatnonzero(label == i)]), clusters) for i in range(len(names))]
    model.centroids = np.concatenate(found).astype(np.float32)
    model.owner = np.repeat(np.arange(len(names)), [len(c) for c in found])
    reached = [(model.judge(rows)[1], rows.sum(axis=1)) for rows in (tallies[at] for at in blocks)]
    score, total = (np.concatenate(c) for c in zip(*reached, strict=True))
    size = np.log2(np.maximum(total, 1)).astype(int)
    low = 0.0
    for b in range(len(model.least)):  # longer texts reach larger cosines, so the bound never falls
        if (size == b).sum() >= 8:
            low = max(low, margin * float(np.quantile(score[size == b], 0.01)))
        model.least[b] = low
    return model


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 400, clusters: int = 3, languages: int = 256) -> CentroidModel | None:
    """A model of the labelled rows of df; None if no text with a letter has a label.

    The sample is bounded, however often texts repeat: rows whose text hash lies under a
    border that lets about ``per_language`` different texts of a language through are
    counted once each, and at most twice as many of them are taken.  Only counters come
    to the driver.  Rows with a null text or label say nothing.
    """
    rows = in_small_batches(df).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not sizes:
        return None
    borders = [(r.lang, min(2**63 - 1, -(2**63) + 2**64 * per_language // max(r.n, 1))) for r in sizes]
    border = F.broadcast(df.sparkSession.createDataFrame(borders, "lang string, border long"))
    sample = rows.join(border, "lang").where("h <= border").select("lang", "h", "text")

    @tidy
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()  # a task sees about per_language different texts a language
        for batch in batches:
            found = []
            for lang, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, h) not in seen:
                    seen.add((lang, h))
                    if has_letter(text):
                        found.append((lang, h, packed(counts(text))))
            columns = [*zip(*found, strict=True)] or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["lang", "h", "tally"])

    once = sample.mapInArrow(tally, "lang string, h long, tally binary").groupBy("lang", "h").agg(F.first("tally").alias("tally"))
    got = sorted((r.lang, r.h, bytes(r.tally)) for r in once.limit(2 * per_language * len(borders)).toLocalIterator())
    model = fit([g[0] for g in got], Packed([g[2] for g in got]), clusters) if got else None
    hand_back()
    trim(df.sparkSession)
    return model


def keep_known(df: DataFrame, model: CentroidModel | None, text_col: str = "text") -> DataFrame:
    """df without the rows that predict() rejects; columns as they are, whatever their names."""
    shared, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield part.filter(pa.array([not rejected for _, _, rejected in verdicts(shared.value, part.column(at).to_pylist())], pa.bool_()))

    return in_small_batches(df).mapInArrow(run, df.schema)


def verdicts(model: CentroidModel | None, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """(language, score, whether it is rejected) of each text."""
    out = [(UNKNOWN, 0.0, True)] * len(texts)
    good = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
    if good:
        for i, a, b, c in zip(good, *model.judge(np.stack([counts(texts[i]) for i in good])), strict=True):
            out[i] = model.languages[a], float(b), bool(c)
    return out


def predict(df: DataFrame, model: CentroidModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of each row, repeated ones too.

    A null text or one without letters gets ``und``, score 0 and is rejected; so does
    every text if there is no model.  Other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                columns = [*zip(*verdicts(shared.value, part.column(1).to_pylist()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True))], names=names)

    plain = in_small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "lang_pred", "score", "rejected"]
    out = T.StructType([plain.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return plain.mapInArrow(run, out).withColumnRenamed("id", id_col)


def held_out(id_col: str) -> Column:
    """Rows that training never sees: those whose id has crc32 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
