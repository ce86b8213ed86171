"""URL filters: rules first, then words of host and path scored by naive Bayes.

Host names run words together.  A unigram model over the words of the pages' own text
splits each label into the likeliest words (Viterbi); the host words and the path
tokens then go to a multinomial naive Bayes model, trained on the urls that a rule
judges.  Urls without a rule get that model's verdict.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.shared import written

ALLOW, BLOCK = "allow", "block"
#: A label of a host has at most so many characters, so no longer word can stand in it.
LONGEST_WORD = 63
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PIECES = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")


@dataclass(frozen=True)
class Rule:
    """host and all its subdomains, where the path starts with path."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for null or without ``://``.  Only A-Z of the host is lower-cased."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, rest = rest[:cut].translate(_LOWER), rest[cut:]
    return host, rest[: min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))]


class RuleBook:
    """Finds the longest rule that fits; equally long ones by their text."""

    def __init__(self, rules: list[Rule]):
        self.by_host: dict[str, list[Rule]] = {}
        for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
            self.by_host.setdefault(rule.host, []).append(rule)

    def find(self, host: str, path: str) -> Rule | None:
        best, at = None, 0
        while host:
            for rule in self.by_host.get(host[at:], ()):
                if path.startswith(rule.path) and (best is None or len(rule.text) > len(best.text)):
                    best = rule
            at = host.find(".", at) + 1
            if not at:
                break
        return best


@dataclass
class Segmenter:
    """Unigram Viterbi segmentation; unknown words get less likely the longer they are."""

    words: dict[str, int]
    total: int

    def __post_init__(self):
        n = max(self.total, 1)
        self.cost = {w: -math.log(c / n) for w, c in self.words.items()}
        self.unknown = [math.log(n) + k * math.log(10.0) for k in range(LONGEST_WORD + 1)]
        self.split = lru_cache(200_000)(self._split)

    def _split(self, run: str) -> tuple[str, ...]:
        best, back = [0.0] + [math.inf] * len(run), [0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            for start in range(max(0, end - LONGEST_WORD), end):
                word = run[start:end]
                c = best[start] + self.cost.get(word, self.unknown[len(word)])
                if c < best[end]:
                    best[end], back[end] = c, start
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return tuple(reversed(out))

    def tokens(self, host: str, path: str) -> list[str]:
        """Segmented host words, then path tokens marked as such; a run of digits is ``<num>``."""
        out = []
        for run in _PIECES.findall(host):
            out += ["<num>"] if run[0].isdigit() else self.split(run) if run.isascii() else [run]
        return out + ["/" + ("<num>" if run[0].isdigit() else run) for run in _PIECES.findall(path.translate(_LOWER))]


@dataclass
class NaiveBayes:
    """Multinomial, add-one smoothed.

    totals: tokens of allowed and of blocked urls and different tokens, where counts are
    not all; table has (token, allow, block) of every token then.
    """

    counts: dict[str, dict[str, int]] = field(default_factory=dict)
    docs: dict[str, int] = field(default_factory=dict)
    totals: tuple[int, int, int] | None = None
    table: DataFrame | None = None

    def __post_init__(self):
        vocabulary = {t for c in self.counts.values() for t in c}
        allow, block = (self.counts.get(k, {}) for k in (ALLOW, BLOCK))
        na, nb, size = self.totals or (sum(allow.values()), sum(block.values()), len(vocabulary))
        self.whole = size == len(vocabulary)
        self.na, self.nb = na, nb = na + size + 1, nb + size + 1
        self.weight = {t: math.log((block.get(t, 0) + 1) / nb) - math.log((allow.get(t, 0) + 1) / na) for t in vocabulary}
        self.absent = math.log(1 / nb) - math.log(1 / na)
        self.prior = math.log((self.docs.get(BLOCK, 0) + 1) / (self.docs.get(ALLOW, 0) + 1))

    def score(self, tokens: list[str]) -> float:
        """Log odds of block; 0 and less is allow."""
        return self.prior + sum(self.weight.get(t, self.absent) for t in tokens)


def frequent(counted: DataFrame, n: str, most: int) -> Column:
    """Rows whose count is so large that at most ``most`` rows have one of its size.

    Sizes are steps of an eighth of a doubling, so a histogram of some hundred rows is all
    that comes to the driver.
    """
    size = F.floor(F.log2(F.expr(n).cast("double")) * 8)
    held, border = 0, None
    for r in counted.groupBy(size.alias("size")).agg(F.count("*").alias("rows")).orderBy(F.desc("size")).collect():
        held += r.rows
        if held > most:
            break
        border = r.size
    return F.lit(False) if border is None else size >= border


def word_model(pages: DataFrame, html_col: str = "html", vocabulary: int = 50_000, url_col: str = "url") -> Segmenter:
    """Counts the words of the visible text of all pages.

    The model holds at most ``vocabulary`` of the most frequent words, and of the others
    those that stand somewhere in a host; no host is segmented by any other word.  The
    total is that of all words.  A null page has none; repeated rows count each.
    """
    visible = F.lower(F.regexp_replace(F.col(html_col), "<[^>]*>", " "))
    words = pages.select(F.explode(F.split(visible, "[^a-z]+")).alias("word")).where(f"length(word) BETWEEN 1 AND {LONGEST_WORD}")
    counted = written(words.groupBy("word").agg(F.count("*").alias("n")), "url-words")
    total, different = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = {r.word: r.n for r in counted.where(frequent(counted, "n", vocabulary)).collect()}
    if different > len(top):

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                runs = {run for url in batch.column(0).to_pylist() for run in _PIECES.findall(split_url(url)[0]) if run.isascii() and not run[0].isdigit()}
                found = {run[i:j] for run in runs for i in range(len(run)) for j in range(i + 1, min(len(run), i + LONGEST_WORD) + 1)}
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["word"])

        inside = pages.select(F.col(url_col).alias("url")).mapInArrow(parts, "word string").distinct()
        top |= {r.word: r.n for r in counted.join(inside, "word", "left_semi").collect()}
    return Segmenter(top, total)


def train(urls: DataFrame, rules: list[Rule], words: Segmenter, url_col: str = "url", tokens: int = 100_000) -> NaiveBayes:
    """Naive Bayes over all urls that a rule judges; at most ``tokens`` of the most frequent tokens are held in memory, all in its table.

    A null url is judged by no rule; repeated rows count each; without any url that a rule
    judges, every url gets the prior's verdict, allow.
    """
    shared = urls.sparkSession.sparkContext.broadcast((rules, words.words, words.total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, cutter = RuleBook(shared.value[0]), Segmenter(*shared.value[1:])
        for batch in batches:
            found: Counter = Counter()
            for url in batch.column(0).to_pylist():
                host, path = split_url(url)
                if rule := book.find(host, path):
                    found[rule.action, None] += 1
                    found.update((rule.action, t) for t in cutter.tokens(host, path))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], names=["action", "token", "n"])

    counted = urls.select(F.col(url_col).alias("url")).mapInArrow(run, "action string, token string, n long")
    of = lambda action: F.sum(F.when(F.col("action") == action, F.col("n")).otherwise(0)).alias(action)
    every = written(counted.groupBy("token").agg(of(ALLOW), of(BLOCK)), "url-tokens")
    docs = every.where("token IS NULL").first()
    table = every.where("token IS NOT NULL")
    totals = table.agg(F.coalesce(F.sum(ALLOW), F.lit(0)), F.coalesce(F.sum(BLOCK), F.lit(0)), F.count("*")).first()
    top = table.where(frequent(table, f"{ALLOW} + {BLOCK}", tokens)).collect()
    counts = {action: {r.token: r[action] for r in top} for action in (ALLOW, BLOCK)}
    return NaiveBayes(counts, {action: docs[action] for action in (ALLOW, BLOCK)} if docs else {}, tuple(totals), table)


def judge(urls: DataFrame, rules: list[Rule], words: Segmenter, bayes: NaiveBayes, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) of every url.

    A null url, or one without ``://``, has empty host and path, fits no rule and gets
    the model's verdict on no tokens, its prior.  Repeated rows are judged each; other
    columns are not read.  Tokens that the model does not hold in memory are looked up
    in its table by a join.
    """
    shared = urls.sparkSession.sparkContext.broadcast((rules, words.words, words.total, bayes.counts, bayes.docs, bayes.totals))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, cutter, model = RuleBook(shared.value[0]), Segmenter(*shared.value[1:3]), NaiveBayes(*shared.value[3:])
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = book.find(host, path)
                tokens = cutter.tokens(host, path)
                rest = [] if model.whole else [t for t in tokens if t not in model.weight]
                score = model.score(tokens if model.whole else [t for t in tokens if t in model.weight])
                rows.append((host, path, rule and rule.text, rule and rule.action, score, rest))
            columns = [*zip(*rows, strict=True)] or [[]] * 6
            kinds = [pa.string()] * 4 + [pa.float64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], names=names)

    names = ["id", "host", "path", "rule", "verdict", "score", "rest"]
    plain = urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    out = T.StructType([plain.schema["id"], *(T.StructField(n, T.StringType()) for n in names[1:5]), T.StructField("score", T.DoubleType()), T.StructField("rest", T.ArrayType(T.StringType()))])
    found = plain.mapInArrow(run, out)
    if not bayes.whole:
        found = written(found.withColumn("row", F.monotonically_increasing_id()), "url-scores")
        weight = F.log((F.coalesce(BLOCK, F.lit(0)) + 1) / F.lit(float(bayes.nb))) - F.log((F.coalesce(ALLOW, F.lit(0)) + 1) / F.lit(float(bayes.na)))
        more = found.select("row", F.explode("rest").alias("token")).join(bayes.table, "token", "left").groupBy("row").agg(F.sum(weight).alias("more"))
        found = found.join(more, "row", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    verdict = F.coalesce("verdict", F.when(F.col("score") > 0, BLOCK).otherwise(ALLOW)).alias("verdict")
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", verdict, "score")
