"""Substring dedup by fixed-block anchors.

A repeat of 13 words holds, wherever it starts, a whole non-overlapping block of 7
words of the document it is a repeat of (13 = 2 * 7 - 1).  So it is enough to index the
blocks that start at every seventh word, and to probe the index with every rolling
window of 7 words.

1. Documents are dealt to groups of a few megabytes.  A group's rolling windows are
   hashed; each distinct hash goes to its bucket, marked if one of its windows is an
   indexed block and if several documents of the group have it.  Hashes travel sorted
   and delta-coded in one row per group and bucket: about four bytes a window.
2. A bucket answers each group with one bit a hash: it is an indexed block that some
   other document has too.  These are the anchors.
3. Anchors are extended to maximal exact repeats: every window of 13 words that holds an
   anchor is a candidate, and its 104-bit hash goes to its bucket with the group's
   least document id; runs of windows that are confirmed make up a maximal repeat.
4. A bucket answers with one bit a window: a smaller document id has it elsewhere.

Nothing travels for pairs of documents, so a passage that very many documents share
costs one entry a group.  The documents are shuffled once, by group; the rounds reuse
that exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.arrowtext import spread, utf8_buffers

#: Bytes of text in a group; words a bucket is meant to get.
GROUP_BYTES, BUCKET_WORDS = 4 << 20, 1_500_000
NO_ID = np.int64(2**63 - 1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_LOW = np.uint64((1 << 40) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a block of texts: where they stand, whose they are, and their hashes."""

    def __init__(self, offsets: np.ndarray, body: np.ndarray):
        n = len(body)
        self.body = body
        inner = ~_SPACE[body]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins, stops = inner.copy(), inner.copy()
        begins[1:] &= ~inner[:-1] | edge[1:n]
        stops[:-1] &= ~inner[1:] | edge[1:n]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)  # of each text, and the end
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        summed = np.concatenate((np.zeros(1, np.uint64), np.cumsum((body.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64)))
        back = _powers(pow(_BASE, -1, 1 << 64), n)
        length = (self.ends - self.starts).astype(np.uint64)
        self.hash = _mix((summed[self.ends] - summed[self.starts]) * back[self.starts] + length) if len(self.starts) else np.zeros(0, np.uint64)

    def windows(self, k: int) -> np.ndarray:
        """Where the windows of k words of one text start."""
        if len(self.doc) < k:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: len(self.doc) - k + 1] == self.doc[k - 1 :])

    def hashes(self, at: np.ndarray, k: int, salt: int) -> np.ndarray:
        """Of the windows of k words that start at those words."""
        h = np.full(len(at), salt, np.uint64)
        for t in range(k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + self.hash[at + t]
        return _mix(h)


def _pack(values: np.ndarray) -> bytes:
    """Sorted 40-bit numbers as differences, four bytes each where that is enough."""
    step = np.diff(values, prepend=np.uint64(0))
    return b"\4" + step.astype("<u4").tobytes() if not len(step) or step.max() < 1 << 32 else b"\x08" + step.astype("<u8").tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.uint64), dtype=np.uint64)


class Anchors:
    """The distinct hashes of a group's rolling windows, in order of bucket and value."""

    def __init__(self, words: Words, block: int, buckets: int):
        self.at = words.windows(block)
        h = words.hashes(self.at, block, 1)
        key = ((h >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(40) | h & _LOW
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        head = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        runs = np.flatnonzero(head)
        self.run = np.cumsum(head) - 1
        self.key = key[runs]
        doc = words.doc[self.at][self.order]
        indexed = ((self.at - words.first[words.doc[self.at]]) % block == 0)[self.order]
        self.indexed = np.logical_or.reduceat(indexed, runs) if len(runs) else indexed
        self.several = np.minimum.reduceat(doc, runs) != np.maximum.reduceat(doc, runs) if len(runs) else indexed

    def hits(self, bits: np.ndarray, n_words: int) -> np.ndarray:
        """How many of the words before each one start an anchor."""
        hit = np.zeros(n_words, np.int64)
        hit[self.at[self.order][bits[self.run].astype(bool)]] = 1
        return np.concatenate(([0], np.cumsum(hit)))


class Candidates:
    """The distinct long windows that hold an anchor, in order of bucket and hash."""

    def __init__(self, words: Words, ids: np.ndarray, hits: np.ndarray, size: int, block: int, buckets: int):
        at = words.windows(size)
        at = at[hits[at + size - block + 1] > hits[at]]
        a, b = words.hashes(at, size, 2), words.hashes(at, size, 3)
        high = ((a >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(40) | a & _LOW
        order = np.lexsort((b, high))
        self.at, high, low = at[order], high[order], b[order]
        head = np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))) if len(high) else np.zeros(0, bool)
        runs = np.flatnonzero(head)
        self.run = np.cumsum(head) - 1
        self.high, self.low = high[runs], low[runs]
        self.id = ids[words.doc[self.at]]
        self.least = np.minimum.reduceat(self.id, runs) if len(runs) else self.id

    def covered(self, bits: np.ndarray) -> np.ndarray:
        """Where windows start that a smaller id has too: in another group, or in this one."""
        return self.at[bits[self.run].astype(bool) | (self.least[self.run] < self.id)]


def _by_bucket(key: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of keys that are sorted with the bucket above bit 40."""
    bucket = (key >> np.uint64(40)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    return [(int(bucket[a]), a, b) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True) if b > a]


def _answers(table: pa.Table, kind: int, n: int) -> np.ndarray:
    """The bits of all buckets in order."""
    rows = sorted((b, s, x) for k, b, s, x in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "n", "bits")), strict=True) if k == kind)
    parts = [np.unpackbits(np.frombuffer(x, np.uint8), count=s) for _, s, x in rows]
    out = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    if len(out) != n:
        raise ValueError(f"{len(out)} answers to {n} questions")
    return out


def _group(table: pa.Table) -> tuple[Words, np.ndarray]:
    offsets, body = utf8_buffers(table.column("text"))
    ids = table.column("id").fill_null(NO_ID).to_numpy()
    return Words(offsets, body), ids


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13) -> DataFrame:
    """(id, n_words, n_removed, kept): kept holds the words that stay, joined by one blank.

    A word goes if a window of ``size`` words over it also starts in a document with a
    smaller id; all windows are those of the input.  Null and empty texts have no words.
    A null id counts as larger than all others.  Rows that repeat an id count as that
    document.  Other columns are not read.
    """
    spark = df.sparkSession
    block = (size + 1) // 2
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = df.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0
    groups = max(-(-total // GROUP_BYTES), parts)
    buckets = min(max(-(-total // (6 * BUCKET_WORDS)), parts), 1 << 24)

    docs = df.select(F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)), F.lit(groups)).cast("int").alias("grp"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def ask_anchors(table: pa.Table) -> pa.Table:
        words, _ = _group(table)
        found, grp = Anchors(words, block, buckets), table.column("grp")[0].as_py()
        rows = [(grp, bucket, b - a, _pack(found.key[a:b] & _LOW), np.packbits(found.indexed[a:b]).tobytes(), np.packbits(found.several[a:b]).tobytes()) for bucket, a, b in _by_bucket(found.key)]
        return _table(rows, asked)

    def answer_anchors(table: pa.Table) -> pa.Table:
        bucket, grp, n = table.column("bucket")[0].as_py(), table.column("grp").to_pylist(), table.column("n").to_numpy()
        value = np.concatenate([_unpack(x) for x in table.column("hashes").to_pylist()])
        indexed, several = (np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(table.column(c).to_pylist(), n, strict=True)]) for c in ("indexed", "several"))
        order = np.argsort(value, kind="stable")
        value = value[order]
        runs = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        length = np.diff(np.append(runs, len(value)))
        hit = np.logical_or.reduceat(indexed[order], runs) & ((length > 1) | np.logical_or.reduceat(several[order], runs))
        bits = np.zeros(len(value), bool)
        bits[order] = np.repeat(hit, length)
        return _bits(grp, bucket, n, bits, 1)

    def ask_windows(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        words, ids = _group(table)
        anchors = Anchors(words, block, buckets)
        found = Candidates(words, ids, anchors.hits(_answers(answers, 1, len(anchors.key)), len(words.doc)), size, block, buckets)
        rows = [(key[0].as_py(), bucket, b - a, _pack(found.high[a:b] & _LOW), found.low[a:b].astype("<u8").tobytes(), found.least[a:b].astype("<i8").tobytes()) for bucket, a, b in _by_bucket(found.high)]
        return _table(rows, wanted)

    def answer_windows(table: pa.Table) -> pa.Table:
        bucket, grp, n = table.column("bucket")[0].as_py(), table.column("grp").to_pylist(), table.column("n").to_numpy()
        high = np.concatenate([_unpack(x) for x in table.column("hashes").to_pylist()])
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), "<u8")
        least = np.frombuffer(b"".join(table.column("least").to_pylist()), "<i8")
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        runs = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))))
        first = np.repeat(np.minimum.reduceat(least[order], runs), np.diff(np.append(runs, len(high))))
        bits = np.zeros(len(high), bool)
        bits[order] = first < least[order]
        return _bits(grp, bucket, n, bits, 2)

    def remove(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        words, ids = _group(table)
        anchors = Anchors(words, block, buckets)
        found = Candidates(words, ids, anchors.hits(_answers(answers, 1, len(anchors.key)), len(words.doc)), size, block, buckets)
        n = len(words.doc)
        change = np.zeros(n + 1, np.int64)
        at = found.covered(_answers(answers, 2, len(found.high)))
        np.add.at(change, at, 1)
        np.add.at(change, at + size, -1)
        gone = np.cumsum(change[:n]) > 0
        stays = np.flatnonzero(~gone)
        before = np.concatenate(([0], np.cumsum(~gone)))[words.first]  # kept words before each text
        length = words.ends[stays] - words.starts[stays]
        last = np.zeros(len(stays), bool)
        last[before[1:][np.diff(before) > 0] - 1] = True
        room = length + ~last
        out = np.full(int(room.sum()), 32, np.uint8)
        ends = np.cumsum(room)
        out[spread(ends - room, length)] = words.body[spread(words.starts[stays], length)]
        offsets = np.concatenate(([0], ends))[before]
        kept = pa.Array.from_buffers(pa.string(), len(ids), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
        return pa.table({"id": table.column("id"), "n_words": pa.array(words.counts.astype(np.int64)), "n_removed": pa.array(words.counts.astype(np.int64) - np.diff(before)), "kept": kept})

    asked = "grp int, bucket int, n int, hashes binary, indexed binary, several binary"
    wanted = "grp int, bucket int, n int, hashes binary, low binary, least binary"
    told = "grp int, bucket int, n int, bits binary, kind int"
    anchors = docs.groupBy("grp").applyInArrow(ask_anchors, asked).groupBy("bucket").applyInArrow(answer_anchors, told)
    windows = docs.groupBy("grp").cogroup(anchors.groupBy("grp")).applyInArrow(ask_windows, wanted).groupBy("bucket").applyInArrow(answer_windows, told)
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return docs.groupBy("grp").cogroup(anchors.unionByName(windows).groupBy("grp")).applyInArrow(remove, out).withColumnRenamed("id", id_col)


_KINDS = {"int": pa.int32(), "binary": pa.binary()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    columns = [*zip(*rows, strict=True)] or [[]] * len(fields)
    return pa.table({name: pa.array(c, _KINDS[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def _bits(grp: list, bucket: int, n: np.ndarray, bits: np.ndarray, kind: int) -> pa.Table:
    ends = np.cumsum(n)
    return pa.table({
        "grp": pa.array(grp, pa.int32()), "bucket": pa.array([bucket] * len(grp), pa.int32()), "n": pa.array(n, pa.int32()),
        "bits": pa.array([np.packbits(bits[b - k : b]).tobytes() for b, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary()),
        "kind": pa.array([kind] * len(grp), pa.int32()),
    })
