"""Byte-pair encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a block lie one after another in one symbol array.  An
index maps each mergeable pair to all positions where it stands.  Merges are applied
in ascending rank, each to all its positions at once; only the neighbours of merged
positions get new pairs, and only their lists are updated.  A new pair always has a
higher rank than the merge that made it, so one ascending sweep equals encoding each
pre-token by itself.

Texts are encoded whole; null counts as the empty text.  A text longer than a block is
encoded in pieces, cut where a pre-token ends whatever stands around it.  A special string of the
tokenizer file becomes its own id, as the tokenizers library does by default.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import pretokens
from corpusloom.llm.arrowtext import BLOCK_BYTES, blocks, in_small_batches, spread, tidy, utf8_buffers

NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PairIndexEncoder:
    """Encodes distinct pre-tokens; keeps the ids of up to ``keep`` of them between blocks."""

    def __init__(self, path: str, keep: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.token_bytes[i] = content
        if len(self.special) > 1:
            raise ValueError("one special string at most is supported")
        self.byte_id = np.zeros(256, np.int32)
        for token, i in vocab.items():
            if len(token) == 1:
                self.byte_id[letters[token]] = i
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.twin = left == right
        self.byte_len = np.array([len(b) for b in self.token_bytes], np.int64)
        self.byte_at = np.concatenate(([0], np.cumsum(self.byte_len)))[:-1]
        self.bytes = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.keep = keep
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {w: k for k, w in enumerate(self.special)}
        self.flat = np.array([*self.special.values()], np.int32)
        self.starts = np.arange(len(self.known), dtype=np.int64)
        self.lengths = np.ones(len(self.known), np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each)."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbol = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbol)
        ends = np.cumsum(sizes)
        after = np.arange(1, n + 1, dtype=np.int64)
        after[ends[sizes > 0] - 1] = n  # n: no neighbour
        before = np.arange(-1, n - 1, dtype=np.int64)
        before[(ends - sizes)[sizes > 0]] = n
        before, after = np.append(before, n), np.append(after, n)
        symbol = np.append(symbol, -1)
        rank = np.full(n + 1, NONE, np.int32)
        inner = np.flatnonzero(after[:n] < n)
        rank[inner] = self.rank_of(symbol[inner], symbol[inner + 1])
        alive = np.ones(n + 1, bool)
        # The index: positions by pair, a pair being known by its rank.
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(positions: np.ndarray) -> None:
            r = rank[positions]
            keep = r != NONE
            positions, r = positions[keep], r[keep]
            if not len(r):
                return
            order = np.argsort(r, kind="stable")
            positions, r = positions[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(r)]
            for a, b, k in zip(bounds, bounds[1:], r[bounds[:-1]].tolist(), strict=False):
                lists = index.get(k)
                if lists is None:
                    index[k] = [positions[a:b]]
                    heapq.heappush(active, k)
                else:
                    lists.append(positions[a:b])

        enter(inner)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[rank[at] == r]  # lists are not cleared of pairs that other merges broke
            if not len(at):
                continue
            if self.twin[r] and len(at) > 1:  # of aaa, the left pair goes first
                at = np.unique(at)
                chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
                run_at = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - run_at) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            symbol[at] = self.made[r]
            alive[gone] = False
            rank[gone] = NONE
            after[at] = beyond
            before[beyond] = at
            before[n], after[n] = n, n
            rank[at] = np.where(beyond < n, self.rank_of(symbol[at], symbol[beyond]), NONE)
            prior = before[at]
            prior = prior[prior < n]
            rank[prior] = self.rank_of(symbol[prior], symbol[after[prior]])
            enter(np.concatenate((at, prior)))
        alive = alive[:n]
        total = np.concatenate(([0], np.cumsum(alive)))
        return symbol[:n][alive].astype(np.int32), total[ends] - total[ends - sizes]

    def encode(self, offsets: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a block one after another, where each text's ids start and the end)."""
        cuts, before = pretokens.borders(offsets, body, next(iter(self.special), b""))
        words, which = pretokens.distinct(cuts, body)
        if len(self.known) > self.keep:
            self._forget()
        known = self.known
        place = [known.get(w, -1) for w in words]
        missing = [w for w, k in zip(words, place, strict=True) if k < 0]
        if missing:
            ids, counts = self.encode_words(missing)
            known.update(zip(missing, range(len(self.starts), len(self.starts) + len(missing)), strict=True))
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(counts) - counts))
            self.lengths = np.concatenate((self.lengths, counts))
            self.flat = np.concatenate((self.flat, ids))
            place = [known[w] for w in words]
        place = np.array(place, np.int64)[which]
        lengths = self.lengths[place]
        total = np.concatenate(([0], np.cumsum(lengths)))
        return self.flat[spread(self.starts[place], lengths)], total[before]

    def encode_rows(self, offsets: np.ndarray, body: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(i, j, ids, starts) of runs of texts [i, j), as encode() has them; no run is longer than a block or one text."""
        for i, j in blocks(offsets):
            at = offsets[i : j + 1]
            part = body[at[0] : at[-1]]
            if len(part) <= 2 * BLOCK_BYTES:
                yield i, j, *self.encode(at - at[0], part)
                continue
            cuts = pretokens.safe_cuts(part, BLOCK_BYTES)
            found = [self.encode(np.array([0, b - a]), part[a:b])[0] for a, b in zip(cuts, cuts[1:], strict=False)]
            ids = np.concatenate(found)
            yield i, j, ids, np.array([0, len(ids)])

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts one after another, where each text's bytes start and the end)."""
        lengths = self.byte_len[ids]
        total = np.concatenate(([0], np.cumsum(lengths)))
        return self.bytes[spread(self.byte_at[ids], lengths)], total[starts]


@lru_cache(2)
def encoder(path: str) -> PairIndexEncoder:
    """One encoder for each worker process."""
    return PairIndexEncoder(path)


def _binary(offsets: np.ndarray, body: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body))])


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each whole text, packed as little-endian unsigned 32-bit integers.

    vocabulary: path of a byte-level BPE file of the tokenizers library, the same on
    every executor.  One pass over the scan, no shuffle; memory holds one block of
    texts, or the longest text and its ids.  A null or empty text has no ids (an empty binary);
    repeated rows stay rows; other columns of df are neither read nor returned, so
    their names do not matter.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            offsets, body = utf8_buffers(batch.column(1))
            for i, j, ids, starts in bpe.encode_rows(offsets, body):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _binary(starts * 4, ids.astype("<u4"), pa.binary())], names=["id", "ids"])

    plain = in_small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = T.StructType([plain.schema["id"], T.StructField("ids", T.BinaryType())])
    return plain.mapInArrow(run, out).withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded): the text of packed ids; bytes that are not UTF-8 become U+FFFD.

    Null or empty ids give the empty text.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            packed = batch.column(1)
            offsets, body = utf8_buffers(packed)
            for i, j in blocks(offsets):
                at = offsets[i : j + 1]
                ids = np.frombuffer(body[at[0] : at[-1]].tobytes(), "<u4").astype(np.int64)
                chars, starts = bpe.decode(ids, (at - at[0]) // 4)
                texts = _binary(starts, chars, pa.binary())
                try:
                    texts = texts.cast(pa.string())
                except pa.ArrowInvalid:
                    texts = pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), packed.slice(i, j - i), texts], names=["id", "ids", "decoded"])

    plain = in_small_batches(df).select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    out = T.StructType([plain.schema["id"], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return plain.mapInArrow(run, out).withColumnRenamed("id", id_col)
