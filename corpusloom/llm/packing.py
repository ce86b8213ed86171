"""Harmonic packing of tokenised documents into fixed-length training sequences.

A document's ids are cut into whole sequences of ``capacity`` and a rest.  The class
of a rest of length r is k = capacity // r, the reciprocal-capacity class whose
lengths lie in (capacity / (k + 1), capacity / k]; a bin of class k takes exactly k
pieces, whoever they come from.  As documents may be cut freely, a rest that would
leave its share of the bin too empty is first cut at the upper border of the class
above, capacity // (k + 1), so what stays over is smaller than a bin's share of the
next classes and so on: two such cuts leave almost no padding.

Every worker fills the bins of its own partition; nothing is shuffled.  Bins that are
still open at the end of a partition are laid one after another, cut at the capacity,
and the last, short one into powers of two.  Sequences whose length is a power of two
need no padding, so a partition ends without any.

Memory: one block of texts, or the longest text with its ids, and the open bins, fewer
than ``capacity`` ids a class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.arrowtext import in_small_batches, tidy, utf8_buffers
from corpusloom.llm.bpe import encoder

#: Sequence numbers of one partition; its number stands above these bits.
SEQUENCE_BITS = 36


class HarmonicPacker:
    """Packs the documents of one partition; rows() hands over the pieces of closed bins."""

    def __init__(self, capacity: int, first_sequence: int, waste: float = 1 / 32, cuts: int = 2):
        self.capacity, self.sequence, self.waste, self.cuts = capacity, first_sequence, waste, cuts
        self.open: dict[int, list[tuple]] = {}
        self.out: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        """ids: all ids of a document, its end mark included."""
        total, at = len(ids), 0
        while total - at >= self.capacity:
            self._close([(doc, at, ids[at : at + self.capacity], total)])
            at += self.capacity
        for _ in range(self.cuts):
            rest = total - at
            if not rest:
                return
            k = self.capacity // rest
            if self.capacity - k * rest <= self.waste * self.capacity:
                break
            part = self.capacity // (k + 1)
            self._put(k + 1, (doc, at, ids[at : at + part], total))
            at += part
        if at < total:
            self._put(self.capacity // (total - at), (doc, at, ids[at:total], total))

    def _put(self, k: int, piece: tuple) -> None:
        held = self.open.setdefault(k, [])
        held.append((piece[0], piece[1], piece[2].copy(), piece[3]))
        if len(held) == k:
            self._close(self.open.pop(k))

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, at, ids, total in pieces:
            self.out.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def finish(self) -> None:
        """Lays the open bins out, largest pieces first."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        room, held = self.capacity, []
        rest = sum(len(p[2]) for p in left)
        if rest < self.capacity:
            room = 1 << (rest.bit_length() - 1) if rest else 0
        for doc, at, ids, total in left:
            while len(ids):
                part = ids[:room]
                held.append((doc, at, part, total))
                at, ids, room, rest = at + len(part), ids[len(part) :], room - len(part), rest - len(part)
                if not room:
                    self._close(held)
                    held, room = [], self.capacity if rest >= self.capacity else 1 << (rest.bit_length() - 1) if rest else 0

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(df: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text and then ``end_id``; null counts as the
    empty text, whose only id is ``end_id``.  Each id lies in exactly one piece.  A
    sequence's pieces fill it from offset 0 without gaps, up to ``capacity``.  The
    sequence number holds the partition's number, so partitions need not know of each
    other; a task that is run again over the same split gives the same rows.  Repeated
    rows are packed each for itself.  Columns besides id and text are not read.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        packer = HarmonicPacker(capacity, TaskContext.get().partitionId() << SEQUENCE_BITS)
        end = np.array([end_id], np.int32)

        def rows() -> pa.RecordBatch:
            columns = [*zip(*packer.rows(), strict=True)] or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 6]
            offsets, body = utf8_buffers(batch.column(1))
            docs = batch.column(0).to_pylist()
            for i, j, ids, starts in bpe.encode_rows(offsets, body):
                for doc, a, b in zip(docs[i:j], starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    packer.add(doc, np.concatenate((ids[a:b], end)))
                yield rows()
        if kinds:
            packer.finish()
            yield rows()

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    plain = in_small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = T.StructType([plain.schema["id"], *(T.StructField(n, T.LongType()) for n in names[1:])])
    return plain.mapInArrow(run, out).withColumnRenamed("id", id_col)
