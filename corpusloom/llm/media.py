"""Media columns: content-addressed payloads in tar shards.

Writing: each task appends its payloads to tar shards in the shared folder, named by
the SHA-256 digest of the payload, each distinct payload once per task.  One place is
then chosen for each digest, so all rows with a payload have the same shard, offset and
length; members that other tasks have stored for it are not referred to.  A shard is
written under an attempt's name and then moved to its final one, which follows from the
partition alone; where a task is run again, the shard that is there stays.

Reading: ``read_headers`` makes range reads of headers alone and fills the metadata
columns (width, height, bit depth); ``read_payloads`` makes range reads of whole members.

The stored form is a PNG of 8-bit grey samples, 192 to a row: lossless, and less than
half the size of the samples for text.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.arrowtext import in_small_batches, tidy
from corpusloom.llm.shared import fresh_dir, written

ROW = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33  # signature and IHDR
#: A shard is closed beyond this size; digests a task remembers at most.
SHARD_BYTES, REMEMBERED = 64 << 20, 200_000


def padded(text: bytes) -> bytes:
    """text with blanks up to a positive multiple of ROW."""
    return text.ljust(max(1, -(-len(text) // ROW)) * ROW, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.concatenate((np.zeros((len(rows), 1), np.uint8), rows), axis=1)  # filter 0 for each row
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first HEADER_BYTES."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("no PNG header at this offset")
    return struct.unpack(">IIB", head[16:25])


def from_png(media: bytes) -> bytes:
    width, height, _ = png_header(media)
    body, at = [], 8
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        if media[at + 4 : at + 8] == b"IDAT":
            body.append(media[at + 8 : at + 8 + size])
        at += size + 12
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("only unfiltered rows are written here")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and spread of the samples, and a 64-bit hash: which of 64 equal stretches are brighter than the mean."""
    a = np.frombuffer(payload, np.uint8).astype(np.float64)
    part = a.reshape(64, -1).mean(axis=1)  # ROW is a multiple of 64
    bits = int("".join("1" if x else "0" for x in part > a.mean()), 2)
    return f"mean={a.mean():.4f};std={a.std():.4f};ahash={bits:016x}"


class ShardWriter:
    """Tar shards of one partition."""

    def __init__(self, folder: str, partition: int):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.partition, self.attempt, self.number = partition, uuid.uuid4().hex, 0
        self.stream = None

    def name(self) -> str:
        return f"shard-{self.partition:06d}-{self.number:04d}.tar"

    def add(self, name: str, body: bytes) -> tuple[str, int]:
        """(shard, offset) of the stored bytes."""
        if self.stream is None:
            self.temporary = f"{self.root}/.{self.name()}.{self.attempt}"
            self.stream, self.at = self.fs.open_output_stream(self.temporary), 0
        info = tarfile.TarInfo(name)
        info.size = len(body)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        place = self.name(), self.at + len(head)
        self.stream.write(head + body + b"\0" * (-len(body) % 512))
        self.at += len(head) + len(body) + -len(body) % 512
        if self.at >= SHARD_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self.stream is not None:
            self.stream.write(b"\0" * 1024)
            self.stream.close()
            final = f"{self.root}/{self.name()}"
            if self.fs.get_file_info(final).type == pafs.FileType.NotFound:
                self.fs.move(self.temporary, final)
            else:  # an earlier attempt of this task, which has stored the same bytes
                self.fs.delete_file(self.temporary)
            self.stream, self.number = None, self.number + 1


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, digest, shard, offset, length): payloads of all rows, written to shards.

    Null counts as the empty text.  Repeated rows stay rows and share a payload; an empty
    table gives no rows; other columns are not read.  A task holds one batch of texts and
    the places of the payloads it has stored last.  Runs at once: the rows are a table in
    the shared folder.
    """
    folder = fresh_dir(df.sparkSession, "media")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, known = ShardWriter(folder, TaskContext.get().partitionId()), {}
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode("utf-8")
                payload = padded(raw)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    media = to_png(payload)
                    known[digest] = (*writer.add(f"{digest}.png", media), len(media))
                rows.append((len(raw), digest, *known[digest]))
            columns = [*zip(*rows, strict=True)] or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[f.name for f in out])
        writer.close()

    plain = in_small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = T.StructType([plain.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
    rows = written(plain.mapInArrow(run, out), "media-places")
    place = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p"))
    named = rows.select("id", "n_bytes", "digest").join(place, "digest").select("id", "n_bytes", "digest", "p.shard", "p.offset", "p.length", F.lit(folder).alias("folder"))
    # In the order of the shards, so that a reader opens few; rows of one payload can part.
    return named.repartitionByRange("shard", "offset", "id").sortWithinPartitions("shard", "offset").withColumnRenamed("id", id_col)


class RangeReader:
    """Range reads of shard members; the shard read last stays open."""

    def __init__(self):
        self.at, self.file = None, None

    def read(self, folder: str, shard: str, offset: int, length: int) -> bytes:
        if (folder, shard) != self.at:
            self.close()
            fs, root = pafs.FileSystem.from_uri(folder)
            self.at, self.file = (folder, shard), fs.open_input_file(f"{root}/{shard}")
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.at, self.file = None, None


_KINDS = {pa.int64(): T.LongType(), pa.string(): T.StringType()}
_PLACE = ("folder", "shard", "offset", "length", "digest")


def _read(rows: DataFrame, new: list[tuple[str, pa.DataType]], made) -> DataFrame:
    """rows and the new columns: made(read, place) gives their values, once for each place of a batch."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader()
        for batch in batches:
            places = [*zip(*(batch.column(c).to_pylist() for c in _PLACE), strict=True)]
            got = {p: made(reader.read, *p) for p in sorted(set(places))}
            columns = [*zip(*(got[p] for p in places), strict=True)] or [[]] * len(new)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, (_, k) in zip(columns, new, strict=True))], names=[*batch.schema.names, *(n for n, _ in new)])
        reader.close()

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(n, _KINDS[k]) for n, k in new)]))


def read_headers(rows: DataFrame) -> DataFrame:
    """store()'s rows with width, height and bit_depth, from the first HEADER_BYTES of each member alone."""
    new = [("width", pa.int64()), ("height", pa.int64()), ("bit_depth", pa.int64())]
    return _read(rows, new, lambda read, folder, shard, offset, length, digest: png_header(read(folder, shard, offset, HEADER_BYTES)))


def read_payloads(rows: DataFrame) -> DataFrame:
    """store()'s rows with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of the bytes as stored."""
    new = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def made(read, folder: str, shard: str, offset: int, length: int, digest: str) -> tuple:
        media = read(folder, shard, offset, length)
        payload = from_png(media)
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{shard}@{offset}: stored bytes do not match their digest")
        return len(payload), digest, zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)

    return _read(rows, new, made)
