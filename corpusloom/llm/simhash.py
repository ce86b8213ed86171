"""SimHash near-dedup: fingerprints of shingles, paired exactly with vantage-point trees.

A top tree, built on a bounded sample of the fingerprints, splits the space: at each
node by the Hamming distance to a vantage point, at the sample's median.  A fingerprint
lives in the shard (leaf) its distances lead to.  It is also a visitor of every other
shard later in the order that the triangle inequality does not rule out: by a node with
distance d and border m, the near side is closed to it only if d > m + radius and the far
side only if d <= m - radius.  So a pair within the radius meets in one shard, the later
of their homes.

Within a shard the same tree is grown further and searched for all fingerprints at once,
node by node, until few enough points are left to compare.  A shard hands on a spanning
forest of its links, not the pairs, so a large group costs as many rows as it has
fingerprints; components of the forests are those of all links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.arrowtext import in_small_batches, tidy, whole_runs
from corpusloom.llm.components import Union, components
from corpusloom.llm.shared import Tables, unused, written

#: Fingerprints that a shard is meant to hold, that the top tree is built on, and that are compared outright.
SHARD, SAMPLE, OUTRIGHT = 32_768, 16_384, 192


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64 bits: set where over half of the shingles' XXH64 have a one.  A-Z count as a-z."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space alone
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(flat[a:b], seed) for a, b in zip(starts, ends, strict=False)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[2 * ones > len(h)].sum(dtype=np.uint64))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): fp as a signed long.  Null and empty texts have fingerprint 0."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fp = np.array([fingerprint(t.as_py() or b"", shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    plain = in_small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, T.StructType([plain.schema["id"], T.StructField("fp", T.LongType())])).withColumnRenamed("id", id_col)


def distance(points: np.ndarray, other) -> np.ndarray:
    """Hamming distance; points with several words stand in the rows of a matrix."""
    bits = np.bitwise_count(points ^ other)
    return bits if bits.ndim == 1 else bits.sum(axis=1, dtype=np.int64)


class TopTree:
    """Nodes in a list: (vantage point, border, near, far), or (None, shard, 0, 0)."""

    def __init__(self, sample: np.ndarray, shards: int, radius: int):
        self.radius, self.nodes, self.shards = radius, [], 0
        self._grow(sample, shards)

    def _grow(self, points: np.ndarray, shards: int) -> int:
        here = len(self.nodes)
        self.nodes.append((None, self.shards, 0, 0))
        if shards > 1 and len(points) > 1:
            vantage, border = choose(points)
            d = distance(points, vantage)
            if (d > border).any():
                near = self._grow(points[d <= border], (shards + 1) // 2)
                far = self._grow(points[d > border], shards // 2)
                self.nodes[here] = (vantage, border, near, far)
                return here
        self.shards += 1
        return here

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, indices of its points and of visitors from earlier homes, whether it is their home)."""
        todo = [(0, np.arange(len(points)), np.ones(len(points), bool))]
        seen = np.zeros(len(points), bool)  # shards come in their order, so these have passed their home
        while todo:
            node, at, home = todo.pop()
            vantage, border, near, far = self.nodes[node]
            if vantage is None:
                seen[at[home]] = True
                meets = seen[at]
                yield border, at[meets], home[meets]
                continue
            d = distance(points[at], vantage).astype(np.int64)
            for child, open_, own in ((far, d > border - self.radius, d > border), (near, d <= border + self.radius, d <= border)):
                if open_.any():  # the near side is popped first
                    todo.append((child, at[open_], (home & own)[open_]))


def choose(points: np.ndarray) -> tuple[np.uint64, int]:
    """The vantage point among a few whose distances spread most, and their median."""
    best = None
    for i in np.linspace(0, len(points) - 1, 8).astype(int):
        d = distance(points[:: max(1, len(points) // 512)], points[i])
        if best is None or d.std() > best[0]:
            best = (d.std(), points[i])
    d = np.sort(distance(points, best[1]))
    return best[1], int(d[(len(d) - 1) // 2])


def pairs_within(points: np.ndarray, home: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index arrays and distances of all pairs of a home point and any other point within the radius.

    A vantage-point tree over the home points, searched for all points together.
    """
    todo = [(np.flatnonzero(home), np.arange(len(points)))]
    while todo:
        own, ask = todo.pop()
        if not len(own) or not len(ask):
            continue
        border = None
        if len(own) > OUTRIGHT:
            vantage, border = choose(points[own])
            d = distance(points[own], vantage).astype(np.int64)
            if (d <= border).all():
                border = None
        if border is not None:
            q = distance(points[ask], vantage).astype(np.int64)
            todo.append((own[d <= border], ask[q <= border + radius]))
            todo.append((own[d > border], ask[q > border - radius]))
            continue
        for i in range(0, len(own), OUTRIGHT):
            part = own[i : i + OUTRIGHT]
            for j in range(0, len(ask), 1 << 12):
                other = ask[j : j + (1 << 12)]
                bits = np.bitwise_count(points[part][:, None] ^ points[other][None, :])
                bits = bits if bits.ndim == 2 else bits.sum(axis=2, dtype=np.uint16)
                x, y = np.nonzero(bits <= radius)
                keep = part[x] != other[y]
                x, y = x[keep], y[keep]
                yield part[x], other[y], bits[x, y]


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): a forest whose components are those of all pairs of fps within the radius.

    fps: a table with one column fp of distinct signed longs.
    """
    total = fps.count()
    # The hash spreads the sample over all fingerprints; its size is bounded.
    share = min(1.0, SAMPLE / max(total, 1))
    sample = [r.fp for r in fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(4 * SAMPLE).collect()]
    tree = TopTree(np.sort(np.array(sample, np.int64)).view(np.uint64), -(-total // SHARD), radius)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for shard, at, home in tree.route(fp.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), pa.array(fp[at]), pa.array(home)], names=["shard", "fp", "home"])

    def search(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy()
        points, found = fp.view(np.uint64), Union(len(fp))
        for x, y, _ in pairs_within(points, table.column("home").to_numpy(), radius):
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                found.join(i, j)
        root = np.array([found.find(i) for i in range(len(fp))], np.int64)
        tied = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"a": fp[tied], "b": fp[root[tied]]})

    routed = fps.select("fp").mapInArrow(route, "shard int, fp long, home boolean")
    return routed.groupBy("shard").applyInArrow(search, "a long, b long")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp, component_id): the least id reachable over links of radius bits or fewer.

    Texts of one fingerprint are linked, those without words among them.  Repeated ids
    count once for the least id; a null id never is it.
    """
    prints = written(fingerprints(df, id_col, text_col, shingle, seed), "fingerprints")
    tables = Tables(df.sparkSession)
    least = tables.written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    tied = tables.written(components(links(least.select("fp"), radius), tables=tables), "fingerprint-components")
    grouped = tied.join(least, tied.node == least.fp)
    first = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = tied.join(first, "component").select(F.col("node").alias("fp"), "component_id")
    known = written(least.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "fingerprint-groups")
    tables.drop()
    return prints.join(known, "fp").select(id_col, "fp", "component_id")


#: Smallest hashes that lead a text to others, and words of 64 bits of the wide fingerprint.
#: The chance that each of the two leaves out a pair of just the similarity.  Number of
#: shingles from which one radius holds.  Rows of a bucket, and documents of a group with
#: their sets, that are one part; parts meet two by two.
KEYS, WIDE_WORDS, MISSED, MANY, CELL, SET_CELL = 6, 16, 1e-4, 256, 2048, 1024
_TURNS = np.random.default_rng(42).integers(1, 1 << 63, WIDE_WORDS, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def wide_radii(similarity: float) -> np.ndarray:
    """Radius by the smaller number of shingles, up to MANY, and by how many the other text has more.

    The bits of two sets that share just enough differ by chance alone: a bit is the
    majority among the ones of common and own shingles, so its probability to differ is a
    sum of binomial ones, and the radius leaves MISSED of such pairs beyond it.  Row 0
    is for more than MANY shingles: the probability only nears acos(2 s / (1 + s)) / pi.
    """
    bits = 64 * WIDE_WORDS
    most = [int(n / similarity) for n in range(MANY + 1)]
    pmf = [np.array([math.comb(k, i) * 0.5**k for i in range(k + 1)]) for k in range(most[-1] + 1)]
    tail = [np.append(np.cumsum(p[::-1])[::-1], 0.0) for p in pmf]  # tail[k][i]: i or more of k
    at_bits = np.arange(bits + 1.0)
    ways = np.array([math.lgamma(bits + 1) - math.lgamma(i + 1) - math.lgamma(bits - i + 1) for i in range(bits + 1)])
    out = np.full((MANY + 1, most[-1] - MANY + 1), -1, np.int16)
    for n in range(1, MANY + 1):
        for m in range(n, most[n] + 1):
            both = next(c for c in range(int(similarity * (n + m) / (1 + similarity)), m + 2) if c >= similarity * (n + m - c))
            if both > n:
                continue
            at = np.arange(both + 1)
            x, y = (tail[k - both][np.clip(k // 2 + 1 - at, 0, k - both + 1)] for k in (n, m))
            p = min(max(float((pmf[both] * (x * (1 - y) + y * (1 - x))).sum()), 1e-300), 1 - 1e-16)
            beyond = np.cumsum(np.exp(ways + at_bits * math.log(p) + (bits - at_bits) * math.log1p(-p))[::-1])[::-1]
            out[n, m - n] = int((np.append(beyond[1:], 0.0) > MISSED).sum())
    out[0] = out[MANY // 2 :].max() + 1
    return out


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """WIDE_WORDS words of fingerprint of a set of shingle hashes."""
    ones = np.zeros(64 * WIDE_WORDS, np.int64)
    for i in range(0, len(h), 1 << 13):
        x = _mixed(h[i : i + (1 << 13), None] * _TURNS)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


class Forest:
    """A spanning forest of pairs of rows 0 .. n - 1; holds nothing for pairs whose ends are joined already."""

    def __init__(self, n: int):
        self.found, self.label = Union(n), np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def add(self, x: np.ndarray, y: np.ndarray, holds: Callable[[int, int], bool] | None = None) -> None:
        """Takes the pairs in turn; holds: says whether a pair whose ends are not joined yet is one."""
        apart = self.label[x] != self.label[y]
        before = len(self.edges)
        for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
            if self.found.find(i) != self.found.find(j) and (holds is None or holds(i, j)):
                self.found.join(i, j)
                self.edges.append((i, j))
        if len(self.edges) > before:
            self.label = np.array([self.found.find(i) for i in range(len(self.label))], np.int64)

    def rows(self, ids: np.ndarray) -> pa.RecordBatch:
        at = np.array(self.edges, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], names=["a", "b"])


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles; a text of fewer words is one shingle, one without words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(flat[a:b]) for a, b in zip(starts, ends.tolist()[min(shingle, len(words)) - 1 :], strict=False)], np.uint64))


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """Number of values that two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0


def sketches(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, row, s, t, n, m0 ..): of each text's shingle set two digests, its size and the smallest of KEYS hashes.

    row: a hash of the text, which tells apart rows that repeat an id.
    """
    names = ["s", "t", "n", *(f"m{k}" for k in range(KEYS))]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2).cast(pa.binary()):
                h = shingle_set(text.as_py() or b"", shingle)
                low = (h[:, None] * _TURNS[:KEYS]).min(axis=0) if len(h) else np.zeros(KEYS, np.uint64)
                rows.append(np.concatenate(([_mixed(h).sum(dtype=np.uint64), _mixed(h * _TURNS[-1]).sum(dtype=np.uint64), np.uint64(len(h))], low)))
            matrix = np.array(rows, np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(np.ascontiguousarray(c)) for c in matrix.T)], names=["id", "row", *names])

    plain = in_small_batches(df).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, "id long, row long, " + ", ".join(f"{n} long" for n in names))


def near_groups(df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(id, row, component_id) of each row: groups of texts whose shingle sets are that similar.

    Texts of equal sets are one from the start.  At such a similarity fingerprints differ
    in so many bits that triangle bounds close almost no side of a tree, and a top tree
    would send each fingerprint to most shards.  So here the smallest of ``KEYS`` hashes of
    the set lead to buckets: two sets of the similarity s have one in common but for
    (1 - s) ** KEYS of them.  A bucket's wide fingerprints are searched by a vantage-point
    tree within the radius of wide_radii, and the bucket hands on a spanning forest of what
    it finds; the forests' components hold all candidates for each other.

    Within a component the candidates are found again by the tree, nearest first, and
    verified on the whole shingle sets as long as their ends are not one group already;
    a task hands on a spanning forest of the verified pairs.  So rows that leave a task
    grow with the rows it reads, not with the pairs.  The work on a large group of texts
    that are alike but below the similarity still grows with the square of the group; it
    is dealt to cells: buckets of over ``CELL`` rows and components of over ``SET_CELL``
    documents are cut into parts that meet two by two.

    component_id is the least id of the group.  Rows of a null id belong to a group but
    never name it, unless all do.  Texts without words are one group.  Two sets that share
    a 64-bit digest (a second one tells) link with nothing.
    """
    radii = wide_radii(similarity)
    word = [f"w{i}" for i in range(WIDE_WORDS)]
    tables = Tables(df.sparkSession)
    prints = written(sketches(df, id_col, text_col, shingle), "sketches")
    mins = [F.min(f"m{k}").alias(f"m{k}") for k in range(KEYS)]
    each = tables.written(prints.groupBy("s").agg(F.min("id").alias("id"), F.min_by("row", "id").alias("row"), F.min("n").alias("n"), F.min("t").alias("t"), F.max("t").alias("t_max"), *mins), "distinct-sets")
    good = each.where("t = t_max AND n > 0 AND id IS NOT NULL")
    keyed = good.select("s", F.explode(F.array(*(F.xxhash64(F.lit(k), f"m{k}") for k in range(KEYS)))).alias("key"))
    sizes = tables.written(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "near-keys")
    met = tables.written(keyed.join(sizes, "key"), "near-buckets")

    @tidy
    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py() or b"", shingle) for t in batch.column(1).cast(pa.binary())]
            matrix = np.array([wide_fingerprint(h) for h in sets], np.uint64).reshape(-1, WIDE_WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary()), *(pa.array(np.ascontiguousarray(c)) for c in matrix.T)], names=["s", "n", "hashes", *word])

    asked = good.join(met.select("s").distinct(), "s", "left_semi").select("s", "id", "row")
    plain = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    texts = plain.join(asked, ["id", "row"]).select("s", "text").dropDuplicates(["s"])
    wide = tables.written(texts.mapInArrow(widen, "s long, n long, hashes binary, " + ", ".join(f"{w} long" for w in word)), "wide-fingerprints")

    def points_of(table: pa.Table) -> np.ndarray:
        return np.stack([table.column(w).to_numpy() for w in word], axis=1).view(np.uint64)

    def fitting(n: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of the pairs those within the radius of their numbers of shingles, nearest first."""
        for x, y, d in found:
            few, many = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            row = np.where(few > MANY, 0, few)
            fits = (few >= similarity * many) & (d <= radii[row, np.where(row, np.minimum(many - few, radii.shape[1] - 1), 0)])
            order = np.flatnonzero(fits)
            order = order[np.argsort(d[order], kind="stable")]
            yield x[order], y[order]

    def cells_of(table: pa.Table, group: str) -> Iterator[tuple[int, int, np.ndarray | None]]:
        """(from, to, rows that are searched) of each cell; None: all of them, and they are few."""
        cell = np.stack([table.column(c).to_numpy() for c in (group, "lo", "hi")])
        cuts = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), cell.shape[1]], strict=True):
            if cell[1, a] != cell[2, a]:
                yield a, b, table.column("part").to_numpy()[a:b] == cell[1, a]
            else:
                yield a, b, np.ones(b - a, bool) if b - a > OUTRIGHT else None

    reach = int(radii.max())

    @tidy
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["key", "lo", "hi"]):
            s, n, points = table.column("s").to_numpy(), table.column("n").to_numpy(), points_of(table)
            found, run = Forest(len(s)), np.full(len(s), -1)
            for k, (a, b, home) in enumerate(cells_of(table, "key")):
                if home is None:
                    run[a:b] = k
                    continue
                for x, y in fitting(n[a:b], pairs_within(points[a:b], home, reach)):
                    found.add(x + a, y + a)
            few = np.flatnonzero(run >= 0)
            for x, y in fitting(n[few], steps(points[few], run[few])):
                found.add(few[x], few[y])
            yield found.rows(s)

    @tidy
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["component", "lo", "hi"], 2_000):
            s, n, points = table.column("s").to_numpy(), table.column("n").to_numpy(), points_of(table)
            sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in table.column("hashes").combine_chunks()]
            found = Forest(len(s))

            def alike(i: int, j: int) -> bool:
                both = shared(sets[i], sets[j])  # noqa: B023  used within the turn
                return both >= similarity * (len(sets[i]) + len(sets[j]) - both)  # noqa: B023

            for a, b, home in cells_of(table, "component"):
                home = np.ones(b - a, bool) if home is None else home
                for x, y in fitting(n[a:b], pairs_within(points[a:b], home, reach)):
                    found.add(x + a, y + a, alike)
            yield found.rows(s)

    def in_cells(rows: DataFrame, group: str, most: int) -> DataFrame:
        """rows (group, s, size) dealt to cells: part, and the lesser and the greater part of the cell."""
        parts = rows.withColumn("parts", F.ceil(F.col("size") / most).cast("int"))
        parts = parts.withColumn("part", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return parts.select(group, "s", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))

    ordered = in_cells(met, "key", CELL).join(wide.drop("hashes"), "s").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    candidates = tables.written(components(ordered.mapInArrow(search, "a long, b long"), tables=tables), "near-candidates")
    sizes = candidates.groupBy("component").agg(F.count("*").alias("size"))
    members = in_cells(candidates.join(sizes, "component").select("component", F.col("node").alias("s"), "size"), "component", SET_CELL)
    ordered = members.join(wide, "s").repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
    tied = tables.written(components(ordered.mapInArrow(verify, "a long, b long"), tables=tables), "near-components")
    least = each.join(tied, each.s == tied.node).groupBy("component").agg(F.min("id").alias("least"))
    named = each.join(tied, each.s == tied.node, "left").join(least, "component", "left").select("s", "t", "t_max", F.coalesce("least", "id").alias("component_id"))
    # Sets that only share a digest stay by themselves.
    groups = written(named, "near-groups")
    tables.drop()
    return prints.join(groups.withColumnRenamed("t", "t_min"), "s").select("id", "row", F.when(F.col("t_min") == F.col("t_max"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def steps(points: np.ndarray, run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index arrays and distances of all pairs within runs, which are short and stand in order."""
    step = 1
    while True:
        x = np.flatnonzero(run[step:] == run[:-step]) if step < len(run) else np.zeros(0, np.int64)
        if not len(x):
            return
        yield x, x + step, distance(points[x], points[x + step])
        step += 1


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """df without the rows whose group has a smaller id; rows with a null id stay.

    Rows that repeat an id with different texts are judged each; extra columns may have any name.
    """
    i, row = unused(df, "_id", "_row")
    gone = near_groups(df, id_col, text_col, shingle, similarity).where("id <> component_id").select(F.col("id").alias(i), F.col("row").alias(row)).distinct()
    gone = written(gone, "near-copies")
    return df.join(gone, (F.col(id_col) == F.col(i)) & (F.xxhash64(text_col) == F.col(row)), "left_anti")
