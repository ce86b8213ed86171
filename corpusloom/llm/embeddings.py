"""Embedding near-dedup by sorted projection passes.

Each pass hashes a vector with random hyperplanes and orders the vectors of a label
lexicographically by the concatenated hash bits.  Close vectors agree in their first
bits, so they stand near each other in some pass: each vector is compared with the next
``window`` ones, in double precision, also over the borders of the sorted ranges.  The
verified pairs of all passes are united to components.

Exact copies are one vector with a weight, so they cost nothing.  Links are then counted
exactly inside components: small ones are taken one after another, of large ones blocks
meet two by two, and only counts leave a task.  That work grows with the square of a
component's distinct vectors, as the number of its links does where it is dense.

Recall: two vectors at cosine c agree in a hash bit with probability a = 1 - acos(c) / pi.
A pair is seen in a pass if it agrees in as many first bits, b, as leave half a window of
vectors of its label together.  b follows from how often a bounded sample agrees in its
first bits and from the size of the label, so crowded and large labels get more passes:
as many as leave ``MISSED`` of the pairs that no other vector connects, 1 - a ** b being
the chance to miss one in a pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.arrowtext import whole_runs
from corpusloom.llm.components import Union, components
from corpusloom.llm.shared import Tables, written

#: Bits of a code; vectors that each is compared with; members of a component that one task
#: counts; least passes; vectors of the sample; share of isolated pairs that all passes miss.
BITS, WINDOW, BLOCK, LEAST_PASSES, SAMPLE, MISSED = 60, 64, 1024, 8, 4096, 1e-4


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Unit rows in double precision; all of one size."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return _units(x)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hash_bits(x: np.ndarray, turn: int, bits: int = BITS) -> np.ndarray:
    """The concatenated hashes of one pass, most significant first."""
    planes = np.random.default_rng(1_000 + turn).standard_normal((x.shape[1], bits))
    return ((x @ planes > 0).astype(np.int64) << np.arange(bits - 1, -1, -1)).sum(axis=1)


def usable(vec: str) -> F.Column:
    """Not null, no null or non-finite component, not zero."""
    return F.col(vec).isNotNull() & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0)


def bits_needed(codes: np.ndarray, total: int, window: int) -> float:
    """First bits in which about ``window`` of ``total`` vectors agree, going by a sample's codes.

    Where the sample has too few agreeing pairs, the last rate per bit goes on.
    """
    n = len(codes)
    if total <= window or n < 2:
        return 0.0 if total <= window else math.log2(total / window)
    wanted, share = math.log2(window / total), []
    for b in range(BITS + 1):
        _, c = np.unique(codes >> (BITS - b), return_counts=True)
        pairs = float((c * (c - 1.0)).sum())
        if pairs < 60:
            break
        share.append(math.log2(pairs / (n * (n - 1.0))))
        if share[-1] <= wanted:
            return float(b)
    done = len(share) - 1
    rate = max((share[0] - share[-1]) / done, 0.05) if done > 0 else 1.0
    return done + max(0.0, share[-1] - wanted) / rate


def passes_needed(reps: DataFrame, least: float, window: int = WINDOW) -> int:
    """Passes that leave MISSED of isolated pairs of each label unseen."""
    sizes = {r.label: r.n for r in reps.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(64).collect()}  # the largest need most
    if not sizes:
        return LEAST_PASSES
    share = min(1.0, SAMPLE / sum(sizes.values()))
    rows = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("label", "vec").limit(2 * SAMPLE).collect()
    need = 0.0
    for label, total in sizes.items():
        by_size: dict[int, list] = {}
        for r in rows:
            if r.label == label:
                by_size.setdefault(len(r.vec), []).append(r.vec)
        most = max(by_size.values(), key=len, default=[])
        codes = hash_bits(_units(np.array(most, np.float64)), 0) if most else np.zeros(0, np.int64)
        need = max(need, bits_needed(codes, total, window // 2))
    agree = 1 - math.acos(least) / math.pi
    seen = min(agree**need, 0.999)
    return max(LEAST_PASSES, math.ceil(math.log(MISSED) / math.log(1 - seen)))


def near_in_window(x: np.ndarray, least: float, window: int) -> Iterator[tuple[np.ndarray, int]]:
    """(rows, step): rows that are near the row so many steps further on."""
    for step in range(1, min(window, len(x) - 1) + 1):
        yield np.flatnonzero(np.einsum("ij,ij->i", x[:-step], x[step:]) >= least), step


def candidate_links(reps: DataFrame, least: float, passes: int, window: int = WINDOW, tables: Tables | None = None) -> DataFrame:
    """(a, b): spanning forests of the pairs that the passes verify."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                rows = batch.take(pa.array(np.flatnonzero(sizes == size)))
                x = _matrix(rows.column(2), int(size))
                for turn in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), turn, np.int32)), *rows.columns, pa.array(hash_bits(x, turn))], names=["turn", *batch.schema.names, "code"])

    def links_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Ends of a forest of the near pairs of rows in order."""
        key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("turn", "label", "size")], axis=1)
        ids = table.column("rep").to_numpy()
        found = Union(len(ids))
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
            if b - a > 1:
                x = _matrix(table.column("vec").slice(a, b - a), int(key[a, 2]))
                for rows, step in near_in_window(x, least, window):
                    for i in rows.tolist():
                        found.join(a + i, a + i + step)
        root = np.array([found.find(i) for i in range(len(ids))], np.int64)
        tied = np.flatnonzero(root != np.arange(len(ids)))
        tied = tied[ids[tied] != ids[root[tied]]]
        return ids[tied], ids[root[tied]]

    kept = ["turn", "label", "size", "rep", "vec"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links inside of a range, and its first and last rows for the borders with the ranges beside it."""
        part, head, tail = TaskContext.get().partitionId(), None, None

        def edge(rows: pa.Table, border: int, first: int) -> pa.RecordBatch:
            rows = rows.select(kept).combine_chunks()
            columns = [rows.column(c).combine_chunks() for c in kept]
            n = rows.num_rows
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, border, np.int64)), pa.array(np.arange(first, first + n, dtype=np.int64)), *columns], schema=arrow)

        arrow = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if arrow is None:
                arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("border", pa.int64()), ("place", pa.int64()), *[batch.schema.field(c) for c in kept]])
                head = table.slice(0, 0)
            if head.num_rows < window:
                head = pa.concat_tables([head, table.slice(0, window - head.num_rows)])
            if tail is not None:
                table = pa.concat_tables([tail, table]).combine_chunks()
            a, b = links_of(table)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), f.type) for f in [*arrow][2:])], schema=arrow)
            tail = table.slice(max(0, table.num_rows - window))
        if tail is not None:
            yield edge(head, part - 1, window)
            yield edge(tail, part, 0)

    def over_border(table: pa.Table) -> pa.Table:
        a, b = links_of(table.sort_by("place"))
        return pa.table({"a": a, "b": b})

    plain = reps.select("rep", "label", "vec", F.size("vec").alias("size"))
    out = T.StructType([T.StructField("turn", T.IntegerType()), *plain.schema.fields, T.StructField("code", T.LongType())])
    coded = plain.mapInArrow(hashes, out)
    # Ranges of some windows at least, so that a window reaches over one border at most.
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(parts, reps.count() * passes // (8 * window)))
    order = ["turn", "label", "size", "code", "rep"]
    ordered = coded.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    numbers = [T.StructField(c, T.LongType()) for c in ("a", "b", "border", "place")]
    found = (tables or Tables(reps.sparkSession)).written(ordered.mapInArrow(compare, T.StructType([*numbers, *[out[c] for c in kept]])), "vector-candidates")
    borders = found.where("border IS NOT NULL").groupBy("border").applyInArrow(over_border, "a long, b long")
    return found.where("border IS NULL").select("a", "b").unionByName(borders)


def link_counts(members: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(rep, n): the weight of the vectors of its component that each vector links with.

    members: rep, label, vec, weight, component, n_members.  Components of up to ``block``
    members lie one after another in a task; rows of larger ones are dealt to cells, pairs
    of blocks of a component, so no task holds a whole large component.
    """

    def counted(x: np.ndarray, weight: np.ndarray, other: np.ndarray, more: np.ndarray, same: bool) -> np.ndarray:
        n = np.zeros(len(x), np.int64)
        for i in range(0, len(x), block):
            near = x[i : i + block] @ other.T >= least
            if same:
                at = np.arange(i, min(i + block, len(x)))
                near[at - i, at] = False
            n[i : i + block] = near @ more
        return n

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["component"], 2_000):
            component = table.column("component").to_numpy()
            cuts = np.flatnonzero(component[1:] != component[:-1]) + 1
            weight, n = table.column("weight").to_numpy(), np.zeros(len(component), np.int64)
            vec = table.column("vec").combine_chunks()
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(component)], strict=True):
                x = _matrix(vec.slice(a, b - a), len(vec[a]))
                n[a:b] = counted(x, weight[a:b], x, weight[a:b], True)
            yield pa.RecordBatch.from_arrays([table.column("rep").combine_chunks(), pa.array(n)], names=["rep", "n"])

    def meet(table: pa.Table) -> pa.Table:
        ids, weight, blocks = (table.column(c).to_numpy() for c in ("rep", "weight", "blk"))
        vec = table.column("vec").combine_chunks()
        x = _matrix(vec, len(vec[0]))
        i, j = int(table.column("i")[0].as_py()), int(table.column("j")[0].as_py())
        if i == j:
            return pa.table({"rep": ids, "n": counted(x, weight, x, weight, True)})
        n, a, b = np.zeros(len(ids), np.int64), np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
        n[a], n[b] = counted(x[a], weight[a], x[b], weight[b], False), counted(x[b], weight[b], x[a], weight[a], False)
        return pa.table({"rep": ids, "n": n})

    few = members.where(F.col("n_members") <= block).select("component", "rep", "vec", "weight").repartition("component").sortWithinPartitions("component")
    total = F.ceil(F.col("n_members") / block).cast("int")
    placed = members.where(F.col("n_members") > block).withColumn("blocks", total).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("rep", "vec", "weight", "blk", "component", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"))
    many = cells.groupBy("component", "i", "j").applyInArrow(meet, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    return few.mapInArrow(small, "rep long, n long").unionByName(many)


def dedup(df: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """(id, n_links, component_id, kept) of each row; passes: None takes as many as passes_needed() says.

    Vectors that are null, zero, or hold null or non-finite components, and those with a
    null label, link with nothing: a component each.  Vectors of different lengths never
    link.  Equal vectors of a label are linked with each other, rows with equal ids too.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).cast("long").alias("label"))
    good = F.coalesce(F.col("label").isNotNull() & F.col("id").isNotNull() & usable("vec"), F.lit(False))
    valid = rows.where(good)
    tables = Tables(df.sparkSession)
    reps = tables.written(valid.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "vectors")
    found = candidate_links(reps, least, passes or passes_needed(reps, least, window), window, tables)
    tied = tables.written(components(found, tables=tables), "vector-components")
    sizes = tied.groupBy("component").agg(F.count("*").alias("n_members"))
    members = reps.join(tied, reps.rep == tied.node).join(sizes, "component").select("rep", "label", "vec", "weight", "component", "n_members")
    counts = link_counts(tables.written(members, "component-vectors"), least)
    known = written(
        reps.join(tied.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left").select("label", "vec", "weight", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "rep").alias("component_id")),
        "vector-groups",
    )
    tables.drop()
    linked = valid.join(known, ["label", "vec"]).select("id", (F.col("weight") - 1 + F.col("n")).alias("n_links"), "component_id")
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = linked.unionByName(alone)
    return every.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
