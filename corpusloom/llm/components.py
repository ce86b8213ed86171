"""Connected components by alternating large-star and small-star rounds.

Every round is one job over the edge table; the edges of the next round are a table in
the shared folder, so lineage stays short and nothing but two numbers a round comes to
the driver.  Nodes with very many edges are looked up by a broadcast of at most
``HOT_NODES`` rows, which the threshold on their degree guarantees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import Tables, remove, written

#: At most so many nodes can have more edges than 1 / HOT_NODES of all.
HOT_NODES, HOT_DEGREE = 4096, 256


def _with_least(pairs: DataFrame, total: int) -> DataFrame:
    """(u, v, m): m is the least of u and all its partners v."""
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    border = max(HOT_DEGREE, total // HOT_NODES)
    hot = least.where(F.col("n") > border).select("u", F.col("m").alias("hot_m"))
    looked = pairs.join(F.broadcast(hot), "u", "left")
    cold = looked.where("hot_m IS NULL").drop("hot_m").join(least.where(F.col("n") <= border).drop("n"), "u")
    return cold.unionByName(looked.where("hot_m IS NOT NULL").withColumnRenamed("hot_m", "m"))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50, tables: Tables | None = None) -> DataFrame:
    """(node, component) of every node with an edge to another; component is its least reachable node.

    Edges may repeat and point either way; those with a null end or from a node to
    itself say nothing.  A table without edges gives no rows.  tables: gets the last
    round's table, which the result reads.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    found = ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    keep = tables or Tables(edges.sparkSession)
    now = keep.written(found, "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _with_least(both, 2 * state[0]).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges-large")
        least = _with_least(large, state[0])
        small = least.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = keep.written(small, "edges")
        then, state = state, _state(after)
        remove(after.sparkSession, large)
        remove(after.sparkSession, now)
        now = after
        if state == then:
            break
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class Union:
    """Union-find over numbers 0 .. n - 1, for what one task holds."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
