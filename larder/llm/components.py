"""Connected components of an edge table, by alternating large-star and small-star (Kiveris et al.).

Each task first makes a forest of its own edges; then each round is two grouped minima and two joins, written to the shared folder. No table of edges,
nodes or components comes to the driver: it sees one answer a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.storage import cut


#: Edges of a task of forest(); keys among which a component's nodes are dealt.
PER_TASK, SALTS = 500_000, 16


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of each partition -> an equivalent forest of stars on the smallest node."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        top = v
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[v] != top:
            parent[v], v = top, parent[v]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    pairs = [(top, v) for v in parent if (top := root(v)) != v]
    yield pa.record_batch([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of every node of edges (a, b: long, not null).

    Nodes without an edge to another node don't appear. An empty table gives none. Edges are dealt to
    tasks of PER_TASK; where one task is enough, its forest is the answer.
    """
    apart = edges.select("a", "b").where("a <> b")
    tasks = -(-apart.count() // PER_TASK)
    now = cut(apart.repartition(max(1, tasks)).mapInArrow(forest, "a long, b long"), "edges")
    while tasks > 1:
        now = now.distinct()
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        down = large.join(lowest, "b")
        small = down.select(F.col("m").alias("a"), "b").union(down.select(F.col("m").alias("a"), F.col("a").alias("b")))
        now = cut(small.where("a < b").distinct(), "edges")
        # Stars are left once each node is either a centre or has one edge to a centre.
        ends = now.select(F.col("b").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(now.select("a", F.lit(0), F.lit(1)))
        open_nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below + above > 1")
        if open_nodes.isEmpty():
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a").distinct())


def smallest_names(components: DataFrame, names: DataFrame) -> DataFrame:
    """node, name: the smallest name in the component of each node of components (node, component); names: node, name.

    The minimum combines before the shuffle; a component's nodes are dealt to SALTS keys to meet it, so a
    large one isn't one task's work.
    """
    named = components.join(names, "node")
    least = named.groupBy("component").agg(F.min("name").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = named.select("node", "component", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
    return dealt.join(least, ["component", "salt"]).select("node", F.col("least").alias("name"))
