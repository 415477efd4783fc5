"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import cut

#: Edges that one task of a round takes, and the fewest tasks that a round is cut into.
EDGES_PER_TASK = 100_000
LEAST_TASKS = 16
#: Nodes that a task holds while it shortens its own edges; then it writes them and starts anew.
FOREST_NODES = 500_000


def _forest(edges: DataFrame) -> DataFrame:
    """(a, b): each node of a task's own edges with the least node that these edges reach.

    Keeps what is connected, writes a row per node and task, and needs no shuffle. Nodes that
    reach nothing less come with themselves, so every node stays.
    """

    def rows(above):
        for x in above:
            while above[above[x]] != above[x]:
                above[x] = above[above[x]]
        return pa.RecordBatch.from_arrays([pa.array(above.keys(), pa.int64()), pa.array(above.values(), pa.int64())], names=["a", "b"])

    def run(batches):
        above = {}

        def root(x):
            while (up := above.setdefault(x, x)) != x:
                above[x] = x = above[up]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                above[max(a, b)] = min(a, b)
            if len(above) >= FOREST_NODES:
                yield rows(above)
                above.clear()
        if above:
            yield rows(above)

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the least one; at most one row per edge."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reachable.

    Every task first shortens its own edges to a forest. Each round after that cuts the lineage, so
    a lost executor repeats one round at most; all steps are aggregates with a map-side combine and
    joins that AQE can split. Rounds over few edges write few shuffle and checkpoint files: their
    tasks follow the number of edges. Self-loops and repeated edges do no harm; an empty table gives
    an empty table.
    """
    first = cut(_forest(edges))
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    apart = first.where("a != b")
    few = lambda df, n: df.coalesce(max(LEAST_TASKS, n // EDGES_PER_TASK + 1))
    now = cut(_forest(few(apart, apart.count())).where("a != b"))
    before = mark(now)
    while before[0]:
        n = before[0]
        now = cut(few(_small_star(few(_large_star(few(now, n)), n)), n))
        after = mark(now)
        if after == before:
            break
        before = after
    nodes = first.select(F.col("a").alias("node")).distinct()
    roots = now.groupBy("a").agg(F.min("b").alias("component"))
    return (
        nodes.join(roots, F.col("node") == F.col("a"), "left")
        .select("node", F.coalesce("component", "node").alias("component"))
    )
