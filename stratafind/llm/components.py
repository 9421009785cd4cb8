"""Connected components of an edge table, all in DataFrame operations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Workspace

#: Edges that one task may join (8 MB); beyond, all rounds are distributed.
ONE_TASK_EDGES = 500_000


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _stars(batches):
    """Union-find over the edges of one partition."""
    root: dict[int, int] = {}

    def find(x):
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_pydict({"node": pa.array(part, pa.int64()), "root": pa.array([find(x) for x in part], pa.int64())})


def connected_components(work: Workspace, edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, root): root is the smallest node reachable; nodes without edges are absent.

    Alternates two contractions: every node hands its larger neighbours, then its smaller
    ones, to the smallest neighbour it knows, which keeps components whole and ends with stars
    after about log(n) rounds. Each round aggregates with map-side combining and is cut by a
    table in the shared folder; only a count and a checksum reach the driver. An edge table
    whose counted size is within ONE_TASK_EDGES is joined by one task instead.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    if edges.count() <= ONE_TASK_EDGES:
        return edges.coalesce(1).mapInArrow(_stars, "node long, root long")
    now = work.keep(edges.distinct(), f"{label}-0")
    seen, turn = _signature(now), 0
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = work.keep(large, f"{label}-large-{turn}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = work.keep(small.select("e.a", "e.b").filter("a <> b").distinct(), f"{label}-{turn + 1}")
        work.drop(f"{label}-large-{turn}", f"{label}-{turn}")
        now, last = after, seen
        seen, turn = _signature(now), turn + 1
        if seen == last:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(now.select(F.col("b"), F.col("b")).distinct())
