"""Distributed union-find: connected components of a DataFrame of edges, without collecting any."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Edges that one task reduces to a forest at once; bounds its memory.
FOREST_EDGES = 400_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition: as many edges as it takes, each to the least node of its tree."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def trees() -> pa.RecordBatch:
        nodes = [x for x in parent if find(x) != x]
        return pa.record_batch([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 4 * FOREST_EDGES:  # a partition larger than planned is reduced in parts
            yield trees()
            parent.clear()
    yield trees()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges (a, b): component is the least id that it is linked to.

    Partitions of about FOREST_EDGES edges are reduced to forests, again and again while that removes
    a third of the edges at least.  As soon as one partition holds them all, its trees are the
    components.  Otherwise stars are contracted: each node's neighbours above it are linked to its
    least neighbour (large star), and its neighbours below it likewise (small star), until nothing
    changes.  Least neighbours are found by map-side aggregation, so a node with very many edges is no
    group in one task.
    """
    edges = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"), "edges")
    n, parts = edges.count(), 0
    while parts != 1:
        parts = max(1, -(-n // FOREST_EDGES))
        edges = cut(edges.repartition(parts).mapInArrow(_forest, "a long, b long"), "forest")
        n, before = edges.count(), n
        if n > 2 * before / 3:
            break
    before = None
    while parts > 1:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")  # written, so that a hot node's edges can be split
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large, "large")
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        edges = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
