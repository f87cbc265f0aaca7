"""Exact top-k search by inner product with Fagin's threshold algorithm.

Candidates are dealt into shards of bounded size.  A shard holds, for each dimension, its vectors
sorted by that component; a query reads the lists from the end that its own sign prefers, a block of
ranks at a time, scores what it meets for the first time, and stops when the bound (the query's
product with the components at the current ranks) cannot beat its kth score.  Queries meet a shard
in blocks.  Each shard gives a query at most k rows, and the best k of all shards are its result.

Defined results: vectors that are null or empty, or of another dimension than most, or hold a null or
non-finite component take no part; ties go to the smaller id; a query's own row (same id) is no
candidate of its own; a row that repeats another's id and vector is a candidate like any other, and a
query that is repeated is asked once; sums are exact as long as they stay below 2 ** 53; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT_BYTES, cut, table

SHARD_ROWS = 8192
QUERY_BLOCK = 1024
#: Ranks that are read from every list before the bound is tested.
DEPTH = 64


class SortedLists:
    """A shard's vectors and, per dimension, their order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.order = np.argsort(self.vectors, axis=0, kind="stable").T.copy()
        self.sorted = np.sort(self.vectors, axis=0).T.copy()

    def top(self, query_id: int, query: np.ndarray, k: int, depth: int = DEPTH) -> list[tuple[int, float]]:
        """The k best (id, score), best first, ties to the smaller id."""
        n, d = self.vectors.shape
        up = query < 0  # there the least components come first
        dims = np.flatnonzero(query)
        seen = np.zeros(n, dtype=bool)
        seen[np.searchsorted(self.ids, query_id) : np.searchsorted(self.ids, query_id, side="right")] = True
        best_ids, best = np.empty(0, np.int64), np.empty(0)
        at, step = 0, depth
        while True:
            to = min(n, at + step)
            if dims.size:
                rows = np.concatenate([self.order[i, at:to] if up[i] else self.order[i, n - to : n - at] for i in dims])
                rows = np.unique(rows[~seen[rows]])
            else:
                rows, to = np.flatnonzero(~seen), n
            seen[rows] = True
            scores = np.concatenate([best, self.vectors[rows] @ query])
            ids = np.concatenate([best_ids, self.ids[rows]])
            keep = np.lexsort((ids, -scores))[:k]
            best_ids, best = ids[keep], scores[keep]
            if to == n or seen.all():
                break
            edge = np.where(up, self.sorted[:, to - 1], self.sorted[:, n - to])
            # an unseen vector with exactly the bound could have a smaller id, so equality goes on
            if best.size == k and edge @ query < best[-1]:
                break
            at, step = to, step * 2
        return list(zip(best_ids.tolist(), best.tolist(), strict=True))


def top_k(candidates: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, id, score) of the k candidates with the highest inner products per query.

    Both sides hold a long id and an array<double>; a candidate with the query's id is left out.
    """
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    rows = cut(clean(candidates), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    d, n = sizes[0]["d"], sizes[0]["n"]
    shards = -(-n // SHARD_ROWS)
    rows = rows.where(F.size("v") == d)
    asked = cut(clean(queries).distinct().where(F.size("v") == d), "queries")
    n_asked = asked.count()

    def search(ids, vectors, ask_ids, ask):
        lists = SortedLists(ids, vectors)
        found = [(q, *x) for q, v in zip(ask_ids.tolist(), ask, strict=True) for x in lists.top(q, v, k)]
        if found:
            q, i, s = zip(*found, strict=True)
            yield pa.record_batch([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "id", "score"])

    def matrix(column):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

    schema = "query_id long, id long, score double"
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    if n_asked * (8 * d + 16) <= BROADCAST_LIMIT_BYTES:
        block = asked.toArrow() if n_asked else None
        if block is None:
            return rows.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
        ask_ids, ask = block.column("id").to_numpy(), matrix(block.column("v"))

        def near(batches):
            held: dict[int, list] = {}
            for batch in batches:
                ids, vectors, shard = batch.column(0).to_numpy(), matrix(batch.column(1)), batch.column(2).to_numpy()
                for s in np.unique(shard):
                    held.setdefault(int(s), []).append((ids[shard == s], vectors[shard == s]))
                # rows come sorted by shard: all but the last one are complete
                for s in [x for x in held if x != shard[-1]]:
                    yield from search(*(np.concatenate(x) for x in zip(*held.pop(s), strict=True)), ask_ids, ask)
            for own in held.values():
                yield from search(*(np.concatenate(x) for x in zip(*own, strict=True)), ask_ids, ask)

        found = dealt.select("id", "v", "shard").repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(near, schema)
    else:  # more queries than may be broadcast: each block of them goes to each shard
        blocks = -(-n_asked // QUERY_BLOCK)
        to = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        cells = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def cell(left: pa.Table, right: pa.Table) -> pa.Table:
            if left.num_rows and right.num_rows:
                got = list(search(left.column("id").to_numpy(), matrix(left.column("v")), right.column("id").to_numpy(), matrix(right.column("v"))))
                if got:
                    return pa.Table.from_batches(got)
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

        found = cells.groupBy("shard", "block").cogroup(to.groupBy("shard", "block")).applyInArrow(cell, schema)
    # each shard gave at most k rows a query; only those meet
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op6_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    vectors = usable.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("vector"))
    found = top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("score").cast("long").alias("score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
