"""Vectors: algebra on sparse map columns and exact top-k by inner product or cosine."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Queries of at most this size go to every task.
QUERY_BYTES = 48 << 20
#: Vectors (or sixteenths of their components) that a task holds at a time.
SHARD_ROWS = 32768
#: Vectors and queries whose scores are held at a time.
_ROWS, _QUERIES = 4096, 128

#: A sparse vector is a map<int, double>; a dense one an array.


def from_dense(v: Column) -> Column:
    """The non-zero components of an array."""
    entries = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("key"), x.cast("double").alias("value"))), lambda e: e["value"] != 0)
    return F.map_from_entries(entries)


def to_dense(v: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(v, i), F.lit(0.0)))


def _total(values: Column, start: float = 0.0) -> Column:
    return F.aggregate(values, F.lit(start), lambda a, x: a + x)


def get(v: Column, dim: int) -> Column:
    return F.coalesce(F.try_element_at(v, F.lit(dim)), F.lit(0.0))


def contains(v: Column, dim: int) -> Column:
    return F.map_contains_key(v, dim)


def set_value(v: Column, dim: int, value: float) -> Column:
    return F.map_concat(F.map_filter(v, lambda k, _: k != dim), F.create_map(F.lit(dim), F.lit(float(value))))


def sum_of(v: Column) -> Column:
    return _total(F.map_values(v))


def norm1(v: Column) -> Column:
    return _total(F.transform(F.map_values(v), F.abs))


def norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(F.map_values(v), lambda x: x * x)))


def dot(a: Column, b: Column) -> Column:
    return _total(F.transform(F.map_entries(a), lambda e: e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0))))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def scale(v: Column, factor: float) -> Column:
    return F.transform_values(v, lambda _, x: x * factor)


def normalize(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform_values(v, lambda _, x: x / n)).otherwise(v)


def add(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def _by_weight(v: Column) -> Column:
    """Entries, greatest absolute value first, ties by dimension."""
    keyed = F.transform(F.map_entries(v), lambda e: F.struct((-F.abs(e["value"])).alias("w"), e["key"].alias("key"), e["value"].alias("value")))
    return F.array_sort(keyed)


def _as_map(entries: Column) -> Column:
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def prune_top_k(v: Column, k: int) -> Column:
    return _as_map(F.slice(_by_weight(v), F.lit(1), F.lit(k)))


def prune_by_threshold(v: Column, least: float) -> Column:
    return F.map_filter(v, lambda _, x: F.abs(x) >= least)


def prune_by_mass(v: Column, alpha: float) -> Column:
    """The fewest entries, greatest first, that hold alpha of the absolute mass."""
    entries, whole = _by_weight(v), norm1(v)
    before = lambda i: _total(F.transform(F.slice(entries, F.lit(1), i), lambda e: -e["w"]))
    return _as_map(F.filter(entries, lambda e, i: before(i) < alpha * whole - 1e-12))


class _Postings:
    """Rows of a block of vectors, by dimension: of each dimension, which rows have it and their values."""

    def __init__(self, rows: np.ndarray, dims: np.ndarray, values: np.ndarray, n: int) -> None:
        order = np.argsort(dims, kind="stable")
        self.n, self.rows, self.values = n, rows[order], values[order]
        self.dims, starts = np.unique(dims[order], return_index=True)
        self.bounds = np.append(starts, dims.size)
        self.least = values.min() if values.size else 0.0

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.bounds[i], self.bounds[i + 1])
        return self.rows[at], self.values[at]


def _blocks(dims: pa.Array, values: pa.Array, step: int, order: np.ndarray | None = None) -> list[tuple[int, _Postings]]:
    """(first row, postings) of each step rows, in the given order of the rows."""
    n, d, v = len(dims), dims.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(n), np.diff(dims.offsets.to_numpy()))
    if order is not None:
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        rows = place[rows]
    by_row = np.argsort(rows, kind="stable")
    rows, d, v = rows[by_row], d[by_row], v[by_row]
    edges = np.searchsorted(rows, np.arange(0, n + step, step))
    return [(i * step, _Postings(rows[a:b] - i * step, d[a:b], v[a:b], min(step, n - i * step))) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]


def _best(own: _Postings, asked: _Postings, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows of each query, ties to the earlier row, among those that share a dimension
    with it.  Products are added one dimension after another, so equal vectors get equal scores."""
    scores = np.zeros((asked.n, own.n))
    met = None if own.least * asked.least > 0 and own.least > 0 else np.zeros(scores.shape, bool)
    _, mine, theirs = np.intersect1d(own.dims, asked.dims, assume_unique=True, return_indices=True)
    for i, j in zip(mine, theirs, strict=True):
        (rows, x), (q, w) = own.of(i), asked.of(j)
        cells = np.ix_(q, rows)
        scores[cells] += w[:, None] * x
        if met is not None:
            met[cells] = True
    met = scores > 0 if met is None else met
    # as in Spark, NaN is the greatest
    key = np.where(met, np.nan_to_num(scores, nan=np.inf, posinf=np.finfo(float).max, neginf=np.finfo(float).min), -np.inf)
    least = np.partition(key, own.n - k, axis=1)[:, own.n - k, None] if k < own.n else -np.inf
    q, rows = np.nonzero(met & (key >= least))
    return _first(q, rows, scores[q, rows], key[q, rows], k)[:3]


def _first(q: np.ndarray, rows: np.ndarray, scores: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((rows, -key, q))
    q, rows, scores, key = q[order], rows[order], scores[order], key[order]
    keep = np.arange(q.size) - np.searchsorted(q, q) < k
    return q[keep], rows[keep], scores[keep], key[keep]


def _search(own: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The k best rows of own for each row of asked; both have id, dims and values."""
    own, asked = own.combine_chunks(), asked.combine_chunks()
    flat = lambda t, c: t.column(c).chunk(0) if t.num_rows else pa.array([], t.schema.field(c).type)
    order = pc.sort_indices(own.select(["id"]), sort_keys=[("id", "ascending")], null_placement="at_start").to_numpy()
    mine = _blocks(flat(own, "dims"), flat(own, "values"), _ROWS, order)
    found = []
    for q0, theirs in _blocks(flat(asked, "dims"), flat(asked, "values"), _QUERIES):
        parts = [(q, rows + at, s) for at, block in mine for q, rows, s in [_best(block, theirs, k)]]
        q, rows, s = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        key = np.nan_to_num(s, nan=np.inf, posinf=np.finfo(float).max, neginf=np.finfo(float).min)
        q, rows, s, _ = _first(q, rows, s, key, k)
        found.append((q + q0, order[rows], s))
    q, rows, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return pa.table({"query_id": asked.column("id").take(pa.array(q)), "id": own.column("id").take(pa.array(rows)), "score": pa.array(s, pa.float64())})


def top_k_sparse(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector", alpha: float | None = None, similarity: str = "dot") -> DataFrame:
    """(query_id, id, score, rank): exact inner products through postings, of the rows that share a dimension with a query.

    Every task has blocks of vectors and all queries, and only each block's k best rows of a query are shuffled, never
    the scores; queries beyond QUERY_BYTES meet the vectors in cells of the two.  Components that are null count as
    absent; rows that repeat an id are rows of their own.  alpha prunes the queries to that share of their mass first,
    which makes the result approximate.
    """
    own = F.col(vector_col)
    query = prune_by_mass(own, alpha) if alpha is not None and alpha < 1 else own
    if similarity == "cosine":
        own, query = normalize(own), normalize(query)

    def plain(df: DataFrame, v: Column) -> DataFrame:
        entries = df.select(F.col(id_col).alias("id"), F.filter(F.map_entries(v), lambda e: e["value"].isNotNull()).alias("e")).where(F.size("e") > 0)
        return entries.select("id", F.col("e.key").cast("array<long>").alias("dims"), F.col("e.value").cast("array<double>").alias("values"))

    rows, asked = plain(vectors, own), plain(queries, query)
    n, entries = asked.agg(F.count(F.lit(1)), F.sum(F.size("dims"))).first()
    spark = vectors.sparkSession
    schema = StructType([StructField("query_id", asked.schema["id"].dataType), StructField("id", rows.schema["id"].dataType), StructField("score", DoubleType())])
    if 16 * ((entries or 0) + n) <= QUERY_BYTES:
        table = asked.toArrow()

        def near(batches):
            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.num_rows + len(batch.column(1).flatten()) // 16
                if size >= SHARD_ROWS:
                    yield from _search(pa.Table.from_batches(held), table, k).to_batches()
                    held, size = [], 0
            if held:
                yield from _search(pa.Table.from_batches(held), table, k).to_batches()

        found = rows.repartition(2 * spark.sparkContext.defaultParallelism).mapInArrow(near, schema)
    else:
        shards, blocks = -(-rows.count() // SHARD_ROWS) or 1, -(-16 * (entries + n) // QUERY_BYTES)
        deal = lambda of: F.pmod(F.xxhash64("id"), F.lit(of)).cast("int")
        each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
        here = rows.withColumn("shard", deal(shards)).withColumn("block", each(blocks))
        there = asked.withColumn("block", deal(blocks)).withColumn("shard", each(shards))
        found = here.groupBy("shard", "block").cogroup(there.groupBy("shard", "block")).applyInArrow(lambda a, b: _search(a, b, k), schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")  # Spark keeps k rows of a group before it shuffles
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def dense_dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def nearest(df: DataFrame, query: list[float], k: int, id_col: str, vector_col: str, similarity: str = "cosine") -> DataFrame:
    """(id, score) of the k rows nearest to one dense query; one scan and a top-k, no shuffle of rows."""
    v = F.col(vector_col)
    q = F.array(*(F.lit(float(x)) for x in query))
    score = dense_dot(v, q)
    if similarity == "cosine":
        length = reduce(lambda a, b: a + b, (float(x) ** 2 for x in query), 0.0) ** 0.5
        score = F.try_divide(score, F.sqrt(dense_dot(v, v)) * F.lit(length))
    return df.select(F.col(id_col), score.alias("score")).orderBy(F.desc_nulls_last("score"), id_col).limit(k)
