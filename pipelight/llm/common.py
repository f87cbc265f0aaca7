"""Helpers that all training-data operators share.

Every operator takes a DataFrame and the names of its columns, selects only those, and so is
indifferent to any further columns and their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialize as cut

__all__ = ["cut", "keyed", "lean", "small", "table"]

#: A side whose estimated size is at most this is broadcast; beyond it the join is shuffled.
BROADCAST_LIMIT_BYTES = 48 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], most: int = 4 << 20) -> Callable:
    """run for mapInArrow, fed with slices of about `most` bytes: a worker then holds, and sends on, no
    more than what comes of one slice, however long the rows of a batch are."""

    @wraps(run)
    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                step = max(1, batch.num_rows * most // max(1, batch.nbytes))
                for at in range(0, batch.num_rows, step):
                    yield batch.slice(at, step)
                pa.default_memory_pool().release_unused()

        yield from run(pieces())

    return sliced


def small(df: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """df with a broadcast hint if rows * bytes_per_row is within the limit, else df as it is."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_LIMIT_BYTES else df


def keyed(docs: DataFrame, id_col: str, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """(key, id, text[, rest]) with a unique, non-null long key whose order is the order of the ids.

    Whole ids that are unique and not null are their own keys.  Otherwise rows are sorted by id (null
    first) and text, and the key is their rank: every row is kept, and rows that repeat an id, or an
    id and a text, are documents of their own.  Null texts become empty.  rest is a struct of the
    columns named in keep, if there are any.
    """
    rest = [F.struct(*(F.col(f"`{c}`") for c in keep)).alias("rest")] if keep else []
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *rest)
    names = [c for c in own.columns if c != "id"]
    if dict(own.dtypes)["id"] in ("bigint", "int", "smallint", "tinyint"):
        most, null = own.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.max(F.col("id").isNull())).first()
        if most in (None, 1) and not null:
            return own.select(F.col("id").cast("long").alias("key"), "id", *names)
    ranked = own.sort("id", "text").withColumn("key", F.monotonically_increasing_id())
    return cut(ranked.select("key", "id", *names), "keyed")
