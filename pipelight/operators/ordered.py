"""Operators that follow a global order of rows, without gathering all rows in one task.

Rows are range-partitioned by the order and written once; a partition's rows are numbered by a
window within it, and the partitions' counts (as many rows as there are partitions) give each its
offset.  Frames over the global order are then evaluated in blocks of consecutive rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, DateType, DoubleType, FloatType, IntegralType, NumericType, StringType, TimestampNTZType, TimestampType

from ..sources.scratch import materialize

#: Rows of a block that one task's window holds.
BLOCK_ROWS = 100_000
ROW = "__row"


def sort_columns(order: list[tuple[str, bool]]) -> list[Column]:
    """Nulls are first ascending and last descending."""
    return [F.col(f"`{n}`").asc_nulls_first() if up else F.col(f"`{n}`").desc_nulls_last() for n, up in order]


def falling(x: Column, kind: DataType) -> Column:
    """A value that rises as x falls, nulls last: so that the least and the greatest can tell the first and
    the last row of a descending order."""
    if isinstance(kind, BooleanType):
        turned = ~x
    elif isinstance(kind, (FloatType, DoubleType)):
        turned = F.struct(~F.isnan(x), -x)  # nan is the greatest
    elif isinstance(kind, IntegralType):
        turned = F.bitwise_not(x)  # unlike -x, there is one for the least
    elif isinstance(kind, NumericType):
        turned = -x
    elif isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        turned = F.lit("1970-01-01").cast(kind) - x
    else:
        text = x if isinstance(kind, (StringType, BinaryType)) else F.to_json(F.struct(x.alias("x")))
        turned = F.concat(F.translate(F.hex(text), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))
    return F.struct(x.isNull(), turned)


def numbered(df: DataFrame, order: list[tuple[str, bool]], name: str = ROW) -> DataFrame:
    """df with its rows' places in the order, from 0."""
    dealt = df.repartitionByRange(*sort_columns(order)).withColumn("__part", F.spark_partition_id())
    dealt = materialize(dealt, "ordered")
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    within = Window.partitionBy("__part").orderBy(*sort_columns(order))
    own = dealt.withColumn("__at", F.row_number().over(within) - 1)
    return own.join(F.broadcast(before), "__part").withColumn(name, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


def framed(df: DataFrame, order: list[tuple[str, bool]], columns: dict[str, Callable[[Window], Column]], back: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """columns evaluated over frames that reach at most `back` rows before a row, in the global order
    or, with keys, within the rows of a key.

    Blocks of consecutive rows get the last `back` rows of the block before them as well.  Rows are
    put in the order of the keys first, so a key with very many rows takes many blocks.
    """
    size = max(BLOCK_ROWS, 4 * back)
    rows = materialize(numbered(df, [*((k, True) for k in keys), *order]), "numbered").withColumn("__block", F.floor(F.col(ROW) / size))
    reach = (F.col(ROW) % size >= size - back) if back else F.lit(False)
    dealt = rows.withColumn("__to", F.explode(F.when(reach, F.array(F.col("__block"), F.col("__block") + 1)).otherwise(F.array("__block"))))
    window = Window.partitionBy("__to", *(F.col(f"`{k}`") for k in keys)).orderBy(ROW)
    for name, build in columns.items():
        dealt = dealt.withColumn(name, build(window))
    return dealt.where(F.col("__to") == F.col("__block")).drop("__to", "__block", ROW)


def running(df: DataFrame, order: list[tuple[str, bool]], totals: dict[str, tuple[str, Column]], current: bool, keys: tuple[str, ...] = ()) -> DataFrame:
    """Running aggregates from the first row, or from a key's first row.

    totals: column -> (sum, count, min or max; input).  Each block has a running aggregate of its
    own; blocks' totals, one row for each block (and key in it), are accumulated and combined.
    """
    rows = materialize(numbered(df, [*((k, True) for k in keys), *order]), "numbered").withColumn("__block", F.floor(F.col(ROW) / BLOCK_ROWS))
    functions = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    own = [F.col(f"`{k}`") for k in keys]
    inner = Window.partitionBy("__block", *own).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    names = [f"__g{i}" for i in range(len(keys))]
    blocks = rows.groupBy("__block", *(c.alias(n) for c, n in zip(own, names, strict=True))).agg(*(functions[kind](x).alias(f"__t_{name}") for name, (kind, x) in totals.items()))
    outer = (Window.partitionBy(*names) if names else Window.partitionBy()).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("__block").alias("__of"), *names, *((F.sum if kind == "count" else functions[kind])(f"__t_{name}").over(outer).alias(f"__b_{name}") for name, (kind, _) in totals.items()))
    for name, (kind, x) in totals.items():
        rows = rows.withColumn(f"__r_{name}", functions[kind](x).over(inner))
    on = F.col("__block") == F.col("__of")
    for c, n in zip(own, names, strict=True):
        on = on & c.eqNullSafe(F.col(n))
    rows = rows.join(blocks, on)
    for name, (kind, _) in totals.items():
        a, b = F.col(f"__r_{name}"), F.col(f"__b_{name}")
        if kind in ("sum", "count"):
            both = F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
        else:
            both = F.least(a, b) if kind == "min" else F.greatest(a, b)
        rows = rows.withColumn(name, both)
    return rows.drop("__block", "__of", ROW, *names, *(f"__{p}_{name}" for p in "rb" for name in totals))
