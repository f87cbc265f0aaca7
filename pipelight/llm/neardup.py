"""Exact links among items that banded signatures brought together.

Items that share a bucket, directly or through others, form a cluster.  Items are compared exactly,
as sets of 64-bit elements, within cells of bounded size; a cell is a matrix in one task's memory and
gives the links of a spanning forest, so pairs are never emitted.

* A cluster of up to CELL items is one cell: all of its pairs are compared.
* A larger one has a hub, the item that is the pivot of the most places in buckets.  Its items are dealt
  into cells at random, each with the hub in it.  In a group of near copies nearly everything links
  to the hub here, and the work is linear in the group.
* What is not in a component of CELL items or more by then is loose: it is dealt into new cells, each with
  the likeliest of the loose as a hub, again and again while that joins a third of it at least.  So the other
  groups of near copies in a cluster become components too, at a cost that is linear in them.
* What is still loose is then compared, block against block, with the rest of its cluster or, where that is
  less work, with the rest of its buckets only.  Large components meet one another in the buckets that they
  share; items of one large component never meet again.  Blocks that the triangle inequality rules out are skipped: Jaccard distance
  is a metric, so items whose distances from the hub differ by more than 1 - threshold aren't similar.

So every two items that share a bucket are compared unless they are linked already or ruled out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean
from .components import connected_components

#: Items of a cell.
CELL = 512
#: Items of a cell up to which pairs are compared one by one.
FEW = 8
#: Elements that a cell's matrix has at once.
COLUMNS = 4096
#: By so much a ring around a hub is wider than 1 - threshold: then only neighbouring rings hold similar items.
_MARGIN = 1e-3


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of left with each of right."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    if not left or not right:
        return out
    if len(left) * len(right) <= 4:
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                out[i, j] = a.size if a is b else np.intersect1d(a, b, assume_unique=True).size
        return out
    if left is right:  # elements of a single item only count for itself
        values, many = np.unique(np.concatenate(left), return_counts=True)
        shared = values[many > 1]
    else:
        shared = np.intersect1d(np.concatenate(left), np.concatenate(right))  # only these count

    def placed(sets):
        """Item and place among shared of each shared element, by place."""
        elements, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [x.size for x in sets])
        at = np.searchsorted(shared, elements)
        inside = at < shared.size
        inside[inside] = shared[at[inside]] == elements[inside]
        of, at = of[inside], at[inside]
        order = np.argsort(at, kind="stable")
        return of[order], at[order]

    def matrix(sets, of, at, start):
        i, j = np.searchsorted(at, [start, start + COLUMNS])
        found = np.zeros((len(sets), min(COLUMNS, shared.size - start)), dtype=np.float32)
        found[of[i:j], at[i:j] - start] = 1
        return found

    own = placed(left)
    others = own if left is right else placed(right)
    for start in range(0, shared.size, COLUMNS):
        x = matrix(left, *own, start)
        out += x @ (x if left is right else matrix(right, *others, start)).T
    if left is right:
        np.fill_diagonal(out, [x.size for x in left])
    return out


def similarities(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact Jaccard similarities of sets of unique elements; two empty sets are equal."""
    common = overlaps(left, right)
    total = np.array([x.size for x in left], dtype=np.float32)[:, None] + np.array([x.size for x in right], dtype=np.float32)[None, :] - common
    return np.where(total > 0, common / np.maximum(total, 1), 1.0)


def similar(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of similar pairs among a few sets; for them, sorting two sets together is faster than matrices."""
    found = []
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            common = 0
            if min(a.size, b.size) >= (threshold - 1e-7) * max(a.size, b.size):
                both = np.concatenate([a, b])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
            total = a.size + b.size - common
            if not total or common / total >= threshold - 1e-7:
                found.append((i, j))
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def forest(rows: np.ndarray, cols: np.ndarray, left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the links left[row] - right[col]."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(rows.tolist(), cols.tolist(), strict=True):
        a, b = find(left[i]), find(right[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((left[i], right[j]))
    return out


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list]]:
    """Runs of equal keys of sorted rows: (key, rows); a run is a cell, which is bounded."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


EDGES = "a long, b long, far double, near int"


def _edges(found: list[tuple[int, int]], far: list[tuple[int, float, int]]) -> pa.RecordBatch:
    """Links a - b; or of an item a its distance from the hub and how many of its cell are similar to it."""
    a, b, none = [x for x, _ in found] + [x[0] for x in far], [y for _, y in found] + [None] * len(far), [None] * len(found)
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(none + [x[1] for x in far], pa.float64()), pa.array(none + [x[2] for x in far], pa.int32())], names=["a", "b", "far", "near"])


def linked(met: DataFrame, fetch: Callable[[DataFrame], DataFrame], elements_of: Callable[[bytes], np.ndarray], threshold: float) -> DataFrame:
    """(a, b) links that connect all similar items.

    met: (bucket, id, pivot) of buckets with several items, of which pivot is one; fetch takes (id, info) and gives it with
    payload, the bytes that elements_of makes an item's unique 64-bit elements of.  Payloads are made
    where the items' texts are read and move to the item's cells, where they are decoded.
    """
    # what is summed up by cluster or bucket is written before it is joined: a hot one's rows can then be split
    members = met
    clusters = connected_components(members.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")))
    agreeing = members.groupBy(F.col("pivot").alias("id")).agg(F.count(F.lit(1)).alias("agrees"))
    items = cut(clusters.join(agreeing, "id", "left").select(F.col("component").alias("cluster"), "id", F.coalesce("agrees", F.lit(0)).alias("agrees")), "items")
    whole = cut(items.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("agrees", (-F.col("id")).alias("least"))).alias("best")).select("cluster", "n", (-F.col("best.least")).alias("hub")), "whole")
    items = cut(items.join(whole, "cluster").withColumn("cells", F.ceil(F.col("n") / CELL).cast("int")).withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")), "items")
    placed = items.select("cluster", "cell", "id", "hub", "cells")
    hubs = items.where("id = hub and cells > 1").select("cluster", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "id", "hub", "cells", F.col("cell").alias("own")).where("cell <> own").drop("own")

    def compare(batches):
        for (_, _), rows in _groups(batches, 2):
            ids, hub, several = [r[0] for r in rows], rows[0][1], rows[0][2] > 1
            elements = [elements_of(r[3]) for r in rows]
            far = []
            if len(ids) <= FEW and not several:
                yield _edges(forest(*similar(elements, threshold), ids, ids), far)
                continue
            sim = similarities(elements, elements)
            close = sim >= threshold - 1e-7
            if several:
                k = ids.index(hub)
                far = [(x, float(1 - s), int(n)) for x, s, n in zip(ids, sim[k], close.sum(axis=1), strict=True) if x != hub]
            yield _edges(forest(*np.nonzero(np.triu(close, 1)), ids, ids), far)

    def within(dealt: DataFrame) -> DataFrame:
        info = ["cluster", "cell", "hub", "cells"]
        cells = fetch(dealt.select("id", F.struct(*info).alias("info"))).select("info.cluster", "info.cell", "id", "info.hub", "info.cells", "payload")
        return cut(cells.repartition("cluster", "cell").sortWithinPartitions("cluster", "cell", "id").mapInArrow(lean(compare), EDGES), "links")

    first = within(placed.unionByName(hubs))
    links = first.where("b is not null").select("a", "b")
    distance = first.where("b is null").select(F.col("a").alias("id"), "far", "near")
    if not distance.limit(1).count():
        return links
    large = items.where("cells > 1").join(distance, "id", "left").select("cluster", "id", "hub", F.floor(F.coalesce("far", F.lit(0.0)) / (1 - threshold + _MARGIN)).cast("int").alias("ring"), F.coalesce("near", F.lit(0)).alias("near"))
    large, before, turn = cut(large, "large"), None, 0
    while True:
        state = large.join(connected_components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
        sizes = cut(state.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
        # home: the item's component if that is large, else null, and the item is loose
        state = cut(state.join(sizes, "component").withColumn("home", F.when(F.col("size") >= CELL, F.col("component"))), "state")
        most = F.max(F.struct("size", "near", "id")).alias("most")
        loose = cut(state.where("home is null").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), most).where(F.col("n") > CELL), "loose")
        now = loose.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not now or before is not None and now > 2 * before / 3:
            break
        before, turn = now, turn + 1
        again = loose.select("cluster", F.col("most.id").alias("hub"), F.ceil(F.col("n") / CELL).cast("int").alias("parts"))
        dealt = state.where("home is null").select("cluster", "id").join(again, "cluster").withColumn("cell", F.pmod(F.xxhash64("id", F.lit(turn)), F.col("parts")).cast("int"))
        guests = again.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("id", F.col("hub")).where(F.col("cell") != F.pmod(F.xxhash64("id", F.lit(turn)), F.col("parts")))
        cols = ["cluster", "cell", "id", "hub", F.lit(1).alias("cells")]
        links = links.unionByName(within(cut(dealt.select(*cols).unionByName(guests.select(*cols)), "dealt")).select("a", "b"))
    state = state.select("cluster", "id", "component", "home", "ring")
    rows = F.col("n") * F.ceil(F.col("loose") / CELL) + F.col("loose") * F.ceil(F.col("n") / CELL)  # that meet, about
    counted = lambda df, *keys: df.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("home").isNull(), 1)).alias("loose")).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("loose").alias("loose"), F.count(F.lit(1)).alias("components"), F.count_if(F.col("loose") < F.col("n")).alias("homes")).where("components > 1")
    apart = cut(counted(state, "cluster").withColumn("cost", rows), "apart")
    if not apart.limit(1).count():
        return links
    # the groups that are compared: a cluster's loose items with all of it, or its buckets that have several
    # components, whichever is less; different homes meet only in the buckets that they share
    chained = cut(members.select("bucket", "id").join(state.join(apart.select("cluster"), "cluster", "left_semi"), "id"), "chained")
    split = cut(counted(chained, "cluster", "bucket").withColumn("cost", F.when(F.col("n") <= CELL, F.col("n")).otherwise(rows)), "split")
    by_bucket = split.groupBy("cluster").agg(F.sum(F.when(F.col("loose") > 0, F.col("cost"))).alias("bucket_cost"))
    apart = cut(apart.join(by_bucket, "cluster", "left").withColumn("whole", F.col("cost") <= F.coalesce("bucket_cost", F.lit(0))), "apart")
    few = state.join(apart.where("whole and loose > 0").select("cluster", "n"), "cluster").select(F.xxhash64(F.lit(0), "cluster").alias("group"), "id", "home", "ring", "n")
    chosen = cut(split.join(apart.select("cluster", "whole"), "cluster").where("not whole or homes > 1").select("bucket", F.when(F.col("whole"), F.col("n") - F.col("loose")).otherwise(F.col("n")).alias("n"), "whole"), "chosen")
    many = chained.join(chosen, "bucket").where("not whole or home is not null").select(F.xxhash64(F.lit(1), "bucket").alias("group"), "id", "home", "ring", "n")
    # a group of up to CELL items is one block; a larger one has blocks by home and ring, of about CELL items each
    home, ring = (F.when(F.col("n") > CELL, F.col(c)) for c in ("home", "ring"))
    mates = few.withColumn("across", F.lit(False)).unionByName(many.withColumn("across", F.lit(True))).select("group", "across", "id", home.alias("home"), F.coalesce(ring, F.lit(0)).alias("ring"))
    parts = cut(mates.groupBy("group", "across", "home", "ring").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts")), "parts")
    same = [F.col("m.group") == F.col("p.group"), F.col("m.home").eqNullSafe(F.col("p.home")), F.col("m.ring") == F.col("p.ring")]
    block = F.xxhash64("home", "ring", "part").alias("block")
    mates = mates.alias("m").join(parts.alias("p"), same).select("m.*", F.pmod(F.xxhash64("id", F.lit(-1)), F.col("parts")).cast("int").alias("part")).select("group", "id", block)
    blocks = cut(parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("group", "across", "home", "ring", block), "blocks")
    pairs = blocks.alias("l").join(blocks.alias("r"), "group").where("l.block <= r.block and abs(l.ring - r.ring) <= 1 and (l.home is null or r.home is null or (l.across and l.home <> r.home))")
    pairs = cut(pairs.select("group", F.col("l.block").alias("left"), F.col("r.block").alias("right")), "pairs")
    mates = cut(mates, "mates")
    asked = mates.withColumnRenamed("block", "left").join(pairs, ["group", "left"]).select("group", "left", "right", "id", F.lit(True).alias("asks"))
    given = mates.withColumnRenamed("block", "right").join(pairs.where("left <> right"), ["group", "right"]).select("group", "left", "right", "id", F.lit(False).alias("asks"))

    def meet(batches):
        for (_, one, other), rows in _groups(batches, 3):
            asking, rest = ([r for r in rows if r[1] == side] for side in (True, False))
            left = [elements_of(r[2]) for r in asking]
            right = left if one == other else [elements_of(r[2]) for r in rest]
            close = similarities(left, right) >= threshold - 1e-7
            i, j = np.nonzero(np.triu(close, 1) if one == other else close)
            yield _edges(forest(i, j, [r[0] for r in asking], [r[0] for r in (asking if one == other else rest)]), [])

    keys = ["group", "left", "right"]
    rest = fetch(asked.unionByName(given).select("id", F.struct(*keys, "asks").alias("info"))).select(*(f"info.{k}" for k in keys), "id", "info.asks", "payload").repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(lean(meet), EDGES)
    return links.unionByName(rest.select("a", "b"))
