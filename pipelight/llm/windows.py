"""Windows of W units that occur more than once in a corpus: what the two exact-repeat operators share.

Shipping every window would multiply the corpus by W.  Instead each window is represented by its
anchor: of the k-grams inside the window, the leftmost one with the least hash.  Equal windows have
equal anchors at equal places, so

1. one pass finds the anchors of each document, with the run of windows each anchor owns and a hash
   of the text those windows span (the anchor's context);
2. one shuffle on the anchor's hash brings equal anchors together, in sorted order, and a streaming
   pass sees which can be repeated at all: an anchor met once owns no repeated window.  Copies are
   pre-aggregated here: of equal contexts the first two go on, and any further one, which is the same
   text as those two, is covered like the second;
3. the contexts that go on get their text fetched, and a solver compares them within the anchor's
   group (suffix array or suffix automaton, see the operators), which finds every repeated window,
   those of equal contexts as well as those of contexts that only overlap;
4. an anchor with more than GROUP_LIMIT different contexts isn't given to a solver in one task: its
   windows are hashed one by one and counted with map-side aggregation, which is exact too and has
   no group to hold.

Every step streams; no group of rows is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import cut, lean

#: Differing contexts of one anchor that a solver takes at once.
GROUP_LIMIT = 2000
#: Units of differing contexts that a solver's task holds at once.
CHUNK_UNITS = 400_000

_OCCURRENCE = "anchor long, context long, key long, start int, windows int"
_FOUND = "kind int, anchor long, key long, start int, end int"
#: In place of an anchor: settled where it was found.
_SETTLED = np.iinfo(np.int64).min


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the place of the least of values[i:i+width], the leftmost of equals."""
    n = values.size
    packed = (values & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
    size = -(-n // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = packed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - width + 1
    least = np.minimum(behind[:last], ahead[width - 1 : width - 1 + last])
    return (least & np.uint64(0xFFFFFF)).astype(np.int64)


def find_anchors(units: np.ndarray, counts: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Anchors of the documents that stand one after another in units; counts: units before each."""
    sizes = np.diff(counts)
    empty = {k: np.empty(0, np.int64) for k in ("doc", "start", "windows", "anchor", "context")}
    if not (sizes >= width).any():
        return empty
    sums = H.prefix_sums(units)
    at = np.arange(units.size - gram + 1)
    grams = H.ranges(sums, at, at + gram)
    # windows that lie within one document
    whole = np.zeros(units.size + 1, dtype=np.int32)
    long = np.flatnonzero(sizes >= width)
    np.add.at(whole, counts[long], 1)
    np.add.at(whole, counts[long + 1] - width + 1, -1)
    if units.size < 1 << 24:
        where = sliding_argmin(grams, width - gram + 1)
    else:  # one very long text: in overlapping runs, for a place has 24 bits
        step, span = 1 << 23, width - gram
        where = np.concatenate([sliding_argmin(grams[i : i + step + span], width - gram + 1)[:step] + i for i in range(0, grams.size - span, step)])
    starts = np.flatnonzero(np.cumsum(whole[:-1])[: where.size] > 0)
    owner = where[starts]
    doc = np.searchsorted(counts, starts, side="right") - 1
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1) | (doc[1:] != doc[:-1])]))
    n = np.diff(np.append(first, starts.size))
    start, anchor, doc = starts[first], owner[first], doc[first]
    place = anchor - start
    context = H.ranges(sums, start, start + n - 1 + width) ^ H.mix(place.astype(np.uint64))
    return {"doc": doc, "start": start - counts[doc], "windows": n, "anchor": grams[anchor].view(np.int64), "context": context.view(np.int64)}


def _heads(cols: dict[str, np.ndarray]) -> np.ndarray:
    """Where a new context begins among rows that are sorted by anchor and context."""
    return np.concatenate([[True], (cols["anchor"][1:] != cols["anchor"][:-1]) | (cols["context"][1:] != cols["context"][:-1])])


def _rank(heads: np.ndarray) -> np.ndarray:
    """The place of each row in its run."""
    at = np.arange(heads.size)
    return at - np.maximum.accumulate(np.where(heads, at, 0))


def _occurrences(units_of: Callable, width: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _b, data, offsets in H.pieces(batch.column(1)):
                units, counts = units_of(data, offsets)
                found = find_anchors(units, counts, width, gram)
                if not found["doc"].size:
                    continue
                key = keys[a + found["doc"]]
                # equal contexts meet here first: the earliest two stand for them, the rest are settled
                order = np.lexsort((found["start"], key, found["context"], found["anchor"]))
                col = {k: v[order] for k, v in found.items()}
                key = key[order]
                lead = _rank(_heads(col)) < 2
                for own in (lead, ~lead):
                    if own.any():
                        yield pa.record_batch(
                            [
                                pa.array(col["anchor"][own] if own is lead else np.full(own.sum(), _SETTLED)),
                                pa.array(col["context"][own]),
                                pa.array(key[own]),
                                pa.array(col["start"][own].astype(np.int32)),
                                pa.array(col["windows"][own].astype(np.int32)),
                            ],
                            names=["anchor", "context", "key", "start", "windows"],
                        )

    return run


def _settle(width: int) -> Callable:
    """Stream over occurrences sorted by anchor, context, key and start.

    Gives the first two occurrences of contexts that share their anchor with others (kind 1; kind 2
    if the anchor has more than GROUP_LIMIT contexts), and further ones as settled spans of units
    (kind 0: key, start, end).
    """

    def rows(kind: int, cols: dict[str, np.ndarray], keep: np.ndarray) -> Iterator[pa.RecordBatch]:
        if keep.any():
            start = cols["start"][keep]
            end = start + cols["windows"][keep] + (width - 1)
            yield pa.record_batch([pa.array(np.full(start.size, kind, np.int32)), pa.array(cols["anchor"][keep]), pa.array(cols["key"][keep]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["kind", "anchor", "key", "start", "end"])

    def release(cols: dict[str, np.ndarray], big_anchor: int | None) -> Iterator[pa.RecordBatch]:
        """Decide on occurrences whose anchor is complete, or known to be a big one."""
        heads = _heads(cols)
        edge = np.flatnonzero(np.concatenate([[True], cols["anchor"][1:] != cols["anchor"][:-1]]))
        many = np.diff(np.append(edge, heads.size))
        contexts = np.add.reduceat(heads.astype(np.int64), edge)
        contexts = np.where(cols["anchor"][edge] == big_anchor, GROUP_LIMIT + 1, contexts) if big_anchor is not None else contexts
        alone, big = np.repeat(many == 1, many), np.repeat(contexts > GROUP_LIMIT, many)
        yield from rows(1, cols, ~alone & ~big)
        yield from rows(2, cols, big)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: dict[str, np.ndarray] = {}  # the first two of the contexts of the anchor met last
        big_anchor = None
        for batch in batches:
            cols = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            settled = cols["anchor"] == _SETTLED
            yield from rows(0, cols, settled)
            cols = {k: np.concatenate([*([carry[k]] if carry else []), v[~settled]]) for k, v in cols.items()}
            if not cols["key"].size:
                continue
            lead = _rank(_heads(cols)) < 2
            yield from rows(0, cols, ~lead)
            cols = {k: v[lead] for k, v in cols.items()}
            last = cols["anchor"] == cols["anchor"][-1]
            if (~last).any():
                yield from release({k: v[~last] for k, v in cols.items()}, big_anchor)
            carry = {k: v[last] for k, v in cols.items()}
            if carry["key"].size > 2 * GROUP_LIMIT:
                # enough to know that it is big; those of the context met last stay, to tell further copies
                big_anchor = carry["anchor"][0]
                stay = carry["context"] == carry["context"][-1]
                yield from rows(2, carry, ~stay)
                carry = {k: v[stay] for k, v in carry.items()}
        if carry:
            yield from release(carry, big_anchor)

    return run


def covered(docs: DataFrame, units_of: Callable, text_units: Callable, width: int, gram: int, earlier_only: bool, solve: Callable, item: int) -> DataFrame:
    """(key, start, end) spans of units covered by windows that are repeated.

    docs: key, text.  earlier_only: a window counts only if an equal one starts earlier (smaller
    key, or same key and earlier start); otherwise if an equal one starts anywhere else.
    units_of(data, offsets) gives 64-bit units and counts; text_units(text) the units of one text,
    as integers of `item` bytes (1: bytes as they are, 8: hashes); solve(list of (key, start, units)) yields (index, first window, last window + 1).
    """
    found_at = docs.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(lean(_occurrences(units_of, width, gram)), _OCCURRENCE)
    # settled rows carry no anchor; they are spread, not gathered
    to = F.when(F.col("anchor") == F.lit(int(_SETTLED)), F.xxhash64("key")).otherwise(F.col("anchor"))
    found = cut(found_at.repartition(to).sortWithinPartitions("anchor", "context", "key", "start").mapInArrow(lean(_settle(width)), _FOUND), "found")
    settled = found.where("kind = 0").select("key", "start", "end")
    open_ = found.where("kind > 0")
    if not open_.limit(1).count():
        return settled
    lists = open_.groupBy("key").agg(F.collect_list(F.struct("kind", "anchor", "start", "end")).alias("open"))
    wanted = docs.join(lists, "key").select("key", F.col("text").cast("binary").alias("text"), "open")

    def fetch(batches):
        for batch in batches:
            out = {k: [] for k in ("kind", "anchor", "key", "start", "units")}
            size = 0
            for key, text, open_list in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                units = text_units(text.as_buffer())
                for x in open_list:
                    for name, v in (("kind", x["kind"]), ("anchor", x["anchor"]), ("key", key), ("start", x["start"]), ("units", units[x["start"] : x["end"]].tobytes())):
                        out[name].append(v)
                    size += x["end"] - x["start"]
                if size > CHUNK_UNITS:
                    yield _fetched(out)
                    out, size = {k: [] for k in out}, 0
            if size:
                yield _fetched(out)

    texts = cut(wanted.mapInArrow(lean(fetch), "kind int, anchor long, key long, start int, units binary"), "contexts")

    def solver(batches):
        group, size, last = [], 0, None

        def flush():
            if not group:
                return
            hit = list(solve(group))
            if hit:
                yield pa.record_batch([pa.array([group[i][0] for i, _, _ in hit], pa.int64()), pa.array([group[i][1] + a for i, a, _ in hit], pa.int32()), pa.array([group[i][1] + b - 1 + width for i, _, b in hit], pa.int32())], names=["key", "start", "end"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for anchor, key, start, units in zip(*cols, strict=True):
                if anchor != last and size >= CHUNK_UNITS:
                    yield from flush()
                    group, size = [], 0
                group.append((key, start, units, anchor))
                size += len(units)
                last = anchor
        yield from flush()

    spans = settled.unionByName(texts.where("kind = 1").select("anchor", "key", "start", "units").repartition("anchor").sortWithinPartitions("anchor", "key", "start").mapInArrow(lean(solver), "key long, start int, end int"))
    if not texts.where("kind = 2").limit(1).count():
        return spans

    def explode(batches):
        for batch in batches:
            for key, start, units in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = np.frombuffer(units, dtype=np.uint8 if item == 1 else np.uint64)
                sums = H.prefix_sums(H.BYTE_UNITS[own] if item == 1 else own)
                sums2 = H.prefix_sums(H.mix((H.BYTE_UNITS[own] if item == 1 else own) + np.uint64(77)))
                at = np.arange(own.size - width + 1)
                yield pa.record_batch([pa.array(H.ranges(sums, at, at + width).view(np.int64)), pa.array(H.ranges(sums2, at, at + width).view(np.int64)), pa.array(np.full(at.size, key)), pa.array((at + start).astype(np.int32))], names=["w1", "w2", "key", "start"])

    hot = texts.where("kind = 2").select("key", "start", "units").repartition(F.xxhash64("key", "start")).mapInArrow(lean(explode, 1 << 18), "w1 long, w2 long, key long, start int")
    groups = hot.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "start")).alias("first")).where("n > 1")
    repeated = hot.join(groups, ["w1", "w2"])
    if earlier_only:
        repeated = repeated.where(F.struct("key", "start") > F.col("first"))
    return spans.unionByName(repeated.select("key", "start", (F.col("start") + width).alias("end")))


def _fetched(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "anchor": pa.int64(), "key": pa.int64(), "start": pa.int32(), "units": pa.binary()}
    return pa.record_batch([pa.array(out[k], t) for k, t in kinds.items()], names=list(kinds))


def merge_spans(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or adjoining spans."""
    merged: list[list[int]] = []
    for a, b in sorted((x["start"], x["end"]) for x in spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]
