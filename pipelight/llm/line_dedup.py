"""Fuzzy line dedup: near-equal lines across a corpus, of which the earliest stays.

A line (texts are split at \\n; surrounding white space doesn't count) is the set of its shingles of
8 bytes; a shorter line is one shingle.  Equal lines are collapsed first.  One-permutation MinHash
signatures, banded for high recall at the threshold, propose pairs; their Jaccard similarity is
computed exactly; links become components by distributed union-find; the line that comes first (by
document id, then by place) stays.

Defined results: a null text has no lines; blank lines always stay; rows that repeat an id and a text
are documents of their own, of which the first keeps its lines; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from . import hashing as H
from .common import cut, keyed, lean, small, table
from .components import connected_components
from .minhash_dedup import bands_of
from .neardup import linked

SHINGLE = 8
THRESHOLD = 0.8
#: At a similarity of 0.8, 16 bands of 4 miss a pair with probability 0.0002; measured, the same to 0.0004
#: for lines of 8 to 20 shingles, whose bins borrow from each other.
BANDS, ROWS = 16, 4
_BUCKETS = [f"b{i}" for i in range(BANDS)]
#: Places in buckets that a task sorts at once; there are tasks for half as many each.
MEETING = 1 << 20
#: Ranges of buckets for each of those tasks, so that hashing deals them out evenly.
RANGES = 16
#: Bytes of lines that are hashed at once.
HASHED = 1 << 15


_FIRST = np.array([True])


def grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as an integer; zeros follow the last byte."""
    padded = np.concatenate([data, np.zeros(SHINGLE, np.uint8)])
    return np.ndarray(shape=(data.size,), dtype="<u8", buffer=padded, strides=(1,))


def _shorten(found: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of lines shorter than a shingle: their bytes, and in the free last byte their length."""
    size = size.astype(np.uint64)
    return found & ((np.uint64(1) << (np.uint64(8) * size)) - np.uint64(1)) | size << np.uint64(56)


def minhash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash signatures of data[start:end], none of which overlap; empty bins borrow from filled ones."""
    least = np.full(starts.size * bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    order = np.argsort(starts, kind="stable")
    at = 0
    while at < order.size:  # arrays of some HASHED bytes stay in a core's cache
        to = max(at + 1, int(np.searchsorted(ends[order], starts[order[at]] + HASHED, side="right")))
        own = order[at:to]
        begin, end = starts[own], ends[own]
        low, many = int(begin[0]), np.maximum(end - begin - SHINGLE + 1, 1)
        found = grams(data[low : int(end[-1]) + SHINGLE])[: int(begin[-1] + many[-1]) - low].copy()
        short = np.flatnonzero(end - begin < SHINGLE)
        found[begin[short] - low] = _shorten(found[begin[short] - low], (end - begin)[short])
        found = H.mix(found)
        # each place's line; between the last shingle of one and the first of the next there are places of none
        spans = np.stack([many, np.append(begin[1:], begin[-1] + many[-1]) - begin - many], axis=1).reshape(-1)
        inside = np.repeat(np.arange(spans.size) % 2 == 0, spans)
        hashes = found[inside]
        slot = hashes >> np.uint64(32)
        slot *= np.uint64(bins)
        slot >>= np.uint64(32)
        slot = slot.view(np.int64)
        slot += np.repeat(own * bins, many)
        hashes &= np.uint64(0xFFFFFFFF)
        np.minimum.at(least, slot, hashes)
        at = to
    table_ = least.reshape(-1, bins)
    # optimal densification: an empty bin takes the value of a bin chosen by hash, the same for all lines
    filled = table_ != np.iinfo(np.uint64).max
    rows, cols = np.nonzero(~filled)
    attempt = 0
    while rows.size:
        attempt += 1
        take = (H.mix(cols.astype(np.uint64) + np.uint64(attempt * 1000003)) % np.uint64(bins)).astype(np.int64)
        good = filled[rows, take]
        table_[rows[good], cols[good]] = H.mix(table_[rows[good], take[good]])
        rows, cols = rows[~good], cols[~good]
    return table_


def _lines(data: bytes) -> list[tuple[int, int]]:
    """Start and end of each line without surrounding white space."""
    out, at = [], 0
    for line in data.split(b"\n"):
        core = line.strip()
        begin = at + (line.find(core) if core else 0)
        out.append((begin, begin + len(core)))
        at += len(line) + 1
    return out


def _sign(batches):
    """Each distinct line of a run of documents, at its first place there."""
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for a, _, data, offsets in H.pieces(batch.column(1)):
            raw = data.tobytes()
            first: dict[int, tuple[int, int, int, int]] = {}
            again: dict[int, int] = {}
            for i in range(offsets.size - 1):
                text = raw[offsets[i] : offsets[i + 1]]
                for place, (begin, end) in enumerate(_lines(text)):
                    if end > begin:
                        h = xxhash.xxh3_64_intdigest(text[begin:end])
                        key = int(keys[a + i])
                        if h in first:
                            again[h] = again.get(h, 0) + 1
                        if h not in first or (key, place) < first[h][:2]:
                            first[h] = (key, place, int(offsets[i]) + begin, int(offsets[i]) + end)
            if not first:
                continue
            ids = np.fromiter(first, dtype=np.uint64, count=len(first)).view(np.int64)
            key, place, begin, end = np.array(list(first.values()), dtype=np.int64).T
            buckets = bands_of(minhash(data, begin, end, BANDS * ROWS), BANDS, ROWS)
            n = np.array([1 + again.get(h, 0) for h in first], dtype=np.int64)
            yield pa.record_batch([pa.array(ids), pa.array(key), pa.array(place.astype(np.int32)), pa.array(n), *(pa.array(buckets[:, i].view(np.int64)) for i in range(BANDS))], names=["id", "key", "place", "n", *_BUCKETS])


def jaccard(left: bytes, right: bytes) -> float:
    """Of the sets of shingles of two lines."""
    a, b = ({x[i : i + SHINGLE] for i in range(max(1, len(x) - SHINGLE + 1))} for x in (left, right))
    common = len(a & b)
    return common / (len(a) + len(b) - common)


def elements_of(line: bytes) -> np.ndarray:
    """A line's shingles as integers, each once."""
    data = np.frombuffer(line, dtype=np.uint8)
    found = grams(data)[: max(1, data.size - SHINGLE + 1)]
    if data.size < SHINGLE:
        return _shorten(found, np.array([data.size]))
    found = np.sort(found)  # faster than np.unique
    return found[np.concatenate([_FIRST, found[1:] != found[:-1]])]


def crowded(batches):
    """Members of buckets of two lines or more, with the first of them, of rows sorted by bucket."""
    held = None  # bucket, id and pivot of the last row, and whether it was given out
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, ids = (batch.column(i).to_numpy() for i in range(2))
        if held is not None:
            bucket, ids = np.concatenate([held[0], bucket]), np.concatenate([held[1], ids])
        same = bucket[1:] == bucket[:-1]
        head = np.concatenate([[True], ~same])
        pivot = ids[np.maximum.accumulate(np.where(head, np.arange(head.size), 0))]
        keep = np.concatenate([same, [False]]) | ~head
        if held is not None:  # the run of the last row goes on with its own pivot
            pivot[: int(np.argmax(head[1:])) + 1 if head[1:].any() else head.size] = held[2][0]
            keep[0] = False if held[3] else keep[0]
        held = (bucket[-1:], ids[-1:], pivot[-1:], keep[-1])
        if keep.any():
            yield pa.record_batch([pa.array(bucket[keep]), pa.array(ids[keep]), pa.array(pivot[keep])], names=["bucket", "id", "pivot"])


def dealt(parts: int):
    """For lines with their buckets: blocks of buckets and of the ids beside them, for each of so many ranges of buckets."""

    def blocks(held):
        ids = np.concatenate([x for x, _ in held])
        bucket = np.concatenate([x for _, x in held], axis=1)
        ids, bucket = np.tile(ids, bucket.shape[0]), bucket.reshape(-1)
        part = (bucket.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
        ids, bucket = ids[order], bucket[order]
        ends = np.cumsum(np.bincount(part.astype(np.int64), minlength=parts))
        whole = np.flatnonzero(np.diff(ends, prepend=0))
        offsets = np.append(0, ends[whole]) * 8
        if offsets[-1]:
            columns = (pa.Array.from_buffers(pa.large_binary(), whole.size, [None, pa.py_buffer(offsets), pa.py_buffer(x)]).cast(pa.binary()) for x in (bucket, ids))
            yield pa.record_batch([pa.array(whole.astype(np.int32)), *columns], names=["part", "buckets", "ids"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            own = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
            held.append((own[0], np.stack(own[1:])))
            n += batch.num_rows * len(own[1:])
            if n >= MEETING:
                yield from blocks(held)
                held, n = [], 0
        if held:
            yield from blocks(held)

    return run


def met_in(batches):
    """crowded() of blocks; what is held is a row of each bucket and about MEETING others, however many share a bucket."""
    bucket = ids = given = np.empty(0, dtype=np.int64)

    def runs():
        held, n = [], 0
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                held.append((np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)))
                n += held[-1][0].size
                if n >= MEETING:
                    yield held
                    held, n = [], 0
        if held:
            yield held

    for held in runs():
        bucket, ids = np.concatenate([bucket, *(x for x, _ in held)]), np.concatenate([ids, *(y for _, y in held)])
        order = np.argsort(bucket, kind="stable")  # a bucket's earlier row stays its pivot
        bucket, ids = bucket[order], ids[order]
        for found in crowded(iter([pa.record_batch([pa.array(bucket), pa.array(ids)], names=["bucket", "id"])])):
            of, own, pivot = (found.column(i).to_numpy() for i in range(3))
            yield found.filter(pa.array((own != pivot) | ~np.isin(of, given))) if given.size else found
            given = np.union1d(given, of)
        head = np.append(True, bucket[1:] != bucket[:-1])
        bucket, ids = bucket[head], ids[head]


def repeated_lines(own: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, component, first) of the lines that occur more than once or are similar to others: id is a
    line's hash and first the (key, place) of the first occurrence of any line of its component."""
    found = own.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(lean(_sign), f"id long, key long, place int, n long, {', '.join(f'{b} long' for b in _BUCKETS)}")
    # a document is in one run, so a key comes once with an id; plain columns keep this a hash aggregate, and max, of equal values, is a column less than first
    lines = found.groupBy("id").agg(F.min("key").alias("key"), F.min_by("place", "key").alias("place"), F.sum("n").alias("n"), *(F.max(b).alias(b) for b in _BUCKETS))
    lines = cut(lines.select("id", F.struct("key", "place").alias("first"), "n", *_BUCKETS), "lines")

    # a bucket is in one task; blocks bring it there, for rows of a bucket and an id would be sixteen for each line
    tasks = max(1, -(-2 * BANDS * lines.count() // MEETING))
    blocks = lines.select("id", *_BUCKETS).mapInArrow(lean(dealt(RANGES * tasks)), "part int, buckets binary, ids binary")
    met = cut(blocks.repartition(tasks, "part").select("buckets", "ids").mapInArrow(lean(met_in), "bucket long, id long, pivot long"), "met")
    wanted = cut(met.select("id").distinct().join(lines.select("id", "first"), "id"), "wanted")

    def read(kind):
        def run(batches):
            for batch in batches:
                ids, infos, found_lines = [], [], []
                for text, found_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    spans = _lines(text)
                    for x in found_:
                        begin, end = spans[x["place"]]
                        ids.append(x["id"])
                        infos.append(x["info"])
                        found_lines.append(text[begin:end])
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(infos, kind), pa.array(found_lines, pa.binary())], names=["id", "info", "payload"])

        return run

    def fetch(asked):
        places = cut(asked.join(wanted, "id").select(F.col("first.key").alias("key"), F.struct("id", F.col("first.place").alias("place"), "info").alias("line")), "places")
        by_text = places.groupBy("key").agg(F.collect_list("line").alias("lines"))
        rows = own.join(small(by_text, places.count(), 80), "key").select(F.col("text").cast("binary").alias("text"), "lines")
        info = asked.schema["info"]
        return rows.mapInArrow(lean(read(to_arrow_type(info.dataType))), StructType([StructField("id", LongType()), info, StructField("payload", BinaryType())]))

    classes = cut(connected_components(linked(met, fetch, elements_of, threshold)), "classes")
    members = classes.join(wanted, "id")
    first = members.groupBy("component").agg(F.min("first").alias("first"))
    similar = members.select("id", "component").join(first, "component")
    found = lines.select("id", "n", F.col("first").alias("own")).join(similar, "id", "left").where("n > 1 or component is not null")
    return cut(found.select("id", F.coalesce("first", "own").alias("first"), F.coalesce("component", "id").alias("component")), "first")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: Sequence[str] = ()) -> DataFrame:
    """(id, text, n_lines, n_removed, kept[, rest]) for each document; kept: its text without removed lines.

    A line is removed if it isn't the first one, in the order of document ids and places, among the
    lines it is linked to by similarities of at least threshold.
    """
    own = keyed(docs, id_col, text_col, keep)
    first = repeated_lines(own, threshold)

    def occurrences(batches):
        for batch in batches:
            keys, places, ids = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for place, (begin, end) in enumerate(_lines(text)):
                    if end > begin:
                        keys.append(key)
                        places.append(place)
                        ids.append(xxhash.xxh3_64_intdigest(text[begin:end]))
            yield pa.record_batch([pa.array(np.array(ids, dtype=np.uint64).view(np.int64)), pa.array(keys, pa.int64()), pa.array(places, pa.int32())], names=["id", "key", "place"])

    all_lines = own.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(lean(occurrences), "id long, key long, place int")
    gone = all_lines.join(small(first.select("id", "first"), first.count(), 48), "id").where((F.col("first.key") != F.col("key")) | (F.col("first.place") != F.col("place")))
    gone = cut(gone.groupBy("key").agg(F.array_sort(F.collect_list("place")).alias("gone")), "gone")
    n, total = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    parts = F.split("text", "\n")
    n_lines = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    joined = own.join(small(gone, 1, 40 * n + 8 * total), "key", "left")
    # the parts are bound to a variable, for within a lambda they would be split again for every line
    kept = F.transform(F.array(parts), lambda p: F.concat_ws("\n", F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), "gone"), lambda i: F.element_at(p, i + 1))))[0]
    return joined.select(
        F.col("id").alias(id_col), "text", F.when(F.col("text") == "", 0).otherwise(n_lines).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept"), *(["rest"] if keep else [])
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
