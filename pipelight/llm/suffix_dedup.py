"""Suffix-array dedup: remove every byte covered by a long string that occurs elsewhere.

Method: suffixes are sorted in two stages.  Only suffixes that are smaller than their successors
are sorted directly; the others are induced by scanning the buckets of first bytes in order; then
the common prefixes of neighbours tell which strings occur twice.  Texts get to a sorter by the
anchors of their windows (see windows.py): every text around an anchor that occurs twice, also where
the texts are equal (two of them; further copies follow the second).  So a sorter holds a bounded
chunk.  An anchor with very many different contexts is counted by window hashes instead of sorted
in one task.

Defined results: a null text is empty; rows that repeat an id and a text are documents of their own
(each other's copies); texts shorter than the length have nothing removed; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .common import keyed, lean, small, table
from .windows import covered, merge_spans

LENGTH = 400
#: Bytes of an anchor: half of the length, so that shorter common lines are no anchors.
GRAM = 200


#: Neighbours whose strings are compared at once.
PAIRS = 4096


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the one that starts a byte later."""
    n = text.size
    step = np.zeros(n, dtype=np.int16)
    step[:-1] = text[1:].astype(np.int16) - text[:-1]
    step[-1] = -1  # the empty suffix is the smallest
    at = np.where(step != 0, np.arange(n), n)
    decides = np.minimum.accumulate(at[::-1])[::-1]
    return step[decides] > 0


def _direct_sort(data: bytes, text: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first depth bytes: dealt by their first four, and compared within these buckets,
    so that only one bucket's strings are held at a time."""
    padded = np.concatenate([text, np.zeros(3, np.uint8)]).astype(np.uint32)
    first = sum(padded[i : i + text.size] << np.uint32(8 * (3 - i)) for i in range(4))[suffixes]
    order = np.argsort(first, kind="stable")
    out, first = suffixes[order], first[order]
    edge = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1], [True]])) if first.size else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b] = sorted(out[a:b].tolist(), key=lambda i: data[i : i + depth])
    return out


def suffix_array(data: bytes, depth: int) -> np.ndarray:
    """Suffixes of data in the order of their first `depth` bytes, by two-stage sorting."""
    text = np.frombuffer(data, dtype=np.uint8)
    n = text.size
    small_type = smaller_than_successor(text)
    direct = _direct_sort(data, text, np.flatnonzero(small_type), depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        level = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        bucket = []
        while level.size:
            bucket.append(level)
            before = level[level > 0] - 1
            level = before[(text[before] == c) & ~small_type[before]]
        bucket.append(direct[bounds[c] : bounds[c + 1]])
        whole = np.concatenate(bucket)
        if not whole.size:
            continue
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[(text[before] > c) & ~small_type[before]]
        if before.size:
            first = text[before]
            before = before[np.argsort(first, kind="stable")]
            first = text[before]
            edge = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            for a, b in zip(edge, np.append(edge[1:], first.size), strict=True):
                induced[first[a]].append(before[a:b])
    return np.concatenate(out)


def common_prefixes(data: bytes, order: np.ndarray, most: int) -> np.ndarray:
    """Lengths, up to most, of the common prefixes of neighbours in order (one fewer than order).

    Both of a pair must have `most` bytes; the caller keeps only such suffixes.
    """
    width = -(-most // 8) * 8
    strings = np.ndarray(shape=(len(data),), dtype=f"V{width}", buffer=data + bytes(width), strides=(1,))
    out = np.zeros(max(0, order.size - 1), dtype=np.int64)
    for at in range(0, out.size, PAIRS):
        words = strings[order[at : at + PAIRS + 1]].view("<u8").reshape(-1, width // 8)
        differ = words[1:] ^ words[:-1]
        first = np.argmax(differ != 0, axis=1)
        low = differ[np.arange(first.size), first]
        low = low & (~low + np.uint64(1))
        out[at : at + PAIRS] = np.where(low == 0, width, 8 * first + np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
    return np.minimum(out, most)


def _solve(length: int):
    def solve(group: list[tuple]) -> Iterator[tuple[int, int, int]]:
        """Runs of windows of the contexts in group that occur twice in it."""
        data = b"".join(x[2] for x in group)
        sizes = np.array([len(x[2]) for x in group])
        begins = np.cumsum(sizes) - sizes
        order = suffix_array(data, length)
        context = np.searchsorted(begins, order, side="right") - 1
        order = order[order - begins[context] <= sizes[context] - length]
        same = common_prefixes(data, order, length) >= length
        repeated = np.zeros(len(data) + 1, dtype=bool)
        repeated[order[:-1][same]] = True
        repeated[order[1:][same]] = True
        repeated[begins[1:] - 1] = False  # no window starts at a context's last byte: runs end there
        edge = np.flatnonzero(np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            i = int(np.searchsorted(begins, a, side="right")) - 1
            yield i, a - int(begins[i]), b - int(begins[i])

    return solve


def _units(data: np.ndarray, offsets: np.ndarray):
    return H.BYTE_UNITS[data], offsets


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, text, n_bytes, n_removed, n_spans, kept binary) for each document.

    Each byte covered by a string of `length` bytes that also starts anywhere else, in the same
    document or another, is removed; strings are judged on the input.
    """
    own = keyed(docs, id_col, text_col)
    spans = covered(own, _units, lambda text: np.frombuffer(text, dtype=np.uint8), length, min(GRAM, max(1, length // 2)), False, _solve(length), 1)
    return _apply(own, spans, id_col)


def _apply(own: DataFrame, spans: DataFrame, id_col: str) -> DataFrame:
    merged = merged_spans(spans)
    hit = own.join(merged, "key", "left").select("id", F.col("text").cast("binary").alias("text"), "spans")

    def remove(batches):
        for batch in batches:
            out = {k: [] for k in ("n_removed", "n_spans", "kept")}
            for text, runs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = text.as_py()
                at, kept = 0, []
                for x in runs or ():
                    kept.append(data[at : x["start"]])
                    at = x["end"]
                kept.append(data[at:])
                kept = b"".join(kept)
                out["n_removed"].append(len(data) - len(kept))
                out["n_spans"].append(len(runs or ()))
                out["kept"].append(kept)
            sizes = [len(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept"], pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    kind = dict(own.dtypes)["id"]
    return hit.mapInArrow(lean(remove), f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def merged_spans(spans: DataFrame) -> DataFrame:
    """(key, spans): maximal runs of each document, broadcast-marked if they are small."""
    from .common import cut

    def merge(batches):
        for batch in batches:
            keys, lists = [], []
            for key, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(key)
                lists.append([{"start": a, "end": b} for a, b in merge_spans(found)])
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(lists, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["key", "spans"])

    merged = cut(spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("found")).mapInArrow(merge, "key long, spans array<struct<start: int, end: int>>"), "spans")
    n, runs = merged.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    return small(merged, 1, 40 * n + 24 * runs)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_array_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[tuple[int, int, str]]:
    """n_removed, n_spans and the hash of what is kept, by counting every string; for tests."""
    from collections import Counter

    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out
