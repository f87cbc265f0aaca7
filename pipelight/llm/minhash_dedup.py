"""MinHash near-dedup with DartMinHash signatures.

A document is the weighted set of its shingles of five words (white-space separated, A-Z lowered),
weighted by their counts; a shorter text is one shingle.  Darts are thrown by hashing into the
region of each weighted element: a Poisson process of rank 1 per unit of weight, whose darts each
fall on one of K coordinates.  Only ranks below K ln K + 2 K over the document's weight are thrown
(more, where a coordinate stays empty), so a signature costs about one hash per word and some
hundred darts.  The earliest dart of a coordinate is the same for two documents with probability
equal to their weighted Jaccard similarity.  Signatures are cut into bands for joining; candidate
pairs are verified exactly, and links become classes by distributed union-find.

Defined results: a null text is empty; texts without words are alike; rows that repeat an id and a text
are documents of their own, of which one is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import hashing as H
from .common import cut, keyed, lean, small, table
from .components import connected_components
from .neardup import linked

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4


def shingles(units: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each shingle of n units; a shorter document is one shingle."""
    sizes = np.diff(counts)
    sums = H.prefix_sums(units)
    many = np.maximum(sizes - n + 1, (sizes > 0).astype(np.int64))
    doc = np.repeat(np.arange(sizes.size), many)
    start = np.arange(doc.size) - np.repeat(np.cumsum(many) - many, many) + counts[doc]
    return doc, H.ranges(sums, start, np.minimum(start + n, counts[doc + 1]))


def weighted(doc: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, element) with their counts."""
    order = np.lexsort((element, doc))
    doc, element = doc[order], element[order]
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (element[1:] != element[:-1])])) if doc.size else np.empty(0, np.int64)
    return doc[edge], element[edge], np.diff(np.append(edge, doc.size)).astype(np.float64)


def dart_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Signatures (n_docs x k) of weighted sets; those of empty sets are 0."""
    signature = np.zeros((n_docs, k), dtype=np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    # a region of weight w is made of unit cells, the last one cut at the fraction that remains
    cells = np.ceil(weight).astype(np.int64)
    of = np.repeat(np.arange(doc.size), cells)
    cell = np.arange(of.size) - np.repeat(np.cumsum(cells) - cells, cells)
    seed = H.mix(element[of] + H.mix(cell.astype(np.uint64) + np.uint64(1)))
    room = weight[of] - cell
    owner = doc[of]
    limit = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    open_ = total > 0
    while open_.any():
        use = open_[owner]
        at, own, left = seed[use], owner[use], room[use]
        rank = np.zeros(at.size)
        slots, ranks, darts = [], [], []
        while at.size:
            at = H.mix(at + np.uint64(0x632BE59BD9B4E019))
            rank = rank - np.log((((at >> np.uint64(11)).astype(np.float64)) + 0.5) * 2.0**-53)
            near = rank < limit[own]
            at, own, left, rank = at[near], own[near], left[near], rank[near]
            dart = H.mix(at ^ np.uint64(0xA0761D6478BD642F))
            hit = (H.mix(dart) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < left  # within the cell's part
            slots.append(own[hit] * k + (dart[hit] % np.uint64(k)).astype(np.int64))
            ranks.append(rank[hit])
            darts.append(dart[hit])
        slot, rank, dart = np.concatenate(slots), np.concatenate(ranks), np.concatenate(darts)
        order = np.lexsort((dart, rank, slot))
        slot, dart = slot[order], dart[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]]) if slot.size else np.empty(0, bool)
        slot, dart = slot[first], dart[first]
        full = open_ & (np.bincount(slot // k, minlength=n_docs) == k)
        keep = full[slot // k]
        signature.reshape(-1)[slot[keep]] = dart[keep]
        open_ &= ~full
        limit = limit * 2
    return signature


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket for each band (n x bands)."""
    out = np.empty((signature.shape[0], bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(signature.shape[0], np.uint64(b + 1))
        for r in range(rows):
            h = H.mix(h + signature[:, b * rows + r])
        out[:, b] = h
    return out


SIGNED = "key long, e1 long, e2 long, n long, bands array<long>"


def sign(batches):
    """(key, binary text) to SIGNED: two hashes of all words, their number and the buckets of the bands."""
    for batch in batches:
        keys = batch.column(0)
        for a, b, data, offsets in H.pieces(batch.column(1)):
            units, _, _, counts = H.words(data, offsets, lower=True)
            doc, element, weight = weighted(*shingles(units, counts, SHINGLE))
            bands = bands_of(dart_minhash(doc, element, weight, b - a, BANDS * ROWS), BANDS, ROWS)
            sums, more = H.prefix_sums(units), H.prefix_sums(H.mix(units))
            exact = [H.ranges(x, counts[:-1], counts[1:]).view(np.int64) for x in (sums, more)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1).view(np.int64)))
            yield pa.record_batch([keys[a:b], pa.array(exact[0]), pa.array(exact[1]), pa.array(np.diff(counts).astype(np.int64)), lists], names=["key", "e1", "e2", "n", "bands"])


def elements_of(text: bytes) -> np.ndarray:
    """A text's counted shingles as a set: the j-th occurrence of a shingle is an element.

    The plain Jaccard similarity of two such sets is the weighted one of the counts.
    """
    data = np.frombuffer(text, dtype=np.uint8)
    units, _, _, counts = H.words(data, np.array([0, data.size]), lower=True)
    _, element = shingles(units, counts, SHINGLE)
    element = np.sort(element)
    first = np.concatenate([[True], element[1:] != element[:-1]]) if element.size else np.empty(0, bool)
    begin = np.flatnonzero(first)
    nth = np.arange(element.size) - begin[np.cumsum(first) - 1]
    return np.sort(H.mix(element + H.mix(nth.astype(np.uint64) + np.uint64(1))))


def weighted_jaccard(left: bytes, right: bytes) -> float:
    """Of the counted shingles of two texts, by their words; for tests."""
    a, b = (_count(x) for x in (left, right))
    common = sum(min(n, b[s]) for s, n in a.items() if s in b)
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 1.0


def _count(text: bytes) -> Counter:
    words = text.translate(H.LOWER.tobytes()).split()
    return Counter(tuple(words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE + 1, min(1, len(words)))))


def _elements(batches):
    for batch in batches:
        sets = [elements_of(t).tobytes() for t in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["id", "info", "payload"])


def _fetch(own: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Elements, as bytes, of the documents with the keys that are asked for."""

    def fetch(wanted: DataFrame) -> DataFrame:
        wanted = cut(wanted, "wanted")
        rows = own.join(small(wanted.withColumnRenamed("id", "key"), wanted.count(), 64), "key").select(F.col("key").alias("id"), "info", F.col("text").cast("binary").alias("text"))
        return rows.mapInArrow(lean(_elements), StructType([*rows.schema.fields[:2], StructField("payload", BinaryType())]))

    return fetch


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: Sequence[str] = ()) -> DataFrame:
    """(id, text, class_id, kept[, rest]): class_id is the least id among the documents linked to this one.

    Documents of equal words are one class member from the start; similar ones are linked if their
    weighted Jaccard similarity is at least threshold.  kept marks one document of each class.
    """
    own = keyed(docs, id_col, text_col, keep)
    classes = _classes(own, threshold)
    n = classes.count()
    ids = own.select(F.col("key").alias("least"), F.col("id").alias("class_id")).join(small(classes.select(F.col("class_key").alias("least")).distinct(), n, 16), "least")
    labelled = classes.select("key", F.col("class_key").alias("least")).join(small(ids, n, 32), "least")
    return own.join(small(labelled, n, 40), "key", "left").select(
        F.col("id").alias(id_col), "text", F.when(F.col("least").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce("least", "key") == F.col("key")).alias("kept"), *(["rest"] if keep else [])
    )


def _classes(own: DataFrame, threshold: float) -> DataFrame:
    """(key, class_key) of the documents that are alone in no class."""
    signed = cut(own.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(lean(sign), SIGNED), "signed")
    equal = cut(signed.groupBy("e1", "e2", "n").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "equal")
    copied = equal.where("copies > 1").select("e1", "e2", "n", "first")
    copies = signed.select("key", "e1", "e2", "n").join(small(copied, copied.count(), 64), ["e1", "e2", "n"]).select(F.col("first").alias("a"), F.col("key").alias("b")).where("a <> b")
    buckets = equal.where("n > 0").select(F.col("first").alias("id"), F.explode("bands").alias("bucket")).select("bucket", "id")
    crowded = cut(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("pivot")).where("n > 1").select("bucket", "pivot"), "crowded")
    met = cut(buckets.join(crowded, "bucket").select("bucket", "id", "pivot"), "met")
    if met.limit(1).count():
        copies = copies.unionByName(linked(met, _fetch(own), lambda x: np.frombuffer(x, dtype=np.uint64), threshold))
    return cut(connected_components(copies).select(F.col("id").alias("key"), F.col("component").alias("class_key")), "classes")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")
