"""Best-fit packing of tokenised documents into sequences, planned on the histogram of lengths.

Method: patterns of one to three lengths that fill a sequence exactly are enumerated; their repeat
counts are fitted to the histogram by non-negative least squares (accelerated projected gradient),
rounded, and applied as far as the histogram allows; the fit is repeated on what remains while it
places anything; residual pieces are packed by best fit, longest first.  Planning sees only the
histogram, which has at most `capacity` entries whatever the corpus, so the driver holds nothing
that grows with the documents.  The plan is a list of runs (so many pieces of a length, from this
rank on, go to these sequences at this offset); pieces get their rank within their length from
salted windows, so that no length is ranked in one task.

Defined results: a null text is empty, and an empty document is one piece that holds only the end
id; ids may be null or repeated, each row is a document; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small, table

CAPACITY = 1024
END_ID = 2
#: Pieces that are ranked by one task, about.
RANKED_ROWS = 100_000
NNLS_STEPS = 300


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def encoder(path: str):
    """text -> ids of the byte-level BPE in a tokenizers file, without special tokens.

    The file's own vocabulary and merge order run on a faster implementation of the same merges;
    tests hold it against the tokenizers library.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"] for x in spec.get("added_tokens", [])}
    # byte-level BPE files spell each byte as a printable character
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spelled = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    ranks = {bytes(spelled[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=4)
def document_encoder(path: str):
    """text -> ids as the tokenizers library gives them at its defaults with add_special_tokens=False.

    An added token's literal in a text is that token; the parts between literals are encoded each by
    itself.  encoder() takes literals as plain text.
    """
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens", [])
    if any(x.get(k) for x in tokens for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: added tokens that depend on what stands around them")
    plain, added = encoder(path), {x["content"]: x["id"] for x in tokens}
    if not added:
        return plain
    # the longest of the tokens that start at a place is taken
    literal = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def encode(text: str) -> list[int]:
        parts = literal.split(text)
        ids = plain(parts[0])
        for token, rest in zip(parts[1::2], parts[2::2], strict=True):
            ids.append(added[token])
            ids += plain(rest)
        return ids

    return encode


def pieces_of(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of each row; only longer documents are cut, and
    only their first piece is shorter than capacity."""

    def run(batches):
        encode = document_encoder(path)
        for batch in batches:
            at, out = [], {k: [] for k in ("piece", "start", "length", "crc", "ids")}
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = encode((text or b"").decode("utf-8", "replace"))
                ids.append(end_id)
                n = len(ids)
                ids = np.array(ids, dtype="<u4")
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    at.append(row)
                    out["piece"].append(k)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["crc"].append(zlib.crc32(ids[a:b].tobytes()))
                    if keep_ids:
                        out["ids"].append(ids[a:b].astype(np.int32))
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "crc")), *([pa.array(out["ids"], pa.list_(pa.int32()))] if keep_ids else [])], names=["id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = dict(own.dtypes)["id"]
    return own.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to three of the lengths, in ascending order after zeros, that add up to capacity."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    have[0] = True
    known = np.flatnonzero(have)
    a, b = np.meshgrid(known, known, indexing="ij")
    a, b = a[a <= b], b[a <= b]
    c = capacity - a - b
    good = (c >= b) & have[np.maximum(c, 0)] & (c > 0)
    return np.stack([a[good], b[good], c[good]], axis=1)


def nnls(rows: np.ndarray, target: np.ndarray, steps: int = NNLS_STEPS) -> np.ndarray:
    """x >= 0 that nearly minimises |A x - target|, where column j of A counts the lengths in rows[j]."""
    size = target.size

    def product(x):
        out = np.zeros(size)
        for k in range(rows.shape[1]):
            out += np.bincount(rows[:, k], weights=x, minlength=size)
        out[0] = 0
        return out

    def gradient(r):
        return r[rows].sum(axis=1)

    v = np.ones(len(rows))
    for _ in range(12):  # the largest eigenvalue, by power iteration
        v = gradient(product(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - gradient(product(y) - target) / (1.05 * top))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(runs, number of sequences); runs: length, first rank, count, first sequence, offset."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    rank = np.zeros(capacity + 1, dtype=np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, int(rank[length]), n, sequence, offset))
        rank[length] += n
        left[length] -= n

    while True:
        rows = patterns(np.flatnonzero(left), capacity)
        if not len(rows):
            break
        fit = nnls(rows, left.astype(np.float64))
        before = sequences
        for j in np.argsort(-fit, kind="stable"):
            wanted = int(fit[j] + 0.5)
            if not wanted:
                break
            need: dict[int, int] = {}
            for length in rows[j].tolist():
                if length:
                    need[length] = need.get(length, 0) + 1
            n = min(wanted, *(int(left[k]) // m for k, m in need.items()))
            if n > 0:
                offset = 0
                for length in rows[j][::-1].tolist():
                    if length:
                        place(length, n, sequences, offset)
                        offset += length
                sequences += n
        if sequences - before < 16:
            break
    # residual pieces: best fit, longest first, on groups of sequences with equal room
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        while left[length]:
            n = int(left[length])
            r = next((r for r in range(length, capacity + 1) if room[r]), None)
            if r is None:
                r, per = capacity, capacity // length
                first, have = sequences, -(-n // per)
                sequences += have
            else:
                first, have = room[r].pop()
            per = r // length
            use = min(have, n // per)
            if use:
                for k in range(per):
                    place(length, use, first, capacity - r + k * length)
                room[r - per * length].append((first, use))
            rest = n - use * per if use < have else 0
            if use < have and rest:
                k = min(rest, per)
                for i in range(k):
                    place(length, 1, first + use, capacity - r + i * length)
                room[r - k * length].append((first + use, 1))
                use += 1
            if use < have:
                room[r].append((first + use, have - use))
    room.clear()
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5), sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (id, piece, start, length, ids_crc32, ...) with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    runs, _ = plan(histogram, capacity)
    salts = -(-sum(histogram.values()) // RANKED_ROWS) or 1
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32"), F.lit(salts)))
    within = Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "ids_crc32")
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(small(before, capacity * salts, 40), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "salt")
    edges = np.searchsorted(runs[:, 0], np.arange(capacity + 2))

    def assign(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            sequence, offset = np.empty(length.size, np.int64), np.empty(length.size, np.int64)
            for value in np.unique(length):
                own = runs[edges[value] : edges[value + 1]]
                here = length == value
                at = np.searchsorted(own[:, 1], rank[here], side="right") - 1
                sequence[here] = own[at, 3] + rank[here] - own[at, 1]
                offset[here] = own[at, 4]
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(n)) for n in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    kept = [f for f in ranked.schema.fields if f.name != "rank"]
    return ranked.mapInArrow(assign, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], sequence_id, offset) for each piece."""
    pieces = cut(pieces_of(docs, id_col, text_col, tokenizer or default_tokenizer(), capacity, end_id, keep_ids), "pieces")
    return pack(pieces, capacity).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the sequences of a packing that kept its ids; one holds at most capacity ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
