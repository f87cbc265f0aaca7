"""Substring dedup: remove words covered by a window of words that occurs earlier.

Method: suffix automata of shards of the reference are streamed against; a document's matching
statistics (for each word, the length of the longest reference substring that ends there) give the
windows that occur earlier.  The reference is the corpus itself, whose size has no bound, so its
automata are not broadcast to everyone: a shard holds the contexts of some anchors (see windows.py)
and gets exactly the passages that can match it: every one around an anchor that occurs twice, also
equal ones (the first two; further copies follow the second).  A shard's automaton grows by the
passages that bring something new, so what it holds is bounded by GROUP_LIMIT contexts of an anchor.

Defined results: a null text has no words; rows that repeat an id and a text are documents of their
own, the later one a copy; ids are ordered null first; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .common import keyed, lean, table
from .suffix_dedup import merged_spans
from .windows import covered

WINDOW = 20
GRAM = 8
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class SuffixAutomaton:
    """Of several sequences of hashable symbols."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, symbols: list) -> None:
        last = 0
        for c in symbols:
            last = self._extend(last, c)

    def _extend(self, last: int, c) -> int:
        to, link, length = self.next, self.link, self.length
        if c in to[last]:
            q = to[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        state = len(to)
        to.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = state
            p = link[p]
        if p >= 0:
            q = to[p][c]
            link[state] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return state

    def _clone(self, p: int, q: int, c) -> int:
        to, link, length = self.next, self.link, self.length
        clone = len(to)
        to.append(to[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and to[p].get(c) == q:
            to[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def matching(self, symbols: list) -> Iterator[int]:
        """For each place, the length of the longest substring of the sequences that ends there."""
        state, size = 0, 0
        for c in symbols:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                size += 1
            else:
                size = 0
            yield size


def _solve(width: int):
    def solve(group: list[tuple]) -> Iterator[tuple[int, int, int]]:
        """Runs of windows of the contexts in group that occur in an earlier one of their anchor."""
        for _, members in groupby(enumerate(group), key=lambda x: x[1][3]):
            shard = SuffixAutomaton()
            for i, (_, _, units, _) in members:
                symbols = np.frombuffer(units, dtype=np.uint64).tolist()
                starts = [e - width + 1 for e, n in enumerate(shard.matching(symbols)) if n >= width]
                for _, run in groupby(enumerate(starts), key=lambda x: x[1] - x[0]):
                    run = [s for _, s in run]
                    yield i, run[0], run[-1] + 1
                if len(starts) < len(symbols) - width + 1:
                    shard.add(symbols)

    return solve


def _units(data: np.ndarray, offsets: np.ndarray):
    hashes, _, _, counts = H.words(data, offsets)
    return hashes, counts


def _text_units(text) -> np.ndarray:
    data = np.frombuffer(text, dtype=np.uint8)
    return H.words(data, np.array([0, data.size]))[0] if data.size else np.empty(0, np.uint64)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept) for each document; kept: the words that stay, by one space.

    A word goes if a window of `window` words that covers it also starts earlier: in a document of
    smaller id, or earlier in the same one.  Windows are judged on the input.
    """
    own = keyed(docs, id_col, text_col)
    merged = merged_spans(covered(own, _units, _text_units, window, min(GRAM, max(1, window // 2)), True, _solve(window), 8))
    hit = own.join(merged, "key", "left").select("id", F.col("text").cast("binary").alias("text"), "spans")

    def remove(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = _WORD.findall(text)
                n_words.append(len(words))
                for x in reversed(runs or ()):
                    del words[x["start"] : x["end"]]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], names=[id_col, "n_words", "n_removed", "kept"])

    kind = dict(own.dtypes)["id"]
    return hit.mapInArrow(lean(remove), f"`{id_col}` {kind}, n_words long, n_removed long, kept binary")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], window: int) -> list[tuple[int, int, str]]:
    """n_words, n_removed and the hash of what is kept, for texts in the order of their ids; for tests."""
    seen: set[tuple] = set()
    out = []
    for t in texts:
        words = _WORD.findall(t)
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        out.append((len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest()))
    return out
