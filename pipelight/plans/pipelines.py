"""Pipelines around searches: stages over the request, the documents or the result."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..search.service import SearchRequest, SearchResponse, SearchService

TYPES = ("query", "document", "result")
POLICIES = ("continue", "abort", "retry")


class StageError(RuntimeError):
    """A stage failed and its policy is to abort."""


@dataclass
class Stage:
    """run maps a request (query), documents (document) or hits (result) to another one.

    Document and result stages build plans: they add to a DataFrame and run nothing themselves.
    """

    name: str
    run: Callable[[Any], Any]
    on_failure: str = "abort"
    retries: int = 1
    timeout: float | None = None
    enabled: bool = True

    def __post_init__(self) -> None:
        if self.on_failure not in POLICIES:
            raise ValueError(f"unknown policy {self.on_failure!r}")


@dataclass
class Pipeline:
    name: str
    type: str
    stages: list[Stage]
    version: str = "1.0.0"
    runs: int = 0
    failures: int = 0
    seconds: float = 0.0
    by_stage: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"unknown pipeline type {self.type!r}")
        if not self.stages:
            raise ValueError("a pipeline has stages")
        if len({s.name for s in self.stages}) < len(self.stages):
            raise ValueError("stages have names of their own")

    def execute(self, value: Any) -> Any:
        began = time.monotonic()
        self.runs += 1
        try:
            for stage in self.stages:
                if stage.enabled:
                    value = self._stage(stage, value)
            return value
        finally:
            self.seconds += time.monotonic() - began

    def _stage(self, stage: Stage, value: Any) -> Any:
        tries = 1 + (stage.retries if stage.on_failure == "retry" else 0)
        for attempt in range(tries):
            began = time.monotonic()
            try:
                out = stage.run(value)
                if stage.timeout is not None and time.monotonic() - began > stage.timeout:
                    raise TimeoutError(f"{stage.name} took more than {stage.timeout} s")
                self.by_stage[stage.name] = self.by_stage.get(stage.name, 0) + 1
                return out
            except Exception as e:
                self.failures += 1
                if stage.on_failure == "continue":
                    return value
                if attempt == tries - 1:
                    raise StageError(f"{self.name}, {stage.name}: {e}") from e
        return value


class Pipelines:
    """Pipelines by name, and which ones an index has."""

    def __init__(self) -> None:
        self._all: dict[tuple[str, str], Pipeline] = {}
        self._of: dict[tuple[str, str], str] = {}

    def create(self, pipeline: Pipeline) -> None:
        key = (pipeline.type, pipeline.name)
        if key in self._all:
            raise ValueError(f"{pipeline.name} is there already")
        self._all[key] = pipeline

    def get(self, type_: str, name: str) -> Pipeline:
        return self._all[type_, name]

    def list(self, type_: str | None = None) -> list[Pipeline]:
        return [p for (t, _), p in sorted(self._all.items()) if type_ in (None, t)]

    def delete(self, type_: str, name: str) -> None:
        if any(n == name and t == type_ for (_, t), n in self._of.items()):
            raise ValueError(f"{name} is in use")
        del self._all[type_, name]

    def associate(self, index: str, type_: str, name: str) -> None:
        self.get(type_, name)
        self._of[index, type_] = name

    def disassociate(self, index: str, type_: str) -> None:
        self._of.pop((index, type_), None)

    def of(self, index: str, type_: str) -> Pipeline | None:
        name = self._of.get((index, type_))
        return self._all[type_, name] if name else None

    def search(self, service: SearchService, index: str, body: dict | None) -> SearchResponse:
        """A search whose request and hits go through the index's pipelines."""
        body = dict(body or {})
        if p := self.of(index, "query"):
            body = p.execute(body)
        response = service.search(index, SearchRequest.parse(body))
        if p := self.of(index, "result"):
            response.hits = p.execute(response.hits)
        return response

    def documents(self, index: str, docs: DataFrame) -> DataFrame:
        p = self.of(index, "document")
        return p.execute(docs) if p else docs


def synonym_stage(synonyms: dict[str, list[str]], name: str = "synonyms") -> Stage:
    """Adds synonyms of a match's words to its query text."""

    def rewrite(node: Any) -> Any:
        if isinstance(node, list):
            return [rewrite(x) for x in node]
        if not isinstance(node, dict):
            return node
        out = {}
        for key, value in node.items():
            if key == "match" and isinstance(value, dict):
                out[key] = {f: _expand(v, synonyms) for f, v in value.items()}
            else:
                out[key] = rewrite(value)
        return out

    return Stage(name, rewrite)


def _expand(spec: Any, synonyms: dict[str, list[str]]) -> Any:
    text = spec["query"] if isinstance(spec, dict) else str(spec)
    words = [x for w in text.split() for x in (w, *synonyms.get(w.lower(), ()))]
    return spec | {"query": " ".join(words)} if isinstance(spec, dict) else " ".join(words)


def spelling_stage(vocabulary: dict[str, int], name: str = "spelling") -> Stage:
    """Replaces a match's unknown words by the most frequent known word one edit away."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def correct(word: str) -> str:
        low = word.lower()
        if low in vocabulary:
            return word
        halves = [(low[:i], low[i:]) for i in range(len(low) + 1)]
        near = {a + b[1:] for a, b in halves if b} | {a + c + b[1:] for a, b in halves if b for c in letters} | {a + c + b for a, b in halves for c in letters} | {a + b[1] + b[0] + b[2:] for a, b in halves if len(b) > 1}
        found = [(vocabulary[w], w) for w in near if w in vocabulary]
        return max(found)[1] if found else word

    def rewrite(node: Any) -> Any:
        if isinstance(node, list):
            return [rewrite(x) for x in node]
        if not isinstance(node, dict):
            return node
        return {k: {f: (v | {"query": " ".join(map(correct, v["query"].split()))} if isinstance(v, dict) else " ".join(map(correct, str(v).split()))) for f, v in value.items()} if k == "match" and isinstance(value, dict) else rewrite(value) for k, value in node.items()}

    return Stage(name, rewrite)


def rerank_stage(weights: dict[str, float], name: str = "rerank") -> Stage:
    """Orders hits by a weighted sum of columns."""

    def run(hits: DataFrame) -> DataFrame:
        score = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
        return hits.withColumn("_score", score).orderBy(F.desc("_score"), "_id")

    return Stage(name, run)
