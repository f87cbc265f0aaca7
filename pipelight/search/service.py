"""Searches: a request over an index gives hits, a total and aggregations."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Catalog
from ..sources.scratch import materialize
from .aggs import aggregate
from .expressions import expression
from .query import Compiler, Node, parse_query

_KEYS = frozenset("query size from sort _source aggs aggregations script_fields highlight timeout track_total_hits".split())


@dataclass
class SearchRequest:
    query: dict | None = None
    #: hits at most; None: all that match
    size: int | None = 10
    from_: int = 0
    sort: list = field(default_factory=list)
    source: Any = True
    aggs: dict = field(default_factory=dict)
    #: name -> expression tree, computed for each hit
    script_fields: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, body: dict | str | None) -> SearchRequest:
        body = json.loads(body) if isinstance(body, str) else dict(body or {})
        if extra := set(body) - _KEYS:
            raise ValueError(f"a request has no {sorted(extra)[0]!r}")
        size, start = body.get("size", 10), int(body.get("from", 0))
        size = None if size is None else int(size)
        if (size or 0) < 0 or start < 0:
            raise ValueError("size and from are not negative")
        sort = body.get("sort", [])
        return cls(body.get("query"), size, start, sort if isinstance(sort, list) else [sort], body.get("_source", True), body.get("aggs") or body.get("aggregations") or {}, body.get("script_fields") or {})


@dataclass
class SearchResponse:
    hits: DataFrame
    matched: DataFrame
    aggregations: dict[str, DataFrame]

    def total(self) -> int:
        return self.matched.count()


class SearchService:
    def __init__(self, catalog: Catalog, udfs=None, id_columns: dict[str, str] | None = None) -> None:
        self.catalog, self.udfs, self.id_columns = catalog, udfs, id_columns or {}
        #: (index, field) -> number of rows, mean length and dictionary, of fields that were indexed
        self.indexed: dict[tuple[str, str], tuple[int, float, DataFrame]] = {}

    def id_column(self, index: str) -> Column:
        own = self.id_columns.get(index) or (self.catalog.order(index) or self.catalog.frame(index).columns)[-1]
        return F.col(own).cast("string")

    def build_index(self, index: str, field: str) -> None:
        """Store what scores need to know of a text field: its term dictionary, in the order of terms so that
        a lookup reads few row groups, and its mean length.  It holds for the rows as they are now."""
        tokens = self.catalog.text[index].of(field).column(F.col(field))
        n, mean = self.catalog.frame(index).agg(F.count(F.lit(1)), F.avg(F.size(tokens))).first()
        words = self.catalog.frame(index).select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))
        self.indexed[index, field] = (n, mean or 1.0, materialize(words.sort("term"), "dictionary"))

    def matching(self, index: str, query: dict | Node | None, scored: bool = True, avgdl: float | None = None) -> DataFrame:
        """Rows that match, with _id and, if scored, _score."""
        df = self.catalog.frame(index)
        node = query if isinstance(query, Node) else parse_query(query)
        settings = self.catalog.text[index]
        plain = Compiler(settings, self.udfs)
        leaves = plain.text_leaves(node)
        # a field's tokens are made once for the condition and the score
        tokens = {f: f"__tokens_{i}" for i, f in enumerate(dict.fromkeys(f for f, _ in leaves))}
        compiler = Compiler(settings, self.udfs, tokens)
        rows = df
        for f, c in tokens.items():  # a generator of one row: the optimizer doesn't copy what it makes into each use
            rows = rows.select("*", F.explode(F.array(plain.tokens(f))).alias(c))
        if scored:
            known = {f: self.indexed[index, f] for f in tokens if (index, f) in self.indexed}
            if len(known) == len(tokens):
                compiler.look_up(node, known, avgdl)
            else:
                compiler.gather(rows, node, avgdl)
        rows = rows.where(compiler.condition(node)).withColumn("_id", self.id_column(index))
        rows = rows.withColumn("_score", compiler.score(node).cast("double")) if scored else rows
        return rows.drop(*tokens.values())

    def search(self, index: str, body: dict | str | SearchRequest | None = None) -> SearchResponse:
        request = body if isinstance(body, SearchRequest) else SearchRequest.parse(body)
        keys = [_sort_key(s) for s in request.sort]
        scored = not keys or any(k == "_score" for k, _ in keys)
        matched = self.matching(index, request.query, scored)
        order = [(F.col(k).desc_nulls_last() if down else F.col(k).asc_nulls_first()) for k, down in keys] or [F.desc("_score")]
        hits = matched.orderBy(*order, "_id")
        hits = hits.offset(request.from_) if request.from_ else hits
        hits = hits if request.size is None else hits.limit(request.size)
        computed = {n: expression(spec.get("script", spec)) for n, spec in request.script_fields.items()}
        hits = _project(hits.withColumns(computed), request.source, list(computed))
        plain = Compiler(self.catalog.text[index], self.udfs)
        return SearchResponse(hits, matched, {n: aggregate(matched, n, spec, plain) for n, spec in request.aggs.items()})

    def count(self, index: str, query: dict | None = None) -> int:
        return self.matching(index, query, scored=False).count()

    def get(self, index: str, id_: str) -> DataFrame:
        """The row with this id; the comparison is on the column itself, so that it reaches the scan."""
        own = self.id_columns.get(index) or (self.catalog.order(index) or self.catalog.frame(index).columns)[-1]
        df = self.catalog.frame(index)
        return df.where(F.col(own) == F.lit(id_).cast(df.schema[own].dataType)).withColumn("_id", F.col(own).cast("string"))

    def postings(self, index: str, field: str) -> DataFrame:
        """(term, _id, position): where each term of a text field stands."""
        tokens = self.catalog.text[index].of(field).column(F.col(field))
        return self.catalog.frame(index).select(self.id_column(index).alias("_id"), F.posexplode(tokens).alias("position", "term"))

    def terms(self, index: str, field: str) -> DataFrame:
        """(term, doc_freq, total_freq): the term dictionary of a text field.

        A row's tokens are followed by its distinct ones, so that one aggregation by term counts both; only rows whose
        id is repeated or null, if there are any, are first counted by term and id.
        """
        tokens = self.catalog.text[index].of(field).column(F.col(field))
        # a generator of one row: the optimizer doesn't copy what it makes into each use
        rows = self.catalog.frame(index).select(self.id_column(index).alias("_id"), F.explode(F.array(tokens)).alias("tokens"))
        ids = self.catalog.frame(index).select(self.id_column(index).alias("_id")).groupBy("_id").agg(F.count(F.lit(1)).alias("n"))
        repeated = ids.where("n > 1 and _id is not null").select("_id")
        known = F.col("_id").isNotNull()
        whole = ids.agg(F.max("n"), F.max(F.col("_id").isNull())).first()
        again = None
        if whole[0] not in (None, 1) or whole[1]:
            again = rows.where(~known).unionAll(rows.where(known).join(repeated, "_id", "left_semi"))
            rows = rows.where(known).join(repeated, "_id", "left_anti")
        both = rows.select(F.size("tokens").alias("n"), "tokens").select("n", F.posexplode(F.concat("tokens", F.array_distinct("tokens"))).alias("at", "term"))
        found = both.select("term", (F.col("at") >= F.col("n")).cast("long").alias("doc"), (F.col("at") < F.col("n")).cast("long").alias("total"))
        if again is not None:
            pairs = again.select("_id", F.explode("tokens").alias("term")).groupBy("term", "_id").agg(F.count(F.lit(1)).alias("total"))
            found = found.unionByName(pairs.select("term", known.cast("long").alias("doc"), "total"))
        return found.groupBy("term").agg(F.sum("doc").alias("doc_freq"), F.sum("total").alias("total_freq"))

    def multi_search(self, lines: str) -> list[SearchResponse]:
        """Pairs of lines: a header with the index, then a request."""
        rows = [json.loads(x) for x in lines.splitlines() if x.strip()]
        if len(rows) % 2:
            raise ValueError("a header has no request")
        return [self.search(h["index"], b) for h, b in zip(rows[::2], rows[1::2], strict=True)]


def _sort_key(spec) -> tuple[str, bool]:
    if isinstance(spec, str):
        return spec, spec == "_score"
    name, value = next(iter(spec.items()))
    value = value.get("order", "asc") if isinstance(value, dict) else value
    if value not in ("asc", "desc"):
        raise ValueError(f"unknown order {value!r}")
    return name, value == "desc"


def _project(df: DataFrame, source, computed: list[str]) -> DataFrame:
    meta = [*computed, *(c for c in ("_id", "_score") if c in df.columns)]
    if source is True or source is None:
        return df
    if source is False:
        return df.select(*meta)
    if isinstance(source, dict):
        wanted = source.get("includes") or [c for c in df.columns if c not in meta]
        names = [c for c in wanted if c not in set(source.get("excludes") or [])]
    else:
        names = [source] if isinstance(source, str) else list(source)
    return df.select(*(n for n in names if n in df.columns and n not in meta), *meta)

