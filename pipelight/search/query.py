"""The JSON query DSL as Columns: parse and validate, then condition and score.

Scores: full-text leaves have BM25 scores, other leaves a constant; bool sums what its must and
should clauses score, filter and must_not score nothing.  BM25 needs the number of documents, the
mean length of each field and each term's document frequency: one aggregation over the index gives
one row with all of them, and the score is then a plain expression without a join or shuffle.
"""

from __future__ import annotations

import math
import re
import dataclasses
from functools import reduce
from operator import add
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import expression
from .text import Analyzer, TextSettings, analyzer

K1, B = 1.2, 0.75
_TYPES = frozenset("match_all match_none term terms range exists prefix wildcard fuzzy regexp match match_phrase match_phrase_prefix match_bool_prefix multi_match query_string simple_query_string bool expr udf wasm_udf".split())


@dataclasses.dataclass
class Node:
    kind: str
    field: str | None = None
    args: dict[str, Any] = dataclasses.field(default_factory=dict)
    children: dict[str, list[Node]] = dataclasses.field(default_factory=dict)

    @property
    def boost(self) -> float:
        return float(self.args.get("boost", 1.0))


def parse_query(body: dict | None) -> Node:
    """A query body as a Node; anything malformed raises ValueError."""
    if not body:
        return Node("match_all")
    if not isinstance(body, dict) or len(body) != 1:
        raise ValueError("a query is an object with one key, its type")
    kind, spec = next(iter(body.items()))
    if kind not in _TYPES:
        raise ValueError(f"unknown query type {kind!r}")
    if kind in ("match_all", "match_none"):
        return Node(kind, args=dict(spec or {}))
    if not isinstance(spec, dict) or not spec:
        raise ValueError(f"{kind} needs an object")
    if kind == "bool":
        known = ("must", "should", "filter", "must_not")
        if extra := set(spec) - {*known, "minimum_should_match", "boost"}:
            raise ValueError(f"bool has no {sorted(extra)[0]!r}")
        children = {k: [parse_query(q) for q in (spec[k] if isinstance(spec[k], list) else [spec[k]])] for k in known if spec.get(k)}
        return Node(kind, args={k: spec[k] for k in ("minimum_should_match", "boost") if k in spec}, children=children)
    if kind == "exists":
        if not spec.get("field"):
            raise ValueError("exists needs a field")
        return Node(kind, spec["field"])
    if kind in ("multi_match", "query_string", "simple_query_string"):
        if not isinstance(spec.get("query"), str):
            raise ValueError(f"{kind} needs a query text")
        return Node(kind, args=dict(spec))
    if kind == "expr":
        return Node(kind, args={"tree": spec.get("expr", spec)})
    if kind in ("udf", "wasm_udf"):
        if not spec.get("name"):
            raise ValueError(f"{kind} needs a name")
        return Node("udf", args=dict(spec))
    boost = {k: spec[k] for k in ("boost",) if kind == "terms" and k in spec}
    named = {k: v for k, v in spec.items() if k not in boost}
    if len(named) != 1:
        raise ValueError(f"{kind} takes one field")
    name, value = next(iter(named.items()))
    if kind == "terms":
        if not isinstance(value, list):
            raise ValueError("terms needs a list")
        return Node(kind, name, {"values": value, **boost})
    if kind == "range":
        if not isinstance(value, dict) or not set(value) & {"gt", "gte", "lt", "lte"}:
            raise ValueError("range needs a bound")
        return Node(kind, name, dict(value))
    key = "query" if kind.startswith("match") else "value"
    args = dict(value) if isinstance(value, dict) else {key: value}
    if key not in args:
        raise ValueError(f"{kind} needs {key!r}")
    return Node(kind, name, args)


def fuzziness(value: Any, text: str) -> int:
    if value in (None, "AUTO", "auto"):
        return 0 if len(text) < 3 else 1 if len(text) < 6 else 2
    return int(value)


def minimum_should_match(value: Any, n: int) -> int:
    if isinstance(value, str) and value.endswith("%"):
        share = int(value[:-1]) * n / 100
        return math.floor(share) if share >= 0 else n + math.ceil(share)
    value = int(value)
    return value if value >= 0 else n + value


def wildcard_regex(pattern: str) -> str:
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


class Compiler:
    """Conditions and scores of Nodes over the columns of one index."""

    def __init__(self, settings: TextSettings | None = None, udfs=None, token_columns: dict[str, str] | None = None) -> None:
        self.settings = settings or TextSettings()
        self.udfs = udfs
        #: text field -> a column that already holds its tokens
        self.token_columns = token_columns or {}
        self.stats: dict[str, float] = {}

    # -- leaves ---------------------------------------------------------------------------------

    def tokens(self, name: str, own: Analyzer | None = None) -> Column:
        if own is None and name in self.token_columns:
            return F.col(self.token_columns[name])
        return (own or self.settings.of(name)).column(F.col(name))

    def _any(self, name: str, test) -> Column:
        """test on the value of a keyword field, or on any token of a text field."""
        return F.exists(self.tokens(name), test) if self.settings.is_text(name) else F.coalesce(test(F.col(name).cast("string")), F.lit(False))

    def _terms_of(self, node: Node) -> tuple[list[str], Analyzer | None]:
        own = analyzer(node.args["analyzer"]) if node.args.get("analyzer") else None
        return (own or self.settings.of(node.field)).tokens(str(node.args["query"])), own

    def condition(self, node: Node) -> Column:
        return getattr(self, f"_if_{node.kind}")(node)

    def _if_match_all(self, node):
        return F.lit(True)

    def _if_match_none(self, node):
        return F.lit(False)

    def _if_term(self, node):
        value = node.args["value"]
        if self.settings.is_text(node.field):
            return F.array_contains(self.tokens(node.field), F.lit(str(value)))
        return F.coalesce(F.col(node.field) == F.lit(value), F.lit(False))

    def _if_terms(self, node):
        values = node.args["values"]
        if not values:
            return F.lit(False)
        if self.settings.is_text(node.field):
            return F.arrays_overlap(self.tokens(node.field), F.array(*(F.lit(str(v)) for v in values)))
        return F.coalesce(F.col(node.field).isin(*values), F.lit(False))

    def _if_range(self, node):
        c = F.col(node.field)
        tests = {"gt": c.__gt__, "gte": c.__ge__, "lt": c.__lt__, "lte": c.__le__}
        parts = [tests[k](F.lit(v)) for k, v in node.args.items() if k in tests and v is not None]
        return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))

    def _if_exists(self, node):
        return F.col(node.field).isNotNull()

    def _if_prefix(self, node):
        return self._any(node.field, lambda t: t.startswith(str(node.args["value"])))

    def _if_wildcard(self, node):
        return self._any(node.field, lambda t: t.rlike(wildcard_regex(str(node.args["value"]))))

    def _if_regexp(self, node):
        return self._any(node.field, lambda t: t.rlike(f"^(?:{node.args['value']})$"))

    def _if_fuzzy(self, node):
        value = str(node.args["value"])
        most = fuzziness(node.args.get("fuzziness"), value)
        return self._any(node.field, lambda t: F.levenshtein(t, F.lit(value), most) >= 0)

    def _if_match(self, node):
        terms, own = self._terms_of(node)
        if not terms:
            return F.lit(False)
        tokens = self.tokens(node.field, own)
        if node.args.get("fuzziness") is not None:
            near = lambda w: F.exists(tokens, lambda t: F.levenshtein(t, F.lit(w), fuzziness(node.args["fuzziness"], w)) >= 0)
            each = [near(w) for w in terms]
        elif str(node.args.get("operator", "or")).lower() == "or" and node.args.get("minimum_should_match") is None:
            return F.arrays_overlap(tokens, F.array(*(F.lit(t) for t in dict.fromkeys(terms))))
        else:
            each = [F.array_contains(tokens, F.lit(t)) for t in dict.fromkeys(terms)]
        if str(node.args.get("operator", "or")).lower() == "and":
            return reduce(lambda a, b: a & b, each)
        least = minimum_should_match(node.args.get("minimum_should_match", 1), len(each))
        return reduce(add, (e.cast("int") for e in each)) >= least

    def _joined(self, node) -> tuple[list[str], Column, Column]:
        terms, own = self._terms_of(node)
        tokens = self.tokens(node.field, own)
        return terms, tokens, F.concat(F.lit(" "), F.concat_ws(" ", tokens), F.lit(" "))

    def _if_match_phrase(self, node):
        terms, tokens, joined = self._joined(node)
        if not terms:
            return F.lit(False)
        slop = int(node.args.get("slop", 0))
        if not slop:  # tokens hold no blanks, so adjacent tokens are a substring
            return joined.contains(f" {' '.join(terms)} ")
        width = len(terms) + slop
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), lambda i: F.element_at(tokens, i).isin(*terms))
        near = F.exists(starts, lambda i: reduce(lambda a, b: a & b, (F.array_contains(F.slice(tokens, i, width), F.lit(t)) for t in dict.fromkeys(terms))))
        return (F.size(tokens) > 0) & near

    def _if_match_phrase_prefix(self, node):
        terms, _, joined = self._joined(node)
        return joined.contains(f" {' '.join(terms)}") if terms else F.lit(False)

    def _if_match_bool_prefix(self, node):
        terms, own = self._terms_of(node)
        if not terms:
            return F.lit(False)
        tokens = self.tokens(node.field, own)
        each = [F.array_contains(tokens, F.lit(t)) for t in terms[:-1]] + [F.exists(tokens, lambda t: t.startswith(terms[-1]))]
        return reduce(lambda a, b: a & b if str(node.args.get("operator", "or")).lower() == "and" else a | b, each)

    def fields_of(self, node: Node) -> list[str]:
        found = node.args.get("fields") or node.args.get("default_field") or list(self.settings.fields)
        found = [found] if isinstance(found, str) else list(found)
        if not found:
            raise ValueError(f"{node.kind} needs fields")
        return found

    def split_multi(self, node: Node) -> list[Node]:
        """A match for each field of multi_match; field^2 boosts."""
        kinds = {"phrase": "match_phrase", "phrase_prefix": "match_phrase_prefix", "bool_prefix": "match_bool_prefix"}
        kind = kinds.get(node.args.get("type", "best_fields"), "match")
        out = []
        for f in self.fields_of(node):
            name, _, boost = f.partition("^")
            args = {k: v for k, v in node.args.items() if k in ("query", "operator", "analyzer", "slop", "fuzziness", "minimum_should_match")}
            out.append(Node(kind, name, args | {"boost": float(boost or 1) * node.boost}))
        return out

    def _if_multi_match(self, node):
        if node.args.get("type") == "cross_fields" and str(node.args.get("operator", "or")).lower() == "and":
            fields = [f.partition("^")[0] for f in self.fields_of(node)]
            terms = self.settings.of(fields[0]).tokens(str(node.args["query"]))
            return reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (F.array_contains(self.tokens(f), F.lit(t)) for f in fields)) for t in terms)) if terms else F.lit(False)
        return reduce(lambda a, b: a | b, (self.condition(n) for n in self.split_multi(node)))

    def expanded(self, node: Node) -> Node:
        from .query_string import parse_query_string

        return parse_query_string(str(node.args["query"]), self.fields_of(node), str(node.args.get("default_operator", "or")), node.kind == "simple_query_string")

    def _if_query_string(self, node):
        return self.condition(self.expanded(node))

    _if_simple_query_string = _if_query_string

    def _if_bool(self, node):
        parts = [self.condition(n) for k in ("must", "filter") for n in node.children.get(k, [])]
        parts += [~self.condition(n) for n in node.children.get("must_not", [])]
        should = node.children.get("should", [])
        least = minimum_should_match(node.args.get("minimum_should_match", 0 if node.children.get("must") or node.children.get("filter") else 1), len(should)) if should else 0
        if should and least > 0:
            each = [self.condition(n) for n in should]
            parts.append(reduce(lambda a, b: a | b, each) if least == 1 else reduce(add, (e.cast("int") for e in each)) >= least)
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)

    def _if_expr(self, node):
        return F.coalesce(expression(node.args["tree"]).cast("boolean"), F.lit(False))

    def _if_udf(self, node):
        if self.udfs is None:
            raise ValueError("no registry of functions was given")
        return self.udfs.column(node.args["name"], node.args.get("version"), node.args.get("parameters") or {}).cast("boolean")

    # -- scores ---------------------------------------------------------------------------------

    def text_leaves(self, node: Node) -> list[tuple[str, str]]:
        """(field, term) that BM25 needs statistics of."""
        if node.kind == "bool":
            return [x for k in ("must", "should") for n in node.children.get(k, []) for x in self.text_leaves(n)]
        if node.kind == "multi_match":
            return [x for n in self.split_multi(node) for x in self.text_leaves(n)]
        if node.kind in ("query_string", "simple_query_string"):
            return self.text_leaves(self.expanded(node))
        if node.kind in ("match", "match_phrase", "match_bool_prefix", "match_phrase_prefix"):
            return [(node.field, t) for t in self._terms_of(node)[0]]
        if node.kind in ("term", "terms") and self.settings.is_text(node.field):
            return [(node.field, str(v)) for v in node.args.get("values", [node.args.get("value")])]
        return []

    def gather(self, df: DataFrame, node: Node, avgdl: float | None = None) -> None:
        """Corpus statistics of the query's terms: one row, whatever the corpus."""
        leaves = list(dict.fromkeys(self.text_leaves(node)))
        if not leaves:
            return
        fields = list(dict.fromkeys(f for f, _ in leaves))
        keys = {f: f"l{i}" for i, f in enumerate(fields)} | {leaf: f"d{i}" for i, leaf in enumerate(leaves)}
        row = df.agg(
            F.count(F.lit(1)).alias("n"),
            *(F.avg(F.size(self.tokens(f))).alias(keys[f]) for f in fields),
            *(F.sum(F.array_contains(self.tokens(f), F.lit(t)).cast("long")).alias(keys[f, t]) for f, t in leaves),
        ).first()
        self.stats = {"n": row["n"] or 0} | {f: avgdl or row[keys[f]] or 1.0 for f in fields} | {leaf: row[keys[leaf]] or 0 for leaf in leaves}

    def look_up(self, node: Node, known: dict, avgdl: float | None = None) -> None:
        """The same statistics from stored dictionaries; known: field -> (rows, mean length, dictionary)."""
        self.stats = {}
        for f, (n, mean, dictionary) in known.items():
            terms = sorted({t for g, t in self.text_leaves(node) if g == f})
            found = {r["term"]: r["doc_freq"] for r in dictionary.where(F.col("term").isin(terms)).collect()}  # a row for each of the query's terms at most
            self.stats |= {"n": n, f: avgdl or mean} | {(f, t): found.get(t, 0) for t in terms}

    def bm25(self, name: str, term: str) -> Column:
        n, df_ = self.stats["n"], self.stats[name, term]
        idf = math.log(1 + (n - df_ + 0.5) / (df_ + 0.5))
        tokens = self.tokens(name)
        tf = F.size(F.filter(tokens, lambda t: t == term)).cast("double")
        return F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size(tokens) / self.stats[name]))

    def score(self, node: Node) -> Column:
        zero = F.lit(0.0)
        if node.kind == "bool":
            parts = [self.score(n) for n in node.children.get("must", [])]
            parts += [F.when(self.condition(n), self.score(n)).otherwise(zero) for n in node.children.get("should", [])]
            return (reduce(add, parts) if parts else zero) * node.boost
        if node.kind == "multi_match":
            parts = [F.when(self.condition(n), self.score(n)).otherwise(zero) for n in self.split_multi(node)]
            best = node.args.get("type", "best_fields") in ("best_fields", "phrase", "phrase_prefix")
            return (F.greatest(*parts) if best else reduce(add, parts)) if len(parts) > 1 else parts[0]
        if node.kind in ("query_string", "simple_query_string"):
            return self.score(self.expanded(node)) * node.boost
        leaves = self.text_leaves(node)
        if leaves:
            return reduce(add, (self.bm25(f, t) for f, t in leaves)) * node.boost
        return F.lit(node.boost)
