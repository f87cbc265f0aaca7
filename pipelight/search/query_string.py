"""The query-string languages, as the DSL's own nodes."""

from __future__ import annotations

import re

from .query import Node

_TOKEN = re.compile(r"\s*(?:(?P<paren>[()])|(?P<range>(?:[\w.]+:)?[\[{][^\]}]*\bTO\b[^\]}]*[\]}])|(?P<phrase>[+-]?(?:[\w.]+:)?\"[^\"]*\"(?:~\d+)?(?:\^[\d.]+)?)|(?P<word>[^\s()|]+)|(?P<bar>\|\|?))")


def parse_query_string(text: str, fields: list[str], default: str = "or", simple: bool = False) -> Node:
    """simple: the language in which nothing is an error, with + | - for and, or, not."""
    tokens = [(m.lastgroup, m.group(m.lastgroup)) for m in _TOKEN.finditer(text)]
    p = _Parser(tokens, fields, default.lower(), simple)
    node = p.alternatives()
    if p.at < len(tokens) and not simple:
        raise ValueError(f"unexpected {tokens[p.at][1]!r} in the query string")
    return node or Node("match_none" if text.strip() else "match_all")


class _Parser:
    def __init__(self, tokens, fields, default, simple) -> None:
        self.tokens, self.fields, self.default, self.simple, self.at = tokens, fields, default, simple, 0

    def now(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, "")

    def is_word(self, *words: str) -> bool:
        kind, text = self.now()
        return (kind == "word" and text in words and not self.simple) or (kind == "bar" and "OR" in words)

    def alternatives(self) -> Node | None:
        parts = [self.sequence()]
        while self.is_word("OR", "||"):
            self.at += 1
            parts.append(self.sequence())
        parts = [p for p in parts if p]
        return parts[0] if len(parts) == 1 else Node("bool", children={"should": parts}) if parts else None

    def sequence(self) -> Node | None:
        """Clauses side by side, joined by AND, NOT, +, - or the default operator."""
        clauses: list[tuple[str, Node]] = []
        joined = False
        while self.at < len(self.tokens) and not self.is_word("OR", "||"):
            kind, text = self.now()
            if kind == "paren" and text == ")":
                break
            if self.is_word("AND", "&&"):
                self.at += 1
                joined = True
                if clauses and clauses[-1][0] == "should":
                    clauses[-1] = ("must", clauses[-1][1])
                continue
            sign = "should"
            if self.is_word("NOT", "!"):
                self.at += 1
                sign = "must_not"
            elif kind in ("word", "phrase") and text[0] in "+-!" and len(text) > 1:
                sign = "must" if text[0] == "+" else "must_not"
                self.tokens[self.at] = (kind, text[1:])
            elif kind == "word" and text in "+-":
                self.at += 1
                if self.simple and text == "+" and clauses:
                    joined = True
                    clauses[-1] = ("must", clauses[-1][1]) if clauses[-1][0] == "should" else clauses[-1]
                    continue
                sign = "must_not" if text == "-" else "must"
                if self.at >= len(self.tokens):
                    break
            node = self.clause()
            if node:
                clauses.append(("must" if sign == "should" and (joined or self.default == "and") else sign, node))
            joined = False
        if not clauses:
            return None
        if len(clauses) == 1 and clauses[0][0] != "must_not":
            return clauses[0][1]
        children: dict[str, list[Node]] = {}
        for sign, node in clauses:
            children.setdefault(sign, []).append(node)
        return Node("bool", children=children)

    def clause(self) -> Node | None:
        kind, text = self.now()
        self.at += 1
        if kind == "paren":
            inner = self.alternatives()
            if self.now() == ("paren", ")"):
                self.at += 1
            elif not self.simple:
                raise ValueError("a bracket is open in the query string")
            return inner
        boost = 1.0
        if m := re.search(r"\^([\d.]+)$", text):
            boost, text = float(m.group(1)), text[: m.start()]
        field = None
        if (m := re.match(r"([A-Za-z_][\w.]*):(.+)$", text, re.S)) and not self.simple:
            field, text = m.group(1), m.group(2)
        names = [field] if field else self.fields
        if field == "_exists_":
            return Node("exists", text)
        nodes = [n for n in (self.leaf(f.partition("^")[0], kind, text, boost * float(f.partition("^")[2] or 1)) for f in names) if n]
        return nodes[0] if len(nodes) == 1 else Node("bool", children={"should": nodes}) if nodes else None

    def leaf(self, field: str, kind: str | None, text: str, boost: float) -> Node | None:
        if kind == "range":
            m = re.match(r"([\[{])\s*(\S+)\s+TO\s+(\S+?)\s*([\]}])$", text)
            if not m:
                raise ValueError(f"not a range: {text!r}")
            low, high = m.group(2), m.group(3)
            bounds = {("gte" if m.group(1) == "[" else "gt"): _number(low)} if low != "*" else {}
            bounds |= {("lte" if m.group(4) == "]" else "lt"): _number(high)} if high != "*" else {}
            return Node("range", field, bounds | {"boost": boost}) if bounds else Node("exists", field)
        if kind == "phrase":
            m = re.match(r"\"([^\"]*)\"(?:~(\d+))?", text)
            return Node("match_phrase", field, {"query": m.group(1), "slop": int(m.group(2) or 0), "boost": boost})
        if m := re.match(r"(>=|<=|>|<)(.+)$", text):
            return Node("range", field, {{">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}[m.group(1)]: _number(m.group(2)), "boost": boost})
        if text == "*":
            return Node("exists", field)
        if "*" in text or ("?" in text and not self.simple):
            return Node("prefix", field, {"value": text[:-1].lower(), "boost": boost}) if text.endswith("*") and text.count("*") == 1 and "?" not in text else Node("wildcard", field, {"value": text.lower(), "boost": boost})
        if m := re.match(r"(.+)~(\d?)$", text):
            return Node("fuzzy", field, {"value": m.group(1).lower(), "fuzziness": int(m.group(2)) if m.group(2) else "AUTO", "boost": boost})
        return Node("match", field, {"query": text, "boost": boost})


def _number(text: str):
    try:
        return int(text) if re.fullmatch(r"-?\d+", text) else float(text)
    except ValueError:
        return text
