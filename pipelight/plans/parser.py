"""Recursive-descent parser of the piped query language: text -> Query."""

from __future__ import annotations

from ..functions.aggregates import NAMES as AGGREGATES
from .ast import Agg, Binary, Call, Case, Command, Exists, Field, InList, InQuery, Lit, Query, Scalar, Span, Unary
from .lexer import QueryError, Token, tokenize, unquote

_COMPARE = {"=": "=", "==": "=", "!=": "!=", "<>": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
#: Fixed unit names of spans.
UNITS = frozenset("s sec second seconds m min minute minutes h hr hour hours d day days w week weeks mon month months q quarter quarters y year years us ms".split())
_STOP_WORDS = frozenset("by as output".split())


def parse(text: str) -> Query:
    p = Parser(tokenize(text))
    query = p.query()
    p.expect_end()
    return query


class Parser:
    def __init__(self, tokens: list[Token]) -> None:
        self.tokens, self.at = tokens, 0

    # -- tokens ---------------------------------------------------------------------------------

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def fail(self, wanted: str):
        raise QueryError(f"expected {wanted} at {self.now.at}, found {self.now.text or 'the end'!r}")

    def take(self) -> Token:
        token = self.now
        self.at += 1
        return token

    def is_symbol(self, text: str) -> bool:
        return self.now.kind == "symbol" and self.now.text == text

    def is_word(self, *words: str) -> bool:
        return self.now.kind == "name" and self.now.low in words

    def symbol(self, text: str) -> bool:
        if self.is_symbol(text):
            self.at += 1
            return True
        return False

    def word(self, *words: str) -> str | None:
        return self.take().low if self.is_word(*words) else None

    def need_symbol(self, text: str) -> None:
        if not self.symbol(text):
            self.fail(repr(text))

    def need_word(self, word: str) -> None:
        if not self.word(word):
            self.fail(word)

    def expect_end(self) -> None:
        if self.now.kind != "end":
            self.fail("a pipe or the end")

    def name(self) -> str:
        if self.now.kind != "name":
            self.fail("a name")
        return self.take().text

    def field_name(self) -> str:
        if self.now.kind == "string" and self.now.text[0] == "`":
            return unquote(self.take().text)
        parts = [self.name()]
        while self.is_symbol(".") and self.peek().kind == "name":
            self.take()
            parts.append(self.name())
        return ".".join(parts)

    def names(self) -> list[str]:
        out = [self.field_name()]
        while self.symbol(","):
            out.append(self.field_name())
        return out

    def loose_names(self) -> list[str]:
        """Names with or without commas between them, up to a pipe, a bracket, an option or `by`."""
        out = []
        while self.now.kind == "name" and not self.option_ahead() and not self.is_word(*_STOP_WORDS):
            out.append(self.field_name())
            self.symbol(",")
        return out

    def string(self) -> str:
        if self.now.kind != "string":
            self.fail("a string")
        return unquote(self.take().text)

    def integer(self) -> int:
        if self.now.kind != "number" or not self.now.text.isdigit():
            self.fail("a whole number")
        return int(self.take().text)

    def option_ahead(self) -> bool:
        return self.now.kind == "name" and self.peek().kind == "symbol" and self.peek().text == "="

    def options(self, *known: str) -> dict:
        """name=value options, as long as the next name is a known one."""
        out = {}
        while self.option_ahead() and self.now.low in known:
            key = self.take().low
            self.take()
            out[key] = self.option_value(key)
        return out

    def option_value(self, key: str):
        if key == "span":
            return self.span()
        if self.now.kind == "string":
            return self.string()
        if self.now.kind == "number" or self.is_symbol("-"):
            sign = -1 if self.symbol("-") else 1
            text = self.take().text
            return sign * (int(text) if text.isdigit() else float(text))
        if self.now.kind == "name":
            text = self.field_name()
            return {"true": True, "false": False, "null": None}.get(text.lower(), text)
        self.fail("a value")

    def span(self) -> Span | str:
        if self.word("auto"):
            return "auto"
        if self.now.kind != "number":
            self.fail("a span")
        number = self.take()
        n = float(number.text)
        if self.now.kind == "name" and self.now.at == number.end:
            unit = self.take().text
            if unit.lower() not in UNITS:
                raise QueryError(f"unknown unit {unit!r} at {number.end}")
            return Span(n, unit.lower() if unit != "M" else "mon")
        return Span(n, "")

    # -- queries --------------------------------------------------------------------------------

    def query(self) -> Query:
        explain = bool(self.word("explain"))
        if self.is_word("describe", "showdatasources"):
            name = self.take().low
            return Query([Command(name, {"source": self.name()} if name == "describe" else {})], explain)
        if self.word("show"):
            self.need_word("datasources")
            return Query([Command("showdatasources")], explain)
        commands = [self.source()]
        while self.symbol("|"):
            commands.append(self.command())
        return Query(commands, explain)

    def source(self) -> Command:
        self.word("search")
        self.need_word("source")
        self.need_symbol("=")
        name = self.string() if self.now.kind == "string" else self.field_name()
        if not name:
            raise QueryError("the source has no name")
        # search source=x <condition> is a where
        found = Command("search", {"source": name})
        if self.now.kind != "end" and not self.is_symbol("|") and not self.is_symbol("]"):
            found.args["where"] = self.expr()
        return found

    def subquery(self) -> Query:
        self.need_symbol("[")
        query = self.query()
        self.need_symbol("]")
        return query

    def subpipeline(self) -> Query:
        self.need_symbol("[")
        self.symbol("|")
        commands = [self.command()]
        while self.symbol("|"):
            commands.append(self.command())
        self.need_symbol("]")
        return Query(commands)

    def command(self) -> Command:
        token = self.now
        word = self.name().lower()
        method = getattr(self, f"do_{word}", None)
        if method is None:
            raise QueryError(f"unknown command {token.text!r} at {token.at}")
        return Command(word, method())

    def do_where(self):
        return {"condition": self.expr()}

    def do_fields(self):
        mode = "-" if self.symbol("-") else "+"
        self.symbol("+")
        return {"exclude": mode == "-", "fields": self.names()}

    def do_table(self):
        out = self.loose_names()
        return {"fields": out} if out else self.fail("a field")

    def do_eval(self):
        out = []
        while True:
            name = self.field_name()
            self.need_symbol("=")
            out.append((name, self.expr()))
            if not self.symbol(","):
                return {"assignments": out}

    def do_rename(self):
        out = []
        while True:
            old = self.field_name()
            self.need_word("as")
            out.append((old, self.field_name()))
            if not self.symbol(","):
                return {"pairs": out}

    def do_replace(self):
        pairs = []
        while True:
            old = self.value_text()
            self.need_word("with")
            pairs.append((old, self.value_text()))
            if not self.symbol(","):
                break
        self.need_word("in")
        return {"pairs": pairs, "fields": self.names()}

    def value_text(self) -> str:
        return self.string() if self.now.kind == "string" else str(self.literal().value)

    def do_fillnull(self):
        if self.is_word("value") and self.option_ahead():
            self.take()
            self.take()
            value = self.literal().value
            self.word("fields")
            return {"value": value, "fields": self.loose_names()}
        out = []
        while True:
            name = self.field_name()
            self.need_symbol("=")
            out.append((name, self.literal().value))
            if not self.symbol(","):
                return {"assignments": out}

    def do_parse(self):
        if self.is_word("field") and self.option_ahead():
            self.take()
            self.take()
        return {"field": self.field_name(), "pattern": self.string()}

    def do_rex(self):
        name = self.options("field").get("field", "_raw")
        return {"field": name, "pattern": self.string()}

    def do_grok(self):
        opts = self.options("field", "keep")
        name = opts.get("field") or (self.field_name() if self.now.kind == "name" else "_raw")
        return {"field": name, "pattern": self.string(), "keep": bool(opts.get("keep", True))}

    def do_spath(self):
        opts = self.options("input", "path", "output")
        if "path" not in opts and self.now.kind in ("name", "string"):
            opts["path"] = self.string() if self.now.kind == "string" else self.field_name()
        return opts

    def do_flatten(self):
        return {"field": self.field_name()}

    def do_bin(self):
        name = self.field_name()
        opts = self.options("span", "bins", "range")
        if not opts:
            self.fail("span= or bins=")
        return {"field": name, **opts}

    def do_stats(self):
        return {"aggs": self.aggregates(), "by": self.by()}

    def do_eventstats(self):
        return {**self.options("bucket_nullable"), **self.do_stats()}

    def do_streamstats(self):
        opts = {}
        while self.option_ahead() and self.now.low in ("window", "current", "global", "reset_before", "reset_after"):
            if self.is_word("reset_before", "reset_after"):
                key = self.take().low
                self.take()
                opts[key] = self.primary()  # a condition in brackets
            else:
                opts |= self.options("window", "current", "global")
        return {"aggs": self.aggregates(), "by": self.by(), **opts}

    def do_chart(self):
        opts = self.options("span", "limit", "useother", "otherstr", "nullstr")
        aggs, by = self.aggregates(), self.by()
        return {"aggs": aggs, "by": by, **opts, **self.options("span", "limit", "useother", "otherstr", "nullstr")}

    def do_timechart(self):
        known = ("span", "bins", "limit", "useother", "otherstr", "timefield")
        opts = self.options(*known)
        aggs, by = self.aggregates(), self.by()
        return {"aggs": aggs, "by": by, **opts, **self.options(*known)}

    def by(self) -> list[str]:
        return self.names() if self.word("by") else []

    def aggregates(self) -> list[Agg]:
        out = [self.aggregate()]
        while self.symbol(",") or (self.now.kind == "name" and self.now.low in AGGREGATES and self.peek().text == "("):
            out.append(self.aggregate())
        return out

    def aggregate(self) -> Agg:
        token = self.now
        name = self.name().lower()
        if name not in AGGREGATES:
            raise QueryError(f"unknown aggregate {token.text!r} at {token.at}")
        args, distinct = [], False
        if self.symbol("("):
            distinct = bool(self.word("distinct"))
            while not self.symbol(")"):
                args.append(self.expr())
                self.symbol(",")
        elif name != "count":
            self.fail("'('")
        call = Call(name, tuple(args), distinct)
        return Agg(call, self.field_name() if self.word("as") else name)

    def do_sort(self):
        keys = []
        limit = self.integer() if self.now.kind == "number" else None
        while True:
            ascending = not self.symbol("-")
            if ascending:
                self.symbol("+")
            name = self.field_name()
            if self.word("desc", "d"):
                ascending = False
            elif self.word("asc", "a"):
                ascending = True
            keys.append((name, ascending))
            if not self.symbol(","):
                return {"keys": keys, "limit": limit}

    def do_head(self):
        return {"n": self.integer() if self.now.kind == "number" else 10}

    def do_reverse(self):
        return {}

    def do_dedup(self):
        n = self.integer() if self.now.kind == "number" else 1
        fields = self.names()
        opts = {}
        while True:
            if self.option_ahead():
                opts |= self.options("keepevents", "consecutive", "keepempty")
            elif self.word("sortby"):
                opts["sortby"] = self.do_sort()["keys"]
            else:
                return {"n": n, "fields": fields, **opts}

    def do_top(self):
        known = ("countfield", "percentfield", "showcount", "showperc", "limit", "useother", "otherstr")
        opts = self.options(*known)
        n = self.integer() if self.now.kind == "number" else opts.get("limit", 10)
        fields = self.names()
        by = self.by()
        return {"n": n, "fields": fields, "by": by, **opts, **self.options(*known)}

    do_rare = do_top

    def do_lookup(self):
        table = self.name()
        keys = []
        while True:
            key = self.field_name()
            keys.append((key, self.field_name() if self.word("as") else key))
            if not self.symbol(","):
                break
        out = []
        if self.word("output"):
            while True:
                name = self.field_name()
                out.append((name, self.field_name() if self.word("as") else name))
                if not self.symbol(","):
                    break
        return {"table": table, "keys": keys, "output": out}

    def do_append(self):
        return {"query": self.subquery()}

    def do_appendcol(self):
        opts = self.options("override")
        return {"override": bool(opts.get("override", False)), "query": self.subquery_or_pipeline()}

    def subquery_or_pipeline(self) -> Query:
        return self.subquery() if self.peek().low in ("search", "source", "explain") and self.peek().kind == "name" else self.subpipeline()

    def do_appendpipe(self):
        return {"query": self.subpipeline()}

    def do_join(self):
        kind = self.options("type").get("type", "inner")
        key = self.field_name()
        return {"type": str(kind).lower(), "key": key, "query": self.subquery()}

    def do_addtotals(self):
        opts = self.options("row", "col", "fieldname", "labelfield", "label")
        opts["fields"] = self.loose_names()
        return opts | self.options("row", "col", "fieldname", "labelfield", "label")

    def do_addcoltotals(self):
        opts = self.options("labelfield", "label", "fieldname")
        opts["fields"] = self.loose_names()
        return opts | self.options("labelfield", "label", "fieldname")

    # -- expressions ----------------------------------------------------------------------------

    def expr(self):
        left = self.conjunction()
        while self.word("or"):
            left = Binary("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.word("and"):
            left = Binary("and", left, self.negation())
        return left

    def negation(self):
        if self.is_word("not") and self.peek().low == "exists":
            self.take()
            self.take()
            return Exists(self.subquery(), True)
        if self.word("not") or self.symbol("!"):
            return Unary("not", self.negation())
        if self.is_word("exists") and self.peek().text == "[":
            self.take()
            return Exists(self.subquery(), False)
        return self.comparison()

    def comparison(self):
        left = self.sum()
        if self.now.kind == "symbol" and self.now.text in _COMPARE:
            op = _COMPARE[self.take().text]
            right = Scalar(self.subquery()) if self.is_symbol("[") else self.sum()
            return Binary(op, left, right)
        negated = self.is_word("not") and self.peek().low in ("in", "like", "between") and bool(self.take())
        if self.word("like"):
            out = Binary("like", left, self.sum())
            return Unary("not", out) if negated else out
        if self.is_word("between") and self.peek().text != "(":
            self.take()
            low = self.sum()
            self.need_word("and")
            out = Call("between", (left, low, self.sum()))
            return Unary("not", out) if negated else out
        if self.word("in"):
            if self.is_symbol("["):
                return InQuery(left, self.subquery(), negated)
            self.need_symbol("(")
            values = []
            while not self.symbol(")"):
                values.append(self.expr())
                self.symbol(",")
            return InList(left, tuple(values), negated)
        return left

    def sum(self):
        left = self.product()
        while self.now.kind == "symbol" and self.now.text in ("+", "-", "."):
            op = self.take().text
            left = Binary("concat" if op == "." else op, left, self.product())
        return left

    def product(self):
        left = self.sign()
        while self.now.kind == "symbol" and self.now.text in ("*", "/", "%"):
            left = Binary(self.take().text, left, self.sign())
        return left

    def sign(self):
        if self.symbol("-"):
            arg = self.sign()
            return Lit(-arg.value) if isinstance(arg, Lit) and isinstance(arg.value, (int, float)) and not isinstance(arg.value, bool) else Unary("-", arg)
        if self.symbol("+"):
            return self.sign()
        return self.primary()

    def literal(self) -> Lit:
        sign = -1 if self.symbol("-") else 1
        token = self.now
        if token.kind == "number":
            self.take()
            return Lit(sign * (int(token.text) if token.text.isdigit() else float(token.text)))
        if token.kind == "string":
            return Lit(self.string())
        if self.is_word("true", "false", "null"):
            return Lit({"true": True, "false": False, "null": None}[self.take().low])
        self.fail("a literal")

    def primary(self):
        token = self.now
        if self.symbol("("):
            inner = self.expr()
            self.need_symbol(")")
            return inner
        if token.kind in ("number", "string"):
            return self.literal()
        if token.kind != "name":
            self.fail("an expression")
        if token.low in ("true", "false", "null") and self.peek().text != "(":
            return self.literal()
        if token.low == "case" and self.peek().low == "when":
            return self.case()
        if self.peek().text == "(" and self.peek().kind == "symbol":
            return self.call()
        name = self.field_name()
        index = None
        if self.is_symbol("[") and self.peek().kind == "number" and self.peek(2).text == "]":
            self.take()
            index = self.integer()
            self.need_symbol("]")
        return Field(name, index)

    def case(self) -> Case:
        self.take()
        whens, default = [], None
        while self.word("when"):
            cond = self.expr()
            self.need_word("then")
            whens.append((cond, self.expr()))
        if self.word("else"):
            default = self.expr()
        self.need_word("end")
        return Case(tuple(whens), default)

    def call(self) -> Call:
        name = self.name()
        self.need_symbol("(")
        distinct = bool(self.is_word("distinct") and self.peek().text not in (",", ")") and self.take())
        args, options = [], []
        while not self.symbol(")"):
            if self.is_symbol("["):  # a list of fields, as multi_match takes
                self.take()
                listed = []
                while not self.symbol("]"):
                    listed.append(self.string() if self.now.kind == "string" else self.field_name())
                    self.symbol(",")
                args.append(Lit(listed))
            elif args and self.option_ahead() and name.lower() in RELEVANCE:
                key = self.take().low
                self.take()
                options.append((key, self.option_value(key)))
            elif name.lower() in ("cast", "try_cast") and args and self.now.kind == "name":
                args.append(Lit(self.name()))
            else:
                args.append(self.expr())
                if name.lower() in ("cast", "try_cast") and self.word("as"):
                    args.append(Lit(self.name()))
            if not self.symbol(",") and not self.is_symbol(")"):
                self.fail("',' or ')'")
        return Call(name, tuple(args), distinct, tuple(options))


#: Fixed names of relevance functions.
RELEVANCE = frozenset("match match_phrase match_phrase_prefix match_bool_prefix multi_match query_string simple_query_string".split())
