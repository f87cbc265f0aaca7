"""Queries as DataFrames: each command extends the plan; Catalyst optimizes the whole.

A Flow carries the DataFrame and the order of its rows.  Order-sensitive commands use the order that
`sort` set, else the source's natural order; its key columns travel as hidden columns, which Catalyst
prunes wherever nothing needs them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, MapType, NumericType, StringType, TimestampNTZType, TimestampType

from ..functions import aggregates, scalar
from ..operators import grok
from ..operators.ordered import ROW, falling, framed, numbered, running, sort_columns
from ..search.query import Compiler as QueryCompiler
from ..search.query import Node
from ..search.text import TextSettings
from ..sources.catalog import Catalog
from .ast import Agg, Binary, Call, Case, Command, Exists, Field, InList, InQuery, Lit, Query, Scalar, Span, Unary
from .lexer import QueryError
from .parser import RELEVANCE, parse

_HIDDEN = "__o"
#: Commands whose result depends on the order of rows.
_ORDERED = frozenset("head dedup streamstats reverse appendcol".split())
_ORDERED_AGGREGATES = frozenset("first last earliest latest".split())
#: Fixed unit lengths in seconds; a month is 30 days and a year 365 in a span.
_SECONDS = {"us": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "mon": 2592000, "q": 7776000, "y": 31536000}
_SPELLED = {"sec": "s", "second": "s", "seconds": "s", "min": "m", "minute": "m", "minutes": "m", "hr": "h", "hour": "h", "hours": "h", "day": "d", "days": "d", "week": "w", "weeks": "w", "month": "mon", "months": "mon", "quarter": "q", "quarters": "q", "year": "y", "years": "y"}
#: Rows of a group up to which a window holds them in one task; larger groups are split.
GROUP_ROWS = 2_000_000
#: Columns that an eager discovery of names may find.
MOST_COLUMNS = 1000


@dataclass
class Flow:
    df: DataFrame
    order: list[tuple[str, bool]]
    time: str | None = None
    text: TextSettings | None = None

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(_HIDDEN)]

    def types(self) -> dict:
        return {f.name: f.dataType for f in self.df.schema}


class Engine:
    """Runs queries over a catalog."""

    def __init__(self, catalog: Catalog, udfs=None) -> None:
        self.catalog, self.udfs = catalog, udfs

    def query(self, text: str) -> DataFrame:
        return self.run(parse(text))

    def run(self, query: Query) -> DataFrame:
        first = query.commands[0]
        if first.name == "describe":
            return self.catalog.describe(first.args["source"])
        if first.name == "showdatasources":
            return self.catalog.show()
        flow = self.flow(query)
        out = flow.df.drop(*(c for c in flow.df.columns if c.startswith(_HIDDEN)))
        if query.explain:
            plan = out._jdf.queryExecution().toString()
            return out.sparkSession.createDataFrame([(plan,)], "plan string")
        return out

    def flow(self, query: Query, ordered: bool = False) -> Flow:
        first = query.commands[0]
        df = self.catalog.frame(first.args["source"])
        flow = Flow(df, [], self.catalog.time(first.args["source"]), self.catalog.text.get(first.args["source"]))
        if ordered or _needs_order(query.commands[1:]):
            flow = self.natural(flow, self.catalog.order(first.args["source"]))
        if "where" in first.args:
            flow = self.do_where(flow, condition=first.args["where"])
        return self.steps(flow, query.commands[1:])

    def steps(self, flow: Flow, commands: list[Command]) -> Flow:
        for command in commands:
            method = getattr(self, f"do_{command.name}", None)
            if method is None:
                raise QueryError(f"{command.name} can't stand here")
            flow = method(flow, **command.args)
        return flow

    def natural(self, flow: Flow, order: list[str]) -> Flow:
        if not order:
            return replace(flow, df=flow.df.withColumn(f"{_HIDDEN}0", F.monotonically_increasing_id()), order=[(f"{_HIDDEN}0", True)])
        return self.ordered(flow, [(c, True) for c in order])

    def ordered(self, flow: Flow, keys: list[tuple[str, bool]]) -> Flow:
        """flow with copies of the keys as hidden columns and as its order."""
        old = [n for n, _ in flow.order]
        base = flow.df.withColumns({f"{_HIDDEN}{i}": F.col(k) for i, (k, _) in enumerate(keys)} | {f"{_HIDDEN}{len(keys) + j}": F.col(n) for j, n in enumerate(old)})
        order = [(f"{_HIDDEN}{i}", up) for i, (_, up) in enumerate(keys)] + [(f"{_HIDDEN}{len(keys) + j}", up) for j, (_, up) in enumerate(flow.order)]
        return replace(flow, df=base, order=order)

    def need_order(self, flow: Flow) -> Flow:
        return flow if flow.order else self.natural(flow, [c for c, t in flow.types().items() if not isinstance(t, MapType)])

    # -- expressions ----------------------------------------------------------------------------

    def expr(self, node, flow: Flow) -> Column:
        out = self.value(node, flow)
        return F.lit(out.value) if isinstance(out, scalar.Literal) else out

    def value(self, node, flow: Flow):
        """A Column, or a Literal that was written as one."""
        if isinstance(node, Lit):
            return scalar.Literal(node.value)
        if isinstance(node, Field):
            found = self.field(node.name, flow)
            return found if node.index is None else F.get(found, node.index)
        if isinstance(node, Unary):
            arg = self.expr(node.arg, flow)
            return ~arg if node.op == "not" else -arg
        if isinstance(node, Binary):
            return self.binary(node, flow)
        if isinstance(node, Case):
            return scalar.call("case", [self.value(x, flow) for pair in node.whens for x in pair] + ([self.value(node.default, flow)] if node.default is not None else []))
        if isinstance(node, InList):
            found = self.expr(node.arg, flow).isin(*(self.expr(v, flow) for v in node.values)) if node.values else F.lit(False)
            return ~found if node.negated else found
        if isinstance(node, Call):
            if node.name.lower() in RELEVANCE:
                return self.relevance(node, flow)
            if self.udfs is not None and self.udfs.has(node.name):
                return self.udfs.apply(node.name, [self.expr(a, flow) for a in node.args])
            return scalar.call(node.name, [self.value(a, flow) for a in node.args])
        raise QueryError("a subquery can only stand as a condition of where, joined by and")

    def field(self, name: str, flow: Flow) -> Column:
        if name in flow.df.columns:
            return F.col(f"`{name}`")
        if "." in name and name.split(".")[0] in flow.df.columns:
            return F.col(".".join(f"`{p}`" for p in name.split(".")))
        raise QueryError(f"unknown field {name!r}; there are {', '.join(flow.columns)}")

    def binary(self, node: Binary, flow: Flow) -> Column:
        op = node.op
        if op in ("and", "or"):
            a, b = self.expr(node.left, flow), self.expr(node.right, flow)
            return a & b if op == "and" else a | b
        a, b = self.expr(node.left, flow), self.expr(node.right, flow)
        simple = {"=": a.__eq__, "!=": a.__ne__, "<": a.__lt__, "<=": a.__le__, ">": a.__gt__, ">=": a.__ge__, "-": a.__sub__, "*": a.__mul__}
        if op in simple:
            return simple[op](b)
        if op == "+":
            return F.concat(a.cast("string"), b.cast("string")) if isinstance(node.left, Lit) and isinstance(node.left.value, str) or isinstance(node.right, Lit) and isinstance(node.right.value, str) else a + b
        if op == "concat":
            return F.concat(a.cast("string"), b.cast("string"))
        if op == "like":
            return F.like(a, b)
        return F.try_divide(a, b) if op == "/" else F.try_mod(a, b)

    def relevance(self, node: Call, flow: Flow) -> Column:
        """Full-text conditions over a field of the flow."""
        args = [a.value if isinstance(a, Lit) else a.name if isinstance(a, Field) else None for a in node.args]
        name, options = node.name.lower(), dict(node.options)
        if name in ("multi_match", "query_string", "simple_query_string"):
            fields = args[0] if isinstance(args[0], list) else [args[0]]
            return QueryCompiler(flow.text).condition(Node(name, args={"query": args[1], "fields": fields} | options))
        return QueryCompiler(flow.text).condition(Node(name, args[0], {"query": args[1]} | options))

    # -- rows -----------------------------------------------------------------------------------

    def do_where(self, flow: Flow, condition) -> Flow:
        for part in _conjuncts(condition):
            flow = self.condition(flow, part)
        return flow

    def condition(self, flow: Flow, node) -> Flow:
        if isinstance(node, InQuery):
            sub = self.run(node.query)
            key = sub.columns[0]
            sub = sub.select(F.col(f"`{key}`").alias("__in")).where("__in is not null").distinct()
            return replace(flow, df=flow.df.join(sub, self.expr(node.arg, flow) == F.col("__in"), "left_anti" if node.negated else "left_semi"))
        if isinstance(node, Exists):
            one = self.run(node.query).limit(1).select(F.lit(1).alias("__one"))
            if node.negated:
                some = one.agg(F.count("*").alias("__some"))
                return replace(flow, df=flow.df.crossJoin(F.broadcast(some)).where("__some = 0").drop("__some"))
            return replace(flow, df=flow.df.crossJoin(F.broadcast(one)).drop("__one"))
        if isinstance(node, Binary) and isinstance(node.right, Scalar):
            sub = self.run(node.right.query)
            if len(sub.columns) != 1:
                raise QueryError("a scalar subquery gives one column")
            # one row, or none: anything else matches nothing
            one = sub.select(F.col(f"`{sub.columns[0]}`").alias("__v")).limit(2).agg(F.max("__v").alias("__scalar"), F.count(F.lit(1)).alias("__rows"))
            joined = flow.df.crossJoin(F.broadcast(one))
            test = self.binary(replace(node, right=Field("__scalar")), replace(flow, df=joined))
            return replace(flow, df=joined.where(test & (F.col("__rows") == 1)).drop("__scalar", "__rows"))
        return replace(flow, df=flow.df.where(self.expr(node, flow)))

    def do_fields(self, flow: Flow, exclude: bool, fields: list[str]) -> Flow:
        if exclude:
            return replace(flow, df=flow.df.drop(*fields))
        return replace(flow, df=flow.df.select(*(self.field(f, flow).alias(f) for f in dict.fromkeys(fields)), *_hidden(flow)))

    def do_table(self, flow: Flow, fields: list[str]) -> Flow:
        known = set(flow.columns)
        return replace(flow, df=flow.df.select(*((F.col(f"`{f}`") if f in known else F.lit(None).cast("string")).alias(f) for f in dict.fromkeys(fields)), *_hidden(flow)))

    def do_eval(self, flow: Flow, assignments: list) -> Flow:
        for name, node in assignments:
            flow = replace(flow, df=flow.df.withColumn(name, self.expr(node, flow)))
        return flow

    def do_rename(self, flow: Flow, pairs: list) -> Flow:
        for old, new in pairs:
            self.field(old, flow)
            df = flow.df.drop(new) if new in flow.df.columns and new != old else flow.df
            flow = replace(flow, df=df.withColumnRenamed(old, new), time=new if flow.time == old else flow.time)
        return flow

    def do_replace(self, flow: Flow, pairs: list, fields: list[str]) -> Flow:
        for f in fields:
            text = self.field(f, flow).cast("string")
            for old, new in pairs:
                if len(old) > 1 and old.startswith("/") and old.endswith("/"):
                    text = F.regexp_replace(text, old[1:-1], new)
                else:
                    text = F.replace(text, F.lit(old), F.lit(new))
            flow = replace(flow, df=flow.df.withColumn(f, text))
        return flow

    def do_fillnull(self, flow: Flow, value=None, fields: list[str] | None = None, assignments: list | None = None) -> Flow:
        wanted = dict(assignments) if assignments else dict.fromkeys(fields or flow.columns, value)
        types, new = flow.types(), {}
        for name, v in wanted.items():
            if name not in types:
                new[name] = F.lit(v)  # a column that is missing is null everywhere
            elif isinstance(v, bool) or isinstance(types[name], StringType) or (isinstance(types[name], NumericType) and isinstance(v, (int, float))):
                fits = isinstance(types[name], StringType) or isinstance(v, (int, float))
                filler = F.lit(str(v) if isinstance(types[name], StringType) else v).try_cast(types[name])
                new[name] = F.coalesce(F.col(f"`{name}`"), filler) if fits else F.col(f"`{name}`")
            elif not isinstance(types[name], (ArrayType, NumericType)):
                new[name] = F.coalesce(F.col(f"`{name}`"), F.lit(str(v)).try_cast(types[name]))
        return replace(flow, df=flow.df.withColumns(new))

    def do_parse(self, flow: Flow, field: str, pattern: str) -> Flow:
        self.field(field, flow)
        return replace(flow, df=grok.extract(flow.df, field, pattern))

    do_rex = do_parse

    def do_grok(self, flow: Flow, field: str, pattern: str, keep: bool = True) -> Flow:
        self.field(field, flow)
        return replace(flow, df=grok.grok(flow.df, field, pattern, keep))

    def do_spath(self, flow: Flow, input: str = "_raw", path: str | None = None, output: str | None = None) -> Flow:
        text = self.field(input, flow)
        if path:
            name = output or [p for p in path.replace("]", "").replace("[", ".").split(".") if p and p != "$"][-1]
            return replace(flow, df=flow.df.withColumn(name, F.get_json_object(text, scalar.jsonfn.path_of(path))))
        # all top-level keys: the keys are found by an eager query, for a plan's columns are fixed
        keys = self.few(flow.df.select(F.explode(F.json_object_keys(text)).alias("k")))
        parsed = F.from_json(text, "map<string,string>")
        return replace(flow, df=flow.df.withColumns({k: F.try_element_at(parsed, F.lit(k)) for k in keys}))

    def do_flatten(self, flow: Flow, field: str) -> Flow:
        self.field(field, flow)
        if not isinstance(flow.types()[field], ArrayType):
            return flow
        names = flow.df.columns
        return replace(flow, df=flow.df.select(*(F.explode_outer(field).alias(field) if c == field else F.col(f"`{c}`") for c in names)))

    def do_bin(self, flow: Flow, field: str, span=None, bins: int | None = None, range: str | None = None) -> Flow:  # noqa: A002
        x, kind = self.field(field, flow), flow.types()[field]
        is_time = isinstance(kind, (TimestampType, TimestampNTZType, DateType))
        if span == "auto" or (range == "auto" and bins):
            low, high = flow.df.agg(*(f(x.cast("timestamp").cast("double") if is_time else x.cast("double")) for f in (F.min, F.max))).first()
            n = int(bins or 100)
            width = max((high or 0) - (low or 0), 1e-9)
            size = next((s for s in (1, 60, 300, 600, 1800, 3600, 10800, 21600, 43200, 86400, 604800, 2592000) if width / s <= n), 31536000) if is_time else _round_size(width / n)
            return replace(flow, df=flow.df.withColumn(field, time_bucket(x, Span(size, "s"), kind) if is_time else F.floor(x / size) * size))
        if span is not None:
            value = time_bucket(x, span, kind) if is_time else F.floor(x / span.n) * span.n
        else:
            size = 100 / float(bins)
            value = F.floor(x / size) * size
        return replace(flow, df=flow.df.withColumn(field, value))

    # -- aggregates -----------------------------------------------------------------------------

    def agg_column(self, agg: Agg, flow: Flow) -> Column:
        call = agg.call
        args = [self.expr(a, flow) for a in call.args[:1]] + [a.value for a in call.args[1:] if isinstance(a, Lit)]
        if call.name in _ORDERED_AGGREGATES and not flow.order and call.name in ("earliest", "latest") and not flow.time:
            raise QueryError(f"{call.name} needs a time column")
        time = flow.time if flow.time in flow.df.columns else None
        types = flow.types()
        order = [F.col(n) if ascending else falling(F.col(n), types[n]) for n, ascending in flow.order] if call.name in _ORDERED_AGGREGATES else []
        return aggregates.build(call.name, args, call.distinct, order, time)

    def grouped(self, flow: Flow, aggs: list[Agg]) -> tuple[Flow, list[Column]]:
        """The aggregates for groupBy().agg(), over the flow that is returned: percentile_approx is the exact discrete
        percentile there, whose argument must be a named column."""
        columns = []
        for i, a in enumerate(aggs):
            x = self.expr(a.call.args[0], flow) if a.call.args else None
            if x is None or aggregates.ALIASES.get(a.call.name.lower(), a.call.name.lower()) != "percentile_approx":
                columns.append(self.agg_column(a, flow))
                continue
            name = f"__percentile{i}"
            flow = replace(flow, df=flow.df.withColumn(name, x))
            p = next((v.value for v in a.call.args[1:] if isinstance(v, Lit)), 50)
            columns.append(aggregates.percentile_disc(name, p).cast(flow.types()[name]))
        return flow, columns

    def named(self, aggs: list[Agg], taken: list[str]) -> list[str]:
        out = []
        for a in aggs:
            name = a.name
            if name in out or name in taken:
                inner = a.call.args[0].name if a.call.args and isinstance(a.call.args[0], Field) else str(len(out))
                name = f"{name}({inner})"
            out.append(name)
        return out

    def do_stats(self, flow: Flow, aggs: list[Agg], by: list[str]) -> Flow:
        keys = [self.field(b, flow).alias(b) for b in by]
        flow, columns = self.grouped(flow, aggs)
        columns = [c.alias(n) for c, n in zip(columns, self.named(aggs, by), strict=True)]
        df = flow.df.groupBy(*keys).agg(*columns) if by else flow.df.agg(*columns)
        return Flow(df, [], flow.time if flow.time in by else None, flow.text)

    def do_chart(self, flow: Flow, aggs: list[Agg], by: list[str], span=None, limit: int = 10, useother: bool = True, otherstr: str = "OTHER", nullstr: str = "NULL") -> Flow:
        if span is not None and by:
            flow = self.do_bin(flow, by[0], span=span)
        if len(by) < 2:
            return self.do_stats(flow, aggs, by)
        return self.series(flow, aggs, by[0], by[1], int(limit), useother, otherstr, nullstr, pivot=True)

    def series(self, flow: Flow, aggs, row: str, column: str, limit: int, useother: bool, otherstr: str, nullstr: str | None, pivot: bool) -> Flow:
        """Aggregates by row and by the `limit` largest values of column; the rest are one series."""
        text = self.field(column, flow).cast("string")
        text = F.coalesce(text, F.lit(nullstr)) if nullstr else text
        df = flow.df.withColumn(column, text)
        if limit:
            scored, (score,) = self.grouped(replace(flow, df=df), aggs[:1])
            ranks = scored.df.groupBy(column).agg(score.alias("__score")).orderBy(F.desc_nulls_last("__score"), column).limit(limit)  # at most `limit` rows
            best = [r[0] for r in ranks.collect()]
            inside = F.col(column).isin(*[b for b in best if b is not None]) | (F.col(column).isNull() & F.lit(None in best))
            df = df.withColumn(column, F.when(inside, F.col(column)).otherwise(otherstr)) if useother else df.where(inside)
        else:
            best = self.few(df.select(column))
        flow, columns = self.grouped(replace(flow, df=df), aggs)
        columns, df = [c.alias(n) for c, n in zip(columns, self.named(aggs, [row, column]), strict=True)], flow.df
        if not pivot:
            return Flow(df.groupBy(row, column).agg(*columns), [], row, flow.text)
        values = [b for b in best if b is not None] + ([otherstr] if useother and limit else [])
        out = df.groupBy(row).pivot(column, list(dict.fromkeys(values))).agg(*columns)
        return Flow(out, [], row, flow.text)

    def do_timechart(self, flow: Flow, aggs: list[Agg], by: list[str], span=None, bins: int | None = None, limit: int = 0, useother: bool = True, otherstr: str = "OTHER", timefield: str | None = None) -> Flow:
        time = timefield or (flow.time if flow.time in flow.df.columns else None) or next((n for n, t in flow.types().items() if isinstance(t, (TimestampType, TimestampNTZType))), None)
        if time is None:
            raise QueryError("timechart needs a time column")
        if time != "_time":
            flow = replace(flow, df=flow.df.withColumn("_time", self.field(time, flow)))
        flow = self.do_bin(flow, "_time", span=span or "auto", bins=bins) if span or not bins else self.do_bin(flow, "_time", bins=bins, range="auto")
        if by and limit:
            return self.series(flow, aggs, "_time", by[0], int(limit), useother, otherstr, None, pivot=False)
        return self.do_stats(flow, aggs, ["_time", *by])

    def do_top(self, flow: Flow, n: int, fields: list[str], by: list[str], countfield: str = "count", percentfield: str = "percent", showcount: bool = True, showperc: bool = True, limit: int | None = None, useother: bool = False, otherstr: str = "OTHER", descending: bool = True) -> Flow:
        keys = [self.field(f, flow).alias(f) for f in dict.fromkeys([*by, *fields])]
        counts = flow.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__count"))
        group = [F.col(f"`{b}`") for b in by]
        totals = counts.groupBy(*group).agg(F.sum("__count").alias("__total"))
        first = F.col("__count").desc() if descending else F.col("__count").asc()
        ties = [F.col(f"`{f}`").asc() for f in fields]
        if by:
            best = counts.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy(first, *ties))).where(F.col("__rank") <= n)
            best = best.join(totals.select(*(F.col(f"`{b}`").alias(f"__k{i}") for i, b in enumerate(by)), "__total"), reduce(lambda a, b: a & b, (F.col(f"`{b}`").eqNullSafe(F.col(f"__k{i}")) for i, b in enumerate(by))))
        else:
            best = counts.orderBy(first, *ties).limit(int(n)).crossJoin(F.broadcast(totals))
        if useother:
            kept = best.groupBy(*group).agg(F.sum("__count").alias("__kept"), F.first("__total").alias("__total")).where("__total > __kept")
            other = kept.select(*group, *((F.lit(otherstr) if i == 0 else F.lit(None)).cast("string").alias(f) for i, f in enumerate(fields)), (F.col("__total") - F.col("__kept")).alias("__count"), "__total")
            best = best.select(*group, *(F.col(f"`{f}`").cast("string").alias(f) for f in fields), "__count", "__total").unionByName(other)
        out = best.select(*group, *(F.col(f"`{f}`") for f in fields), *([F.col("__count").alias(countfield)] if showcount else []), *([(F.col("__count") * 100.0 / F.col("__total")).alias(percentfield)] if showperc else []))
        return Flow(out, [(countfield, not descending)] if showcount else [], None, flow.text)

    def do_rare(self, flow: Flow, **args) -> Flow:
        return self.do_top(flow, **args, descending=False)

    def do_dedup(self, flow: Flow, n: int, fields: list[str], keepevents: bool = False, consecutive: bool = False, keepempty: bool = True, sortby: list | None = None) -> Flow:
        flow = self.ordered(flow, sortby) if sortby else self.need_order(flow)
        keys = [self.field(f, flow) for f in fields]
        df = flow.df
        if not keepempty:
            df = df.where(reduce(lambda a, b: a & b, (k.isNotNull() for k in keys)))
        if consecutive:
            pair = F.struct(*keys)
            # a row is one of a run's first n if its key differs from that of the row n before it, or a
            # change lies between
            before = {f"__lag{i}": (lambda w, i=i: F.lag(F.to_json(F.struct(pair.alias("k"))), i).over(w)) for i in range(1, n + 1)}
            df = framed(df, flow.order, before, n)
            own = F.to_json(F.struct(pair.alias("k")))
            keep = reduce(lambda a, b: a | b, (~own.eqNullSafe(F.col(f"__lag{i}")) for i in range(1, n + 1)))
            df = df.withColumn("__keep", keep).drop(*before)
        else:
            window = Window.partitionBy(*keys).orderBy(*sort_columns(flow.order))
            df = df.withColumn("__keep", F.row_number().over(window) <= n)
        if keepevents:
            df = df.withColumns({f: F.when(F.col("__keep"), F.col(f"`{f}`")) for f in fields})
        else:
            df = df.where("__keep")
        return replace(flow, df=df.drop("__keep"))

    # -- totals ---------------------------------------------------------------------------------

    def few(self, values: DataFrame) -> list:
        """The distinct values, which become columns; too many of them are an error, not cut off."""
        found = [r[0] for r in values.distinct().limit(MOST_COLUMNS + 1).collect()]
        if len(found) > MOST_COLUMNS:
            raise QueryError(f"there are more than {MOST_COLUMNS} values of {values.columns[0]} to make columns of")
        return sorted(found, key=lambda v: (v is not None, v))

    def numeric(self, flow: Flow, fields: list[str]) -> list[str]:
        if fields:
            for f in fields:
                self.field(f, flow)
            return fields
        return [c for c, t in flow.types().items() if isinstance(t, NumericType) and not c.startswith(_HIDDEN)]

    def row_total(self, flow: Flow, fields: list[str]) -> Column:
        return reduce(add, (F.coalesce(F.col(f"`{f}`").try_cast("double"), F.lit(0.0)) for f in fields), F.lit(0.0))

    def do_addtotals(self, flow: Flow, fields: list[str], row: bool = True, col: bool = False, fieldname: str = "total", labelfield: str | None = None, label: str = "Total") -> Flow:
        wanted = self.numeric(flow, fields)
        if row:
            flow = replace(flow, df=flow.df.withColumn(fieldname, self.row_total(flow, wanted)))
        if not col:
            return flow
        summed = [*wanted, *([fieldname] if row else [])]
        types = flow.types()
        text = labelfield or (next((c for c in flow.columns if c not in summed and isinstance(types[c], StringType)), None))
        sums = flow.df.agg(*(F.sum(F.col(f"`{c}`").try_cast("double")).alias(c) for c in summed), F.count(F.lit(1)).alias("__n")).where("__n > 0").drop("__n")
        if text:
            sums = sums.withColumn(text, F.lit(label))
        df = flow.df
        if text and text not in df.columns:
            df = df.withColumn(text, F.lit(None).cast("string"))
        return replace(flow, df=df.withColumns({c: F.col(f"`{c}`").cast("double") for c in summed}).unionByName(sums, allowMissingColumns=True), order=[])

    def do_addcoltotals(self, flow: Flow, fields: list[str], fieldname: str = "Total", labelfield: str | None = None, label: str = "Total") -> Flow:
        flow = replace(flow, df=flow.df.withColumn(fieldname, self.row_total(flow, self.numeric(flow, fields))))
        return replace(flow, df=flow.df.withColumn(labelfield, F.lit(label))) if labelfield else flow

    # -- order ----------------------------------------------------------------------------------

    def do_sort(self, flow: Flow, keys: list, limit: int | None = None) -> Flow:
        for k, _ in keys:
            self.field(k, flow)
        flow = self.ordered(flow, keys)
        df = flow.df.orderBy(*sort_columns(flow.order))
        return replace(flow, df=df.limit(limit) if limit else df)

    def do_head(self, flow: Flow, n: int) -> Flow:
        if n <= 0:
            raise QueryError("head takes a positive number")
        df = flow.df.orderBy(*sort_columns(flow.order)) if flow.order else flow.df
        return replace(flow, df=df.limit(n))

    def do_reverse(self, flow: Flow) -> Flow:
        flow = self.need_order(flow)
        order = [(n, not up) for n, up in flow.order]
        turned = [F.col(n).asc_nulls_last() if up else F.col(n).desc_nulls_last() for n, up in order]
        return replace(flow, df=flow.df.orderBy(*turned), order=order)

    # -- window aggregates ----------------------------------------------------------------------

    def do_eventstats(self, flow: Flow, aggs: list[Agg], by: list[str], bucket_nullable: bool = False) -> Flow:
        """Rows with a null in a group key get nulls, or with bucket_nullable are a group like any other."""
        names = self.named(aggs, [])
        over, columns = self.grouped(flow, aggs)
        columns = [c.alias(n) for c, n in zip(columns, names, strict=True)]
        # a join with the aggregates, not a window: groups are pre-aggregated and never held in one task
        df = flow.df.drop(*(n for n in names if n not in by))
        if not by:
            return replace(flow, df=df.crossJoin(F.broadcast(over.df.agg(*columns))))
        keys = [self.field(b, flow).alias(f"__g{i}") for i, b in enumerate(by)]
        groups = over.df.groupBy(*keys).agg(*columns)
        same = (lambda a, b: a.eqNullSafe(b)) if bucket_nullable else (lambda a, b: a == b)
        on = reduce(lambda a, b: a & b, (same(F.col(f"`{b}`"), F.col(f"__g{i}")) for i, b in enumerate(by)))
        return replace(flow, df=df.join(groups, on, "left").drop(*(f"__g{i}" for i in range(len(by)))))

    def largest_group(self, flow: Flow, by: list[str]) -> int:
        return flow.df.groupBy(*(self.field(b, flow) for b in by)).count().agg(F.max("count")).first()[0] or 0

    def do_streamstats(self, flow: Flow, aggs: list[Agg], by: list[str], window: int = 0, current: bool = True, reset_before=None, reset_after=None, **more) -> Flow:
        """Frames count the rows of the group; rows with a null in a group key get none.

        Groups that are small enough are windows of one task each; if the largest one isn't, or
        without groups, rows are dealt into blocks of the order.
        """
        flow = self.need_order(flow)
        if reset_before is not None or reset_after is not None:
            # a run starts at a row that the one condition holds for, or after one that the other holds for
            starts = {k: F.coalesce(self.expr(c, flow).cast("int"), F.lit(0)) for k, c in (("before", reset_before), ("after", reset_after)) if c is not None}
            df = flow.df
            for k, x in starts.items():
                if by and self.largest_group(flow, by) <= GROUP_ROWS:
                    upto = Window.partitionBy(*(self.field(b, flow) for b in by)).orderBy(*sort_columns(flow.order)).rowsBetween(Window.unboundedPreceding, 0 if k == "before" else -1)
                    df = df.withColumn(f"__run_{k}", F.coalesce(F.sum(x).over(upto), F.lit(0)))
                else:
                    df = running(df, flow.order, {f"__run_{k}": ("sum", x)}, k == "before", tuple(by)).withColumn(f"__run_{k}", F.coalesce(f"__run_{k}", F.lit(0)))
            runs = [f"__run_{k}" for k in starts]
            out = self.do_streamstats(replace(flow, df=df), aggs, [*by, *runs], window, current, **more)
            return replace(out, df=out.df.drop(*runs))
        names = self.named(aggs, [])
        keys = [self.field(b, flow) for b in by]
        known = reduce(lambda a, b: a & b, (k.isNotNull() for k in keys), F.lit(True))
        back = int(window) - (1 if current else 0) if window else 0
        kinds = [aggregates.ALIASES.get(a.call.name, a.call.name) for a in aggs]
        simple = all(k in ("sum", "count", "min", "max", "avg") and not a.call.distinct for k, a in zip(kinds, aggs, strict=True))
        if keys and (not (window or simple) or self.largest_group(flow, by) <= GROUP_ROWS):
            base = Window.partitionBy(*keys).orderBy(*sort_columns(flow.order))
            frame = base.rowsBetween(-int(window) + (1 if current else 0) if window else Window.unboundedPreceding, 0 if current else -1)
            new = {n: F.when(known, self.agg_column(a, flow).over(frame)) for a, n in zip(aggs, names, strict=True)}
            return replace(flow, df=flow.df.withColumns(new))
        if window:
            new = {n: (lambda w, a=a: F.when(known, self.agg_column(a, flow).over(w.rowsBetween(-int(window) + (1 if current else 0), 0 if current else -1)))) for a, n in zip(aggs, names, strict=True)}
            return replace(flow, df=framed(flow.df, flow.order, new, max(back, int(window)), tuple(by)))
        if not simple:
            raise QueryError("without by or window, streamstats has count, sum, avg, min and max")
        totals, finish = {}, {}
        for i, (a, n, kind) in enumerate(zip(aggs, names, kinds, strict=True)):
            x = self.expr(a.call.args[0], flow) if a.call.args else F.lit(1)
            if kind == "avg":
                totals |= {f"__s{i}": ("sum", x.cast("double")), f"__c{i}": ("count", x)}
                finish[n] = F.when(known, F.try_divide(F.col(f"__s{i}"), F.col(f"__c{i}")))
            else:
                totals[f"__s{i}"] = (kind, x)
                finish[n] = F.when(known, F.col(f"__s{i}"))
        df = running(flow.df, flow.order, totals, bool(current), tuple(by)).withColumns(finish).drop(*totals)
        return replace(flow, df=df)

    # -- several sources ------------------------------------------------------------------------

    def do_join(self, flow: Flow, type: str, key: str, query: Query) -> Flow:  # noqa: A002
        kinds = {"inner": "inner", "left": "left", "leftouter": "left", "right": "right", "rightouter": "right", "full": "full", "outer": "full", "semi": "left_semi", "anti": "left_anti", "cross": "inner"}
        if type not in kinds:
            raise QueryError(f"unknown join type {type!r}")
        self.field(key, flow)
        right = self.run(query)
        if key not in right.columns:
            raise QueryError(f"the right side has no {key!r}")
        if kinds[type] in ("left_semi", "left_anti"):
            return replace(flow, df=flow.df.join(right.select(key), key, kinds[type]))
        clash = {c: f"{c}_right" for c in right.columns if c != key and c in flow.df.columns}
        return replace(flow, df=flow.df.join(right.withColumnsRenamed(clash), key, kinds[type]), order=flow.order if kinds[type] in ("inner", "left") else [])

    def do_lookup(self, flow: Flow, table: str, keys: list, output: list) -> Flow:
        """keys: (column of the lookup table, column of the rows), which may be named the same."""
        found = self.catalog.lookups.get(table)
        found = self.catalog.frame(table) if found is None else found
        wanted = output or [(c, c) for c in found.columns if c not in {k for k, _ in keys}]
        for k, own in keys:
            if k not in found.columns:
                raise QueryError(f"{table} has no {k!r}")
            self.field(own if own in flow.df.columns else k, flow)
        unique = found.dropDuplicates([k for k, _ in keys]).select(*(F.col(k).alias(f"__k{i}") for i, (k, _) in enumerate(keys)), *(F.col(f).alias(f"__v{i}") for i, (f, _) in enumerate(wanted)), F.lit(True).alias("__hit"))
        # Spark broadcasts a lookup table if its statistics say that it is small
        on = reduce(lambda a, b: a & b, (self.field(own if own in flow.df.columns else k, flow) == F.col(f"__k{i}") for i, (k, own) in enumerate(keys)))
        df = flow.df.join(unique, on, "left")
        for i, (_, name) in enumerate(wanted):
            new = F.col(f"__v{i}")
            same = name in flow.df.columns and flow.types()[name] == unique.schema[f"__v{i}"].dataType
            df = df.withColumn(name, F.when(F.col("__hit"), new).otherwise(F.col(f"`{name}`")) if same else new)
        return replace(flow, df=df.drop("__hit", *(f"__k{i}" for i in range(len(keys))), *(f"__v{i}" for i in range(len(wanted)))))

    def do_append(self, flow: Flow, query: Query) -> Flow:
        return replace(flow, df=_union(flow.df.drop(*(n for n, _ in flow.order)), self.run(query)), order=[])

    def do_appendpipe(self, flow: Flow, query: Query) -> Flow:
        sub = self.steps(flow, query.commands)
        drop = [c for c in flow.df.columns if c.startswith(_HIDDEN)]
        return replace(flow, df=_union(flow.df.drop(*drop), sub.df.drop(*(c for c in sub.df.columns if c.startswith(_HIDDEN)))), order=[])

    def do_appendcol(self, flow: Flow, query: Query, override: bool = False) -> Flow:
        flow = self.need_order(flow)
        sub = self.steps(flow, query.commands) if query.commands[0].name != "search" else self.flow(query, ordered=True)
        sub = self.need_order(sub)
        right = numbered(sub.df, sub.order).drop(*(c for c in sub.df.columns if c.startswith(_HIDDEN)))
        left = numbered(flow.df, flow.order)
        right = right.withColumnsRenamed({c: f"__a_{c}" for c in right.columns if c != ROW})
        df = left.join(right, ROW, "left")
        for c in sub.columns:
            new = F.col(f"`__a_{c}`")
            df = df.withColumn(c, (F.coalesce(new, F.col(f"`{c}`")) if override else F.coalesce(F.col(f"`{c}`"), new)) if c in flow.df.columns else new)
        return replace(flow, df=df.drop(ROW, *(f"__a_{c}" for c in sub.columns)))


def _union(a: DataFrame, b: DataFrame) -> DataFrame:
    """By name; a column whose types differ becomes text."""
    types = dict(a.dtypes)
    clash = [n for n, t in b.dtypes if n in types and types[n] != t]
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")
    for n in clash:
        kinds = (types[n], dict(b.dtypes)[n])
        to = "double" if all(k in numbers for k in kinds) and any(k in ("float", "double") for k in kinds) else "bigint" if all(k in numbers for k in kinds) else "string"
        a, b = a.withColumn(n, F.col(f"`{n}`").cast(to)), b.withColumn(n, F.col(f"`{n}`").cast(to))
    return a.unionByName(b, allowMissingColumns=True)


def _hidden(flow: Flow) -> list[Column]:
    return [F.col(c) for c in flow.df.columns if c.startswith(_HIDDEN)]


def _conjuncts(node) -> list:
    return [*_conjuncts(node.left), *_conjuncts(node.right)] if isinstance(node, Binary) and node.op == "and" else [node]


def _needs_order(commands: list[Command]) -> bool:
    for c in commands:
        if c.name in _ORDERED or any(a.call.name in _ORDERED_AGGREGATES for a in c.args.get("aggs", [])):
            return True
        if c.name == "appendpipe" and _needs_order(c.args["query"].commands):
            return True
    return False


def _round_size(x: float) -> float:
    """The least of 1, 2 and 5 times a power of ten that is at least x."""
    import math

    base = 10.0 ** math.floor(math.log10(x))
    return next(base * m for m in (1, 2, 5, 10) if base * m >= x * (1 - 1e-9))


def time_bucket(x: Column, span: Span, kind) -> Column:
    """x floored to a multiple of the span since the epoch, in x's own type."""
    unit = _SPELLED.get(span.unit, span.unit) or "s"
    if unit not in _SECONDS:
        raise QueryError(f"unknown unit {span.unit!r}")
    size = round(span.n * _SECONDS[unit] * 1_000_000)
    floored = F.timestamp_micros((F.floor(F.unix_micros(x.cast("timestamp")) / F.lit(size)) * F.lit(size)).cast("bigint"))
    return floored.cast(kind) if isinstance(kind, (TimestampNTZType, DateType)) else floored
