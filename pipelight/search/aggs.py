"""Aggregations of the JSON search API as DataFrames.

Each bucket aggregation is one groupBy or one row of conditional counts; metric sub-aggregations ride
along in the same aggregate, and one nested level of buckets is a further group key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from ..plans.ast import Span
from .query import Compiler, parse_query

METRICS = frozenset("avg min max sum value_count count cardinality stats extended_stats percentiles".split())
BUCKETS = frozenset("terms histogram date_histogram range date_range filters filter missing".split())
_CALENDAR = {"minute": "minute", "1m": "minute", "hour": "hour", "1h": "hour", "day": "day", "1d": "day", "week": "week", "1w": "week", "month": "month", "1M": "month", "quarter": "quarter", "1q": "quarter", "year": "year", "1y": "year"}


def split_spec(spec: dict) -> tuple[str, dict, dict]:
    """(kind, body, sub-aggregations) of one aggregation; anything malformed raises ValueError."""
    sub = spec.get("aggs") or spec.get("aggregations") or {}
    kinds = [k for k in spec if k not in ("aggs", "aggregations", "meta")]
    if len(kinds) != 1 or kinds[0] not in METRICS | BUCKETS:
        raise ValueError(f"not an aggregation: {kinds}")
    if kinds[0] in METRICS and sub:
        raise ValueError(f"{kinds[0]} has no sub-aggregations")
    return kinds[0], spec[kinds[0]], sub


def metric_columns(name: str, kind: str, body: dict) -> dict[str, Column]:
    """The columns of one metric, named after it."""
    if "field" not in body:
        raise ValueError(f"{kind} needs a field")
    x = F.col(body["field"])
    if "missing" in body:
        x = F.coalesce(x, F.lit(body["missing"]))
    if kind in ("avg", "min", "max", "sum"):
        return {name: getattr(F, kind)(x)}
    if kind in ("value_count", "count"):
        return {name: F.count(x)}
    if kind == "cardinality":
        return {name: F.approx_count_distinct(x) if body.get("approximate") else F.count_distinct(x)}
    if kind == "percentiles":
        percents = body.get("percents", [1, 5, 25, 50, 75, 95, 99])
        build = (lambda p: F.percentile_approx(x, p / 100)) if body.get("approximate") else (lambda p: F.percentile(x, p / 100))
        return {f"{name}_{float(p):g}": build(p) for p in percents}
    y = x.cast("double")
    out = {f"{name}_count": F.count(x), f"{name}_min": F.min(x), f"{name}_max": F.max(x), f"{name}_avg": F.avg(x), f"{name}_sum": F.sum(x)}
    if kind == "extended_stats":
        sigma = float(body.get("sigma", 2))
        out |= {f"{name}_sum_of_squares": F.sum(y * y), f"{name}_variance": F.var_pop(x), f"{name}_std_deviation": F.stddev_pop(x), f"{name}_upper": F.avg(x) + sigma * F.stddev_pop(x), f"{name}_lower": F.avg(x) - sigma * F.stddev_pop(x)}
    return out


def _sub(sub: dict) -> tuple[dict[str, Column], tuple[str, dict] | None]:
    metrics: dict[str, Column] = {}
    nested = None
    for name, spec in sub.items():
        kind, body, deeper = split_spec(spec)
        if kind in METRICS:
            metrics |= metric_columns(name, kind, body)
        elif nested or deeper and any(split_spec(s)[0] in BUCKETS for s in deeper.values()):
            raise ValueError("one level of nested buckets is supported")
        else:
            nested = (name, spec)
    return metrics, nested


def bucket_key(df: DataFrame, kind: str, body: dict) -> Column:
    x = F.col(body["field"])
    if kind == "terms":
        return F.coalesce(x, F.lit(body["missing"])) if "missing" in body else x
    if kind == "histogram":
        size, offset = float(body["interval"]), float(body.get("offset", 0))
        if size <= 0:
            raise ValueError("an interval is positive")
        return F.floor((x - offset) / size) * size + offset
    from ..plans.compiler import time_bucket
    from ..plans.parser import Parser, tokenize

    own = df.schema[body["field"]].dataType
    calendar = body.get("calendar_interval") or (body["interval"] if body.get("interval") in _CALENDAR else None)
    if calendar:
        if calendar not in _CALENDAR:
            raise ValueError(f"unknown interval {calendar!r}")
        cut = F.date_trunc(_CALENDAR[calendar], x)
        return cut.cast(own) if isinstance(own, (TimestampNTZType, TimestampType, DateType)) else cut
    text = body.get("fixed_interval") or body.get("interval")
    if not text:
        raise ValueError("date_histogram needs an interval")
    span = Parser(tokenize(str(text))).span()
    if not isinstance(span, Span):
        raise ValueError(f"unknown interval {text!r}")
    return time_bucket(x, span, own)


def range_name(r: dict) -> str:
    ends = ["*" if r.get(k) is None else f"{float(r[k])}" if isinstance(r[k], (int, float)) else str(r[k]) for k in ("from", "to")]
    return r.get("key") or "-".join(ends)


def range_test(x: Column, r: dict) -> Column:
    parts = ([x >= F.lit(r["from"])] if r.get("from") is not None else []) + ([x < F.lit(r["to"])] if r.get("to") is not None else [])
    return reduce(lambda a, b: a & b, parts, x.isNotNull())


def aggregate(df: DataFrame, name: str, spec: dict, compiler: Compiler) -> DataFrame:
    """One aggregation of the rows of df: metrics give one row, buckets one row each with key,
    doc_count and the sub-aggregations' columns."""
    kind, body, sub = split_spec(spec)
    if kind in METRICS:
        columns = metric_columns(name, kind, body)
        bare = {c: (c.removeprefix(f"{name}_") if c != name else "value") for c in columns}
        return df.agg(*(c.alias(bare[n]) for n, c in columns.items()))
    metrics, nested = _sub(sub)
    extra = [c.alias(n) for n, c in metrics.items()]
    if kind in ("range", "date_range", "filters", "filter", "missing"):
        if kind in ("range", "date_range"):
            tests = [(range_name(r), range_test(F.col(body["field"]), r)) for r in body["ranges"]]
        elif kind == "filters":
            queries = body["filters"]
            named = queries.items() if isinstance(queries, dict) else ((str(i), q) for i, q in enumerate(queries))
            tests = [(k, compiler.condition(parse_query(q))) for k, q in named]
            if body.get("other_bucket") or body.get("other_bucket_key"):
                tests.append((body.get("other_bucket_key", "_other_"), ~reduce(lambda a, b: a | b, (t for _, t in tests))))
        elif kind == "filter":
            tests = [(name, compiler.condition(parse_query(body)))]
        else:
            tests = [(name, F.col(body["field"]).isNull())]
        if nested is None and not extra:  # one pass, one row of counts, stacked
            row = df.agg(*(F.count(F.when(t, 1)).alias(f"b{i}") for i, (_, t) in enumerate(tests)))
            stack = F.explode(F.array(*(F.struct(F.lit(i).alias("position"), F.lit(k).alias("key"), F.col(f"b{i}").alias("doc_count")) for i, (k, _) in enumerate(tests))))
            return row.select(stack.alias("b")).select("b.*").orderBy("position").drop("position")
        # buckets may overlap: a row goes to each bucket that it is in
        inside = F.filter(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(i)) for i, (_, t) in enumerate(tests))), lambda x: x.isNotNull())
        names = F.create_map(*(x for i, (k, _) in enumerate(tests) for x in (F.lit(i), F.lit(k))))
        rows = df.withColumn("__bucket", F.explode(inside))
        groups = rows.groupBy("__bucket", *_nested_key(df, nested)).agg(F.count(F.lit(1)).alias("doc_count"), *extra)
        return groups.orderBy("__bucket").select(F.element_at(names, F.col("__bucket")).alias("key"), *[c for c in groups.columns if c != "__bucket"])
    key = bucket_key(df, kind, body)
    rows = df.withColumn("__key", key).where("__key is not null")
    if nested is not None:
        inner_name, inner_spec = nested
        inner_kind, inner_body, inner_sub = split_spec(inner_spec)
        inner_metrics, _ = _sub(inner_sub)
        inner = bucket_key(df, inner_kind, inner_body)
        fine = rows.groupBy(F.col("__key").alias("key"), inner.alias(f"{inner_name}_key")).agg(F.count(F.lit(1)).alias(f"{inner_name}_doc_count"), *(c.alias(n) for n, c in inner_metrics.items()))
        outer = aggregate(df, name, {kind: body, "aggs": {n: s for n, s in sub.items() if n != inner_name}} if len(sub) > 1 else {kind: body}, compiler)
        best = Window.partitionBy("key").orderBy(F.desc(f"{inner_name}_doc_count"), f"{inner_name}_key")
        fine = fine.where(F.col(f"{inner_name}_key").isNotNull()).withColumn("__rank", F.row_number().over(best))
        if inner_kind == "terms":
            fine = fine.where(F.col("__rank") <= int(inner_body.get("size", 10)))
        return outer.join(fine.drop("__rank"), "key", "left")
    groups = rows.groupBy(F.col("__key").alias("key")).agg(F.count(F.lit(1)).alias("doc_count"), *extra)
    least = int(body.get("min_doc_count", 1 if kind == "terms" else 0))
    if least > 1:
        groups = groups.where(F.col("doc_count") >= least)
    if kind != "terms":
        return groups.orderBy("key")
    order = body.get("order", {"_count": "desc"})
    order = order if isinstance(order, list) else [order]
    keys = [({"_count": F.col("doc_count"), "_key": F.col("key"), "_term": F.col("key")}.get(k, F.col(k) if k in groups.columns else None), d) for o in order for k, d in o.items()]
    if any(k is None for k, _ in keys):
        raise ValueError("terms are ordered by _count, _key or a metric of theirs")
    return groups.orderBy(*(k.desc() if d == "desc" else k.asc() for k, d in keys), "key").limit(int(body.get("size", 10)))


def _nested_key(df: DataFrame, nested) -> list[Column]:
    if nested is None:
        return []
    name, spec = nested
    kind, body, _ = split_spec(spec)
    return [bucket_key(df, kind, body).alias(f"{name}_key")]
