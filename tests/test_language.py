"""The piped language: parsing, and each command on small rows."""

import pytest

from pipelight.plans.ast import Binary, Field, Lit, Span, Unary
from pipelight.plans.compiler import Engine
from pipelight.plans.lexer import QueryError
from pipelight.plans.parser import parse
from pipelight.search.text import TextSettings
from pipelight.sources.catalog import Catalog


@pytest.fixture(scope="module")
def engine(spark):
    catalog = Catalog(spark)
    logs = [(1, "a", 200, 10.0, "x|y"), (2, "b", 500, None, ""), (3, "a", 200, 30.0, None), (4, None, 404, 5.0, "z"), (5, "b", 500, 20.0, "é.*")]
    catalog.register("logs", spark.createDataFrame(logs, "id int, host string, status int, latency double, tag string"), order=["id"])
    catalog.register("empty", spark.createDataFrame([], "id int, host string"), order=["id"])
    catalog.register("hosts", spark.createDataFrame([("a", "north"), ("a", "south"), (None, "none")], "host string, region string"))
    catalog.register("users", spark.createDataFrame([("a", 7), (None, 8)], "host string, status int"))
    catalog.register("raw", spark.createDataFrame([(1, '{"a": {"b": true}, "n": 1}', ["p", "q"], "user bob from 10.0.0.1"), (2, "bad", [], "nothing"), (3, None, None, None)], "id int, _raw string, tags array<string>, message string"), order=["id"])
    catalog.register("docs", spark.createDataFrame([(1, "The quick brown fox"), (2, "quick fox, brown!"), (3, None)], "id int, text string"), order=["id"], text=TextSettings({"text": "standard"}))
    return Engine(catalog)


def rows(engine, text):
    return [tuple(r) for r in engine.query(text).collect()]


def test_precedence_and_literals():
    cond = parse("source=x | where a = 1 or not b > -2.5 and c like 'q%'").commands[1].args["condition"]
    assert isinstance(cond, Binary) and cond.op == "or" and cond.right.op == "and"
    assert isinstance(cond.right.left, Unary) and cond.right.left.arg.right == Lit(-2.5)
    assert parse("source=x | eval v = value, t = `type` // comment\n | head 3").commands[1].args["assignments"] == [("v", Field("value")), ("t", Lit("type"))]
    assert parse("source=x | bin ts span=15min").commands[1].args["span"] == Span(15, "min")


@pytest.mark.parametrize("text", ["where a", "source=", "source=x | head", "source=x | nothing", "source=x | where", "source=x | stats foo(a)", "source=x | where a = ", "source=x | fields a,", "source=x ]", "source=x | eval a", "source=x | join k", "source=x | where a in [source=y", "source=x | where a # b"])
def test_bad_queries(text, engine):
    if text == "source=x | head":  # ten rows are the default
        assert parse(text).commands[1].args["n"] == 10
        return
    with pytest.raises(QueryError):
        parse(text)


def test_unknown_names(engine):
    for text in ("source=nowhere", "source=logs | where nothing = 1", "source=logs | fields nothing", "source=logs | eval a = nofunction(1)", "source=logs | head 0", "source=logs | lookup nowhere host"):
        with pytest.raises(ValueError):
            engine.query(text)


def test_rows_and_nulls(engine):
    assert rows(engine, "source=logs | where latency > 5 | fields id") == [(1,), (3,), (5,)]
    assert rows(engine, "source=logs | where host != 'a' | fields id") == [(2,), (5,)]
    assert rows(engine, "source=logs | eval a = latency / 0, b = status % 0, c = 7 % -3 | head 1 | fields a, b, c") == [(None, None, 1)]
    assert rows(engine, "source=logs | where tag like '%|%' | fields id") == [(1,)]
    assert rows(engine, "source=logs | replace '.*' with 'dots' in tag | where id = 5 | fields tag") == [("édots",)]
    assert rows(engine, "source=logs | fillnull value=0 | where id = 2 | fields latency, tag") == [(0.0, "")]
    assert rows(engine, "source=logs | fillnull host='?', none='n' | where id = 4 | fields host, none") == [("?", "n")]
    assert rows(engine, "source=logs | table host, nope | head 1") == [("a", None)]
    assert rows(engine, "source=logs | rename status as host | head 1 | fields id, host") == [(1, 200)]
    assert rows(engine, "source=empty | stats count() as n, max(id) as m") == [(0, None)]
    assert rows(engine, "source=empty | stats count() as n by host") == []


def test_aggregates(engine):
    assert sorted(rows(engine, "source=logs | stats count() as n, avg(latency) as a by host"), key=str) == [("a", 2, 20.0), ("b", 2, 20.0), (None, 1, 5.0)]
    assert rows(engine, "source=logs | stats dc(host) as d, count(latency) as c, range(latency) as r, median(status) as m") == [(2, 4, 25.0, 404.0)]
    assert rows(engine, "source=logs | stats first(id) as f, last(id) as l, earliest(id) as e") == [(1, 5, 1)]
    assert rows(engine, "source=logs | top 1 host") == [("a", 2, 40.0)]
    assert rows(engine, "source=logs | rare 1 host showperc=false") == [(None, 1)]
    assert rows(engine, "source=logs | top 1 status by host showperc=false countfield=n | where host = 'a'") == [("a", 200, 2)]
    assert rows(engine, "source=logs | chart count() by host, status limit=1 | where host = 'a' | fields host") == [("a",)]


def test_order(engine):
    assert rows(engine, "source=logs | sort latency | fields id") == [(2,), (4,), (1,), (5,), (3,)]
    assert rows(engine, "source=logs | sort - latency | fields id") == [(3,), (5,), (1,), (4,), (2,)]
    assert rows(engine, "source=logs | sort status, - id | head 2 | fields id") == [(3,), (1,)]
    assert rows(engine, "source=logs | reverse | fields id") == [(5,), (4,), (3,), (2,), (1,)]
    assert sorted(rows(engine, "source=logs | dedup host | fields id")) == [(1,), (2,), (4,)]
    assert sorted(rows(engine, "source=logs | dedup status consecutive=true | fields id")) == [(1,), (2,), (3,), (4,), (5,)]
    assert sorted(rows(engine, "source=logs | dedup host keepevents=true | fields id, host"))[2] == (3, None)
    assert sorted(rows(engine, "source=logs | streamstats count() as n, sum(latency) as s | fields id, n, s")) == [(1, 1, 10.0), (2, 2, 10.0), (3, 3, 40.0), (4, 4, 45.0), (5, 5, 65.0)]
    assert sorted(rows(engine, "source=logs | streamstats window=2 max(status) as m | fields id, m")) == [(1, 200), (2, 500), (3, 500), (4, 404), (5, 500)]
    assert sorted(rows(engine, "source=logs | streamstats current=false count() as n | fields id, n")) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert sorted(rows(engine, "source=logs | streamstats count() as n by host | fields id, n")) == [(1, 1), (2, 1), (3, 2), (4, None), (5, 2)]
    assert sorted(rows(engine, "source=logs | eventstats max(latency) as m by host | fields id, m")) == [(1, 30.0), (2, 20.0), (3, 30.0), (4, None), (5, 20.0)]


def test_several_sources(engine):
    assert sorted(rows(engine, "source=logs | join host [source=users] | fields id, status, status_right")) == [(1, 200, 7), (3, 200, 7)]
    assert len(rows(engine, "source=logs | join type=left host [source=users]")) == 5
    assert len(rows(engine, "source=logs | join type=full host [source=users]")) == 6
    assert len(rows(engine, "source=logs | lookup hosts host output region as r")) == 5
    assert sorted(rows(engine, "source=logs | where host in [source=users | fields host] | fields id")) == [(1,), (3,)]
    assert sorted(rows(engine, "source=logs | where host not in [source=users | fields host] | fields id")) == [(2,), (4,), (5,)]
    assert rows(engine, "source=logs | where exists [source=empty]") == []
    assert len(rows(engine, "source=logs | where not exists [source=empty]")) == 5
    assert sorted(rows(engine, "source=logs | where latency = [source=logs | stats max(latency)] | fields id")) == [(3,)]
    assert rows(engine, "source=logs | where latency = [source=logs | fields latency]") == []
    assert len(rows(engine, "source=logs | append [source=hosts]")) == 8
    assert sorted(rows(engine, "source=logs | fields id | appendcol [source=users | fields status]"))[4] == (5, None)
    assert sorted(rows(engine, "source=logs | stats sum(status) as s by host | appendpipe [stats sum(s) as s]"), key=str)[-1] == (None, 404)


def test_totals(engine):
    assert rows(engine, "source=logs | addtotals status, latency fieldname=t | where id = 2 | fields t") == [(500.0,)]
    got = rows(engine, "source=logs | fields host, status | addtotals row=false col=true")
    assert ("Total", 1804.0) in got and len(got) == 6
    assert rows(engine, "source=logs | addcoltotals status latency | where id = 1 | fields Total") == [(210.0,)]
    assert rows(engine, "source=empty | addtotals col=true") == []


def test_extraction(engine):
    assert rows(engine, "source=raw | parse message 'user (?<who>\\w+) from (?P<ip_addr>[0-9.]+)' | fields id, who, ip_addr") == [(1, "bob", "10.0.0.1"), (2, None, None), (3, None, None)]
    assert rows(engine, "source=raw | rex field=message \"(?<id>nothing)\" | fields id") == [(None,), ("nothing",), (None,)]
    assert rows(engine, "source=raw | grok message 'user %{WORD:who} from %{IP:ip}' | fields who, ip | head 1") == [("bob", "10.0.0.1")]
    assert rows(engine, "source=raw | spath path=a.b | fields b") == [("true",), (None,), (None,)]
    assert rows(engine, "source=raw | spath | fields n, a | head 1") == [("1", '{"b":true}')]
    assert rows(engine, "source=raw | flatten tags | fields id, tags") == [(1, "p"), (1, "q"), (2, None), (3, None)]
    assert rows(engine, "source=raw | flatten id | fields id") == [(1,), (2,), (3,)]
    with pytest.raises(ValueError):
        engine.query("source=raw | parse message 'no group'")


def test_relevance(engine):
    assert rows(engine, "source=docs | where match(text, 'fox') | fields id") == [(1,), (2,)]
    assert rows(engine, "source=docs | where match_phrase(text, 'brown fox') | fields id") == [(1,)]
    assert rows(engine, "source=docs | where match_phrase(text, 'quick brown', slop=1) | fields id") == [(1,), (2,)]
    assert rows(engine, "source=docs | where match_phrase_prefix(text, 'quick bro') | fields id") == [(1,)]
    assert rows(engine, "source=docs | where query_string([text], 'fox AND NOT \"brown fox\"') | fields id") == [(2,)]


def test_metadata(engine):
    assert rows(engine, "describe hosts") == [("host", "string", True), ("region", "string", True)]
    assert ("logs",) in rows(engine, "showdatasources")
    assert "Filter" in rows(engine, "explain source=logs | where id > 1")[0][0]


def test_groups_that_are_split(engine, monkeypatch):
    """Large groups take blocks of the order; the result is the same."""
    from pipelight.operators import ordered
    from pipelight.plans import compiler

    texts = ["source=logs | streamstats count() as n, avg(latency) as m, max(status) as x by host | fields id, n, m, x", "source=logs | streamstats window=2 sum(status) as s by host | fields id, s", "source=logs | streamstats current=false sum(status) as s by host | fields id, s"]
    want = [sorted(rows(engine, t)) for t in texts]
    monkeypatch.setattr(compiler, "GROUP_ROWS", 0)
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 2)
    assert [sorted(rows(engine, t)) for t in texts] == want
    assert sorted(rows(engine, "source=logs | streamstats count() as n, sum(latency) as s | fields id, n, s")) == [(1, 1, 10.0), (2, 2, 10.0), (3, 3, 40.0), (4, 4, 45.0), (5, 5, 65.0)]
    assert sorted(rows(engine, "source=logs | streamstats window=3 max(id) as m | fields m")) == [(1,), (2,), (3,), (4,), (5,)]


def test_streamstats_resets(engine):
    assert sorted(rows(engine, "source=logs | streamstats reset_before=(status = 500) count() as n | fields id, n")) == [(1, 1), (2, 1), (3, 2), (4, 3), (5, 1)]
    assert sorted(rows(engine, "source=logs | streamstats reset_after=(status = 500) count() as n by host | fields id, n")) == [(1, 1), (2, 1), (3, 2), (4, None), (5, 1)]


def test_percentile_approx_of_many_values_is_exact(engine, spark):
    n = 600_000
    mixed = spark.range(n, numPartitions=8).selectExpr("id * 7919 % 600000 AS v", "id % 2 AS g")
    engine.catalog.register("mixed", mixed)
    assert rows(engine, "source=mixed | stats percentile_approx(v, 50) as a, percentile_approx(v, 33) as b, percentile_approx(v + 1) as c") == [(n // 2 - 1, n * 33 // 100 - 1, n // 2)]
    odd = n // 4 * 2 - 1  # v is odd where id is
    assert sorted(rows(engine, "source=mixed | stats percentile_approx(v, 50) as a by g")) == [(0, odd - 1), (1, odd)]
    assert sorted(rows(engine, "source=mixed | head 5 | eventstats percentile_approx(v, 100) as a | fields a")) == [(7919 * 4,)] * 5
    assert sorted(rows(engine, "source=mixed | chart percentile_approx(v, 50) as a by g, g | fields g")) == [("0",), ("1",)]
