"""Search requests, aggregations, vectors, user functions, pipelines, the writer, streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from pipelight.catalogue import QUERIES
from pipelight.functions import scalar, udf
from pipelight.plans.pipelines import Pipeline, Pipelines, Stage, StageError, spelling_stage, synonym_stage
from pipelight.search import sparse
from pipelight.search.query import parse_query
from pipelight.search.service import SearchRequest, SearchService
from pipelight.search.text import ANALYZERS, Analyzer, TextSettings
from pipelight.sources.catalog import Catalog
from pipelight.sources.writer import Action, IndexWriter, parse_bulk
from pipelight.streaming import queries as streams


@pytest.fixture(scope="module")
def service(spark):
    rows = [("1", "red shoe and red sock", 10.0, "shoes"), ("2", "blue shoe", 20.0, "shoes"), ("3", "green hat", 30.0, "hats"), ("4", None, None, None)]
    catalog = Catalog(spark).register("items", spark.createDataFrame(rows, "id string, title string, price double, category string"), order=["id"], text=TextSettings({"title": "standard"}))
    registry = udf.Registry()
    registry.register(udf.Function("dear", "1.0.0", lambda price, least: price >= least, ("price",), (udf.Parameter("least", "double", True),)))
    return SearchService(catalog, registry)


def ids(service, query, **more):
    return [r["_id"] for r in service.search("items", {"query": query, "size": 100, **more}).hits.collect()]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ({"match_all": {}}, ["1", "2", "3", "4"]),
        ({"term": {"category": "shoes"}}, ["1", "2"]),
        ({"terms": {"category": ["hats", "x"]}}, ["3"]),
        ({"range": {"price": {"gt": 10, "lte": 30}}}, ["2", "3"]),
        ({"exists": {"field": "price"}}, ["1", "2", "3"]),
        ({"prefix": {"title": "sh"}}, ["1", "2"]),
        ({"wildcard": {"category": "?at*"}}, ["3"]),
        ({"fuzzy": {"category": {"value": "hots"}}}, ["3"]),
        ({"match": {"title": {"query": "red shoe", "operator": "and"}}}, ["1"]),
        ({"match": {"title": {"query": "shoo", "fuzziness": 1}}}, ["1", "2"]),
        ({"match_phrase": {"title": "red sock"}}, ["1"]),
        ({"multi_match": {"query": "hat", "fields": ["title^2", "category"]}}, ["3"]),
        ({"query_string": {"query": "title:shoe -blue"}}, ["1"]),
        ({"simple_query_string": {"query": "\"green hat\" | bl*", "fields": ["title"]}}, ["2", "3"]),
        ({"bool": {"must_not": [{"term": {"category": "shoes"}}]}}, ["3", "4"]),
        ({"bool": {"should": [{"term": {"category": "hats"}}, {"range": {"price": {"lt": 15}}}], "minimum_should_match": 1}}, ["1", "3"]),
        ({"bool": {"must": [{"match_all": {}}], "should": [{"term": {"category": "hats"}}]}}, ["1", "2", "3", "4"]),
        ({"expr": {"op": ">", "args": [{"op": "*", "args": [{"field": "price"}, {"const": 2}]}, {"const": 50}]}}, ["3"]),
        ({"wasm_udf": {"name": "dear", "parameters": {"least": 20.0}}}, ["2", "3"]),
    ],
)
def test_queries(service, query, want):
    assert sorted(ids(service, query)) == want


@pytest.mark.parametrize("body", [{"nope": {}}, {"term": {}}, {"term": {"a": 1, "b": 2}}, {"terms": {"a": 1}}, {"range": {"a": {}}}, {"exists": {}}, {"bool": {"musty": []}}, {"match": {"a": {}}}, {"multi_match": {"fields": ["a"]}}, {"match_all": {}, "term": {}}, {"wasm_udf": {}}])
def test_bad_queries(body):
    with pytest.raises(ValueError):
        parse_query(body)


def test_requests(service):
    got = service.search("items", {"sort": [{"price": "desc"}], "from": 1, "size": 1, "_source": ["title"]}).hits
    assert got.columns == ["title", "_id"] and [r["_id"] for r in got.collect()] == ["2"]
    assert service.search("items", {"size": 1}).total() == 4
    assert service.count("items", {"term": {"category": "shoes"}}) == 2
    assert [r["title"] for r in service.get("items", "3").collect()] == ["green hat"]
    for bad in ({"size": -1}, {"sise": 3}):
        with pytest.raises(ValueError):
            SearchRequest.parse(bad)


def test_scores(service):
    hits = service.search("items", {"query": {"match": {"title": "red shoe"}}}).hits.collect()
    assert [h["_id"] for h in hits] == ["1", "2"] and hits[0]["_score"] > hits[1]["_score"] > 0
    assert service.search("items", {"query": {"match_all": {"boost": 3}}}).hits.first()["_score"] == 3.0


def test_aggregations(service):
    spec = {
        "cats": {"terms": {"field": "category"}, "aggs": {"p": {"max": {"field": "price"}}}},
        "bands": {"range": {"field": "price", "ranges": [{"to": 20}, {"from": 10}]}},
        "named": {"filters": {"filters": {"dear": {"range": {"price": {"gte": 20}}}}, "other_bucket": True}},
        "s": {"stats": {"field": "price"}},
        "none": {"missing": {"field": "price"}},
        "h": {"histogram": {"field": "price", "interval": 20}},
    }
    got = {k: [tuple(r) for r in v.collect()] for k, v in service.search("items", {"size": 0, "aggs": spec}).aggregations.items()}
    assert got["cats"] == [("shoes", 2, 20.0), ("hats", 1, 30.0)]
    assert got["bands"] == [("*-20.0", 1), ("10.0-*", 3)]
    assert got["named"][0] == ("dear", 2)
    assert got["s"] == [(3, 10.0, 30.0, 20.0, 60.0)]
    assert got["none"] == [("none", 1)]
    assert got["h"] == [(0.0, 1), (20.0, 2)]
    for bad in ({"terms": {"field": "category", "order": {"nope": "asc"}}}, {"nope": {}}, {"avg": {}}, {"date_histogram": {"field": "price"}}):
        with pytest.raises(ValueError):
            service.search("items", {"aggs": {"a": bad}})


@pytest.mark.parametrize("name", sorted(ANALYZERS))
def test_analyzers_agree_in_both_forms(spark, name):
    texts = ["Don't stop, U.S. 3.14 Café", "", "  a  B ", "über-Straße 你好吗", "the and of"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ANALYZERS[name].column(F.col("t"))).collect()]
    assert got == [ANALYZERS[name].tokens(t) for t in texts]


def test_synonyms(spark):
    a = Analyzer("words", lower=True, synonyms=(("tv", ("tv", "television")),))
    assert spark.range(1).select(a.column(F.lit("big TV"))).first()[0] == a.tokens("big TV") == ["big", "tv", "television"]


@pytest.mark.parametrize(
    ("name", "args", "want"),
    [
        ("round", [scalar.Literal(-1.5)], -2.0), ("sqrt", [scalar.Literal(-1.0)], None), ("truncate", [scalar.Literal(-1.29), scalar.Literal(1)], -1.2), ("mod", [scalar.Literal(-7), scalar.Literal(3)], -1), ("substr", [scalar.Literal("héllo"), scalar.Literal(2), scalar.Literal(2)], "él"),
        ("locate", [scalar.Literal("l"), scalar.Literal("hello")], 3), ("instr", [scalar.Literal("hello"), scalar.Literal("z")], 0), ("split", [scalar.Literal("a.b"), scalar.Literal(".")], ["a", "b"]), ("period_add", [scalar.Literal(202411), scalar.Literal(3)], 202502), ("period_diff", [scalar.Literal(202502), scalar.Literal(202411)], 3),
        ("maketime", [scalar.Literal(1), scalar.Literal(2), scalar.Literal(3)], "01:02:03"), ("timediff", [scalar.Literal("10:00:00"), scalar.Literal("11:30:00")], "-01:30:00"), ("str_to_date", [scalar.Literal("03/02/2024"), scalar.Literal("%d/%m/%Y")], datetime.datetime(2024, 2, 3)), ("from_days", [scalar.Literal(739251)], datetime.date(2024, 1, 1)),
        ("makedate", [scalar.Literal(2024), scalar.Literal(60)], datetime.date(2024, 2, 29)), ("int", [scalar.Literal("x")], None), ("cidr", [scalar.Literal("10.1.2.3"), scalar.Literal("10.0.0.0/8")], True), ("cidr", [scalar.Literal("fe80::1"), scalar.Literal("fe80::/10")], True), ("ipBroadcast", [scalar.Literal("10.1.2.3"), scalar.Literal("24")], "10.1.2.255"),
        ("isValidIP", [scalar.Literal("1::")], True), ("isValidIP", [scalar.Literal("300.1.1.1")], False), ("isPublicIP", [scalar.Literal("8.8.8.8")], True), ("json_type", [scalar.Literal("[1]")], "array"), ("json_set", [scalar.Literal('{"a":{}}'), scalar.Literal("a.b"), scalar.Literal("x")], '{"a":{"b":"x"}}'), ("json_array", [scalar.Literal(1), scalar.Literal("a"), scalar.Literal(None)], '[1,"a",null]'),
        ("json_length", [scalar.Literal('{"a":1,"b":2}')], 2), ("json_valid", [scalar.Literal("{bad")], False), ("json_array_append", [scalar.Literal("[]"), scalar.Literal("x")], '["x"]'), ("json_pretty", [scalar.Literal('{"a":1}')], '{\n  "a": 1\n}'), ("sha2", [scalar.Literal("a"), scalar.Literal(256)], "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"), ("base64decode", [scalar.Literal("aGk=")], "hi"),
    ],
)
def test_functions(spark, name, args, want):
    assert spark.range(1).select(scalar.call(name, args)).first()[0] == want


def test_every_declared_function_resolves():
    assert len(scalar.FUNCTIONS) + 7 + 20 >= 190
    assert all(v in scalar.FUNCTIONS for v in scalar.ALIASES.values())
    with pytest.raises(ValueError):
        scalar.call("nope", [])


def test_sparse_vectors(spark):
    df = spark.createDataFrame([(1, {0: 3.0, 2: 4.0}), (2, {0: 1.0}), (3, {1: 5.0})], "id long, vector map<int,double>")
    v = F.col("vector")
    row = df.where("id = 1").select(sparse.norm(v), sparse.norm1(v), sparse.sum_of(v), sparse.get(v, 2), sparse.contains(v, 1), sparse.dot(v, v), sparse.cosine(v, v), sparse.prune_top_k(v, 1), sparse.prune_by_mass(v, 0.5), sparse.to_dense(v, 3), sparse.normalize(v), sparse.scale(v, 2.0), sparse.add(v, v), sparse.set_value(v, 0, 9)).first()
    assert row[:7] == (5.0, 7.0, 7.0, 4.0, False, 25.0, 1.0)
    assert row[7] == row[8] == {2: 4.0} and row[9] == [3.0, 0.0, 4.0] and row[10] == {0: 0.6, 2: 0.8} and row[11] == row[12] == {0: 6.0, 2: 8.0} and row[13] == {0: 9.0, 2: 4.0}
    got = sparse.top_k_sparse(df, df.where("id = 2"), 2).select("id", "score").collect()
    assert sorted(map(tuple, got)) == [(1, 3.0), (2, 1.0)]


def test_sparse_search_takes_every_row_divisible_by_20(spark, sf):
    rows = {r.vec_id: [x if x > 0.05 else 0.0 for x in map(float, r.embedding)] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()}
    want = []
    for q in (i for i in rows if i % 20 == 0):
        scores = [(-sum(a * b for a, b in zip(rows[q], v, strict=True)), i) for i, v in rows.items()]
        want += [(q, i, pytest.approx(-s, abs=1e-5)) for s, i in sorted(x for x in scores if x[0] < 0)[:5]]
    got = sorted(map(tuple, QUERIES["V2_sparse_topk"](spark, sf).collect()))
    assert len({q for q, *_ in got}) == sum(i % 20 == 0 for i in rows) > sum(i % 100 == 0 for i in rows)
    assert got == sorted(want, key=lambda x: x[:2])


def test_sparse_search_shuffles_no_scores(spark, monkeypatch):
    """Blocks of any size give the same rows; ties go to the smaller id, negative, null and repeated entries count."""
    vectors = [(i, {d: float((i * d) % 7 - 3) for d in range(i % 5, 9, 2)}) for i in range(40)]
    vectors += [(41, None), (42, {}), (43, {0: None, 2: 2.0}), (7, {8: 3.0}), (44, vectors[3][1]), (45, {99: 1.0})]
    df = spark.createDataFrame(vectors, "id long, vector map<int,double>")
    asked = df.where("id % 4 = 0 or id = 45")
    want = []
    for q, w in ((q, w) for q, w in vectors if q % 4 == 0 or q == 45):
        met = [(-sum(x * w[d] for d, x in (v or {}).items() if d in w and x is not None), i) for i, v in vectors if any(d in w and x is not None for d, x in (v or {}).items())]
        want += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(met)[:6])]
    got = sparse.top_k_sparse(df, asked, 6)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan  # no row for each pair
    for name, value in (("_ROWS", 4), ("_QUERIES", 3), ("SHARD_ROWS", 8), ("QUERY_BYTES", 300)):  # the last one deals cells
        monkeypatch.setattr(sparse, name, value)
        assert sorted(map(tuple, sparse.top_k_sparse(df, asked, 6).collect())) == sorted(want)
    text = spark.createDataFrame([("b", {0: float("nan")}), ("a", {0: 1.0}), ("c", {0: float("inf")}), ("d", {0: 1.0})], "id string, vector map<int,double>")
    assert [r.id for r in sparse.top_k_sparse(text, text.where("id = 'a'"), 3).orderBy("rank").collect()] == ["b", "c", "a"]
    assert sparse.top_k_sparse(df, df.where("id < 0"), 3).count() == 0


def test_registry():
    r = udf.Registry()
    for v in ("1.0.0", "1.10.0", "1.2.0"):
        r.register(udf.Function("f", v, lambda x: x, ("x",), tags=("t",)))
    assert r.versions("f") == ["1.0.0", "1.2.0", "1.10.0"] and r.get("f").version == "1.10.0"
    assert len(r.query(tags=("t",))) == 3 and not r.query(author="me")
    with pytest.raises(ValueError):
        r.register(udf.Function("f", "1.0.0", lambda x: x))
    r.unregister("f", "1.10.0")
    assert r.get("f").version == "1.2.0"
    with pytest.raises(KeyError):
        r.get("g")
    f = udf.Function("g", "1", lambda **k: None, (), (udf.Parameter("a", "int", True), udf.Parameter("b", "double", False, 1.5)))
    assert f.arguments({"a": 3}) == {"a": 3, "b": 1.5}
    for bad in ({}, {"a": "x"}, {"a": 1, "c": 2}, {"a": True}):
        with pytest.raises(ValueError):
            f.arguments(bad)


def test_pipelines(service):
    p = Pipelines()
    p.create(Pipeline("q", "query", [synonym_stage({"cap": ["hat"]}), spelling_stage({"hat": 3, "cap": 1, "shoe": 2})]))
    p.associate("items", "query", "q")
    assert [r["_id"] for r in p.search(service, "items", {"query": {"match": {"title": "cap"}}}).hits.collect()] == ["3"]
    with pytest.raises(ValueError):
        p.delete("query", "q")

    def fail(_):
        raise RuntimeError("no")

    assert Pipeline("a", "document", [Stage("s", fail, "continue")]).execute(5) == 5
    tries = []
    with pytest.raises(StageError):
        Pipeline("b", "document", [Stage("s", lambda x: tries.append(x) or fail(x), "retry", retries=2)]).execute(1)
    assert len(tries) == 3
    with pytest.raises(ValueError):
        Pipeline("c", "nope", [Stage("s", fail)])


def test_request_without_a_size_takes_all_matches(spark, tmp_path):
    n = 100_050
    row = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("with").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(4).cast("long").alias("n_chars"))
    row.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["X12_pipeline"](spark, str(tmp_path))
    assert got.count() == got.distinct().count() == n
    spark.range(60).select(F.col("id").alias("p_partkey"), F.col("id").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(map(tuple, QUERIES["P27_script_fields"](spark, str(tmp_path)).collect())) == [(i, 2 * i) for i in range(60)]
    assert list(map(tuple, QUERIES["SC6_terms"](spark, str(tmp_path)).collect())) == [("with", n, n)]
    with pytest.raises(ValueError):
        SearchRequest.parse({"size": -1})


def test_term_dictionary_counts_ids_once(spark):
    """In one shuffle of terms, if ids are unique; an id that is repeated counts once, a null one not at all."""
    catalog = Catalog(spark)
    for name, rows in (("own", [(1, "a b A"), (2, "b"), (3, None), (4, "")]), ("mixed", [(1, "a b a"), (1, "a c"), (2, "b b"), (None, "a z"), (None, None)])):
        catalog.register(name, spark.createDataFrame(rows, "id int, text string"), order=["id"], text=TextSettings({"text": "multilingual"}))
    terms = SearchService(catalog).terms
    assert sorted(map(tuple, terms("own", "text").collect())) == [("a", 1, 2), ("b", 2, 2)]
    assert sorted(map(tuple, terms("mixed", "text").collect())) == [("a", 1, 4), ("b", 2, 3), ("c", 1, 1), ("z", 0, 1)]
    assert terms("own", "text")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_bulk(spark, tmp_path):
    writer = IndexWriter(spark, f"{tmp_path}/index")
    text = '{"index": {"_id": "1"}}\n{"a": 1, "b": "x"}\n{"create": {"_id": "2"}}\n{"a": 2}\n{"update": {"_id": "1"}}\n{"doc": {"b": "y"}}\n'
    assert writer.bulk(parse_bulk(text, "i")) == {"index": 1, "create": 1, "update": 1, "delete": 0}
    assert sorted((r["_id"], r["a"], r["b"]) for r in writer.read().collect()) == [("1", 1, "y"), ("2", 2, None)]
    writer.bulk([Action("update", "i", "2", {"a": 7, "c": True}), Action("delete", "i", "1"), Action("index", "i", "3", {"a": 9})])
    assert sorted((r["_id"], r["a"], r["c"]) for r in writer.read().collect()) == [("2", 7, True), ("3", 9, None)]
    writer.vacuum()
    assert writer.read().count() == 2
    for bad in ("{}", '{"index": {}}', '{"index": {"_id": "1"}}', '{"nope": {"_id": "1"}}\n{}', "x"):
        with pytest.raises(ValueError):
            parse_bulk(bad, "i")
    writer.drop()
    assert not writer.exists()


def test_lookup_table_from_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text("k,v\na,1\nb,2\na,3\n")
    catalog = Catalog(spark)
    table = catalog.lookups.load_csv("l", f"{tmp_path}/l.csv", "k")
    assert sorted(map(tuple, table.collect())) == [("a", "3"), ("b", "2")]
    assert catalog.lookups.list() == ["l"]
    with pytest.raises(ValueError):
        catalog.lookups.load_csv("m", f"{tmp_path}/l.csv", "z")


def test_streams(spark, tmp_path, sf):
    source = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    out = streams.timechart(stream, "ts", "1 day", {"n": F.count(F.lit(1))}, ["event_type"], "60 days")
    q = out.writeStream.format("memory").queryName("chart").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM chart").first()[0] == source.count()
    d = streams.dedup(stream, "ts", ["user_id"], "60 days").writeStream.format("memory").queryName("dd").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/d").start()
    d.awaitTermination(120)
    assert spark.sql("SELECT count(*) FROM dd").first()[0] == source.select("user_id").distinct().count()
