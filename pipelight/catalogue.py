"""Registered queries of the engine and the SQL each must agree with.

A query is (name, callable); most are texts of the piped language or JSON requests over the tables of
a folder.  Floating sums and means are rounded on both sides, for their order of addition differs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import udf
from .operators import ordered
from .plans.compiler import Engine
from .plans.pipelines import Pipeline, Pipelines, rerank_stage, synonym_stage
from .search import sparse
from .search.service import SearchService
from .search.text import ANALYZERS, FOLD_FROM, FOLD_TO, STOP_WORDS, Analyzer, TextSettings
from .sources.catalog import Lookups, folder_catalog
from .sources.scratch import shared_folder
from .sources.writer import IndexWriter, parse_bulk

FLAGSHIP = "stats_by_event_type"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def ppl(name: str, text: str, oracle: str | None = None, post: Callable[[DataFrame], DataFrame] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = Engine(folder_catalog(spark, sf_dir)).query(text)
        return post(out) if post else out

    add(name, run, oracle)


def add(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


#: Tokens of the search oracles, which DuckDB can make too.
PLAIN = Analyzer("words", lower=True)


def service(spark: SparkSession, sf_dir: str) -> SearchService:
    catalog = folder_catalog(spark, sf_dir)
    catalog.text["documents"] = TextSettings({"text": PLAIN})
    return SearchService(catalog, registry(), {"orders": "o_orderkey", "events": "event_id", "lineitem": "l_orderkey", "conversations": "conv_id"})


#: Indexes of documents.text that were built, by application and folder.
_INDEXES: dict[tuple[str, str], dict] = {}


def indexed(spark: SparkSession, sf_dir: str) -> SearchService:
    """A service that scores documents.text by a stored index, built when it is first asked for."""
    out = service(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        out.build_index("documents", "text")
        _INDEXES[key] = out.indexed
    out.indexed = _INDEXES[key]
    return out


def registry() -> udf.Registry:
    out = udf.Registry()
    out.register(udf.text_distance("n_name"))
    out.register(udf.Function("expensive", "1.0.0", lambda p_retailprice, least: p_retailprice >= least, ("p_retailprice",), (udf.Parameter("least", "double", True),)))
    return out


def search(name: str, index: str, query: dict, columns: list[str], oracle: str) -> None:
    """All rows that match."""
    add(name, lambda spark, sf_dir: service(spark, sf_dir).matching(index, query, scored=False).select(*columns), oracle)


def scored(name: str, index: str, query: dict, columns: list[str], oracle: str) -> None:
    add(name, lambda spark, sf_dir: indexed(spark, sf_dir).matching(index, query).select(*columns, F.round("_score", 6).alias("score")), oracle)


def agg(name: str, index: str, spec: dict, oracle: str, post: Callable[[DataFrame], DataFrame] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = service(spark, sf_dir).search(index, {"size": 0, "aggs": {"a": spec}}).aggregations["a"]
        return post(out) if post else out

    add(name, run, oracle)


def rounded(*names: str, digits: int = 4) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({n: F.round(n, digits) for n in names})


# -- scans, projection, filters ------------------------------------------------------------------
ppl("stats_by_event_type", "source=events | where value > 50 | stats count() as n, avg(value) as avg_v by event_type | sort event_type", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_v FROM events WHERE value > 50 GROUP BY event_type", rounded("avg_v", digits=6))
ppl("S1_scan", "source=region", "SELECT r_regionkey, r_name FROM region")
ppl("S1_search_where", "search source=nation n_regionkey = 2", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
add("S5_count", lambda s, d: s.createDataFrame([(service(s, d).count("events", {"range": {"value": {"gte": 100}}}),)], "n long"), "SELECT count(*) AS n FROM events WHERE value >= 100")
add("S7_get_by_id", lambda s, d: service(s, d).get("documents", "17").select("doc_id", "lang", "_id"), "SELECT doc_id, lang, CAST(doc_id AS VARCHAR) AS _id FROM documents WHERE doc_id = 17")
add("S13_multi_search", lambda s, d: _multi(s, d), "(SELECT 'a' AS part, CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_regionkey = 1 ORDER BY n_nationkey LIMIT 3) UNION ALL (SELECT 'b', CAST(r_regionkey AS VARCHAR) FROM region WHERE r_regionkey > 2)")
add("S16_describe", lambda s, d: Engine(folder_catalog(s, d)).query("describe region").select("name"), "SELECT unnest(['r_regionkey', 'r_name']) AS name")
add("S17_showdatasources", lambda s, d: Engine(folder_catalog(s, d)).query("showdatasources"), "SELECT unnest(['benchmark','conversations','customer','documents','embeddings','events','labels','lineitem','nation','orders','pages','part','region','supplier']) AS name")
add("S18_explain", lambda s, d: Engine(folder_catalog(s, d)).query("explain source=events | where value > 3 | fields event_id"))
ppl("P1_where", "source=lineitem | where l_quantity > 45 and l_discount < 0.02 | fields l_orderkey, l_linenumber", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02")
ppl("P1_where_or_not", "source=part | where not p_size > 10 or p_brand in ('Brand#11', 'Brand#12') | fields p_partkey", "SELECT p_partkey FROM part WHERE NOT p_size > 10 OR p_brand IN ('Brand#11', 'Brand#12')")
ppl("P2_fields", "source=customer | fields c_custkey, c_name", "SELECT c_custkey, c_name FROM customer")
ppl("P2_fields_exclude", "source=nation | fields - n_regionkey", "SELECT n_nationkey, n_name FROM nation")
ppl("P3_table", "source=region | table r_name, nothing, r_regionkey", "SELECT r_name, CAST(NULL AS VARCHAR) AS nothing, r_regionkey FROM region")
ppl("P4_eval_seq", "source=part | eval a = p_retailprice * 2, b = a + p_size | fields p_partkey, b", "SELECT p_partkey, p_retailprice * 2 + p_size AS b FROM part")
ppl("P5_rename", "source=region | rename r_name as name", "SELECT r_regionkey, r_name AS name FROM region")
ppl("P6_replace", "source=events | replace 'click' with 'tap', 'view' with 'look' in event_type | fields event_id, event_type", "SELECT event_id, replace(replace(event_type, 'click', 'tap'), 'view', 'look') AS event_type FROM events")
ppl("P6_replace_regex", "source=part | replace '/Brand#([0-9])[0-9]*/' with 'B' in p_brand | fields p_partkey, p_brand", "SELECT p_partkey, regexp_replace(p_brand, 'Brand#([0-9])[0-9]*', 'B', 'g') AS p_brand FROM part")
ppl("P7_fillnull", "source=documents | join type=left doc_id [source=labels] | fillnull value=0 fields quality, toxic | fields doc_id, quality, toxic", "SELECT d.doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
ppl("P8_fillnull_each", "source=documents | join type=left doc_id [source=labels] | fillnull quality=7, toxic=9 | fields doc_id, quality, toxic", "SELECT d.doc_id, coalesce(quality, 7) AS quality, coalesce(toxic, 9) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
ppl("P9_parse", "source=pages | parse url 'https?://(?<host>[^/]+)/(?<lang>[a-z]+)/' | where isnotnull(host) | fields page_id, host, lang", "SELECT page_id, regexp_extract(url, 'https?://([^/]+)/([a-z]+)/', 1) AS host, regexp_extract(url, 'https?://([^/]+)/([a-z]+)/', 2) AS lang FROM pages WHERE regexp_matches(url, 'https?://([^/]+)/([a-z]+)/')")
ppl("P10_rex", 'source=events | rex field=props "(?<key_name>[a-z]+)\\W+(?<num>[0-9]+)" | fields event_id, key_name, num', "SELECT event_id, regexp_extract(props, '([a-z]+)\\W+([0-9]+)', 1) AS key_name, regexp_extract(props, '([a-z]+)\\W+([0-9]+)', 2) AS num FROM events")
ppl("P11_grok", "source=pages | grok url '%{URIPROTO:proto}://%{HOSTNAME:host}/%{GREEDYDATA:rest}' | fields page_id, proto, host", "SELECT page_id, CASE WHEN regexp_matches(url, m) THEN regexp_extract(url, m, 1) END AS proto, CASE WHEN regexp_matches(url, m) THEN regexp_extract(url, m, 2) END AS host FROM (SELECT page_id, url, '([A-Za-z][A-Za-z0-9+.-]*)://(\\b[0-9A-Za-z][0-9A-Za-z-]{0,62}(?:\\.[0-9A-Za-z][0-9A-Za-z-]{0,62})*\\.?)/(.*)' AS m FROM pages)")
ppl("P12_grok_typed", "source=events | grok props '%{NUMBER:k:int}' | stats sum(k) as total, max(k) as top", "SELECT CAST(sum(k) AS BIGINT) AS total, max(k) AS top FROM (SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)")
ppl("P13_spath", "source=events | spath input=props path=k output=k | fields event_id, k", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
ppl("P13_spath_auto", "source=events | spath input=props | fields event_id, k", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
ppl("P14_flatten", "source=part | eval word = split(p_name, ' ') | flatten word | fields p_partkey, word", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
ppl("P15_bin_span", "source=events | bin ts span=6h | stats count() as n by ts", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, count(*) AS n FROM events GROUP BY 1")
ppl("P15_bin_number", "source=orders | bin o_totalprice span=5000 | stats count() as n by o_totalprice", "SELECT floor(o_totalprice / 5000) * 5000 AS o_totalprice, count(*) AS n FROM orders GROUP BY 1")
ppl("P16_bin_bins", "source=part | bin p_size bins=10 | stats count() as n by p_size", "SELECT floor(p_size / 10.0) * 10.0::DOUBLE AS p_size, count(*) AS n FROM part GROUP BY 1")
ppl(
    "P17_bin_auto",
    "source=events | bin ts span=auto | stats count() as n by ts",
    "WITH w AS (SELECT epoch(max(ts)) - epoch(min(ts)) AS width FROM events), z AS (SELECT coalesce(min(size), 31536000) AS size FROM (SELECT unnest([1, 60, 300, 600, 1800, 3600, 10800, 21600, 43200, 86400, 604800, 2592000]) AS size), w WHERE width / size <= 100)"
    " SELECT time_bucket(to_seconds(size), ts, TIMESTAMP '1970-01-01') AS ts, count(*) AS n FROM events, z GROUP BY 1",
)
ppl("P18_operators", "source=lineitem | eval a = l_extendedprice * (1 - l_discount), b = l_quantity % 7, c = l_quantity / 0, d = l_returnflag . '/' . l_linestatus | fields l_orderkey, l_linenumber, a, b, c, d", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS a, l_quantity % 7 AS b, CAST(NULL AS DOUBLE) AS c, l_returnflag || '/' || l_linestatus AS d FROM lineitem", rounded("a"))
ppl("P20_like", "source=part | where p_type like '%STEEL%' or p_name like 'blue%' | fields p_partkey", "SELECT p_partkey FROM part WHERE p_type LIKE '%STEEL%' OR p_name LIKE 'blue%'")
ppl("P21_in", "source=orders | where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus not in ('F') | stats count() as n", "SELECT count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')")
ppl("P22_case", "source=events | eval band = case when value > 200 then 'hi' when value > 50 then 'mid' else 'lo' end | stats count() as n by band", "SELECT CASE WHEN value > 200 THEN 'hi' WHEN value > 50 THEN 'mid' ELSE 'lo' END AS band, count(*) AS n FROM events GROUP BY 1")
ppl("P23_array_index", "source=part | eval words = split(p_name, ' ') | eval first = words[0], third = words[2] | fields p_partkey, first, third", "SELECT p_partkey, string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[3] AS third FROM part")
add("P25_source_projection", lambda s, d: service(s, d).search("nation", {"query": {"term": {"n_regionkey": 3}}, "_source": ["n_name"], "size": 100}).hits.select("n_name", "_id"), "SELECT n_name, CAST(n_nationkey AS VARCHAR) AS _id FROM nation WHERE n_regionkey = 3")

# -- joins, lookups, subqueries, sets ------------------------------------------------------------
ppl("J1_inner", "source=orders | rename o_custkey as c_custkey | join c_custkey [source=customer] | stats count() as n by c_mktsegment", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
ppl("J1_collision", "source=labels | join doc_id [source=labels | fields doc_id, quality] | fields doc_id, quality, quality_right", "SELECT a.doc_id, a.quality, b.quality AS quality_right FROM labels a JOIN labels b USING (doc_id)")
ppl("J2_left", "source=customer | join type=left c_custkey [source=orders | rename o_custkey as c_custkey] | stats count(o_orderkey) as n by c_custkey", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
ppl("J3_right", "source=labels | where toxic = 1 | join type=right doc_id [source=documents | fields doc_id, lang] | fields doc_id, lang, quality", "SELECT d.doc_id, d.lang, l.quality FROM (SELECT * FROM labels WHERE toxic = 1) l RIGHT JOIN documents d ON l.doc_id = d.doc_id")
ppl("J3_full", "source=lineitem | where l_quantity > 49 | stats count() as na by l_suppkey | rename l_suppkey as k | join type=full k [source=supplier | stats count() as nb by s_suppkey | rename s_suppkey as k]", "SELECT coalesce(a.k, b.k) AS k, na, nb FROM (SELECT l_suppkey k, count(*) na FROM lineitem WHERE l_quantity > 49 GROUP BY 1) a FULL JOIN (SELECT s_suppkey k, count(*) nb FROM supplier GROUP BY 1) b ON a.k = b.k")
ppl("J4_lookup", "source=lineitem | lookup part p_partkey as l_partkey output p_brand as brand | stats count() as n by brand", "SELECT p_brand AS brand, count(*) AS n FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1")
ppl("J5_append", "source=region | append [source=nation | fields n_nationkey]", "SELECT r_regionkey, r_name, NULL::INT AS n_nationkey FROM region UNION ALL SELECT NULL, NULL, n_nationkey FROM nation")
ppl("J6_appendcol", "source=nation | fields n_nationkey | appendcol [source=part | fields p_name]", "SELECT n_nationkey, p_name FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation) LEFT JOIN (SELECT p_name, row_number() OVER (ORDER BY p_partkey) AS r FROM part) USING (r)")
ppl("J7_appendpipe", "source=events | stats count() as n by event_type | appendpipe [stats sum(n) as n | eval event_type = 'all']", "WITH a AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n FROM a UNION ALL SELECT 'all', CAST(sum(n) AS BIGINT) FROM a")
ppl("J8_in", "source=orders | where o_custkey in [source=customer | where c_acctbal > 9000 | fields c_custkey] | fields o_orderkey", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
ppl("J8_not_in", "source=customer | where c_custkey not in [source=orders | where o_totalprice > 400000 | fields o_custkey] | fields c_custkey", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 400000)")
ppl("J9_exists", "source=region | where exists [source=part | where p_size > 49] | fields r_name", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM part WHERE p_size > 49)")
ppl("J9_not_exists", "source=region | where not exists [source=part | where p_size > 4900] | fields r_name", "SELECT r_name FROM region WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size > 4900)")
ppl("J10_scalar", "source=events | where value > [source=events | stats avg(value)] | fields event_id", "SELECT event_id FROM events WHERE value > (SELECT avg(value) FROM events)")

# -- aggregates ----------------------------------------------------------------------------------
ppl("A1_stats_global", "source=lineitem | stats count() as n, sum(l_quantity) as q, max(l_shipdate) as d", "SELECT count(*) AS n, round(sum(l_quantity), 4) AS q, max(l_shipdate) AS d FROM lineitem", rounded("q"))
ppl("A2_stats", "source=lineitem | stats count() as n, sum(l_quantity) as q, min(l_tax) as mn, max(l_tax) as mx by l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS q, min(l_tax) AS mn, max(l_tax) AS mx FROM lineitem GROUP BY ALL", rounded("q"))
ppl("A4_dc", "source=events | stats dc(user_id) as u, count(distinct props) as p by event_type", "SELECT event_type, count(DISTINCT user_id) AS u, count(DISTINCT props) AS p FROM events GROUP BY 1")
ppl("A6_spread", "source=events | stats stdev(value) as sd, stdevp(value) as sp, var(value) as vr, varp(value) as vp, median(value) as md, range(value) as rg, percentile(value, 90) as p90", "SELECT round(stddev_samp(value), 4) AS sd, round(stddev_pop(value), 4) AS sp, round(var_samp(value), 4) AS vr, round(var_pop(value), 4) AS vp, round(median(value), 4) AS md, round(max(value) - min(value), 4) AS rg, round(quantile_cont(value, 0.9), 4) AS p90 FROM events", rounded("sd", "sp", "vr", "vp", "md", "rg", "p90"))
ppl("A6_earliest_latest", "source=events | stats earliest(event_id) as a, latest(event_id) as z, first(value) as f, last(value) as l by event_type", "SELECT event_type, arg_min(event_id, ts) AS a, arg_max(event_id, ts) AS z, arg_min(value, ts) AS f, arg_max(value, ts) AS l FROM events GROUP BY 1")
ppl("A6_values_mode", "source=nation | stats values(n_name) as v, mode(n_regionkey) as m by n_regionkey | eval v = concat_ws(',', v) | fields n_regionkey, v, m", "SELECT n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS v, mode(n_regionkey) AS m FROM nation GROUP BY 1")
ppl("A7_chart", "source=orders | chart count() by o_orderstatus, o_orderpriority limit=0", "SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS \"1-URGENT\", count(*) FILTER (o_orderpriority = '2-HIGH') AS \"2-HIGH\", count(*) FILTER (o_orderpriority = '3-MEDIUM') AS \"3-MEDIUM\", count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS \"4-NOT SPECIFIED\", count(*) FILTER (o_orderpriority = '5-LOW') AS \"5-LOW\" FROM orders GROUP BY 1")
ppl("A8_timechart", "source=events | timechart span=1d count() as n by event_type", "SELECT date_trunc('day', ts)::TIMESTAMP AS _time, event_type, count(*) AS n FROM events GROUP BY 1, 2")
ppl("A8_timechart_limit", "source=events | timechart span=7d limit=2 count() as n by event_type", "WITH b AS (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 2) SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS _time, CASE WHEN event_type IN (SELECT event_type FROM b) THEN event_type ELSE 'OTHER' END AS event_type, count(*) AS n FROM events GROUP BY 1, 2")
ppl("A9_top", "source=part | top 4 p_brand", "SELECT p_brand, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM part), 6) AS percent FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4", rounded("percent", digits=6))
ppl("A9_top_by", "source=lineitem | top 2 l_suppkey by l_returnflag", "SELECT * FROM (SELECT l_returnflag, l_suppkey, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS percent FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY count DESC, l_suppkey) <= 2", rounded("percent", digits=6))
ppl("A9_top_other", "source=part | top 3 p_brand useother=true countfield=n showperc=false", "WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, p_brand LIMIT 3) SELECT p_brand, n FROM t UNION ALL SELECT 'OTHER', CAST((SELECT sum(n) FROM c) - (SELECT sum(n) FROM t) AS BIGINT)")
ppl("A10_rare", "source=part | rare 5 p_brand showperc=false", "SELECT p_brand, count(*) AS count FROM part GROUP BY 1 ORDER BY 2, 1 LIMIT 5")
ppl("A11_dedup", "source=events | sort ts, event_id | dedup 2 user_id | fields event_id, user_id", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 2")
ppl("A11_dedup_sortby", "source=events | dedup event_type sortby - value | fields event_id, event_type", "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, ts, event_id) = 1")
ppl("A11_dedup_consecutive", "source=events | dedup event_type consecutive=true | fields event_id", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
ppl("A11_dedup_keepevents", "source=events | dedup user_id keepevents=true | fields event_id, user_id", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN user_id END AS user_id FROM events")
ppl("A12_addtotals", "source=lineitem | addtotals l_quantity, l_tax fieldname=t | fields l_orderkey, l_linenumber, t", "SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax, 6) AS t FROM lineitem", rounded("t", digits=6))
ppl("A12_addtotals_col", "source=nation | addtotals row=false col=true labelfield=n_name n_regionkey | fields n_name, n_regionkey", "SELECT n_name, n_regionkey::DOUBLE AS n_regionkey FROM nation UNION ALL SELECT 'Total', sum(n_regionkey)::DOUBLE FROM nation")
ppl("A13_addcoltotals", "source=part | fields p_partkey, p_size, p_retailprice | addcoltotals p_size p_retailprice", "SELECT p_partkey, p_size, p_retailprice, round(p_size + p_retailprice, 4) AS Total FROM part", rounded("Total"))
agg("A20_terms", "lineitem", {"terms": {"field": "l_suppkey", "size": 7}}, "SELECT l_suppkey AS key, count(*) AS doc_count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
agg("A20_terms_sub", "lineitem", {"terms": {"field": "l_returnflag"}, "aggs": {"q": {"avg": {"field": "l_quantity"}}}}, "SELECT l_returnflag AS key, count(*) AS doc_count, round(avg(l_quantity), 4) AS q FROM lineitem GROUP BY 1", rounded("q"))
agg("A20_terms_nested", "lineitem", {"terms": {"field": "l_returnflag"}, "aggs": {"s": {"terms": {"field": "l_linestatus", "size": 5}}}}, "WITH c AS (SELECT l_returnflag AS key, l_linestatus AS s_key, count(*) AS s_doc_count FROM lineitem GROUP BY 1, 2) SELECT key, CAST(sum(s_doc_count) OVER (PARTITION BY key) AS BIGINT) AS doc_count, s_key, s_doc_count FROM c")
agg("A21_histogram", "orders", {"histogram": {"field": "o_totalprice", "interval": 1000}}, "SELECT floor(o_totalprice / 1000) * 1000 AS key, count(*) AS doc_count FROM orders GROUP BY 1")
agg("A22_date_histogram", "orders", {"date_histogram": {"field": "o_orderdate", "calendar_interval": "month"}}, "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS key, count(*) AS doc_count FROM orders GROUP BY 1")
agg("A22_date_histogram_fixed", "events", {"date_histogram": {"field": "ts", "fixed_interval": "12h"}}, "SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS key, count(*) AS doc_count FROM events GROUP BY 1")
agg("A23_range", "part", {"range": {"field": "p_size", "ranges": [{"to": 10}, {"from": 10, "to": 30}, {"key": "big", "from": 20}]}}, "SELECT '*-10.0' AS key, count(*) FILTER (p_size < 10) AS doc_count FROM part UNION ALL SELECT '10.0-30.0', count(*) FILTER (p_size >= 10 AND p_size < 30) FROM part UNION ALL SELECT 'big', count(*) FILTER (p_size >= 20) FROM part")
agg("A24_filters", "events", {"filters": {"filters": {"clicks": {"term": {"event_type": "click"}}, "large": {"range": {"value": {"gt": 200}}}}}}, "SELECT 'clicks' AS key, count(*) FILTER (event_type = 'click') AS doc_count FROM events UNION ALL SELECT 'large', count(*) FILTER (value > 200) FROM events")
agg("A24_filters_sub", "events", {"filters": {"filters": [{"term": {"event_type": "click"}}, {"range": {"value": {"gt": 100}}}]}, "aggs": {"v": {"max": {"field": "value"}}}}, "SELECT '0' AS key, count(*) AS doc_count, max(value) AS v FROM events WHERE event_type = 'click' UNION ALL SELECT '1', count(*), max(value) FROM events WHERE value > 100")
agg("A25_stats", "events", {"stats": {"field": "value"}}, "SELECT count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 4) AS avg, round(sum(value), 2) AS sum FROM events", lambda df: df.withColumns({"avg": F.round("avg", 4), "sum": F.round("sum", 2)}))
agg("A26_extended_stats", "events", {"extended_stats": {"field": "value"}}, "SELECT count(value) AS count, round(var_pop(value), 4) AS variance, round(stddev_pop(value), 4) AS std_deviation, round(avg(value) + 2 * stddev_pop(value), 4) AS upper, round(avg(value) - 2 * stddev_pop(value), 4) AS lower FROM events", lambda df: df.select("count", *(F.round(c, 4).alias(c) for c in ("variance", "std_deviation", "upper", "lower"))))
agg("A27_percentiles", "events", {"percentiles": {"field": "value", "percents": [50, 95]}}, "SELECT round(quantile_cont(value, 0.5), 4) AS \"50\", round(quantile_cont(value, 0.95), 4) AS \"95\" FROM events", lambda df: df.select(*(F.round(F.col(f"`{c}`"), 4).alias(c) for c in ("50", "95"))))
agg("A28_cardinality", "events", {"cardinality": {"field": "user_id"}}, "SELECT count(DISTINCT user_id) AS value FROM events")
for _kind, _sql in (("avg", "round(avg(p_retailprice), 4)"), ("min", "min(p_retailprice)"), ("max", "max(p_retailprice)"), ("sum", "round(sum(p_retailprice), 2)"), ("value_count", "count(p_retailprice)")):
    agg(f"A29_{_kind}", "part", {_kind: {"field": "p_retailprice"}}, f"SELECT {_sql} AS value FROM part", rounded("value", digits=2 if _kind == "sum" else 4) if _kind in ("avg", "sum") else None)

# -- windows, order ------------------------------------------------------------------------------
ppl("W1_eventstats", "source=events | eventstats avg(value) as a, count() as n by event_type | fields event_id, a, n", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type), 6) AS a, count(*) OVER (PARTITION BY event_type) AS n FROM events", rounded("a", digits=6))
ppl("W1_eventstats_global", "source=events | eventstats max(value) as m | where value = m | fields event_id", "SELECT event_id FROM events WHERE value = (SELECT max(value) FROM events)")
ppl("W2_streamstats", "source=events | streamstats sum(value) as s, count() as n by user_id | fields event_id, s, n", "SELECT event_id, round(sum(value) OVER w, 4) AS s, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)", rounded("s"))
ppl("W2_streamstats_global", "source=events | streamstats sum(value) as s, max(value) as x, avg(user_id) as a | fields event_id, s, x, a", "SELECT event_id, round(sum(value) OVER w, 4) AS s, max(value) OVER w AS x, avg(user_id) OVER w AS a FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)", rounded("s"))
ppl("W3_window", "source=events | streamstats window=5 avg(value) as m | fields event_id, m", "SELECT event_id, round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS m FROM events", rounded("m"))
ppl("W4_current_false", "source=events | streamstats window=3 current=false max(value) as m by user_id | fields event_id, m", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m FROM events")
ppl("O1_sort_head", "source=orders | sort - o_totalprice, o_orderkey | head 20 | fields o_orderkey, o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
ppl("O3_head", "source=events | head 7 | fields event_id", "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 7")
ppl("O4_reverse", "source=events | sort value, event_id | reverse | head 5 | fields event_id", "SELECT event_id FROM events ORDER BY value DESC, event_id DESC LIMIT 5")
add("O5_dsl_sort_page", lambda s, d: service(s, d).search("orders", {"sort": [{"o_totalprice": {"order": "desc"}}], "from": 10, "size": 5, "_source": ["o_orderkey", "o_totalprice"]}).hits.select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 5 OFFSET 10")
add("O_row_numbers", lambda s, d: ordered.numbered(s.read.parquet(f"{d}/events.parquet").select("event_id", "ts"), [("ts", True), ("event_id", True)], "n").select("event_id", F.col("n").cast("long").alias("n")), "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS n FROM events")

# -- query DSL -----------------------------------------------------------------------------------
search("Q1_match_all", "region", {"match_all": {}}, ["r_regionkey"], "SELECT r_regionkey FROM region")
search("Q2_term", "part", {"term": {"p_brand": "Brand#12"}}, ["p_partkey"], "SELECT p_partkey FROM part WHERE p_brand = 'Brand#12'")
search("Q3_terms", "part", {"terms": {"p_size": [1, 5, 9]}}, ["p_partkey"], "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9)")
search("Q4_range", "orders", {"range": {"o_totalprice": {"gte": 100000, "lt": 150000}}}, ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 150000")
search("Q5_exists", "events", {"exists": {"field": "value"}}, ["event_id"], "SELECT event_id FROM events WHERE value IS NOT NULL")
search("Q6_prefix", "part", {"prefix": {"p_name": "blue"}}, ["p_partkey"], "SELECT p_partkey FROM part WHERE starts_with(p_name, 'blue')")
search("Q7_wildcard", "part", {"wildcard": {"p_brand": "Brand#?2*"}}, ["p_partkey"], "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#.2.*')")
search("Q8_fuzzy", "nation", {"fuzzy": {"n_name": {"value": "NATION_1", "fuzziness": 1}}}, ["n_name"], "SELECT n_name FROM nation WHERE levenshtein(n_name, 'NATION_1') <= 1")
_TOKENS = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+(?:[''.][\\p{L}\\p{N}]+)*'), lambda x: x <> '')"
search("Q9_match", "documents", {"match": {"text": "with from"}}, ["doc_id"], f"SELECT doc_id FROM documents WHERE list_has_any({_TOKENS}, ['with', 'from'])")
search("Q9_match_and", "documents", {"match": {"text": {"query": "with from", "operator": "and"}}}, ["doc_id"], f"SELECT doc_id FROM documents WHERE list_has_all({_TOKENS}, ['with', 'from'])")
search("Q10_match_phrase", "documents", {"match_phrase": {"text": "of the"}}, ["doc_id"], f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' of the ')")
search("Q11_multi_match", "documents", {"multi_match": {"query": "with", "fields": ["text", "source"]}}, ["doc_id"], f"SELECT doc_id FROM documents WHERE list_contains({_TOKENS}, 'with') OR lower(source) = 'with'")
search("Q12_query_string", "documents", {"query_string": {"query": "(with OR from) AND NOT is", "fields": ["text"]}}, ["doc_id"], f"SELECT doc_id FROM documents WHERE list_has_any({_TOKENS}, ['with', 'from']) AND NOT list_contains({_TOKENS}, 'is')")
search("Q12_simple_query_string", "documents", {"simple_query_string": {"query": "+with -from", "fields": ["text"]}}, ["doc_id"], f"SELECT doc_id FROM documents WHERE list_contains({_TOKENS}, 'with') AND NOT list_contains({_TOKENS}, 'from')")
search("Q13_bool", "part", {"bool": {"must": [{"range": {"p_size": {"gte": 5, "lte": 20}}}], "must_not": [{"term": {"p_brand": "Brand#12"}}], "should": [{"prefix": {"p_name": "blue"}}, {"prefix": {"p_name": "red"}}], "minimum_should_match": 1}}, ["p_partkey"], "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand <> 'Brand#12' AND (starts_with(p_name, 'blue') OR starts_with(p_name, 'red'))")
search("Q14_expr", "lineitem", {"expr": {"op": ">", "args": [{"op": "*", "args": [{"field": "l_extendedprice"}, {"op": "-", "args": [{"const": 1}, {"field": "l_discount"}]}]}, {"const": 50000}]}}, ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000")
search("Q15_udf", "part", {"wasm_udf": {"name": "expensive", "parameters": {"least": 950.0}}}, ["p_partkey"], "SELECT p_partkey FROM part WHERE p_retailprice >= 950")
_BM25 = f"""
WITH t AS (SELECT doc_id, {_TOKENS} AS tk FROM documents), d AS (SELECT doc_id, len(tk) AS dl, len(list_filter(tk, lambda x: x = 'from')) AS a, len(list_filter(tk, lambda x: x = 'with')) AS b FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS av, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM d)
SELECT doc_id, round(SCORE, 6) AS score FROM d, s WHERE CONDITION
"""
_PART = "ln(1 + (n - d{0} + 0.5) / (d{0} + 0.5)) * {0} * 2.2 / ({0} + 1.2 * (0.25 + 0.75 * dl / av))"


def bm25_sql(score: str, condition: str) -> str:
    return _BM25.replace("SCORE", score).replace("CONDITION", condition)


_FROM, _WITH = _PART.format("a"), _PART.format("b")
scored("SC1_bm25", "documents", {"term": {"text": "from"}}, ["doc_id"], bm25_sql(_FROM, "a > 0"))
scored("SC3_bool_scores", "documents", {"bool": {"must": [{"match": {"text": "from"}}], "should": [{"match": {"text": {"query": "with", "boost": 2.0}}}], "filter": [{"term": {"lang": "en"}}]}}, ["doc_id"], bm25_sql(f"{_FROM} + CASE WHEN b > 0 THEN 2.0 * {_WITH} ELSE 0 END", "a > 0 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"))
add("SC1_bm25_unindexed", lambda s, d: service(s, d).matching("documents", {"match": {"text": {"query": "from with", "operator": "and"}}}).select("doc_id", F.round("_score", 6).alias("score")), bm25_sql(f"{_FROM} + {_WITH}", "a > 0 AND b > 0"))
add("O8_top_docs", lambda s, d: indexed(s, d).search("documents", {"query": {"match": {"text": "from"}}, "size": 10}).hits.select("doc_id"), bm25_sql(_FROM, "a > 0").strip().replace("SELECT doc_id, round(", "SELECT doc_id FROM (SELECT doc_id, round(") + ") ORDER BY score DESC, CAST(doc_id AS VARCHAR) LIMIT 10")
add("SC6_terms", lambda s, d: service(s, d).terms("documents", "text"), f"WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS doc_freq, count(*) AS total_freq FROM t GROUP BY 1")
add("P27_script_fields", lambda s, d: service(s, d).search("part", {"sort": ["p_partkey"], "size": None, "_source": ["p_partkey"], "script_fields": {"twice": {"script": {"op": "*", "args": [{"field": "p_size"}, {"const": 2}]}}}}).hits.select("p_partkey", "twice"), "SELECT p_partkey, p_size * 2 AS twice FROM part")
_STANDARD = f"list_filter({_TOKENS}, lambda x: x NOT IN ({', '.join(repr(w) for w in STOP_WORDS)}))"


def relevance(name: str, condition: str, sql: str) -> None:
    """A full-text condition in where; sql is over tk, the text's tokens, and flat, the same between spaces."""
    ppl(name, f"source=documents | where {condition} | fields doc_id", f"SELECT doc_id FROM (SELECT doc_id, tk, ' ' || array_to_string(tk, ' ') || ' ' AS flat FROM (SELECT doc_id, {_STANDARD} AS tk FROM documents)) WHERE {sql}")


relevance("F_relevance_where", "match_phrase(text, 'anthat thnt') or match_bool_prefix(text, 'zzz ed')", "flat LIKE '% anthat thnt %' OR list_contains(tk, 'zzz') OR len(list_filter(tk, lambda x: starts_with(x, 'ed'))) > 0")
relevance("F_relevance_match", "match(text, 'from which')", "list_contains(tk, 'from') OR list_contains(tk, 'which')")
relevance("F_relevance_phrase_prefix", "match_phrase_prefix(text, 'from th')", "flat LIKE '% from th%'")
relevance("F_relevance_multi", "multi_match(['text'], 'from')", "list_contains(tk, 'from')")
relevance("F_relevance_query_string", "query_string(['text'], 'from AND NOT which')", "list_contains(tk, 'from') AND NOT list_contains(tk, 'which')")
relevance("F_relevance_simple", "simple_query_string(['text'], 'from -which')", "list_contains(tk, 'from') AND NOT list_contains(tk, 'which')")

# -- vectors -------------------------------------------------------------------------------------
add("V1_cosine", lambda s, d: _nearest(s, d), "SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 4) AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, 1 LIMIT 10")
add("V2_sparse_topk", lambda s, d: _sparse(s, d), "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0.05 THEN x::DOUBLE ELSE 0 END) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_dot_product(v.e, q.e) AS score FROM v, v q WHERE q.vec_id % 20 = 0) SELECT query_id, id, round(score, 6) AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5")
add("V1_algebra", lambda s, d: _algebra(s, d), "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 4) AS n1, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS n2, CAST(len(list_filter(embedding, lambda x: abs(x::DOUBLE) >= 0.2)) AS INTEGER) AS kept FROM embeddings")


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = '{"index": "nation"}\n{"query": {"term": {"n_regionkey": 1}}, "sort": ["n_nationkey"], "size": 3}\n{"index": "region"}\n{"query": {"range": {"r_regionkey": {"gt": 2}}}}\n'
    a, b = service(spark, sf_dir).multi_search(lines)
    return a.hits.select(F.lit("a").alias("part"), F.col("_id").alias("id")).unionByName(b.hits.select(F.lit("b").alias("part"), F.col("_id").alias("id")))


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    query = df.where("vec_id = 0").select("embedding").first()[0]
    return sparse.nearest(df, query, 10, "vec_id", "embedding").select("vec_id", F.round("score", 4).alias("sim"))


def _sparse(spark: SparkSession, sf_dir: str, every: int = 20) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), sparse.from_dense(F.transform("embedding", lambda x: F.when(x > 0.05, x.cast("double")).otherwise(0.0))).alias("vector"))
    return sparse.top_k_sparse(v, v.where(F.col("id") % every == 0), 5).select("query_id", "id", F.round("score", 6).alias("score"))


def _algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", sparse.from_dense(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(sparse.norm1(F.col("v")), 4).alias("n1"), F.round(sparse.norm(F.col("v")), 4).alias("n2"), F.size(sparse.prune_by_threshold(F.col("v"), 0.2)).alias("kept"))


# -- functions, one query for each family ----------------------------------------------------------
ppl("F_math", "source=part | eval a = abs(0 - p_size), b = round(p_retailprice / 3, 2), c = floor(p_retailprice), d = ceil(p_retailprice), e = sqrt(p_size), f = pow(p_size, 2), g = mod(p_size, 7), h = sign(0 - p_size), i = truncate(p_retailprice, 1), j = ln(p_size), k = bit_and(p_size, 12), l = degrees(p_size), m = atan2(p_size, 2), n = cbrt(p_size) | fields p_partkey, a, b, c, d, e, f, g, h, i, j, k, l, m, n", "SELECT p_partkey, abs(0 - p_size) AS a, round(p_retailprice / 3, 2) AS b, CAST(floor(p_retailprice) AS BIGINT) AS c, CAST(ceil(p_retailprice) AS BIGINT) AS d, round(sqrt(p_size), 6) AS e, pow(p_size, 2) AS f, p_size % 7 AS g, CAST(sign(0 - p_size) AS INTEGER) AS h, floor(p_retailprice * 10) / 10 AS i, round(ln(p_size), 6) AS j, p_size & 12 AS k, round(degrees(p_size), 6) AS l, round(atan2(p_size, 2), 6) AS m, round(cbrt(p_size), 6) AS n FROM part", rounded("e", "j", "l", "m", "n", digits=6))
ppl("F_string", "source=part | eval a = upper(p_name), b = substring(p_name, 2, 3), c = length(p_name), d = concat(p_brand, '-', p_name), e = left(p_name, 2), f = right(p_name, 2), g = replace(p_name, 'e', 'E'), h = reverse(p_name), i = locate('e', p_name), j = lpad(p_brand, 12, '*'), k = regexp_replace(p_name, '[aeiou]', '_'), l = ascii(p_name), m = trim('  x '), n = concat_ws('/', p_brand, p_type) | fields p_partkey, a, b, c, d, e, f, g, h, i, j, k, l, m, n", "SELECT p_partkey, upper(p_name) AS a, substring(p_name, 2, 3) AS b, CAST(length(p_name) AS INTEGER) AS c, p_brand || '-' || p_name AS d, left(p_name, 2) AS e, right(p_name, 2) AS f, replace(p_name, 'e', 'E') AS g, reverse(p_name) AS h, CAST(instr(p_name, 'e') AS INTEGER) AS i, lpad(p_brand, 12, '*') AS j, regexp_replace(p_name, '[aeiou]', '_', 'g') AS k, ascii(p_name) AS l, 'x' AS m, p_brand || '/' || p_type AS n FROM part")
ppl("F_date", "source=orders | eval a = year(o_orderdate), b = month(o_orderdate), c = dayofweek(o_orderdate), d = weekofyear(o_orderdate), e = quarter(o_orderdate), f = dayname(o_orderdate), g = monthname(o_orderdate), h = date_format(o_orderdate, '%Y-%m-%d %H:%i'), i = to_days(o_orderdate), j = last_day(o_orderdate), k = datediff(o_orderdate, '1992-01-01'), l = unix_timestamp(o_orderdate), m = date_add(o_orderdate, 10), n = timestampdiff('DAY', '1992-01-01 00:00:00', o_orderdate), o = dayofyear(o_orderdate) | fields o_orderkey, a, b, c, d, e, f, g, h, i, j, k, l, m, n, o", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS a, CAST(month(o_orderdate) AS INTEGER) AS b, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS c, CAST(weekofyear(o_orderdate) AS INTEGER) AS d, CAST(quarter(o_orderdate) AS INTEGER) AS e, dayname(o_orderdate) AS f, monthname(o_orderdate) AS g, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS h, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719528 AS INTEGER) AS i, last_day(o_orderdate) AS j, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS k, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS l, CAST(o_orderdate AS DATE) + 10 AS m, CAST(date_sub('day', TIMESTAMP '1992-01-01', o_orderdate) AS BIGINT) AS n, CAST(dayofyear(o_orderdate) AS INTEGER) AS o FROM orders")
ppl("F_type", "source=events | eval a = int(value), b = string(event_id), c = cast(value as string), d = double('1.5'), e = try_cast(event_type as int), f = bool('true'), g = long('12') | fields event_id, a, b, d, e, f, g", "SELECT event_id, CAST(trunc(value) AS INTEGER) AS a, CAST(event_id AS VARCHAR) AS b, 1.5::DOUBLE AS d, CAST(NULL AS INTEGER) AS e, true AS f, 12::BIGINT AS g FROM events")
ppl("F_conditional", "source=documents | join type=left doc_id [source=labels] | eval a = isnull(quality), b = ifnull(quality, 5), c = nullif(lang, 'en'), d = coalesce(toxic, quality, 3), e = if(n_chars > 100, 'long', 'short'), f = greatest(quality, toxic), g = nvl2(quality, 'y', 'n'), h = between(n_chars, 10, 50) | fields doc_id, a, b, c, d, e, f, g, h", "SELECT doc_id, quality IS NULL AS a, coalesce(quality, 5) AS b, nullif(lang, 'en') AS c, coalesce(toxic, quality, 3) AS d, CASE WHEN n_chars > 100 THEN 'long' ELSE 'short' END AS e, greatest(quality, toxic) AS f, CASE WHEN quality IS NOT NULL THEN 'y' ELSE 'n' END AS g, n_chars BETWEEN 10 AND 50 AS h FROM documents LEFT JOIN labels USING (doc_id)")
ppl("F_crypto", "source=nation | eval a = md5(n_name), b = sha1(n_name), c = sha256(n_name), d = base64(n_name), e = base64decode(base64(n_name)), f = hex(n_name), g = unhex(hex(n_name)), h = urlencode(n_name . ' &') | fields n_nationkey, a, b, c, d, e, f, g", "SELECT n_nationkey, md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c, base64(encode(n_name)) AS d, n_name AS e, hex(n_name) AS f, n_name AS g FROM nation")
ppl("F_ip", "source=nation | eval ip = intToIP(167772160 + n_nationkey * 70000) | eval a = ipToInt(ip), b = isPrivateIP(ip), c = cidr(ip, '10.5.0.0/16'), d = ipNetwork(ip, '255.255.0.0'), e = isValidIP(ip), f = isLoopbackIP('127.0.0.1'), g = ipRange(ip, '10.1.0.0', '10.9.0.0'), h = isValidIPv6('fe80::1') | fields n_nationkey, ip, a, b, c, d, e, f, g, h", "WITH t AS (SELECT n_nationkey, 167772160::BIGINT + n_nationkey * 70000 AS n FROM nation) SELECT n_nationkey, concat_ws('.', n >> 24, (n >> 16) & 255, (n >> 8) & 255, n & 255) AS ip, n AS a, (n >> 24) = 10 AS b, (n >> 16) = 2565 AS c, concat_ws('.', n >> 24, (n >> 16) & 255, 0, 0) AS d, true AS e, true AS f, n BETWEEN 167837696 AND 168361984 AS g, true AS h FROM t")
ppl("F_json", "source=events | eval a = json_extract(props, '$.k'), b = json_valid(props), c = json_length(props), d = json_type(props), e = json_object('id', event_id, 't', event_type), f = json_array_contains('[\"a\",\"b\"]', 'b'), g = json_set(props, '$.z', 1), h = json_delete(props, '$.k') | fields event_id, a, b, c, d, e, f, g, h", "SELECT event_id, json_extract_string(props, '$.k') AS a, true AS b, 1::INTEGER AS c, 'object' AS d, '{\"id\":' || event_id || ',\"t\":\"' || event_type || '\"}' AS e, true AS f, '{\"k\":' || json_extract_string(props, '$.k') || ',\"z\":1}' AS g, '{}' AS h FROM events")
ppl("F_system", "source=region | eval a = version(), b = typeof(r_name), c = isnull(null()) | fields r_regionkey, a, b, c", "SELECT r_regionkey, '0.1.0' AS a, 'string' AS b, true AS c FROM region")

# -- pipelines -----------------------------------------------------------------------------------

# -- writes, lookup files, analyzers --------------------------------------------------------------


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nations are indexed, those of region 1 again with another name; then updates and deletes."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("_id"), "n_name", "n_regionkey")
    writer = IndexWriter(spark, f"{shared_folder(spark)}/pipelight/index-{uuid.uuid4().hex}")
    writer.index(nation)
    writer.index(nation.where("n_regionkey = 1").withColumn("n_name", F.lower("n_name")))
    writer.update(nation.where("n_regionkey = 2").select("_id", F.lit(9).alias("n_regionkey"), F.lit("changed").alias("note")))
    writer.delete(nation.where("n_regionkey = 3").select("_id"))
    return writer.read()


add(
    "S8_index_update_delete",
    _written,
    "SELECT CAST(n_nationkey AS VARCHAR) AS _id, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n_name, CASE WHEN n_regionkey = 2 THEN 9 ELSE n_regionkey END AS n_regionkey, CASE WHEN n_regionkey = 2 THEN 'changed' END AS note FROM nation WHERE n_regionkey <> 3",
)


def _bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulk request over an index of all regions."""
    writer = IndexWriter(spark, f"{shared_folder(spark)}/pipelight/index-{uuid.uuid4().hex}")
    writer.index(spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("string").alias("_id"), "r_name"))
    lines = ('{"index": {"_id": "0"}}', '{"r_name": "first"}', '{"create": {"_id": "77"}}', '{"r_name": "new"}', '{"update": {"_id": "1"}}', '{"doc": {"r_name": "second"}}', '{"delete": {"_id": "2"}}')
    writer.bulk(parse_bulk("\n".join(lines) + "\n", "region"))
    return writer.read()


add("S9_bulk", _bulk, "SELECT CAST(r_regionkey AS VARCHAR) AS _id, CASE r_regionkey WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 2 UNION ALL SELECT '77', 'new'")


def _csv_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup table from a file of lines, joined to nations."""
    path = f"{shared_folder(spark)}/pipelight/lookup-{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", F.lower("r_name").alias("area")).write.option("header", True).csv(path)
    table = Lookups(spark).load_csv("areas", path, "r_regionkey")
    catalog = folder_catalog(spark, sf_dir)
    catalog.register("areas", table)
    return Engine(catalog).query("source=nation | lookup areas r_regionkey as n_regionkey output area | fields n_name, area")


add("S11_csv_lookup", _csv_lookup, "SELECT n_name, lower(r_name) AS area FROM nation JOIN region ON n_regionkey = r_regionkey")
add("A30_count", lambda s, d: s.createDataFrame([(service(s, d).count("documents", {"term": {"lang": "en"}}),)], "n long"), "SELECT count(*) AS n FROM documents WHERE lang = 'en'")


def analyzed(name: str, sql: str) -> None:
    """How many tokens an analyzer makes of each text, and which ones."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tokens = ANALYZERS[name].column(F.col("text"))
        return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.size(tokens).cast("long").alias("n"), F.md5(F.concat_ws(" ", tokens)).alias("tokens"))

    add(f"T_{name}", run, f"SELECT doc_id, CAST(len(tk) AS BIGINT) AS n, md5(array_to_string(tk, ' ')) AS tokens FROM (SELECT doc_id, {sql} AS tk FROM documents)")


_SPLIT = "list_filter(regexp_split_to_array({}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
analyzed("whitespace", _SPLIT.format("coalesce(text, '')"))
analyzed("simple", _SPLIT.format("lower(coalesce(text, ''))"))
analyzed("keyword", "list_filter([coalesce(text, '')], lambda x: x <> '')")
analyzed("standard", _STANDARD)
_FOLDED = _TOKENS.replace("lower(coalesce(text, ''))", f"translate(lower(coalesce(text, '')), '{FOLD_FROM}', '{FOLD_TO}')")
analyzed("multilingual", _FOLDED)
analyzed("english", _STANDARD.replace(_TOKENS, _FOLDED))
analyzed("search", _STANDARD.replace(_TOKENS, _FOLDED))

# -- functions, the rest ------------------------------------------------------------------------------

ppl(
    "F_math_more",
    "source=part | eval a = round(log10(p_size), 6), b = round(log2(p_size), 6), c = round(exp(p_size / 50.0), 6), d = round(tan(p_size), 5), e = round(acos(p_size / 100.0), 6), f = round(atan(p_size), 6), g = round(cot(p_size), 5), h = round(e(), 6), i = round(pi(), 6), j = bit_or(p_size, 12), k = bit_xor(p_size, 12), l = bit_not(p_size), m = round(sin(p_size), 6), n = round(cos(p_size), 6), o = round(asin(p_size / 100.0), 6), q = round(radians(p_size), 6), s = rand() >= 0 and rand() < 1"
    " | fields p_partkey, a, b, c, d, e, f, g, h, i, j, k, l, m, n, o, q, s",
    "SELECT p_partkey, round(log10(p_size), 6) AS a, round(log2(p_size), 6) AS b, round(exp(p_size / 50.0), 6) AS c, round(tan(p_size), 5) AS d, round(acos(p_size / 100.0), 6) AS e, round(atan(p_size), 6) AS f, round(cot(p_size), 5) AS g, round(exp(1.0::DOUBLE), 6) AS h, round(pi(), 6) AS i, p_size | 12 AS j, xor(p_size, 12) AS k, ~p_size AS l, round(sin(p_size), 6) AS m, round(cos(p_size), 6) AS n, round(asin(p_size / 100.0), 6) AS o, round(radians(p_size), 6) AS q, true AS s FROM part",
)
ppl(
    "F_string_more",
    "source=part | eval a = ltrim(concat('  ', p_name)), b = rtrim(concat(p_name, '  ')), c = repeat(p_brand, 2), d = regexp(p_name, '^[a-m]'), e = like(p_name, '%e%'), f = rpad(p_brand, 12, '*'), g = chr(65 + mod(p_size, 26)), h = lower(upper(p_name)), i = instr(p_name, 'a'), j = regexp_extract(p_type, '([A-Za-z]+)', 1), k = mid(p_name, 1, 2), l = ucase(p_name), m = char_length(p_name)"
    " | fields p_partkey, a, b, c, d, e, f, g, h, i, j, k, l, m",
    "SELECT p_partkey, p_name AS a, p_name AS b, repeat(p_brand, 2) AS c, regexp_matches(p_name, '^[a-m]') AS d, p_name LIKE '%e%' AS e, rpad(p_brand, 12, '*') AS f, chr(65 + p_size % 26) AS g, lower(p_name) AS h, CAST(instr(p_name, 'a') AS INTEGER) AS i, regexp_extract(p_type, '([A-Za-z]+)', 1) AS j, substring(p_name, 1, 2) AS k, upper(p_name) AS l, CAST(length(p_name) AS INTEGER) AS m FROM part",
)
ppl(
    "F_date_more",
    "source=events | eval a = day(ts), b = hour(ts), c = minute(ts), d = second(ts), e = microsecond(ts), f = date(ts), g = time(ts), h = makedate(2024, 60), i = maketime(1, 2, 3), j = date_format(addtime(ts, '01:30:00'), '%Y-%m-%d %H:%i:%s'), k = date_format(subtime(ts, '00:00:30'), '%Y-%m-%d %H:%i:%s'), l = timediff('10:00:00', '08:30:15'), m = period_add(202411, 3), n = period_diff(202403, 202312), o = from_days(to_days(ts)), p = to_seconds(ts), q = date_format(from_unixtime(unix_timestamp(ts)), '%Y-%m-%d %H:%i:%s'), r = date_format(convert_tz(ts, 'UTC', 'Asia/Tokyo'), '%Y-%m-%d %H:%i'), s = date_format(str_to_date('2024-03-05', '%Y-%m-%d'), '%d.%m.%Y'), t = time_format(ts, '%H:%i'), u = date_sub(ts, 10)"
    " | fields event_id, a, b, c, d, e, f, g, h, i, j, k, l, m, n, o, p, q, r, s, t, u",
    "SELECT event_id, CAST(day(ts) AS INTEGER) AS a, CAST(hour(ts) AS INTEGER) AS b, CAST(minute(ts) AS INTEGER) AS c, CAST(second(ts) AS INTEGER) AS d, CAST(microsecond(ts) % 1000000 AS INTEGER) AS e, CAST(ts AS DATE) AS f, strftime(ts, '%H:%M:%S') AS g, DATE '2024-02-29' AS h, '01:02:03' AS i, strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS j, strftime(ts - INTERVAL 30 SECOND, '%Y-%m-%d %H:%M:%S') AS k, '01:29:45' AS l, 202502::BIGINT AS m, 3::BIGINT AS n, CAST(ts AS DATE) AS o, CAST(epoch(date_trunc('second', ts)) AS BIGINT) + 62167219200 AS p, strftime(ts, '%Y-%m-%d %H:%M:%S') AS q, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS r, '05.03.2024' AS s, strftime(ts, '%H:%M') AS t, CAST(ts AS DATE) - 10 AS u FROM events",
)
ppl(
    "F_date_now",
    "source=region | eval a = datediff(now(), curdate()), b = now() = sysdate(), c = length(curtime()), d = abs(datediff(utc_date(), curdate())) <= 1, e = length(utc_time()), f = abs(datediff(utc_timestamp(), now())) <= 1, g = year(now()) >= 2024, h = unix_timestamp() > 1700000000"
    " | fields r_regionkey, a, b, c, d, e, f, g, h",
    "SELECT r_regionkey, 0::INTEGER AS a, true AS b, 8::INTEGER AS c, true AS d, 8::INTEGER AS e, true AS f, true AS g, true AS h FROM region",
)
ppl(
    "F_type_more",
    "source=events | eval a = cast(value as string), b = cast(event_type as int), c = convert('12', 'long'), d = convert(event_type, 'double'), e = float('1.5'), f = cast('2024-01-05' as date), g = cast('x' as timestamp), h = tolong('7'), i = cast(1 as boolean)"
    " | eval a = length(a) > 0 | fields event_id, a, b, c, d, e, f, h, i | eval g = isnull(d)",
    "SELECT event_id, true AS a, CAST(NULL AS INTEGER) AS b, 12::BIGINT AS c, CAST(NULL AS DOUBLE) AS d, 1.5::FLOAT AS e, DATE '2024-01-05' AS f, 7::BIGINT AS h, true AS i, true AS g FROM events",
)
ppl(
    "F_conditional_more",
    "source=nation | eval a = case(n_nationkey < 5, 'low', n_nationkey < 10, 'mid', 'high'), b = in(n_nationkey, 1, 2, 3), c = least(n_nationkey, 7), d = isnotnull(nullif(n_regionkey, 0)), e = case(n_nationkey < 5, 1) | fields n_nationkey, a, b, c, d, e",
    "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'low' WHEN n_nationkey < 10 THEN 'mid' ELSE 'high' END AS a, n_nationkey IN (1, 2, 3) AS b, least(n_nationkey, 7) AS c, n_regionkey <> 0 AS d, CASE WHEN n_nationkey < 5 THEN 1 END AS e FROM nation",
)
ppl(
    "F_crypto_more",
    "source=region | eval a = sha512('abc'), b = urlencode(concat(r_name, ' &/?')), c = urldecode(urlencode(concat(r_name, ' &/?'))), d = urldecode('%zz'), e = sha2(r_name, 256) | eval d = isnull(d) | fields r_regionkey, a, b, c, d, e",
    "SELECT r_regionkey, 'ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f' AS a, replace(r_name, ' ', '+') || '+%26%2F%3F' AS b, r_name || ' &/?' AS c, true AS d, sha256(r_name) AS e FROM region",
)
ppl(
    "F_ip_more",
    "source=nation | eval ip = intToIP(167772160 + n_nationkey * 70000) | eval a = isValidIPv4(ip), b = isPublicIP(ip), c = isPublicIP('8.8.8.8'), d = isMulticastIP('224.1.2.3'), e = isMulticastIP(ip), f = cidrContains('10.0.0.0/8', ip), g = ipBroadcast(ip, '255.255.0.0'), h = ipNetmask('10.0.0.0/20'), i = isValidIPv4('300.1.1.1'), j = isLoopbackIP(ip)"
    " | fields n_nationkey, a, b, c, d, e, f, g, h, i, j",
    "WITH t AS (SELECT n_nationkey, 167772160::BIGINT + n_nationkey * 70000 AS n FROM nation) SELECT n_nationkey, true AS a, false AS b, true AS c, true AS d, false AS e, true AS f, concat_ws('.', n >> 24, (n >> 16) & 255, 255, 255) AS g, '255.255.240.0' AS h, false AS i, false AS j FROM t",
)
ppl(
    "F_json_more",
    "source=events | eval a = json_extract_scalar(props, '$.k'), b = json_keys(props), c = json_values(props), d = json_array(event_id, event_type), e = json_array_append('[1]', event_id), f = json_format('{\"a\":1}'), g = json_compact('{ \"a\" : 1 }'), h = json_array_length('[1,2,3]')"
    " | eval b = concat_ws(',', b), c = concat_ws(',', c) | fields event_id, a, b, c, d, e, f, g, h",
    "SELECT event_id, json_extract_string(props, '$.k') AS a, 'k' AS b, json_extract_string(props, '$.k') AS c, '[' || event_id || ',\"' || event_type || '\"]' AS d, '[1,' || event_id || ']' AS e, '{' || chr(10) || '  \"a\": 1' || chr(10) || '}' AS f, '{\"a\":1}' AS g, 3::INTEGER AS h FROM events",
)
ppl(
    "F_system_more",
    "source=region | eval a = database() = current_schema(), b = user() = session_user(), c = length(connection_id()) > 0, d = length(current_catalog()) > 0, e = length(current_user()) > 0 | fields r_regionkey, a, b, c, d, e",
    "SELECT r_regionkey, true AS a, true AS b, true AS c, true AS d, true AS e FROM region",
)
ppl(
    "A2_aggregates_more",
    "source=events | stats approx_count_distinct(event_type) as a, percentile_approx(user_id, 50) as b, list(event_type) as c, median(event_id) as m, stdevp(event_id) as s, varp(event_id) as v, sum(distinct user_id) as u | eval c = length(concat_ws('', c)), s = round(s, 4), v = round(v, 2)",
    "SELECT approx_count_distinct(event_type) * 0 + count(DISTINCT event_type) AS a, quantile_disc(user_id, 0.5) AS b, CAST(sum(length(event_type)) AS INTEGER) AS c, median(event_id) AS m, round(stddev_pop(event_id), 4) AS s, round(var_pop(event_id), 2) AS v, CAST(sum(DISTINCT user_id) AS BIGINT) AS u FROM events",
)
ppl("A6_first_descending", "source=events | sort - value, event_id | stats first(event_id) as f, last(event_id) as l", "SELECT first(event_id ORDER BY value DESC, event_id) AS f, last(event_id ORDER BY value DESC, event_id) AS l FROM events")
ppl(
    "A6_first_descending_by",
    "source=events | sort event_type, - value, - ts | stats first(event_id) as f, last(event_id) as l by event_type",
    "SELECT event_type, first(event_id ORDER BY value DESC, ts DESC, event_id) AS f, last(event_id ORDER BY value DESC, ts DESC, event_id) AS l FROM events GROUP BY event_type",
)
ppl(
    "A6_first_descending_text",
    "source=part | sort - p_name, p_partkey | stats first(p_partkey) as f, last(p_partkey) as l by p_brand",
    "SELECT p_brand, first(p_partkey ORDER BY p_name DESC, p_partkey) AS f, last(p_partkey ORDER BY p_name DESC, p_partkey) AS l FROM part GROUP BY p_brand",
)
ppl(
    "W1_eventstats_nullable",
    "source=documents | join type=left doc_id [source=labels] | eventstats bucket_nullable=true count() as n by quality | fields doc_id, quality, n",
    "SELECT doc_id, quality, count(*) OVER (PARTITION BY quality) AS n FROM documents LEFT JOIN labels USING (doc_id)",
)
ppl(
    "W4_reset_by",
    "source=events | streamstats reset_after=(event_type = 'purchase') count() as n by user_id | fields event_id, n",
    "SELECT event_id, count(*) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS n FROM (SELECT *, coalesce(sum((event_type = 'purchase')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM events)",
)
ppl(
    "W4_reset_before",
    "source=events | streamstats reset_before=(event_type = 'signup') count() as n, sum(event_id) as s | fields event_id, n, s",
    "SELECT event_id, count(*) OVER w AS n, CAST(sum(event_id) OVER w AS BIGINT) AS s FROM (SELECT *, sum((event_type = 'signup')::INTEGER) OVER (ORDER BY ts, event_id) AS run FROM events) WINDOW w AS (PARTITION BY run ORDER BY ts, event_id)",
)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipelines = Pipelines()
    pipelines.create(Pipeline("expand", "query", [synonym_stage({"with": ["from"]})]))
    pipelines.create(Pipeline("order", "result", [rerank_stage({"n_chars": 1.0})]))
    pipelines.associate("documents", "query", "expand")
    pipelines.associate("documents", "result", "order")
    return pipelines.search(service(spark, sf_dir), "documents", {"query": {"match": {"text": "with"}}, "size": None}).hits.select("doc_id", F.col("_score").cast("long").alias("score"))


add("X12_pipeline", _pipeline, f"SELECT doc_id, n_chars AS score FROM documents WHERE list_has_any({_TOKENS}, ['with', 'from'])")
search("X8_text_distance", "nation", {"udf": {"name": "text_distance", "parameters": {"target": "NATION_1", "most": 1}}}, ["n_name"], "SELECT n_name FROM nation WHERE levenshtein(n_name, 'NATION_1') <= 1")
add("X8_haversine", lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.round(udf.haversine(F.col("n_nationkey") * 2.0, F.col("n_regionkey") * 10.0, 48.2, 16.4), 3).alias("km")), "SELECT n_nationkey, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(n_nationkey * 2.0) - radians(48.2)) / 2), 2) + cos(radians(n_nationkey * 2.0)) * cos(radians(48.2)) * pow(sin((radians(n_regionkey * 10.0) - radians(16.4)) / 2), 2)))), 3) AS km FROM nation")
