"""Registered queries of the engine over whole tables, and their SQL."""

from __future__ import annotations

import json
import math
import tempfile
import uuid
from functools import reduce

from pyspark.sql import functions as F

from larkspur.functions import analysis
from larkspur.operators import aggs, postings, search, vector
from larkspur.operators.dsl import Compiler, Schema
from larkspur.plans import golden
from larkspur.sources import catalog, ingest, schema
from larkspur.streaming import log

QUERIES: dict = {}
ORACLES: dict = {}
Q = [round(math.sin(i + 1), 3) for i in range(64)]
_STANDARD = "list_transform(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+(?:[''’.:·][\\p{L}\\p{M}\\p{N}_]+)*'), lambda x: lower(x))"
_T = "list_transform(regexp_extract_all(text, '\\w+'), lambda x: lower(x))"


def _add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pred(table: str, query: dict, cols: list[str], compat: bool = True):
    def run(spark, d):
        df = _t(spark, d, table)
        return df.where(Compiler(Schema.of(df.schema, ("text",), compat=compat, default="regexp")).compile(query).pred).select(*cols)

    return run


def _filter(name: str, table: str, query: dict, where: str, cols: str, compat: bool = True) -> None:
    _add(name, _pred(table, query, cols.split(", "), compat), f"select {cols} from {table} where {where}")


has = lambda *w: " and ".join(f"list_contains({_T}, '{x}')" for x in w)

# -- matching text
_filter("match_or", "documents", {"match": {"text": "with thon"}}, f"list_has_any({_T}, ['with', 'thon'])", "doc_id")
_filter("match_and", "documents", {"match": {"text": {"query": "with thon", "operator": "and"}}}, has("with", "thon"), "doc_id")
_filter("match_msm", "documents", {"match": {"text": {"query": "with thon er st", "minimum_should_match": "75%"}}}, f"(list_contains({_T}, 'with')::int + list_contains({_T}, 'thon')::int + list_contains({_T}, 'er')::int + list_contains({_T}, 'st')::int) >= 3", "doc_id")
_filter("match_fuzzy", "documents", {"match": {"text": {"query": "thonn", "fuzziness": 1}}}, f"len(list_filter({_T}, lambda x: levenshtein(x, 'thonn') <= 1)) > 0", "doc_id")
_filter("multi_match", "documents", {"multi_match": {"query": "en", "fields": ["text", "lang"]}}, f"{has('en')} or lang = 'en'", "doc_id")
_filter("match_phrase", "documents", {"match_phrase": {"text": "of the"}}, f"contains(' ' || array_to_string({_T}, ' ') || ' ', ' of the ')", "doc_id")
_filter("match_bool_prefix", "documents", {"match_bool_prefix": {"text": "thon wit"}}, f"{has('thon')} or len(list_filter({_T}, lambda x: starts_with(x, 'wit'))) > 0", "doc_id")
_filter("match_phrase_prefix", "documents", {"match_phrase_prefix": {"text": "of the wit"}}, f"contains(' ' || array_to_string({_T}, ' ') || ' ', ' of the ') and len(list_filter({_T}, lambda x: starts_with(x, 'wit'))) > 0", "doc_id")
_filter("terms_text", "documents", {"terms": {"text": ["nd", "ea"]}}, f"list_has_any({_T}, ['nd', 'ea'])", "doc_id")
_filter("query_string", "documents", {"query_string": {"query": '+text:with -text:thon lang:en "of the"'}}, f"{has('with')} and not {has('thon')}", "doc_id")
_filter("wildcard_text", "documents", {"wildcard": {"text": "thon?e*"}}, f"len(list_filter({_T}, lambda x: regexp_full_match(x, 'thon.e.*'))) > 0", "doc_id")
# -- keywords, numbers, dates
_filter("match_all", "nation", {"match_all": {}}, "true", "n_nationkey, n_name")
_filter("match_none", "nation", {"match_none": {}}, "false", "n_nationkey, n_name")
_filter("term_keyword", "orders", {"term": {"o_orderstatus": "F"}}, "o_orderstatus = 'F'", "o_orderkey, o_orderstatus")
_filter("term_numeric", "part", {"term": {"p_size": 10}}, "p_size = 10", "p_partkey, p_size")
_filter("terms_keyword", "orders", {"terms": {"o_orderstatus": ["F", "P"]}}, "o_orderstatus in ('F', 'P')", "o_orderkey, o_orderstatus")
_filter("prefix_keyword", "part", {"prefix": {"p_type": "S"}}, "starts_with(p_type, 'S')", "p_partkey, p_type")
_filter("wildcard_keyword", "part", {"wildcard": {"p_brand": "Brand#?2"}}, "regexp_full_match(p_brand, 'Brand#.2')", "p_partkey, p_brand")
_filter("regexp_keyword", "part", {"regexp": {"p_brand": "Brand#[1-3]."}}, "regexp_full_match(p_brand, 'Brand#[1-3].')", "p_partkey, p_brand")
_filter("fuzzy_keyword", "orders", {"fuzzy": {"o_orderpriority": {"value": "1-URGEN", "fuzziness": 1}}}, "levenshtein(o_orderpriority, '1-URGEN') <= 1", "o_orderkey, o_orderpriority")
_filter("range_numeric", "lineitem", {"range": {"l_quantity": {"gte": 10, "lt": 20}}}, "l_quantity >= 10 and l_quantity < 20", "l_orderkey, l_linenumber, l_quantity")
_filter("range_numeric_compat", "customer", {"range": {"c_acctbal": {"gte": -500, "lt": 500}}}, "c_acctbal > 0 and c_acctbal < 500", "c_custkey, c_acctbal")
_filter("range_numeric_plain", "customer", {"range": {"c_acctbal": {"gte": -500, "lt": 500}}}, "c_acctbal >= -500 and c_acctbal < 500", "c_custkey, c_acctbal", compat=False)
_filter("range_date", "orders", {"range": {"o_orderdate": {"gte": "1995-01-01", "lt": "1996-01-01"}}}, "o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01'", "o_orderkey")
_filter("bool_nested", "orders", {"bool": {"must": [{"term": {"o_orderstatus": "O"}}], "must_not": [{"prefix": {"o_orderpriority": "5"}}], "filter": {"range": {"o_totalprice": {"gt": 1000}}}}}, "o_orderstatus = 'O' and not starts_with(o_orderpriority, '5') and o_totalprice > 1000", "o_orderkey")
_filter("bool_msm", "lineitem", {"bool": {"should": [{"term": {"l_returnflag": "R"}}, {"term": {"l_linestatus": "F"}}, {"range": {"l_quantity": {"gt": 25}}}], "minimum_should_match": 2}}, "(l_returnflag = 'R')::int + (l_linestatus = 'F')::int + (l_quantity > 25)::int >= 2", "l_orderkey, l_linenumber")
_add("ids", lambda s, d: (lambda df: df.where(Compiler(Schema.of(df.schema)).compile({"ids": {"values": ["1", "7", "99"]}}).pred).select("o_orderkey"))(_t(s, d, "orders").withColumn("_id", F.col("o_orderkey").cast("string"))), "select o_orderkey from orders where o_orderkey in (1, 7, 99)")

# -- ranking
_BM25 = f"""
with t as (select doc_id, {_T} w from documents),
s as (select count(*) filter (len(w) > 0) n, sum(len(w)) / count(*) filter (len(w) > 0) avg from t),
d as (select count(*) filter (list_contains(w, 'with')) d1, count(*) filter (list_contains(w, 'thon')) d2 from t),
f as (select doc_id, len(w) dl, len(list_filter(w, lambda x: x = 'with'))::double f1, len(list_filter(w, lambda x: x = 'thon'))::double f2 from t where list_has_any(w, ['with', 'thon']))
select doc_id, round(ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 / (f1 + 1.2 * (0.25 + 0.75 * dl / avg))
                   + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * f2 / (f2 + 1.2 * (0.25 + 0.75 * dl / avg)), 6) score
from f, s, d order by score desc, doc_id limit 10
"""


def _bm25(s, d):
    df = _t(s, d, "documents").select("doc_id", "text")
    return search.search(df, {"query": {"match": {"text": "with thon"}}, "_source": False}, Schema.of(df.schema, ("text",), default="regexp"), id_col="doc_id").select("doc_id", F.round("_score", 6).alias("score"))


def _postings(s, d):
    df = _t(s, d, "documents")
    p = postings.build(df, analysis.tokens(F.col("text"), "regexp"), "doc_id")
    return postings.top(p, {"with": 1, "thon": 1}).select(F.col("id").alias("doc_id"), F.round("_score", 6).alias("score"))


def _postings_batch(s, d):
    df = _t(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("with "), "text")).otherwise(F.col("text")).alias("text"))
    words = analysis.tokens(F.col("text"), "regexp")
    before = postings.build(_t(s, d, "documents").where("doc_id % 3 != 1"), words, "doc_id")
    after = postings.apply(before, postings.build(df.where("doc_id % 5 = 0 and doc_id % 7 != 0"), words, "doc_id"), df.where("doc_id % 7 = 0").select(F.col("doc_id").alias("id")))
    return postings.bm25(after, {"with": 1, "thon": 1}).select(F.col("id").alias("doc_id"), F.round("_score", 6).alias("score"))


_BATCH = "(select doc_id, case when doc_id % 5 = 0 then 'with ' || text else text end as text from documents where doc_id % 7 != 0 and (doc_id % 3 != 1 or doc_id % 5 = 0))"

_add("bm25_topk", _bm25, _BM25)
_add("bm25_postings", _postings, _BM25)
_add("bm25_postings_batch", _postings_batch, _BM25.replace("from documents", f"from {_BATCH}").replace("order by score desc, doc_id limit 10", "where true"))
_add("sort_paging", lambda s, d: search.search(_t(s, d, "orders"), {"query": {"term": {"o_orderstatus": "F"}}, "sort": ["-o_totalprice", {"o_orderdate": "asc"}], "from": 20, "size": 15, "_source": ["o_total*", "o_custkey"]}, id_col="o_orderkey").drop("_score"), "select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderdate, o_orderkey limit 15 offset 20")
_add("highlight", lambda s, d: _t(s, d, "documents").select("doc_id", search.highlight(F.col("text"), ["with", "thon"]).alias("marked")), "select doc_id, regexp_replace(text, '(?i)\\b(thon|with)\\b', '<mark>\\1</mark>', 'g') marked from documents")
_add("total_hits", lambda s, d: search.count(_t(s, d, "documents"), {"match": {"text": "with"}}, Schema.of(_t(s, d, "documents").schema, ("text",), default="regexp")), f"select count(*) total from documents where {has('with')}")
_add("search_v1", lambda s, d: search.search_v1(_t(s, d, "orders"), {"search_type": "prefix", "query": {"field": "o_orderpriority", "term": "2"}, "max_results": 12, "sort_fields": ["-o_totalprice"], "_source": ["o_totalprice"]}, id_col="o_orderkey").drop("_score"), "select o_orderkey, o_totalprice from orders where starts_with(o_orderpriority, '2') order by o_totalprice desc, o_orderkey limit 12")


def _multi(s, d):
    a = _t(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    b = _t(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return search.multi_search({"customer": a, "supplier": b}, "cust*,supplier", {"query": {"range": {"bal": {"gt": 9000}}}, "sort": ["-bal"], "size": 25}).select("_id", "name", "bal", "_index")


_add("multi_index", _multi, "select * from (select 'c' || c_custkey _id, c_name name, c_acctbal bal, 'customer' _index from customer union all select 's' || s_suppkey, s_name, s_acctbal, 'supplier' from supplier) where bal > 9000 order by bal desc, _id limit 25")

# -- aggregations
_add("agg_metrics", lambda s, d: aggs.metrics(_t(s, d, "lineitem"), {"n": {"count": {}}, "avg_q": {"avg": {"field": "l_quantity"}}, "max_p": {"max": {"field": "l_extendedprice"}}, "min_p": {"min": {"field": "l_extendedprice"}}, "sum_q": {"sum": {"field": "l_quantity"}}, "parts": {"cardinality": {"field": "l_partkey", "exact": True}}}), "select count(*) n, avg(l_quantity) avg_q, max(l_extendedprice) max_p, min(l_extendedprice) min_p, sum(l_quantity) sum_q, count(distinct l_partkey) parts from lineitem")
_add("agg_weighted_avg", lambda s, d: aggs.metrics(_t(s, d, "lineitem"), {"w": {"weighted_avg": {"field": "l_discount", "weight_field": "l_quantity"}}}).select(F.round("w", 6).alias("w")), "select round(sum(l_discount * l_quantity) / sum(l_quantity), 6) w from lineitem")
_add("agg_cardinality", lambda s, d: aggs.metrics(_t(s, d, "lineitem"), {"n": {"cardinality": {"field": "l_partkey", "exact": True}}, "e": {"cardinality": {"field": "l_partkey"}}}).select("n", (F.abs(F.col("e") - F.col("n")) <= 0.15 * F.col("n")).alias("near")), "select count(distinct l_partkey) n, true near from lineitem")
_add("agg_terms", lambda s, d: aggs.terms(_t(s, d, "orders"), "o_orderpriority", aggs={"total": {"max": {"field": "o_totalprice"}}}), "select o_orderpriority key, count(*) doc_count, max(o_totalprice) total from orders group by 1")
_add("agg_terms_nested", lambda s, d: aggs.nested_terms(_t(s, d, "lineitem"), "l_returnflag", "l_linenumber", 2, 3), "with p as (select l_returnflag key, count(*) parent_count from lineitem group by 1 order by 2 desc, 1 limit 2), c as (select l_returnflag key, l_linenumber child, count(*) doc_count from lineitem group by 1, 2) select key, child, doc_count, parent_count from c join p using (key) qualify row_number() over (partition by key order by doc_count desc, child) <= 3")
_add("agg_range", lambda s, d: aggs.ranges(_t(s, d, "lineitem"), "l_quantity", [{"key": "low", "to": 10}, {"key": "mid", "from": 5, "to": 30}, {"key": "high", "from": 30, "to": 1000}]), "select 'low' key, count(*) filter (l_quantity >= 0 and l_quantity < 10) doc_count from lineitem union all select 'mid', count(*) filter (l_quantity >= 5 and l_quantity < 30) from lineitem union all select 'high', count(*) filter (l_quantity >= 30 and l_quantity < 1000) from lineitem")
_add("agg_date_range", lambda s, d: aggs.ranges(_t(s, d, "orders"), "o_orderdate", [{"key": "old", "to": "1995-01-01"}, {"key": "new", "from": "1995-01-01"}], date=True), "select 'old' key, count(*) filter (o_orderdate < timestamp '1995-01-01') doc_count from orders union all select 'new', count(*) filter (o_orderdate >= timestamp '1995-01-01') from orders")
_add("agg_histogram", lambda s, d: aggs.histogram(_t(s, d, "orders"), "o_totalprice", 7500.0, aggs={"top": {"max": {"field": "o_totalprice"}}}), "with b as (select floor(o_totalprice / 7500.0) i, count(*) c, max(o_totalprice) m from orders group by 1), e as (select min(i) lo, max(i) hi from b) select g.i * 7500.0::double key, coalesce(c, 0) doc_count, coalesce(m, 0) top from (select unnest(generate_series(lo::bigint, hi::bigint)) i from e) g left join b on b.i = g.i")
_add("agg_date_histogram_hour", lambda s, d: aggs.date_histogram(_t(s, d, "events"), "ts", fixed="1h").select(F.col("key").cast("string"), "doc_count"), "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') key, count(*) doc_count from events group by 1 order by 1 limit 1000")
for _u, _e in (("week", "date_trunc('day', o_orderdate) - interval 1 day * dayofweek(o_orderdate)"), ("month", "date_trunc('month', o_orderdate)"), ("quarter", "date_trunc('quarter', o_orderdate)"), ("year", "date_trunc('year', o_orderdate)")):
    _add(f"agg_date_histogram_{_u}", lambda s, d, u=_u: aggs.date_histogram(_t(s, d, "orders"), "o_orderdate", calendar=u).select(F.col("key").cast("string"), "doc_count"), f"select strftime({_e}, '%Y-%m-%d %H:%M:%S') key, count(*) doc_count from orders group by 1 order by 1 limit 1000")
_LADDER = ", ".join(f"({aggs.micros(x)})" for x in aggs.LADDER)
_add("agg_auto_date_histogram", lambda s, d: aggs.auto_date_histogram(_t(s, d, "events"), "ts", 10).select(F.unix_micros(F.col("key").cast("timestamp")).alias("key"), "doc_count"), f"with e as (select epoch_us(ts) u from events), x as (select min(u) lo, max(u) hi from e), p as (select min(s) s from (values {_LADDER}) l(s), x where hi // s - lo // s + 1 <= 10), b as (select u // s i, count(*) c from e, p group by 1) select g.i * s as key, coalesce(c, 0) doc_count from (select unnest(generate_series(lo // s, hi // s)) i, s from x, p) g left join b on b.i = g.i")
_add("agg_histogram_fraction", lambda s, d: aggs.histogram(_t(s, d, "customer").select((F.col("c_acctbal") / 1000).alias("v")), "v", 0.1, 0.05, extended=(-2.0, 11.0)).select(F.round("key", 6).alias("key"), "doc_count"), "with b as (select floor((c_acctbal / 1000 - 0.05) / 0.1)::bigint i, count(*) c from customer group by 1) select round(g.i * 0.1::double + 0.05, 6) as key, coalesce(c, 0) doc_count from (select unnest(generate_series(least(min(i), floor((-2 - 0.05) / 0.1)::bigint), greatest(max(i), floor((11 - 0.05) / 0.1)::bigint))) i from b) g left join b on b.i = g.i")
_M = lambda *n: [F.round(F.element_at("metrics", x), 4).alias(x) for x in n]
_keys = lambda: F.array_join("keys", "|").alias("keys")
_REQUEST = {"query": {"range": {"o_totalprice": {"gt": 100000}}}, "size": 0, "aggs": {"status": {"terms": {"field": "o_orderstatus", "size": 2}, "aggs": {"top": {"max": {"field": "o_totalprice"}}, "year": {"date_histogram": {"field": "o_orderdate", "calendar_interval": "year", "format": "2006"}, "aggs": {"top": {"max": {"field": "o_totalprice"}}}}}}, "top": {"max": {"field": "o_totalprice"}}, "price": {"range": {"field": "o_totalprice", "ranges": [{"key": "mid", "from": 100000, "to": 200000}, {"key": "high", "from": 200000, "to": 1000000}]}}}}
_add("search_aggs", lambda s, d: search.respond(_t(s, d, "orders"), _REQUEST, id_col="o_orderkey").aggregations.select("agg", _keys(), "doc_count", *_M("top")), "with o as (select * from orders where o_totalprice > 100000), p as (select o_orderstatus k, count(*) c, max(o_totalprice) m from o group by 1 order by 2 desc, 1 limit 2), y as (select o_orderstatus k, year(o_orderdate) y, count(*) c, max(o_totalprice) m from o where o_orderstatus in (select k from p) group by 1, 2) select '' agg, '' keys, count(*) doc_count, round(max(o_totalprice), 4) top from o union all select 'status', k, c, round(m, 4) from p union all select 'status>year', k || '|' || y, c, round(m, 4) from y union all select 'price', 'mid', count(*) filter (o_totalprice >= 100000 and o_totalprice < 200000), null from o union all select 'price', 'high', count(*) filter (o_totalprice >= 200000 and o_totalprice < 1000000), null from o")
_add("agg_nested_deep", lambda s, d: aggs.tree(_t(s, d, "lineitem"), {"flag": {"terms": {"field": "l_returnflag"}, "aggs": {"qty": {"histogram": {"field": "l_quantity", "interval": 12.5, "min_doc_count": 1}, "aggs": {"line": {"terms": {"field": "l_linenumber", "size": 2}, "aggs": {"avg_d": {"avg": {"field": "l_discount"}}}}}}}}}).select("agg", _keys(), "doc_count", *_M("avg_d")), "with a as (select l_returnflag f, floor(l_quantity / 12.5) * 12.5::double h, l_linenumber n, l_discount d from lineitem), t as (select f, h, n, count(*) c, avg(d) m from a group by f, h, n qualify row_number() over (partition by f, h order by count(*) desc, n::varchar) <= 2) select 'flag' agg, f keys, count(*) doc_count, null::double avg_d from a group by f union all select 'flag>qty', f || '|' || h, count(*), null from a group by f, h union all select 'flag>qty>line', f || '|' || h || '|' || n, c, round(m, 4) from t")
_add("agg_terms_missing", lambda s, d: aggs.tree(_t(s, d, "customer").withColumn("seg", F.nullif("c_mktsegment", F.lit("BUILDING"))), {"seg": {"terms": {"field": "seg"}}}, missing=True).select(_keys(), "doc_count"), "select case when c_mktsegment = 'BUILDING' then '' else c_mktsegment end keys, count(*) doc_count from customer group by 1")
_add("agg_date_histogram_format", lambda s, d: aggs.tree(_t(s, d, "events"), {"h": {"date_histogram": {"field": "ts", "fixed_interval": "6h", "format": "epoch_millis", "extended_bounds": {"min": 1672531200000, "max": 1672531200000}}}, "q": {"date_histogram": {"field": "ts", "calendar_interval": "week", "time_zone": "+02:00", "format": "2006-01-02", "min_doc_count": 1}}}).select("agg", _keys(), "doc_count"), "with e as (select epoch_ms(ts) // 21600000 i, count(*) c from events group by 1), x as (select least(min(i), 1672531200000 // 21600000) lo, greatest(max(i), 1672531200000 // 21600000) hi from e), w as (select date_trunc('day', ts + interval 2 hour) - interval 1 day * dayofweek(ts + interval 2 hour) w, count(*) c from events group by 1) select 'h' agg, (g.i * 21600000)::varchar keys, coalesce(c, 0) doc_count from (select unnest(generate_series(lo, hi)) i from x) g left join e on e.i = g.i where g.i < (select lo + 1000 from x) union all select 'q', strftime(w, '%Y-%m-%d'), c from w")
_add("search_v1_aggs", lambda s, d: search.respond_v1(_t(s, d, "orders"), {"search_type": "term", "query": {"field": "o_orderstatus", "term": "F"}, "aggs": {"prio": {"agg_type": "term", "field": "o_orderpriority", "size": 3}, "low": {"agg_type": "min", "field": "o_totalprice"}}}, id_col="o_orderkey").aggregations.select("agg", _keys(), "doc_count", *_M("low")), "with o as (select * from orders where o_orderstatus = 'F') select '' agg, '' keys, count(*) doc_count, round(min(o_totalprice), 4) low from o union all select * from (select 'prio', o_orderpriority, count(*), null::double from o group by 2 order by 3 desc, 2 limit 3)")
_add("multi_index_aggs", lambda s, d: search.multi_aggregate({"customer": _t(s, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal")), "supplier": _t(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"))}, "parties", {"range": {"bal": {"gt": 1000}}}, {"nation": {"terms": {"field": "nation", "size": 30}, "aggs": {"total": {"sum": {"field": "bal"}}}}}, {"parties": ["customer", "supplier"]}).select(_keys(), "doc_count", *[F.round(F.element_at("metrics", "total"), 2).alias("total")]), "select nation::varchar keys, count(*) doc_count, round(sum(bal), 2) total from (select c_nationkey nation, c_acctbal bal from customer union all select s_nationkey, s_acctbal from supplier) where bal > 1000 group by 1")

# -- requests and their answers
_add("alias_scan", lambda s, d: search.multi_search({"customer": _t(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("_id"), F.col("c_acctbal").alias("bal")), "supplier": _t(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("_id"), F.col("s_acctbal").alias("bal"))}, "sellers", {"query": {"match_all": {}}, "sort": [{"bal": {"order": "asc"}}], "size": 7}, {"sellers": ["supplier"]}).select("_id", "bal", "_index"), "select 's' || s_suppkey _id, s_acctbal bal, 'supplier' _index from supplier order by bal, _id limit 7")
_add("get_document", lambda s, d: search.get_document(_t(s, d, "orders"), 7, "o_orderkey").select("o_orderkey", "o_custkey"), "select o_orderkey, o_custkey from orders where o_orderkey = 7")
_add("search_each", lambda s, d: search.search_each({"customer": (_t(s, d, "customer").select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("name")), {"query": {"prefix": {"name": {"value": "Customer#00000000", "boost": 2}}}, "size": 12}), "supplier": (_t(s, d, "supplier").select(F.col("s_suppkey").alias("_id"), F.col("s_name").alias("name")), {"query": {"match_all": {}}})}).select("_index", "_id", "name", "_score"), "select * from (select 'customer' _index, c_custkey _id, c_name as name, 2.0::double _score from customer where starts_with(c_name, 'Customer#00000000') union all select 'supplier', s_suppkey, s_name, 1.0 from supplier) order by _score desc, _index, _id limit 12")
_add("msearch", lambda s, d: reduce(lambda a, b: a.unionByName(b), [x.select(F.lit(i).alias("request"), "o_orderkey") for i, x in enumerate(search.msearch([(_t(s, d, "orders"), {"query": {"term": {"o_orderstatus": v}}, "sort": ["-o_totalprice"], "size": 4}) for v in ("F", "O")], id_col="o_orderkey"))]), "select * from (select 0 request, o_orderkey from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 4) union all select * from (select 1, o_orderkey from orders where o_orderstatus = 'O' order by o_totalprice desc, o_orderkey limit 4)")
_add("response_totals", lambda s, d: (lambda df: search.respond(df, {"query": {"match": {"text": "with thon"}}}, Schema.of(df.schema, ("text",), default="regexp"), "doc_id").totals.select("total", F.round("max_score", 6).alias("max_score")))(_t(s, d, "documents").select("doc_id", "text")), _BM25.replace("select doc_id, round(", "select count(*) total, round(max(").replace("dl / avg)), 6) score", "dl / avg))), 6) max_score").replace("order by score desc, doc_id limit 10", ""))
_add("explain_scores", lambda s, d: (lambda df, sc: search.explanation(df, Compiler(sc).compile({"match": {"text": "with thon"}}), sc, "doc_id").where("frequency > 0").select("doc_id", "term", "frequency", "length", F.round("score", 6).alias("score")))(_t(s, d, "documents").select("doc_id", "text"), Schema.of(_t(s, d, "documents").select("doc_id", "text").schema, ("text",), default="regexp")), _BM25.split("select doc_id, round(")[0] + " select * from (select doc_id, 'with' term, f1::bigint frequency, dl::bigint length, round(ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 / (f1 + 1.2 * (0.25 + 0.75 * dl / avg)), 6) score from f, s, d union all select doc_id, 'thon', f2::bigint, dl::bigint, round(ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * f2 / (f2 + 1.2 * (0.25 + 0.75 * dl / avg)), 6) from f, s, d) where frequency > 0")
_add("hit_shape", lambda s, d: search.shape(_t(s, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("_id"), "n_name", "n_regionkey"), "nations", source=["n_name"], fields_spec=["n_reg*"]).select("_index", "_type", "_id", "_source", "fields", "highlight"), "select 'nations' _index, '_doc' _type, n_nationkey::varchar _id, to_json({n_name: n_name})::varchar _source, to_json({n_regionkey: [n_regionkey]})::varchar fields, '{}' highlight from nation where n_regionkey = 1")
_add("fields_dates", lambda s, d: (lambda df: df.select("o_orderkey", *[c.getItem(0).alias(n) for n, c in search.fields(df, [{"field": "o_orderdate", "format": "2006/01/02"}, "o_cust*"]).items()]))(_t(s, d, "orders")), "select o_orderkey, strftime(o_orderdate, '%Y/%m/%d') o_orderdate, o_custkey from orders")
_add("simple_query_string", _pred("part", {"simple_query_string": {"query": "+p_brand:Brand#1* -p_type:/.*STEEL/ +p_size:>=10"}}, ["p_partkey"]), "select p_partkey from part where starts_with(p_brand, 'Brand#1') and not regexp_full_match(p_type, '.*STEEL') and p_size >= 10")
_add("term_bool", lambda s, d: (lambda df: df.where(Compiler(Schema.of(df.schema)).compile({"bool": {"must": [{"term": {"good": "true"}}], "must_not": [{"term": {"toxic": True}}]}}).pred).select("doc_id"))(_t(s, d, "labels").select("doc_id", F.col("quality").cast("boolean").alias("good"), F.col("toxic").cast("boolean").alias("toxic"))), "select doc_id from labels where quality = 1 and toxic is distinct from 1")
_add("range_date_format", _pred("orders", {"range": {"o_orderdate": {"gte": "01.07.1996", "lt": "15.08.1996", "format": "02.01.2006"}}}, ["o_orderkey"]), "select o_orderkey from orders where o_orderdate >= timestamp '1996-07-01' and o_orderdate < timestamp '1996-08-15'")
_add("match_standard", lambda s, d: (lambda df: df.where(Compiler(Schema.of(df.schema, ("text",))).compile({"match": {"text": {"query": "The with!", "operator": "AND"}}}).pred).select("doc_id"))(_t(s, d, "documents")), f"select doc_id from documents where {has('the', 'with').replace(_T, _STANDARD)}")
_add("shard_routing", lambda s, d: _t(s, d, "customer").select("c_custkey", ingest.shard_of(F.col("c_custkey"), 5).alias("shard")), "select c_custkey, (list_sort([{w: md5(c_custkey || '#' || i), i: i} for i in range(5)])[-1]).i::int shard from customer")
_add("partial_scan", lambda s, d: ingest.partial_scan(_t(s, d, "customer"), 2, 5, "c_custkey").select("c_custkey"), "select c_custkey from customer where (list_sort([{w: md5(c_custkey || '#' || i), i: i} for i in range(5)])[-1]).i = 2")

# -- analysis
for _n, _sql in (("regexp", _T), ("simple", "list_transform(regexp_extract_all(text, '\\p{L}+'), lambda x: lower(x))"), ("whitespace", "regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')")):
    _add(f"analyze_{_n}", lambda s, d, n=_n: _t(s, d, "benchmark").select("item_id", F.array_join(analysis.tokens(F.col("text"), n), "|").alias("tokens")), f"select item_id, array_to_string({_sql}, '|') tokens from benchmark")
_add("analyze_shingle", lambda s, d: _t(s, d, "benchmark").select("item_id", F.array_join(analysis.shingle_tokens(analysis.tokens(F.col("text")), 2), "|").alias("tokens")), f"select item_id, array_to_string(list_transform(range(1, len({_T})), lambda i: {_T}[i] || ' ' || {_T}[i + 1]), '|') tokens from benchmark")
_add("analyze_edge_ngram", lambda s, d: _t(s, d, "benchmark").select("item_id", F.array_join(analysis.edge_ngrams(analysis.tokens(F.col("text")), 2, 3), "|").alias("tokens")), f"select item_id, array_to_string(flatten(list_transform({_T}, lambda x: list_transform(list_filter([2, 3], lambda n: n <= length(x)), lambda n: substr(x, 1, n)))), '|') tokens from benchmark")
_quote = lambda x: "'" + x.replace("'", "''") + "'"


def _golden(s, d):
    rows = [(n, json.dumps(r), json.dumps(st), t) for n, r, st, t, _ in golden.CASES]
    return analysis.analyze_rows(s.createDataFrame(rows, "name string, request string, settings string, text string")).select("name", F.array_join("tokens.token", "|").alias("tokens"))


_add("analyze_golden", _golden, "select * from (values " + ", ".join(f"({_quote(n)}, {_quote('|'.join(w))})" for n, _, _, _, w in golden.CASES) + ") t(name, tokens)")


def _places(s, d):
    rows = [("a", json.dumps({"tokenizer": "standard", "filter": ["lowercase", "stop"]}), "{}", "Près of 2 Foxes"), ("b", json.dumps({"tokenizer": "standard", "filter": ["cjk_bigram"]}), "{}", "東京都"), ("c", json.dumps({"tokenizer": "letter", "filter": [{"type": "keyword", "keywords": ["b"]}, "shingle"]}), "{}", "a b")]
    return analysis.analyze_rows(s.createDataFrame(rows, "name string, request string, settings string, text string")).select("name", F.expr("inline(tokens)"))


_add("analyze_places", _places, "select * from (values ('a', 'près', 0, 5, 1, 'AlphaNumeric', false), ('a', '2', 9, 10, 2, 'Numeric', false), ('a', 'foxes', 11, 16, 1, 'AlphaNumeric', false), ('b', '東京', 0, 6, 1, 'Double', false), ('b', '京都', 3, 9, 1, 'Double', false), ('c', 'a', 0, 1, 1, 'AlphaNumeric', false), ('c', 'b', 2, 3, 1, 'AlphaNumeric', true), ('c', 'a b', 0, 3, 0, 'Shingle', true)) t(name, token, start_offset, end_offset, position, type, keyword)")
_W = "regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')"
_FILTERS = {
    "length": ({"type": "length", "min": 3, "max": 5}, f"list_filter({_W}, lambda x: length(x) between 3 and 5)"),
    "truncate": ({"type": "truncate", "length": 4}, f"list_transform({_W}, lambda x: substr(x, 1, 4))"),
    "reverse": ("reverse", f"list_transform({_W}, lambda x: reverse(x))"),
    "unique": ("unique", f"list_filter({_W}, lambda x, i: list_position({_W}, x) = i)"),
    "lower_case": ("lowercase", f"list_transform({_W}, lambda x: lower(x))"),
    "stop_words": ({"type": "stop", "stopwords": ["of", "the", "and"]}, f"list_filter({_W}, lambda x: x not in ('of', 'the', 'and'))"),
    "pattern_replace": ({"type": "pattern_replace", "pattern": "[aeiou]+", "replacement": "*"}, f"list_transform({_W}, lambda x: regexp_replace(x, '[aeiou]+', '*', 'g'))"),
    "ngram": ({"type": "ngram", "min_gram": 2, "max_gram": 2}, f"flatten(list_transform({_W}, lambda x: list_transform(range(1, length(x)), lambda i: substr(x, i::int, 2))))"),
    "unicodenorm": ({"type": "unicodenorm", "form": "NFC"}, f"list_transform({_W}, lambda x: nfc_normalize(x))"),
    "trim": ("trim", _W),
}
for _n, (_o, _sql) in _FILTERS.items():
    _add(f"filter_{_n}", lambda s, d, o=_o: _t(s, d, "benchmark").select("item_id", F.array_join(analysis.analyze_udf({"tokenizer": "whitespace", "filter": [o]})("text"), "|").alias("tokens")), f"select item_id, array_to_string({_sql}, '|') tokens from benchmark")
_TOKENIZERS = {
    "letter": ("letter", "regexp_extract_all(text, '\\p{L}+')"),
    "lower_case": ("lower_case", "list_transform(regexp_extract_all(text, '\\p{L}+'), lambda x: lower(x))"),
    "character": ({"type": "character", "char": "digit"}, "regexp_extract_all(text, '\\p{Nd}+')"),
    "char_group": ({"type": "char_group", "tokenize_on_chars": ["whitespace", "."]}, "regexp_extract_all(text, '[^\\p{Z}\\s.]+')"),
    "keyword": ("keyword", "[text]"),
    "regexp": ({"type": "regexp", "pattern": "[A-Z][a-z]+"}, "regexp_extract_all(text, '[A-Z][a-z]+')"),
    "edge_ngram": ({"type": "edge_ngram", "min_gram": 2, "max_gram": 4}, "[substr(text, 1, 2), substr(text, 1, 3), substr(text, 1, 4)]"),
    "unicode": ("unicode", _STANDARD.removeprefix("list_transform(").removesuffix(", lambda x: lower(x))")),
    "exception": ({"type": "exception", "patterns": ["[A-Z]\\w+ \\w+"]}, "regexp_extract_all(text, '(?:[A-Z][0-9A-Za-z_]+ [0-9A-Za-z_]+)|[\\p{L}\\p{M}\\p{N}_]+(?:[''’.:·][\\p{L}\\p{M}\\p{N}_]+)*')"),
}
for _n, (_o, _sql) in _TOKENIZERS.items():
    _add(f"tokenizer_{_n}", lambda s, d, o=_o: _t(s, d, "benchmark").select("item_id", F.array_join(analysis.analyze_udf({"tokenizer": o})(F.regexp_replace("text", "[^ -~\n]", "")), "|").alias("tokens")), f"select item_id, array_to_string({_sql}, '|') tokens from (select item_id, regexp_replace(text, '[^ -~\\n]', '', 'g') as text from benchmark)")
_add("tokenizer_path_hierarchy", lambda s, d: _t(s, d, "pages").select("page_id", F.array_join(analysis.analyze_udf({"tokenizer": "path_hierarchy"})(F.regexp_extract("url", r"^\w+://[^/?#]+((?:/[\w.-]+)*)", 1)), "|").alias("tokens")), "select page_id, coalesce(array_to_string(list_transform(range(1, length(p) - length(replace(p, '/', '')) + 1), lambda k: '/' || array_to_string(string_split(p, '/')[2:k + 1], '/')), '|'), '') tokens from (select page_id, regexp_extract(url, '^\\w+://[^/?#]+((?:/[\\w.-]+)*)', 1) p from pages)")
_CHARS = {
    "mapping": ({"type": "mapping", "mappings": ["e => 3", "th => TH"]}, "replace(replace(text, 'e', '3'), 'th', 'TH')"),
    "pattern_replace": ({"type": "pattern_replace", "pattern": "(\\w)\\.", "replacement": "$1!"}, "regexp_replace(text, '([0-9A-Za-z_])\\.', '\\1!', 'g')"),
    "zero_width_non_joiner": ("zero_width_non_joiner", "replace(text, chr(8204), ' ')"),
    "html_strip": ("html_strip", "regexp_replace(text, '<[^>]*>', ' ', 'g')"),
    "ascii_folding": ("ascii_folding", "text"),
}
for _n, (_o, _sql) in _CHARS.items():
    _add(f"char_filter_{_n}", lambda s, d, o=_o: _t(s, d, "benchmark").select("item_id", F.array_join(analysis.analyze_udf({"tokenizer": "keyword", "char_filter": [o]})(F.regexp_replace("text", "[^ -~\n]", "")), "|").alias("tokens")), f"select item_id, {_sql} tokens from (select item_id, regexp_replace(text, '[^ -~\\n]', '', 'g') as text from benchmark)")
_add("analyze_stop", lambda s, d: _t(s, d, "benchmark").select("item_id", F.array_join(analysis.tokens(F.col("text"), "stop"), "|").alias("tokens")), f"select item_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '\\p{{L}}+'), lambda x: lower(x)), lambda x: x not in ({', '.join(_quote(x) for x in sorted(analysis.STOP_EN))})), '|') tokens from benchmark")
_add("analyze_keyword", lambda s, d: _t(s, d, "benchmark").select("item_id", F.array_join(analysis.tokens(F.col("text"), "keyword"), "|").alias("tokens")), "select item_id, text tokens from benchmark")
_add("analyze_standard", lambda s, d: _t(s, d, "benchmark").select("item_id", F.array_join(analysis.tokens(F.col("text"), "standard"), "|").alias("tokens")), f"select item_id, array_to_string({_STANDARD}, '|') tokens from benchmark")
for _n in ("en", "web", "de", "fr", "es", "it"):
    _add(f"analyze_{_n}", lambda s, d, n=_n: _t(s, d, "benchmark").select("item_id", F.array_join(analysis.analyze_udf(n)("text"), "|").alias("tokens")))

# -- vectors
_D = f"list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::double - {Q}[i]) * (embedding[i]::double - {Q}[i])))"
_add("knn_flat", lambda s, d: vector.knn(_t(s, d, "embeddings"), Q, 10).select("vec_id", F.round("distance", 4).alias("distance"), F.round("score", 6).alias("score")), f"select vec_id, round({_D}, 4) distance, round(1 / (1 + {_D}), 6) score from embeddings order by {_D}, vec_id limit 10")
_add("knn_filtered", lambda s, d: vector.knn(_t(s, d, "embeddings"), Q, 5, where=F.col("label") == 3).select("vec_id", F.round("distance", 4).alias("distance")), f"select vec_id, round({_D}, 4) distance from embeddings where label = 3 order by {_D}, vec_id limit 5")


def _ivf(s, d):
    e = _t(s, d, "embeddings")
    q = e.where("vec_id % 50 = 0")
    return vector.mean_recall(vector.ivfpq_search(vector.build_ivfpq(e, m=16), q, 10, NPROBE), vector.knn_each(e, q, 10))


NPROBE = 0.45  # of the lists
_add("knn_ivf_recall", _ivf)
_EACH = "with q as (select vec_id query, embedding q from embeddings where vec_id % 50 = 0), p as (select query, vec_id id, list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::double - q[i]::double) * (embedding[i]::double - q[i]::double))) distance from q, embeddings) select query, id, round(distance, 4) distance from p qualify row_number() over (partition by query order by p.distance, id) <= 10"
_add("knn_each", lambda s, d: (lambda e: vector.knn_each(e, e.where("vec_id % 50 = 0"), 10).select("query", "id", F.round("distance", 4).alias("distance")))(_t(s, d, "embeddings")), _EACH)
_add("knn_request", lambda s, d: vector.search_request(_t(s, d, "embeddings"), {"query_field": "embedding", "vector": Q, "k": 6, "return_fields": ["label"]}, F.col("label").isin(1, 2), "vec_id").select("vec_id", "label", F.round("_score", 6).alias("score")), f"select vec_id, label, round(1 / (1 + {_D}), 6) score from embeddings where label in (1, 2) order by {_D}, vec_id limit 6")
_add("knn_several", lambda s, d: vector.global_top([vector.knn(_t(s, d, "embeddings").where(f"label % 2 = {i}"), Q, 8) for i in (0, 1)], 8).select("vec_id", F.round("distance", 4).alias("distance")), f"select vec_id, round({_D}, 4) distance from embeddings order by {_D}, vec_id limit 8")
_add("vector_halves", lambda s, d: _t(s, d, "embeddings").select("vec_id", F.aggregate(F.zip_with("embedding", vector.from_half_bytes(vector.half_bytes(F.col("embedding"))), lambda x, y: F.abs(x - y) <= F.abs(x) / 1000 + 1e-6), F.lit(True), lambda a, x: a & x).alias("near")), "select vec_id, true near from embeddings")
_add("vectors_of_ids", lambda s, d: _t(s, d, "embeddings").join(_t(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select("vec_id", F.round(vector.l2(F.col("embedding"), Q), 4).alias("distance")), f"select vec_id, round({_D}, 4) distance from embeddings where vec_id in (select doc_id from labels where toxic = 1)")


def _vector_log(s, d):
    e = _t(s, d, "embeddings")
    put = e.where("vec_id % 10 = 0").select(F.lit(1).alias("seq"), F.lit("upsert").alias("op"), "vec_id", F.transform("embedding", lambda x: x * F.lit(0.5).cast("float")).alias("embedding"))
    gone = e.where("vec_id % 14 = 0").select(F.lit(2).alias("seq"), F.lit("delete").alias("op"), "vec_id", F.lit(None).cast("array<float>").alias("embedding"))
    return e.where("vec_id % 10 != 0 or vec_id % 20 = 0"), put.unionByName(gone)


_LOGGED = "(select vec_id, case when vec_id % 10 = 0 then list_transform(embedding, lambda x: (x * 0.5)::float) else embedding end embedding from embeddings where vec_id % 14 != 0)"
_add("knn_logged", lambda s, d: vector.knn(vector.current(*_vector_log(s, d)), Q, 10).select("vec_id", F.round("distance", 4).alias("distance")), f"select vec_id, round({_D}, 4) distance from {_LOGGED} order by {_D}, vec_id limit 10")


# -- mutations
def _log(s, d):
    e = _t(s, d, "events")
    return e.select(F.col("user_id").cast("string").alias("_id"), F.col("event_id").alias("seq"), F.when(F.pmod("event_id", F.lit(7)) == 0, "delete").when(F.pmod("event_id", F.lit(3)) == 0, "insert").otherwise("update").alias("op"), "value")


_LOG = "select user_id::varchar _id, event_id seq, case when event_id % 7 = 0 then 'delete' when event_id % 3 = 0 then 'insert' else 'update' end op, value from events"
_COMPACT = f"with l as ({_LOG}), g as (select _id, arg_min(op, seq) f, arg_max(op, seq) l, max(seq) seq, arg_max(value, seq) v from l group by _id) select _id, seq, case when l = 'delete' then 'delete' when f = 'insert' then 'insert' else 'update' end op, v as value from g where not (f = 'insert' and l = 'delete')"
_add("compaction", lambda s, d: ingest.compact(_log(s, d)), _COMPACT)
_add("upsert", lambda s, d: ingest.apply_log(_t(s, d, "customer").select(F.col("c_custkey").cast("string").alias("_id"), F.col("c_acctbal").alias("value")), ingest.compact(_log(s, d))), f"with c as ({_COMPACT}) select c_custkey::varchar _id, c_acctbal as value from customer where c_custkey::varchar not in (select _id from c) union all select _id, value from c where op <> 'delete'")
_add("delete_by_query", lambda s, d: ingest.delete_by_query(_t(s, d, "customer").select("c_custkey", "c_mktsegment"), F.col("c_mktsegment") == "BUILDING", "c_custkey", 10), "select c_custkey, c_mktsegment from customer where c_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING' order by c_custkey limit 10)")
_add("catalogue_counts", lambda s, d: search.union({n: _t(s, d, n).select() for n in ("customer", "supplier", "part")}).groupBy("_index").agg(F.count("*").alias("doc_num")), "select 'customer' _index, count(*) doc_num from customer union all select 'supplier', count(*) from supplier union all select 'part', count(*) from part")

_add("update_insert", lambda s, d: ingest.update(_t(s, d, "nation").select(F.col("n_nationkey").alias("_id"), "n_name"), _t(s, d, "region").select((F.col("r_regionkey") + 23).alias("_id"), F.col("r_name").alias("n_name")), insert=True), "select n_nationkey _id, n_name from nation where n_nationkey not in (select r_regionkey + 23 from region) union all select r_regionkey + 23, r_name from region")
_add("batch_delete", lambda s, d: ingest.delete(_t(s, d, "customer").select("c_custkey"), _t(s, d, "supplier").select(F.col("s_suppkey").alias("c_custkey")), "c_custkey"), "select c_custkey from customer where c_custkey not in (select s_suppkey from supplier)")
_add("delete_one", lambda s, d: ingest.delete_one(_t(s, d, "nation").select("n_nationkey"), 3, "n_nationkey"), "select n_nationkey from nation where n_nationkey <> 3")
_add("bulk_records", lambda s, d: ingest.records(_t(s, d, "nation").select(F.col("n_nationkey").alias("_id"), "n_name")), "select 'upsert' op, n_nationkey::varchar _id, to_json({n_name: n_name})::varchar doc from nation")
_add("bulk_response", lambda s, d: ingest.bulk_response(_log(s, d).where("seq < 500"), "log", _t(s, d, "customer").select(F.col("c_custkey").alias("_id"))), f"with l as ({_LOG}) select seq, case when op = 'delete' then 'delete' else 'index' end as action, 'log' _index, _id, case when op = 'delete' then 200 else 201 end status, case when op = 'delete' then 'deleted' when _id in (select c_custkey::varchar from customer) then 'updated' else 'created' end result, 1::bigint _version from l where seq < 500")
_add("deletes_first", lambda s, d: ingest.compact(ingest.deletes_first(_log(s, d))).where("op = 'delete'").select("_id"), f"with l as ({_LOG}) select _id from l group by _id having count(*) filter (op <> 'delete') = 0")


# -- catalogue, documents and streams
def _catalogue(s, d):
    c = catalog.Catalog()
    c.put_template("low", ["log-*"], {"mappings": {"properties": {"level": {"type": "text"}}}}, 1)
    c.put_template("high", ["log-*", "web-*"], {"mappings": {"properties": {"level": {"type": "keyword"}, "msg": {"type": "text", "fields": {"raw": {"type": "keyword"}}}}}, "aliases": {"logs": {}}}, 2)
    for n in ("log-1", "log-2", "other"):
        c.create(n)
    c.put_mapping("log-1", {"user": {"properties": {"age": {"type": "long"}}}})
    c.put_settings("other", {"analysis": {"analyzer": {"mine": {"tokenizer": "letter"}}}})
    c.alias([{"add": {"index": "oth*", "alias": "rest"}}, {"add": {"index": "log-2", "alias": "rest"}}, {"remove": {"index": "log-2", "alias": "rest"}}])
    rows = [("mapping", json.dumps(c.render_mapping("log-1"), sort_keys=True)), ("settings", json.dumps(c.get("other")["settings"], sort_keys=True)), ("aliases", ",".join(c.get("other")["aliases"] + c.get("log-1")["aliases"])), ("resolved", ",".join(search.resolve(sorted(c.indexes), "logs", c.aliases))), ("suggested", ",".join(c.suggest("LOG"))), ("listed", ",".join(c.listing("", 0, 2, True, "doc_num", {"log-1": {"doc_num": 5}, "log-2": {"doc_num": 9}}))), ("exists", str(c.exists("rest") and not c.exists("none")))]
    rows += [("deleted", ",".join(c.delete("log-*"))), ("left", ",".join(c.listing()))]
    return s.createDataFrame(rows, "step string, value string")


_add("catalogue_steps", _catalogue, """select * from (values
    ('mapping', '{"log-1": {"mappings": {"properties": {"level": {"type": "keyword"}, "msg": {"fields": {"raw": {"type": "keyword"}}, "type": "text"}, "user": {"properties": {"age": {"type": "numeric"}}}}}}}'),
    ('settings', '{"analysis": {"analyzer": {"mine": {"tokenizer": "letter"}}}}'), ('aliases', 'rest,logs'), ('resolved', 'log-1,log-2'), ('suggested', 'log-1,log-2'), ('listed', 'log-2,log-1'),
    ('exists', 'True'), ('deleted', 'log-1,log-2'), ('left', 'other')) t(step, value)""")


def _documents(s, d):
    flat = schema.flatten({"a": {"b": 1, "c": [1, 2]}, "d": [{"x": 1}, {"x": 2}]})
    rows = [("flatten", json.dumps(flat)), ("unflatten", json.dumps(schema.unflatten({"a.b": 1, "a.c.d": 2}))), ("infer", ",".join(str(schema.infer(v)) for v in ("x", "2020-01-01T00:00:00+00:00", 1.5, True, ["a", 2], None))), ("coerce", ",".join(map(str, [schema.coerce("t", "bool"), schema.coerce("12.5", "numeric"), schema.coerce(7.0, "keyword"), schema.coerce("", "text"), schema.coerce([1, 0], "bool")])))]
    rows += [("time", ",".join(schema.parse_time(*x).isoformat() for x in ((1577836800000,), ("2020-01-01T00:00:00+02:00",), ("01.02.2021", "02.01.2006"), (1577836800,), ("2020-01-01 10:00:00", None, "+03:00")))), ("duration", ",".join(str(schema.parse_duration(x).total_seconds()) for x in ("1d2h", "1.5s", "100ms", "30m"))), ("format", ",".join(schema.format_duration(schema.parse_duration(x)) for x in ("90s", "2h", "48h"))), ("base62", f"{schema.base62(123456789)},{schema.from_base62(schema.base62(123456789))}")]
    return s.createDataFrame(rows, "step string, value string")


_add("document_steps", _documents, """select * from (values
    ('flatten', '{"a.b": 1, "a.c": [1, 2], "d.0.x": 1, "d.1.x": 2}'), ('unflatten', '{"a": {"b": 1, "c": {"d": 2}}}'), ('infer', 'text,date,numeric,bool,numeric,None'), ('coerce', 'True,12.5,7,None,[True, False]'),
    ('time', '2020-01-01T00:00:00+00:00,2020-01-01T00:00:00+02:00,2021-02-01T00:00:00+00:00,2020-01-01T00:00:00+00:00,2020-01-01T10:00:00+03:00'),
    ('duration', '93600.0,1.5,0.1,1800.0'), ('format', '90s,2h,2d'), ('base62', '8M0kX,123456789')) t(step, value)""")


def _stream(s, d):
    """Counts of closed hours, from a stream of the events file that ends when all is read."""
    base = f"{s.conf.get('spark.checkpoint.dir', None) or 'file://' + tempfile.mkdtemp(prefix='stream-')}/stream-{uuid.uuid4().hex}"
    kinds = _t(s, d, "events").schema
    log.window_counts(s, d, kinds, "ts", "event_type", "6 hours", "12 hours", f"{base}/progress", f"{base}/counts", "events.parquet")
    return s.read.schema("start timestamp, event_type string, n long").parquet(f"{base}/counts").select(F.unix_micros("start").alias("start"), "event_type", "n")


_add("stream_window_counts", _stream, "with w as (select epoch_us(ts) // 21600000000 * 21600000000 as start, event_type, count(*) n from events group by 1, 2) select * from w where start + 21600000000 <= (select max(epoch_us(ts)) - 43200000000 from events)")


def _replayed(s, d):
    """A versioned table after a log has been streamed into it in several files."""
    base = f"{s.conf.get('spark.checkpoint.dir', None) or 'file://' + tempfile.mkdtemp(prefix='log-')}/log-{uuid.uuid4().hex}"
    t = ingest.Table(s, f"{base}/table")
    t.write(_t(s, d, "customer").select(F.col("c_custkey").cast("string").alias("_id"), F.col("c_acctbal").alias("value")))
    part = _log(s, d).withColumn("op", F.when(F.col("op") == "insert", "update").otherwise(F.col("op")))  # an insert says that there was no such id
    for i in range(2):  # a file at a time, in the log's order
        part.where(F.col("seq") < part.agg(F.max("seq")).first()[0] // 2 if i == 0 else F.col("seq") >= part.agg(F.max("seq")).first()[0] // 2).coalesce(1).write.mode("append").parquet(f"{base}/log")
        log.consume(s, f"{base}/log", part.schema, t, f"{base}/progress")
    return t.refresh()


_add("stream_replay", _replayed, f"with l as ({_LOG}), c as (select _id, arg_max(op, seq) op, arg_max(value, seq) v from l group by _id) select c_custkey::varchar _id, c_acctbal as value from customer where c_custkey::varchar not in (select _id from c) union all select _id, v from c where op <> 'delete'")
