"""The registered queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import (
    cotraining,
    embedding_dedup,
    gru_lm,
    line_dedup,
    minhash_dedup,
    mixing,
    quality_rules,
    sentencepiece_codec,
    url_rules,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that the labels call good and not toxic."""
    return _table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, _table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_texts(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


def op6_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(_table(spark, sf_dir, "documents"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(_table(spark, sf_dir, "documents").select("doc_id", F.col("text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_cotraining, op2_embedding_dedup, op3_warc, op4_minhash_dedup, op5_quality_rules, op6_gru_lm, op7_mixing, op8_line_dedup, op9_url_rules, op10_sentencepiece)}


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = """
with recursive v as (
    select vec_id, embedding::double[] e from embeddings
    where embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
    select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where case when len(a.e) = len(b.e) then list_cosine_similarity(a.e, b.e) end >= 0.95
), reach(n, m) as (
    select a, b from links union select r.n, l.b from reach r join links l on r.m = l.a
), comp as (select n, min(m) m from reach group by n),
deg as (select a, count(distinct b) n from links group by a)
select e.vec_id, coalesce(d.n, 0)::bigint n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) component_id,
       e.vec_id = least(e.vec_id, coalesce(c.m, e.vec_id)) kept
from embeddings e left join comp c on c.n = e.vec_id left join deg d on d.a = e.vec_id
"""

_OP3 = """
with p as (select page_id, coalesce(html, '') html from pages),
d as (select page_id, octet_length(encode(html))::bigint payload_bytes, sha1(html) h from p),
f as (select *, min(page_id) over (partition by h) first from d)
select page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((('0x' || substr(h, 1 + 5 * (k // 4), 5))::bigint >> (15 - 5 * (k % 4))) & 31))::int, 1)), '') payload_digest,
    case when page_id = first then 'response' else 'revisit' end record_type,
    case when page_id = first then null else first end refers_to
from f
"""

_OP4 = f"""
with recursive w as (
    select doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') w from documents
), sh as (
    select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1:i + 3], ' ')) end) s from w
), n as (select doc_id, len(s) n, s from sh),
t as (select doc_id, n, unnest(s) g from n),
-- a pair at 85 % shares one of the rarest 15 % of each side's shingles
df as (select g, count(*) c from t group by g),
o as (select t.doc_id, t.n, t.g, row_number() over (partition by t.doc_id order by df.c, t.g) k from t join df using (g)),
p as (select doc_id, n, g from o where k <= n - ceil(0.85 * n) + 1),
cand as (select distinct a.doc_id a, b.doc_id b from p a join p b on a.g = b.g and a.doc_id < b.doc_id
         where 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
links as (
    select a, b from (select a, b, x.n nx, y.n ny, len(list_intersect(x.s, y.s)) i
                      from cand join n x on x.doc_id = a join n y on y.doc_id = b)
    where 100 * i >= 85 * (nx + ny - i)
), sym as (select a, b from links union all select b, a from links),
reach(n, m) as (select a, b from sym union select r.n, l.b from reach r join sym l on r.m = l.a),
comp as (select n, min(m) m from reach group by n)
select n.doc_id, n.n::bigint n_shingles, least(n.doc_id, coalesce(c.m, n.doc_id)) component_id,
       n.doc_id = least(n.doc_id, coalesce(c.m, n.doc_id)) kept
from n left join comp c on c.n = n.doc_id
"""

_OP8 = f"""
with l as (
    select doc_id, generate_subscripts(a, 1) k, unnest(a) line
    from (select doc_id, string_split(coalesce(text, ''), chr(10)) a from documents)
), m as (
    select *, {_LOW.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} key from l
), f as (
    select key, min(doc_id) first, count(distinct doc_id) n from m where length(key) >= 10 group by key
), j as (
    select m.doc_id, k, line, coalesce(f.n >= 2 and m.doc_id > f.first, false) gone from m left join f using (key)
)
select doc_id, count(*)::bigint n_lines, count(*) filter (gone)::bigint n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by k) filter (not gone), '')) kept_sha256
from j group by doc_id
"""

_OP9 = f"""
with r(rhost, rpath, v) as (values {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_rules.RULES)}),
u as (
    select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end rest from pages
), p as (
    select page_id, {_LOW.format("regexp_extract(rest, '^[^/?#]*')")} host,
           regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) path from u
), best as (
    select page_id, host, path, arg_max(rhost || rpath, length(rhost) * 100000 + length(rpath)) rule,
           arg_max(v, length(rhost) * 100000 + length(rpath)) v
    from p join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
    group by page_id, host, path
)
select p.page_id, p.host, p.path, best.rule, coalesce(best.v, 'allow') verdict from p left join best using (page_id)
"""


def oracle_sql() -> dict[str, str]:
    """The contents of these, in DuckDB's SQL; the others are tested against brute force."""
    return {"op2_embedding_dedup": _OP2, "op3_warc": _OP3, "op4_minhash_dedup": _OP4, "op8_line_dedup": _OP8, "op9_url_rules": _OP9}
