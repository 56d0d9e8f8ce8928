"""Search: filtering, BM25 ranking, sorting, paging, source filters, highlights, several indexes."""

from __future__ import annotations

import re
import threading
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import aggs
from larkspur.operators.dsl import Compiler, Node, Schema, from_v1

K1, B = 1.2, 0.75
MOST = 10_000  # hits of a page


def _times(tokens: Column, t: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == t))


def _term_scores(df: DataFrame, node: Node, schema: Schema, stats: DataFrame | None = None) -> tuple[DataFrame, list[tuple[Column, Column, Column]]]:
    """The matching rows of df, and of each of node's terms its frequency, its field's length and its score in them.

    One pass over df counts, for every scored term, its documents and each field's lengths (one row of numbers to the
    driver); what follows are expressions over the rows that match, whose tokens are made once for all terms.
    """
    fields = sorted({f for f, _, _ in node.terms})
    terms = sorted({(f, t) for f, t, _ in node.terms})
    base = (stats if stats is not None else df).select(*[schema.tokens(f).alias(f"_t{i}") for i, f in enumerate(fields)])
    place = {f: f"_t{i}" for i, f in enumerate(fields)}
    row = base.agg(
        *[F.count(F.when(F.size(place[f]) > 0, 1)).alias(f"n{i}") for i, f in enumerate(fields)],
        *[F.sum(F.size(place[f])).alias(f"s{i}") for i, f in enumerate(fields)],
        *[F.count(F.when(F.array_contains(place[f], t), 1)).alias(f"d{j}") for j, (f, t) in enumerate(terms)],
    ).first()
    df = df.where(node.pred).withColumns({place[f]: schema.tokens(f) for f in fields})
    df = df.withColumns({f"_l{i}": F.size(place[f]) for i, f in enumerate(fields)} | {f"_f{j}": _times(F.col(place[f]), t) for j, (f, t) in enumerate(terms)}).drop(*place.values())
    out = []
    for f, t, w in node.terms:
        i, j = fields.index(f), terms.index((f, t))
        n, total, d = row[f"n{i}"], row[f"s{i}"] or 0, row[f"d{j}"]
        size, tf = F.col(f"_l{i}"), F.col(f"_f{j}").cast("double")
        score = F.lit(0.0)
        if n and total:
            norm = F.lit(K1) * (1 - B + B * size / F.lit(total / n))
            score = F.lit(w) * F.log(F.lit(1 + (n - d + 0.5) / (d + 0.5))) * tf / (tf + norm)
        out.append((F.col(f"_f{j}"), size, score))
    return df, out


def bm25(df: DataFrame, node: Node, schema: Schema, id_col: str, stats: DataFrame | None = None) -> DataFrame:
    """The matching rows of df with _score; no posting is shuffled.

    stats: the rows whose statistics count (default df), for scores that agree across several indexes.
    """
    score = reduce(lambda a, b: a + b, [F.when(c, F.lit(w)).otherwise(0.0) for c, w in node.const], F.lit(0.0))
    if not node.terms:
        return df.where(node.pred).withColumn("_score", score)
    found, parts = _term_scores(df, node, schema, stats)
    return found.select(*df.columns, reduce(lambda a, b: a + b, [x for _, _, x in parts], score).alias("_score"))


def sort_columns(spec) -> list[Column]:
    """Sort keys from "f", "-f", "+f", {f: "desc"}, {f: {"order": "desc"}}, alone or in a list; missing values last."""
    out = []
    for s in spec if isinstance(spec, list) else [spec]:
        if isinstance(s, str):
            f, desc = s.lstrip("+-"), s.startswith("-") or s == "_score"
        else:
            (f, o), = s.items()
            desc = (o if isinstance(o, str) else o.get("order", "asc")).lower() == "desc"
        out.append(F.desc_nulls_last(f) if desc else F.asc_nulls_last(f))
    return out


def source_columns(columns: list[str], spec) -> list[str]:
    """The columns that a _source filter leaves: true, false, names, or prefixes ending in *."""
    if spec is None or spec is True:
        return columns
    if spec is False:
        return []
    names = [spec] if isinstance(spec, str) else spec
    return [c for c in columns if any(c == n or n.endswith("*") and c.startswith(n[:-1]) for n in names)]


def highlight(text: Column, words: list[str], pre: str = "<mark>", post: str = "</mark>") -> Column:
    """text with whole words wrapped, whatever their case."""
    if not words:
        return text
    return F.regexp_replace(text, F.lit("(?i)\\b(" + "|".join(map(re.escape, sorted(words))) + ")\\b"), F.lit(f"{pre}$1{post}".replace("\\", "\\\\")))


def search(df: DataFrame, body: dict, schema: Schema | None = None, id_col: str = "_id", stats: DataFrame | None = None, text: tuple[str, ...] = ()) -> DataFrame:
    """The page of hits of a request {query, from, size, sort, _source, highlight}: the kept columns and _score.

    Ranking and the page are one top-k over ids and scores; other columns are only read for its rows.
    """
    schema = schema or Schema.of(df.schema, text)
    columns = df.columns
    node = Compiler(schema).compile(body.get("query"))
    size, start = min(int(body.get("size", 10)), MOST), int(body.get("from", 0))
    order = sort_columns(body["sort"]) if body.get("sort") else [F.desc("_score")]
    hits = bm25(df, node, schema, id_col, stats).orderBy(*order, id_col).offset(start).limit(size)
    keep = source_columns([c for c in columns if c != id_col], body.get("_source"))
    marks = [highlight(F.col(f), [t for g, t, _ in node.terms if g == f], *(o.get("pre_tags") or body["highlight"].get("pre_tags") or ["<mark>"])[:1], *(o.get("post_tags") or body["highlight"].get("post_tags") or ["</mark>"])[:1]).alias(f"highlight_{f}") for f, o in body.get("highlight", {}).get("fields", {}).items()]
    return hits.select(id_col, *keep, "_score", *marks)


@contextmanager
def deadline(spark: SparkSession, seconds: float | None):
    """Cancels what this thread's queries still run after `seconds`, as a TimeoutError; 0 or None sets no limit."""
    if not seconds:
        yield
        return
    sc, tag, late = spark.sparkContext, f"deadline-{uuid.uuid4().hex}", threading.Event()

    def cancel() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, cancel)
    sc.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"the request took more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


@dataclass
class Response:
    """What a request gives: its page of hits, their total and greatest score over all matches, and its aggregations."""

    hits: DataFrame
    totals: DataFrame  # one row: total, max_score
    aggregations: DataFrame | None
    took: float = 0.0


def respond(df: DataFrame, body: dict, schema: Schema | None = None, id_col: str = "_id", text: tuple[str, ...] = (), missing: bool = False) -> Response:
    """A whole request: hits as `search` gives them, and `aggs` over all matching rows, whatever the page."""
    began = time.time()
    schema = schema or Schema.of(df.schema, text)
    node = Compiler(schema).compile(body.get("query"))
    matched = df.where(node.pred)
    scored = bm25(df, node, schema, id_col)
    totals = scored.agg(F.count("*").alias("total"), F.coalesce(F.max("_score"), F.lit(0.0)).alias("max_score"))
    wanted = body.get("aggs") or body.get("aggregations")
    found = aggs.tree(matched, wanted, missing) if wanted else None
    return Response(search(df, body, schema, id_col), totals, found, time.time() - began)


def explanation(df: DataFrame, node: Node, schema: Schema, id_col: str = "_id") -> DataFrame:
    """id, field, term, boost, frequency, length, score of every scoring term of every hit: their sum is its _score."""
    if not node.terms:
        return df.where(node.pred).select(id_col, F.lit("").alias("field"), F.lit("").alias("term"), F.lit(1.0).alias("boost"), F.lit(0).cast("long").alias("frequency"), F.lit(0).cast("long").alias("length"), F.lit(1.0).alias("score"))
    found, parts = _term_scores(df, node, schema)
    rows = [F.struct(F.lit(f).alias("field"), F.lit(t).alias("term"), F.lit(float(w)).alias("boost"), tf.cast("long").alias("frequency"), size.cast("long").alias("length"), score.alias("score")) for (f, t, w), (tf, size, score) in zip(node.terms, parts, strict=True)]
    return found.select(id_col, F.inline(F.array(*rows)))


def fields(df: DataFrame, spec: list) -> dict[str, Column]:
    """The `fields` of a hit: each named value (or prefix*) in an array; dates by their format, a layout or epoch_millis."""
    out: dict[str, Column] = {}
    for x in spec:
        name, layout = (x, None) if isinstance(x, str) else (x["field"], x.get("format"))
        for c in source_columns(df.columns, name):
            kind = df.schema[c].dataType.typeName()
            v = F.col(c)
            if kind in ("timestamp", "timestamp_ntz", "date"):
                v = aggs._day(v.cast("timestamp"), {"format": layout})
            out[c] = v if kind == "array" else F.array(v)
    return out


def shape(hits: DataFrame, index: str = "", id_col: str = "_id", source: list[str] | None = None, fields_spec: list | None = None) -> DataFrame:
    """Hits as (_index, _type, _id, _score, _source, fields, highlight): source, fields and highlights as JSON text."""
    own = [c for c in hits.columns if c not in (id_col, "_score", "_index") and not c.startswith("highlight_")]
    keep = [c for c in own if source is None or c in source]
    marks = [c for c in hits.columns if c.startswith("highlight_")]
    say = lambda cols: F.to_json(F.struct(*cols)) if cols else F.lit("{}")
    return hits.select(
        F.col("_index") if "_index" in hits.columns else F.lit(index).alias("_index"), F.lit("_doc").alias("_type"), F.col(id_col).cast("string").alias("_id"),
        F.col("_score") if "_score" in hits.columns else F.lit(0.0).alias("_score"), say([F.col(c) for c in keep]).alias("_source"),
        say([c.alias(n) for n, c in fields(hits.select(own), fields_spec).items()]).alias("fields") if fields_spec else F.lit("{}").alias("fields"),
        say([F.array(c).alias(c.removeprefix("highlight_")) for c in marks]).alias("highlight"))


def get_document(df: DataFrame, key, id_col: str = "_id") -> DataFrame:
    """The document of an id, if there is one: a filter that the scan takes."""
    return df.where(F.col(id_col) == F.lit(key)).limit(1)


def respond_v1(df: DataFrame, body: dict, **how) -> Response:
    return respond(df, from_v1(body), **how)


def search_v1(df: DataFrame, body: dict, **how) -> DataFrame:
    return search(df, from_v1(body), **how)


def count(df: DataFrame, query: dict | None, schema: Schema | None = None, text: tuple[str, ...] = ()) -> DataFrame:
    """hits.total of a query, whatever its page."""
    return df.where(Compiler(schema or Schema.of(df.schema, text)).compile(query).pred).agg(F.count("*").alias("total"))


def resolve(names: list[str], target: str, aliases: dict[str, list[str]] | None = None) -> list[str]:
    """Indexes named by a comma list with leading or trailing *, empty for all, or an alias."""
    out = []
    for part in target.split(",") if target else ["*"]:
        for p in (aliases or {}).get(part, [part]):
            if p == "*":
                out += names
            elif p.endswith("*"):
                out += [n for n in names if n.startswith(p[:-1])]
            elif p.startswith("*"):
                out += [n for n in names if n.endswith(p[1:])]
            elif p in names:
                out.append(p)
    return list(dict.fromkeys(out))


def union(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of all tables with _index, missing columns null."""
    parts = [t.withColumn("_index", F.lit(n)) for n, t in sorted(tables.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def multi_search(tables: dict[str, DataFrame], target: str, body: dict, aliases: dict | None = None, unified: bool = True, id_col: str = "_id", text: tuple[str, ...] = ()) -> DataFrame:
    """One ranking over several indexes, scored with the statistics of all (unified) or of each alone."""
    names = resolve(sorted(tables), target, aliases)
    if unified:
        return search(union({n: tables[n] for n in names}), body, id_col=id_col, text=text)
    size, start = min(int(body.get("size", 10)), MOST), int(body.get("from", 0))
    parts = [search(tables[n].withColumn("_index", F.lit(n)), body | {"from": 0, "size": size + start}, id_col=id_col, text=text) for n in names]
    order = sort_columns(body["sort"]) if body.get("sort") else [F.desc("_score")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).orderBy(*order, "_index", id_col).offset(start).limit(size)


def multi_aggregate(tables: dict[str, DataFrame], target: str, query: dict | None, wanted: dict, aliases: dict | None = None, text: tuple[str, ...] = ()) -> DataFrame:
    """Aggregations over the matches of several indexes: buckets of one key are one bucket, whatever the index."""
    names = resolve(sorted(tables), target, aliases)
    every = union({n: tables[n] for n in names})
    return aggs.tree(every.where(Compiler(Schema.of(every.schema, text)).compile(query).pred), wanted)


def search_each(requests: dict[str, tuple[DataFrame, dict]], id_col: str = "_id", text: tuple[str, ...] = ()) -> DataFrame:
    """A query of its own for each index, one ranking: the best `size` of the first request over all."""
    size = min(int(next(iter(requests.values()))[1].get("size", 10)), MOST)
    parts = [search(df.withColumn("_index", F.lit(n)), body | {"from": 0, "size": size}, id_col=id_col, text=text) for n, (df, body) in requests.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).orderBy(F.desc("_score"), "_index", id_col).limit(size)


def msearch(requests: list[tuple[DataFrame, dict]], **how) -> list[DataFrame]:
    """Independent searches in order."""
    return [search(df, body, **how) for df, body in requests]
