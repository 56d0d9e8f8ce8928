"""The JSON query language: parsed to a small tree, compiled to predicates and to scored terms."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import analysis
from larkspur.sources import schema as times


class QueryError(ValueError):
    """A malformed query."""


@dataclass
class Schema:
    """Kinds of columns (text, keyword, numeric, bool, date), analyzers of text columns, and their Spark types.

    search_analyzers analyse query text where a field has one, formats are layouts of date fields, multi names
    the columns that hold arrays, any value of which may match.
    """

    kinds: dict[str, str]
    analyzers: dict[str, str] = field(default_factory=dict)
    default: str = "standard"
    search_analyzers: dict[str, str] = field(default_factory=dict)
    formats: dict[str, str] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    multi: frozenset[str] = frozenset()
    #: compat keeps the surprising bounds of ranges (see num_range and date_range); otherwise they mean what they say
    compat: bool = True

    @classmethod
    def of(cls, schema: T.StructType, text: tuple[str, ...] = (), **how) -> Schema:
        def kind(f: T.StructField) -> str:
            t = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            if isinstance(t, T.BooleanType):
                return "bool"
            if isinstance(t, T.NumericType):
                return "numeric"
            if isinstance(t, T.TimestampType | T.TimestampNTZType | T.DateType):
                return "date"
            return "text" if f.name in text else "keyword"

        multi = frozenset(f.name for f in schema.fields if isinstance(f.dataType, T.ArrayType))
        return cls({f.name: kind(f) for f in schema.fields}, types={f.name: f.dataType.simpleString() for f in schema.fields}, multi=multi, **how)

    def analyzer(self, f: str) -> str:
        return self.analyzers.get(f, self.default)

    def tokens(self, f: str) -> Column:
        c = F.col(f)
        if self.kinds.get(f) != "text":
            return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(c.cast("array<string>") if f in self.multi else F.array(c.cast("string")))
        if f not in self.multi:
            return analysis.tokens(c, self.analyzer(f))
        return analysis.tokens(F.array_join(c, "\n"), self.analyzer(f))


@dataclass
class Node:
    """A compiled query: its predicate, and the (field, token, boost) terms that score."""

    pred: Column
    terms: list[tuple[str, str, float]] = field(default_factory=list)
    const: list[tuple[Column, float]] = field(default_factory=list)

    def boosted(self, b: float | None) -> Node:
        if b is None or b < 0:
            return self
        return Node(self.pred, [(f, t, w * b) for f, t, w in self.terms], [(c, w * b) for c, w in self.const])


def safe(c: Column) -> Column:
    """Null as false, for negations alone: elsewhere a null test already rejects, and a bare one reaches the scan."""
    return F.coalesce(c, F.lit(False))


def number(v) -> int | float:
    """A numeric literal, whole if it is: a scan can compare it with whole columns of any size."""
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, str):
        v = int(v) if re.fullmatch(r"\s*[+-]?\d+\s*", v) else float(v)
    return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 2**63 else v


def min_should(n: int, spec) -> int:
    """How many of n clauses must match: integer, percentage, or conditional forms such as "2<75% 9<-3"."""
    if n == 0:
        return 1

    def one(x) -> int:
        s = str(x).strip()
        if s.endswith("%"):
            p = float(s[:-1])
            v = math.floor(n * abs(p) / 100)
            return n - v if p < 0 else v
        v = math.floor(float(s))
        return n + v if v < 0 else v

    s = str(spec).strip()
    if "<" in s:
        value = n
        for k, expr in sorted((int(k), expr) for k, _, expr in (part.partition("<") for part in s.split())):
            if n <= k:
                break
            value = one(expr)
    else:
        value = one(spec)
    return max(1, min(n, value))


def fuzziness(spec, longest: int) -> int:
    """Edits allowed: an integer, AUTO, or AUTO:low,high by the longest token's bytes."""
    s = str(spec).upper()
    if not s.startswith("AUTO"):
        return int(float(s))
    lo, hi = 3, 6
    if ":" in s:
        lo, hi = (int(x) for x in s.split(":")[1].split(","))
        if lo < 2 or lo >= hi:
            return 0
    return 0 if longest < lo else 1 if longest < hi else 2


def wildcard_re(p: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p) + "$"


NOT_IMPLEMENTED = {"boosting", "combined_fields", "exists", "terms_set", "geo_bounding_box", "geo_distance", "geo_polygon", "geo_shape"}


class Compiler:
    def __init__(self, schema: Schema, now: datetime | None = None):
        self.s, self.now = schema, now or datetime.now(UTC)

    def compile(self, q: dict | None) -> Node:
        if q is None or q == {}:
            return Node(F.lit(True), const=[(F.lit(True), 1.0)])
        if not isinstance(q, dict) or len(q) != 1:
            raise QueryError("malformed query: one key is expected")
        (name, body), = q.items()
        if name in NOT_IMPLEMENTED:
            raise NotImplementedError(f"query {name} is not implemented")
        f = getattr(self, "q_" + name, None)
        if f is None:
            raise QueryError(f"unknown query {name}")
        return f(body)

    # -- helpers

    def _field(self, body: dict, key: str = "value") -> tuple[str, dict]:
        if not isinstance(body, dict) or len(body) != 1:
            raise QueryError("malformed query: one field is expected")
        (f, v), = body.items()
        return f, v if isinstance(v, dict) else {key: v}

    def _any_token(self, f: str, test) -> Column:
        if f not in self.s.kinds:
            return F.lit(False)
        if self.s.kinds[f] == "text":
            return F.exists(self.s.tokens(f), test)
        return self._any(f, lambda c: test(c if self.s.kinds[f] == "keyword" else c.cast("string")))

    def _any(self, f: str, test) -> Column:
        """A test of the bare column, which a scan can take, or of any value of an array; null where there is none."""
        return F.exists(F.col(f), test) if f in self.s.multi else test(F.col(f))

    def _instant(self, f: str, v, layout: str | None = None, zone: str | None = None) -> Column:
        """A date as a literal of the column's own type."""
        layout = layout or self.s.formats.get(f)
        try:
            t = times.parse_time(v, layout, zone)
        except (ValueError, TypeError) as e:
            raise QueryError(f"{v!r} is no date of {f}") from e
        kind = self.s.types.get(f, "timestamp")
        kind = kind[6:-1] if kind.startswith("array<") else kind
        return F.lit(t).cast(kind if kind in ("timestamp", "timestamp_ntz") else "timestamp")

    def _const(self, pred: Column, boost=None) -> Node:
        return Node(pred, const=[(pred, 1.0)]).boosted(boost)

    def _term(self, f: str, v, boost=None) -> Node:
        kind = self.s.kinds.get(f)
        if kind is None:
            return Node(F.lit(False))
        if kind == "numeric":
            return self._const(self._any(f, lambda c: c == number(v)), boost)
        if kind == "bool":
            return self._const(self._any(f, lambda c: c == (v if isinstance(v, bool) else str(v).lower() in ("1", "t", "true"))), boost)
        if kind == "date":
            return self._const(self._any(f, lambda c: c == self._instant(f, v)), boost)
        pred = F.array_contains(self.s.tokens(f), str(v)) if kind == "text" else self._any(f, lambda c: c == str(v))
        return Node(pred, [(f, str(v), 1.0)]).boosted(boost)

    def _analyzed(self, f: str, text: str, analyzer: str | None) -> list[str]:
        if self.s.kinds.get(f) != "text":
            return [str(text)]
        return analysis.analyze(str(text), analyzer or self.s.search_analyzers.get(f) or self.s.analyzer(f))

    # -- leaves

    def q_match_all(self, body) -> Node:
        return self._const(F.lit(True), (body or {}).get("boost"))

    def q_match_none(self, body) -> Node:
        return Node(F.lit(False))

    def q_term(self, body) -> Node:
        f, o = self._field(body)
        return self._term(f, o["value"], o.get("boost"))

    def q_terms(self, body) -> Node:
        body = dict(body)
        boost = body.pop("boost", None)
        (f, values), = body.items()
        kind = self.s.kinds.get(f)
        if kind is None or not values:
            return Node(F.lit(False))
        if kind == "text":
            pred = F.arrays_overlap(self.s.tokens(f), F.array(*[F.lit(str(v)) for v in values]))
            return Node(pred, [(f, str(v), 1.0) for v in values]).boosted(boost)
        say = {"numeric": number, "bool": lambda v: v if isinstance(v, bool) else str(v).lower() in ("1", "t", "true"), "date": lambda v: self._instant(f, v)}.get(kind, str)
        return self._const(self._any(f, lambda c: c.isin(*[say(v) for v in values])), boost)

    def q_ids(self, body) -> Node:
        values = body["values"] if "values" in body else next(iter(body.values())) if isinstance(body, dict) else body
        values = values if isinstance(values, list) else [values]
        c = F.col("_id")
        return self._const((c if self.s.kinds.get("_id") == "keyword" else c.cast("string")).isin(*[str(v) for v in values]))

    def q_range(self, body) -> Node:
        f, o = self._field(body)
        kind = self.s.kinds.get(f)
        if kind == "numeric":
            return self._const(self.num_range(f, o), o.get("boost"))
        if kind == "date":
            return self._const(self.date_range(f, o), o.get("boost"))
        raise QueryError(f"range on {f} of type {kind}")

    def num_range(self, f: str, o: dict) -> Column:
        """compat: bounds of 0 or less count as missing, a missing lower bound is 0 exclusive, inclusive wins."""
        lo, hi = (o.get("gte"), True) if "gte" in o else (o.get("gt"), False), (o.get("lte"), True) if "lte" in o else (o.get("lt"), False)
        if self.s.compat:
            lo = lo if lo[0] is not None and float(lo[0]) > 0 else (0, False)
            hi = hi if hi[0] is not None and float(hi[0]) > 0 else (2**63 - 1, False)

        def test(c: Column) -> Column:
            out = c.isNotNull()
            if lo[0] is not None:
                out = out & (c >= number(lo[0]) if lo[1] else c > number(lo[0]))
            if hi[0] is not None:
                out = out & (c <= number(hi[0]) if hi[1] else c < number(hi[0]))
            return out

        return self._any(f, test)

    def date_range(self, f: str, o: dict) -> Column:
        """format: a layout or epoch_millis, else the field's; compat: a missing upper bound is the present, exclusive."""
        at = lambda v: self._instant(f, v, o.get("format"), o.get("time_zone"))

        def test(c: Column) -> Column:
            out = c.isNotNull()
            for k, op in (("gte", "__ge__"), ("gt", "__gt__"), ("lte", "__le__"), ("lt", "__lt__")):
                if k in o and not (k == "gt" and "gte" in o) and not (k == "lt" and "lte" in o):
                    out = out & getattr(c, op)(at(o[k]))
            return out & (c < at(self.now.timestamp() * 1000 if o.get("format") == "epoch_millis" else self.now)) if self.s.compat and "lt" not in o and "lte" not in o else out

        return self._any(f, test)

    def q_match(self, body) -> Node:
        f, o = self._field(body, "query")
        if f not in self.s.kinds:
            return Node(F.lit(False))
        if self.s.kinds[f] in ("numeric", "bool", "date"):
            return self._term(f, o["query"], o.get("boost"))
        t = self._analyzed(f, o["query"], o.get("analyzer"))
        if not t:
            return Node(F.lit(False))
        k = fuzziness(o["fuzziness"], max(len(x.encode()) for x in t)) if "fuzziness" in o else 0
        subs = [self._fuzzy(f, x, k, int(o.get("prefix_length", 0))) if k else self._term(f, x) for x in t]
        need = len(subs) if str(o.get("operator", "or")).lower() == "and" else min_should(len(subs), o["minimum_should_match"]) if "minimum_should_match" in o else 1
        node = self._should(subs, need)
        if self.s.kinds[f] == "text" and not k and len(set(t)) == len(t) > 1:
            # the same test with the tokens said, and so made, once
            want = F.array(*[F.lit(x) for x in t])
            node.pred = F.arrays_overlap(self.s.tokens(f), want) if need <= 1 else F.size(F.array_intersect(want, self.s.tokens(f))) >= need
        return node.boosted(o.get("boost"))

    def _should(self, subs: list[Node], need: int) -> Node:
        if need <= 1:
            pred = subs[0].pred
            for s in subs[1:]:
                pred = pred | s.pred
        elif need == len(subs):
            pred = subs[0].pred
            for s in subs[1:]:
                pred = pred & s.pred
        else:
            pred = sum((F.when(s.pred, 1).otherwise(0) for s in subs), F.lit(0)) >= need
        return Node(pred, [t for s in subs for t in s.terms], [c for s in subs for c in s.const])

    def _phrase(self, f: str, t: list[str]) -> Column:
        """Tokens at consecutive positions: one search in the tokens joined by a control character that none holds."""
        if not t or f not in self.s.kinds:
            return F.lit(False)
        sep = "\x1f"
        return F.contains(F.concat(F.lit(sep), F.array_join(self.s.tokens(f), sep), F.lit(sep)), F.lit(sep + sep.join(t) + sep))

    def q_match_phrase(self, body) -> Node:
        f, o = self._field(body, "query")
        t = self._analyzed(f, o["query"], o.get("analyzer"))
        return Node(self._phrase(f, t), [(f, x, 1.0) for x in t]).boosted(o.get("boost"))

    def q_match_bool_prefix(self, body) -> Node:
        f, o = self._field(body, "query")
        t = self._analyzed(f, o["query"], o.get("analyzer"))
        if not t:
            return Node(F.lit(False))
        return self._should([*(self._term(f, x) for x in t[:-1]), self._prefix(f, t[-1])], 1).boosted(o.get("boost"))

    def q_match_phrase_prefix(self, body) -> Node:
        """The last token is a prefix of some token; the others are a phrase. They need not be adjacent."""
        f, o = self._field(body, "query")
        t = self._analyzed(f, o["query"], o.get("analyzer"))
        if not t:
            return Node(F.lit(False))
        p = self._prefix(f, t[-1])
        return (Node(p.pred & self._phrase(f, t[:-1]), [(f, x, 1.0) for x in t[:-1]], p.const) if len(t) > 1 else p).boosted(o.get("boost"))

    def q_multi_match(self, body) -> Node:
        subs = [self.q_match({f: {k: body[k] for k in ("query", "operator", "analyzer") if k in body}}) for f in body["fields"]]
        return self._should(subs, min_should(len(subs), body["minimum_should_match"]) if "minimum_should_match" in body else 1).boosted(body.get("boost"))

    def _prefix(self, f: str, v: str) -> Node:
        return self._const(self._any_token(f, lambda t: F.startswith(t, F.lit(v))))

    def q_prefix(self, body) -> Node:
        f, o = self._field(body)
        return self._prefix(f, str(o["value"])).boosted(o.get("boost"))

    def q_wildcard(self, body) -> Node:
        f, o = self._field(body)
        p = str(o.get("value", o.get("wildcard")))
        return self._const(self._any_token(f, lambda t: F.rlike(t, F.lit(wildcard_re(p)))), o.get("boost"))

    def q_regexp(self, body) -> Node:
        f, o = self._field(body)
        return self._const(self._any_token(f, lambda t: F.rlike(t, F.lit(f"^(?:{o['value']})$"))), o.get("boost"))

    def _fuzzy(self, f: str, v: str, k: int, prefix: int) -> Node:
        return self._const(self._any_token(f, lambda t: (F.levenshtein(t, F.lit(v), k) >= 0) & F.startswith(t, F.lit(v[:prefix]))))

    def q_fuzzy(self, body) -> Node:
        f, o = self._field(body)
        v = str(o["value"])
        k = fuzziness(o.get("fuzziness", "AUTO"), len(v.encode())) or 1
        return self._fuzzy(f, v, k, int(o.get("prefix_length", 0))).boosted(o.get("boost"))

    def q_bool(self, body) -> Node:
        get = lambda k: [self.compile(q) for q in (body.get(k) if isinstance(body.get(k), list) else [body[k]] if body.get(k) else [])]
        must, should, out, filters = get("must"), get("should"), get("must_not"), get("filter")
        preds = [n.pred for n in must + filters] + [~safe(n.pred) for n in out]
        need = min_should(len(should), body["minimum_should_match"]) if "minimum_should_match" in body else 0 if must or filters else 1
        if should and need:
            preds.append(self._should(should, need).pred)
        pred = F.lit(True)
        for p in preds:
            pred = pred & p
        if not (must or should or filters or out):
            pred = F.lit(False)
        return Node(pred, [t for n in must + should for t in n.terms], [c for n in must + should for c in n.const]).boosted(body.get("boost"))

    def q_query_string(self, body) -> Node:
        unknown = set(body) - {"query", "fields", "analyzer", "default_field", "default_operator", "boost"}
        if unknown:
            raise QueryError(f"unknown key {sorted(unknown)[0]}")
        return self.compile(parse_query_string(body["query"], [f for f, k in self.s.kinds.items() if k in ("text", "keyword")], self.s)).boosted(body.get("boost"))

    q_simple_query_string = q_query_string


_PART = re.compile(r'\s*([+-]?)(?:([\w.@]+):)?(?:"([^"]*)"|/((?:[^/\\]|\\.)*)/|([<>]=?)\s*"?([^\s"]+)"?|((?:\\.|[^\s"\\])+))(?:\^(\d+(?:\.\d+)?))?')


def parse_query_string(text: str, fields: list[str], schema: Schema) -> dict:
    r"""field:term, +must, -not, "phrase", wild*cards, /regexp/, fuzzy~1, boost^2, field:>=5, \ before what is meant literally; a bare term is tried on every text or keyword field."""
    must, should, out = [], [], []
    at = 0
    while at < len(text) and text[at:].strip():
        m = _PART.match(text, at)
        if not m or m.end() == at:
            raise QueryError(f"query string at {at}: {text[at:]}")
        at = m.end()
        sign, f, phrase, rx, op, bound, word, boost = m.groups()
        if word and (m := re.search(r"(?<!\\)\^", word)):
            word, boost = word[: m.start()], word[m.end() :]
        plain = re.sub(r"\\(.)", r"\1", word or "")

        def leaf(f: str) -> dict:
            b = {"boost": float(boost)} if boost else {}
            if phrase is not None:
                return {"match_phrase": {f: {"query": phrase} | b}}
            if rx is not None:
                return {"regexp": {f: {"value": rx} | b}}
            if op:
                v = float(bound) if schema.kinds.get(f) == "numeric" else bound
                return {"range": {f: {{">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}[op]: v} | b}}
            if re.search(r"(?<!\\)[*?]", word):
                return {"wildcard": {f: {"value": word} | b}}
            if t := re.search(r"(?<!\\)~", word):
                return {"fuzzy": {f: {"value": word[: t.start()], "fuzziness": word[t.end() :] or 1} | b}}
            return {"match": {f: {"query": plain} | b}}

        q = leaf(f) if f else {"bool": {"should": [leaf(x) for x in fields]}}
        (must if sign == "+" else out if sign == "-" else should).append(q)
    return {"bool": {k: v for k, v in (("must", must), ("should", should), ("must_not", out)) if v}} if must or should or out else {"match_none": {}}


def from_v1(search: dict) -> dict:
    """The older search form: search_type, query {term, field, start_time, end_time, boost}, from, max_results, sort_fields, _source, aggs."""
    q = search.get("query") or {}
    f, term, b = q.get("field") or "_all", q.get("term", ""), {"boost": q["boost"]} if "boost" in q else {}
    kind = search.get("search_type", "")
    leaf = {
        "wildcard": {"wildcard": {f: {"value": term} | b}}, "fuzzy": {"fuzzy": {f: {"value": term} | b}}, "term": {"term": {f: {"value": term} | b}},
        "match": {"match": {f: {"query": term} | b}}, "matchphrase": {"match_phrase": {f: {"query": term} | b}}, "prefix": {"prefix": {f: {"value": term} | b}},
        "querystring": {"query_string": {"query": term}}, "matchall": {"match_all": {}}, "alldocuments": {"match_all": {}},
        "multiphrase": {"match_phrase": {f: {"query": " ".join(x[0] if isinstance(x, list) else x for x in q.get("terms") or [term])} | b}}, "daterange": {"match_all": {}},
    }.get(kind, {"match_all": {}})
    parts = [leaf]
    if q.get("start_time") or q.get("end_time"):
        r = {k: v for k, v in (("gte", q.get("start_time")), ("lt", q.get("end_time"))) if v}
        parts.append({"range": {"@timestamp": r}})
    out = {"query": {"bool": {"must": parts}} if len(parts) > 1 else leaf, "from": search.get("from", 0), "size": search.get("max_results", 10)}
    if search.get("sort_fields"):
        out["sort"] = search["sort_fields"]
    if search.get("_source"):
        out["_source"] = search["_source"]
    if search.get("aggs"):
        out["aggs"] = {k: {("terms" if v["agg_type"] == "term" else v["agg_type"]): {x: y for x, y in v.items() if x != "agg_type"}} for k, v in search["aggs"].items()}
    return out
