"""Metric and bucket aggregations as DataFrames."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.sources.schema import parse_time

SIZE = 1000
_UNIT = {"ms": 1000, "s": 10**6, "m": 60 * 10**6, "h": 3600 * 10**6, "d": 86400 * 10**6}


def metric(kind: str, o: dict) -> Column:
    """A metric as a Column; empty input gives 0, as avg of nothing does."""
    f = F.col(o["field"]) if o.get("field") else None
    if kind == "count":
        return F.count("*")
    if kind == "cardinality":
        return F.count_distinct(f) if o.get("exact") else F.approx_count_distinct(f)
    if kind == "weighted_avg":
        v, w = F.col(o.get("field") or o["value"]["field"]), F.col(o.get("weight_field") or o["weight"]["field"])
        return F.coalesce(F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w))), F.lit(0.0))
    if kind not in ("avg", "max", "min", "sum"):
        raise NotImplementedError(f"aggregation {kind}")
    return F.coalesce(getattr(F, kind)(f).cast("double"), F.lit(0.0))


def metrics(df: DataFrame, aggs: dict[str, dict]) -> DataFrame:
    """One row with a column for each named metric.

    A field whose exact cardinality is wanted is read by itself: its values are grouped with nothing beside them, and
    exact and approximate cardinalities are of the values left, so that no value carries the buffers of other metrics.
    """
    kinds = {n: next(iter(a.items())) for n, a in aggs.items()}
    exact = {o["field"] for kind, o in kinds.values() if kind == "cardinality" and o.get("exact")}
    apart = {n: o["field"] for n, (kind, o) in kinds.items() if kind == "cardinality" and o["field"] in exact}
    parts = []
    for f in dict.fromkeys(apart.values()):
        mine = [n for n in apart if apart[n] == f]
        one = df.select(F.col(f).alias("_v")).where(F.col("_v").isNotNull()).distinct()
        parts.append(one.agg(*[(F.count("_v") if kinds[n][1].get("exact") else F.approx_count_distinct("_v")).alias(n) for n in mine]))
    rest = [metric(*a).alias(n) for n, a in kinds.items() if n not in apart]
    if rest or not parts:
        parts.append(df.agg(*rest))
    return reduce(lambda a, b: a.crossJoin(b), parts).select(*kinds)


def micros(interval: str) -> int:
    n, unit = re.fullmatch(r"(\d+)(ms|s|m|h|d)", interval).groups()
    return int(n) * _UNIT[unit]


def calendar_floor(ts: Column, unit: str, zone: str = "UTC") -> Column:
    """The start of the calendar unit in the zone; weeks start on Sunday."""
    t = F.from_utc_timestamp(ts.cast("timestamp"), zone)
    u = {"1s": "second", "1m": "minute", "1h": "hour", "1d": "day", "1w": "week", "1M": "month", "1q": "quarter", "1y": "year"}.get(unit, unit)
    out = F.date_sub(F.to_date(t), F.dayofweek(F.to_date(t)) - 1).cast("timestamp") if u == "week" else F.date_trunc(u, t)
    return F.to_utc_timestamp(out, zone)


def fixed_floor(ts: Column, interval: str) -> Column:
    """Multiples of the interval since the epoch."""
    iv = micros(interval)
    return F.timestamp_micros((F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(float(iv))) * iv).cast("long"))


def histogram_key(v: Column, interval: float, offset: float = 0.0) -> Column:
    return F.floor((v.cast("double") - offset) / interval) * F.lit(float(interval)) + offset


def _subs(aggs: dict | None) -> list[Column]:
    return [metric(*next(iter(a.items()))).alias(n) for n, a in (aggs or {}).items()]


def terms(df: DataFrame, field: str, size: int = SIZE, aggs: dict | None = None) -> DataFrame:
    """The `size` most frequent values: key, doc_count, metrics; ties by key. Nulls form no bucket."""
    return df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("key")).agg(F.count("*").alias("doc_count"), *_subs(aggs)).orderBy(F.desc("doc_count"), "key").limit(size)


def nested_terms(df: DataFrame, outer: str, inner: str, size: int = SIZE, inner_size: int = SIZE, aggs: dict | None = None) -> DataFrame:
    """Terms within terms: key, child, doc_count, metrics. The outer buckets are ranked first, and only their rows counted."""
    top = terms(df, outer, size).select(F.col("key"), F.col("doc_count").alias("parent_count"))
    c = df.where(F.col(inner).isNotNull()).groupBy(F.col(outer).alias("key"), F.col(inner).alias("child")).agg(F.count("*").alias("doc_count"), *_subs(aggs)).join(F.broadcast(top) if size <= 10_000 else top, "key")
    w = Window.partitionBy("key").orderBy(F.desc("doc_count"), "child")
    return c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= inner_size).drop("_r")


def ranges(df: DataFrame, field: str, bounds: list[dict], date: bool = False, compat: bool = True) -> DataFrame:
    """One row a range, [from, to): key, doc_count. Ranges may overlap; one pass counts them all.

    compat: a missing numeric bound is 0; dates (and compat=False) take it as open.
    """
    c = F.col(field).cast("timestamp" if date else "double")
    lit = lambda v: F.lit(v).cast("timestamp") if date else F.lit(float(v))
    cols, keys = [], []
    for i, b in enumerate(bounds):
        lo, hi = b.get("from"), b.get("to")
        if not date and compat:
            lo, hi = lo or 0.0, hi or 0.0
        p = c.isNotNull()
        if lo is not None:
            p = p & (c >= lit(lo))
        if hi is not None:
            p = p & (c < lit(hi))
        cols.append(F.count(F.when(p, 1)).alias(f"c{i}"))
        keys.append(b.get("key") or f"{'*' if lo is None else lo}-{'*' if hi is None else hi}")
    row = df.agg(*cols)
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"c{i}").alias("doc_count")) for i, k in enumerate(keys)])))


def _filled(b: DataFrame, parents: list[str], slot: str, window: tuple[int | None, int | None], size: int, hard: bool = False) -> DataFrame:
    """b with a row for every whole slot between the least and the greatest of each parent, widened to window (or held to it).

    Slots are whole numbers, so that a bucket meets its own row exactly; of a range longer than size only the
    first size slots are made, since no more are shown.
    """
    e = b.groupBy(*parents).agg(F.min(slot).alias("_lo"), F.max(slot).alias("_hi")).where("_lo is not null")
    lo, hi = window
    if hard:
        e = e.withColumns({"_lo": F.lit(lo) if lo is not None else F.col("_lo"), "_hi": F.lit(hi) if hi is not None else F.col("_hi")})
    else:
        e = e.withColumns({"_lo": F.least("_lo", F.lit(lo)) if lo is not None else F.col("_lo"), "_hi": F.greatest("_hi", F.lit(hi)) if hi is not None else F.col("_hi")})
    e = e.where("_lo <= _hi").select(*parents, F.explode(F.sequence("_lo", F.least("_hi", F.col("_lo") + (size - 1)))).alias(slot))
    on = [*parents, slot]
    names = [n for n in b.columns if n not in on]
    return e.join(b, on, "full").select(*on, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def _slot(v: Column, interval: float, offset: float) -> Column:
    return F.floor((v.cast("double") - offset) / interval)


def _slot_of(v: float | None, interval: float, offset: float) -> int | None:
    return None if v is None else math.floor((v - offset) / interval)


def histogram(df: DataFrame, field: str, interval: float, offset: float = 0.0, min_doc_count: int = 0, extended: tuple | None = None, size: int = SIZE, aggs: dict | None = None, hard: tuple | None = None) -> DataFrame:
    """Numeric buckets: key, doc_count, metrics. With min_doc_count 0, gaps between the least and greatest key are filled.

    extended widens what is filled, hard replaces it; neither drops a document's bucket.
    """
    if interval <= 0 or offset >= interval:
        raise ValueError("interval must be positive and the offset below it")
    b = df.where(F.col(field).isNotNull()).groupBy(_slot(F.col(field), interval, offset).alias("_i")).agg(F.count("*").alias("doc_count"), *_subs(aggs))
    if min_doc_count == 0:
        lo, hi = (hard or extended or (None, None))
        b = _filled(b, [], "_i", (_slot_of(lo, interval, offset), _slot_of(hi, interval, offset)), size, bool(hard))
    b = b.select((F.col("_i") * F.lit(float(interval)) + offset).alias("key"), *[c for c in b.columns if c != "_i"])
    return b.where(F.col("doc_count") >= min_doc_count).orderBy("key").limit(size)


def date_histogram(df: DataFrame, field: str, fixed: str | None = None, calendar: str | None = None, zone: str = "UTC", min_doc_count: int = 1, size: int = SIZE, aggs: dict | None = None) -> DataFrame:
    """Time buckets: key (their start), doc_count, metrics. min_doc_count 0 fills gaps of fixed intervals and of calendar units."""
    ts = F.col(field)
    k = fixed_floor(ts, fixed) if fixed else calendar_floor(ts, calendar, zone)
    b = df.where(ts.isNotNull()).groupBy(k.alias("key")).agg(F.count("*").alias("doc_count"), *_subs(aggs))
    if min_doc_count == 0:
        e = b.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo is not null")
        step = f"interval {micros(fixed)} microseconds" if fixed else {"week": "interval 7 days", "quarter": "interval 3 months"}.get(calendar, f"interval 1 {calendar}")
        b = e.select(F.explode(F.expr(f"sequence(lo, hi, {step})")).alias("key")).join(b, "key", "left").select("key", *[F.coalesce(n, F.lit(0)).alias(n) for n in b.columns if n != "key"])
    return b.where(F.col("doc_count") >= min_doc_count).orderBy("key").limit(size)


LADDER = ["1s", "5s", "10s", "30s", "1m", "5m", "10m", "30m", "1h", "3h", "12h", "1d", "7d", "30d", "90d", "180d", "365d", "1825d", "3650d", "7300d", "18250d"]


def auto_date_histogram(df: DataFrame, field: str, buckets: int = 10, minimum: str = "1s") -> DataFrame:
    """The finest interval of the ladder that gives at most `buckets` buckets: key, doc_count, interval."""
    pick = pick_interval(df, F.col(field).cast("timestamp"), buckets, minimum)
    return date_histogram(df, field, fixed=pick, min_doc_count=0).withColumn("interval", F.lit(pick))


# -- aggregations of a request, nested to any depth ----------------------------------------------------------

METRICS = ("avg", "max", "min", "sum", "count", "cardinality", "weighted_avg")
TREE = "agg string, keys array<string>, doc_count long, metrics map<string,double>"
MISSING = ""  # the bucket of documents without a value


def _day(ts: Column, o: dict) -> Column:
    """A date key as text: epoch_millis, a layout, or ISO in the zone."""
    layout, zone = o.get("format"), o.get("time_zone", "UTC")
    if layout == "epoch_millis":
        return F.unix_millis(ts).cast("string")
    at = F.from_utc_timestamp(ts, _zone(zone))
    return F.date_format(at, java_layout(layout) if layout else "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _zone(z: str) -> str:
    return "UTC" if z.upper() in ("UTC", "Z", "") else z


#: The reference time's parts in layouts, and the same parts in patterns.
_LAYOUT = [("2006", "yyyy"), ("January", "MMMM"), ("Monday", "EEEE"), ("Jan", "MMM"), ("Mon", "E"), ("01", "MM"), ("02", "dd"), ("15", "HH"), ("03", "hh"), ("04", "mm"), ("05", "ss"), (".000", ".SSS"), ("Z07:00", "XXX"), ("-0700", "xx"), ("PM", "a")]


def java_layout(layout: str) -> str:
    out, at = "", 0
    while at < len(layout):
        part = next(((a, b) for a, b in _LAYOUT if layout.startswith(a, at)), None)
        out += part[1] if part else f"'{layout[at]}'" if layout[at].isalpha() else layout[at]
        at += len(part[0]) if part else 1
    return out


def _first(df: DataFrame, field: str) -> Column:
    return F.get(F.col(field), 0) if df.schema[field].dataType.typeName() == "array" else F.col(field)


def _metric_map(df: DataFrame, aggs: dict) -> Column:
    pairs = [x for n, a in aggs.items() for kind, o in [_kind(a)] if kind in METRICS for x in (F.lit(n), _metric(df, kind, o).cast("double"))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")


def _metric(df: DataFrame, kind: str, o: dict) -> Column:
    f = o.get("field")
    if kind in ("avg", "max", "min", "sum") and f and df.schema[f].dataType.typeName() == "array":
        v = F.transform(F.col(f), lambda x: x.cast("double"))
        total, n = F.sum(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))), F.sum(F.size(F.filter(v, lambda x: x.isNotNull())))
        return F.coalesce({"sum": total, "avg": F.try_divide(total, n), "max": F.max(F.array_max(v)), "min": F.min(F.array_min(v))}[kind], F.lit(0.0))
    return metric(kind, o)


def _kind(a: dict) -> tuple[str, dict]:
    kinds = [k for k in a if k not in ("aggs", "aggregations")]
    if len(kinds) != 1:
        raise ValueError("an aggregation has one kind")
    return kinds[0], a[kinds[0]]


def tree(df: DataFrame, aggs: dict, missing: bool = False) -> DataFrame:
    """Rows (agg, keys, doc_count, metrics) of all aggregations of a request over all matching rows of df.

    agg is the path of names joined by '>', keys the bucket's keys from the outermost on, metrics the values of
    the metrics inside it. Top-level metrics are one row whose agg is empty and keys are none. Children are
    counted within the surviving buckets of their parents only. missing: rows without a value form the bucket
    '' of terms, else they form none. Numeric keys are doubles as text, dates as their format says.
    """
    out = [df.agg(F.lit("").alias("agg"), F.array().cast("array<string>").alias("keys"), F.count("*").alias("doc_count"), _metric_map(df, aggs).alias("metrics"))] if any(_kind(a)[0] in METRICS for a in aggs.values()) else []
    out += _level(df, aggs, [], "", missing)
    if not out:
        raise ValueError("no aggregation is given")
    for a in out[1:]:
        out[0] = out[0].unionByName(a)
    return out[0]


def _level(df: DataFrame, aggs: dict, parents: list[str], path: str, missing: bool) -> list[DataFrame]:
    out: list[DataFrame] = []
    for name, a in aggs.items():
        kind, o = _kind(a)
        inner = a.get("aggs") or a.get("aggregations") or {}
        if kind in METRICS:
            continue
        here = f"{path}>{name}" if path else name
        if kind in ("range", "date_range"):
            out.append(_range_rows(df, kind, o, parents, here))
            continue
        k, slot = f"_k{len(parents)}", f"_i{len(parents)}"
        size, least = int(o.get("size") or SIZE), int(o.get("min_doc_count") or 0)
        say, fill = None, None
        f = _first(df, o["field"])
        if kind == "terms":
            value = f.cast("string")
            d = df.withColumn(k, F.coalesce(value, F.lit(MISSING)) if missing else value).where(F.col(k).isNotNull())
            group, order = k, [F.desc("doc_count"), F.col(k)]
        elif kind == "histogram":
            iv, off = float(o["interval"]), float(o.get("offset") or 0)
            if iv <= 0 or off >= iv:
                raise ValueError("interval must be positive and the offset below it")
            d = df.withColumn(slot, _slot(f, iv, off)).where(F.col(slot).isNotNull())
            say, group, order = (F.col(slot) * F.lit(iv) + off).cast("string"), slot, [F.col(slot)]
            hard, ext = o.get("hard_bounds"), o.get("extended_bounds")
            w = hard or ext or {}
            fill = ((_slot_of(w.get("min"), iv, off), _slot_of(w.get("max"), iv, off)), bool(hard))
        elif kind in ("date_histogram", "auto_date_histogram"):
            ts = f.cast("timestamp")
            fixed, calendar = o.get("fixed_interval") or o.get("interval"), o.get("calendar_interval")
            if kind == "auto_date_histogram":
                fixed, calendar = pick_interval(df, ts, int(o.get("buckets") or 10), o.get("minimum_interval") or "1s"), None
            if calendar in FIXED_UNITS:
                fixed, calendar = FIXED_UNITS[calendar], None
            zone = _zone(o.get("time_zone", "UTC"))
            if calendar:
                d = df.withColumn(slot, _calendar_slot(ts, calendar, zone)).where(F.col(slot).isNotNull())
                say = _day(_calendar_start(F.col(slot), calendar, zone), o)
                bound = lambda v: None if v is None else df.sparkSession.range(1).select(_calendar_slot(F.timestamp_millis(F.lit(int(v))), calendar, zone)).first()[0]  # noqa: E731, B023
            else:
                iv = micros(fixed)
                d = df.withColumn(slot, F.floor(F.unix_micros(ts) / F.lit(float(iv))).cast("long")).where(F.col(slot).isNotNull())
                say = _day(F.timestamp_micros((F.col(slot) * F.lit(iv)).cast("long")), o)
                bound = lambda v: None if v is None else int(v) * 1000 // iv  # noqa: E731, B023
            group, order = slot, [F.col(slot)]
            hard, ext = o.get("hard_bounds"), o.get("extended_bounds")
            w = hard or ext or {}
            fill = ((bound(w.get("min")), bound(w.get("max"))), bool(hard))
        else:
            raise NotImplementedError(f"aggregation {kind}")
        b = d.groupBy(*parents, group).agg(F.count("*").alias("doc_count"), _metric_map(df, inner).alias("metrics"))
        if fill is not None and least == 0:
            b = b.withColumnRenamed("metrics", "_m")
            b = _filled(b.drop("_m"), parents, slot, fill[0], size, fill[1]).join(b.select(*parents, slot, "_m"), [*parents, slot], "left").withColumnRenamed("_m", "metrics")
        b = b.where(F.col("doc_count") >= least)
        if parents:
            b = b.withColumn("_r", F.row_number().over(Window.partitionBy(*parents).orderBy(*order))).where(F.col("_r") <= size).drop("_r")
        else:
            b = b.orderBy(*order).limit(size)
        b = b.withColumn(k, say) if say is not None else b
        keys = F.array(*[F.col(x) for x in [*parents, k]])
        out.append(b.select(F.lit(here).alias("agg"), keys.alias("keys"), "doc_count", F.coalesce("metrics", F.create_map().cast("map<string,double>")).alias("metrics")))
        if any(_kind(x)[0] not in METRICS for x in inner.values()):
            alive = b.select(*parents, group, k).distinct()
            within = d.drop(k) if group != k else d
            out += _level(within.join(alive, [*parents, group]), inner, [*parents, k], here, missing)
    return out


def _range_rows(df: DataFrame, kind: str, o: dict, parents: list[str], path: str) -> DataFrame:
    """Rows of a range aggregation, [from, to): one pass counts all ranges; a missing numeric bound is 0, a missing date open."""
    date = kind == "date_range"
    c = _first(df, o["field"]).cast("timestamp" if date else "double")

    def lit(v) -> Column:
        return F.lit(parse_time(v, o.get("format"), o.get("time_zone"))) if date else F.lit(float(v))

    counts, keys = [], []
    for i, b in enumerate(o["ranges"]):
        lo, hi = b.get("from"), b.get("to")
        if not date:
            lo, hi = lo or 0.0, hi or 0.0
        p = c.isNotNull()
        p = p & (c >= lit(lo)) if lo is not None else p
        p = p & (c < lit(hi)) if hi is not None else p
        counts.append(F.count(F.when(p, 1)).alias(f"c{i}"))
        keys.append(b.get("key") or f"{'*' if lo is None else lo}-{'*' if hi is None else hi}")
    if not counts:
        raise ValueError("a range aggregation has one range or more")
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("_key"), F.col(f"c{i}").alias("doc_count")) for i, k in enumerate(keys)]))
    out = df.groupBy(*parents).agg(*counts).select(*parents, rows)
    return out.select(F.lit(path).alias("agg"), F.array(*parents, "_key").alias("keys"), "doc_count", F.create_map().cast("map<string,double>").alias("metrics"))


FIXED_UNITS = {"second": "1s", "1s": "1s", "minute": "1m", "1m": "1m", "hour": "1h", "1h": "1h", "day": "1d", "1d": "1d"}


def _calendar_slot(ts: Column, unit: str, zone: str) -> Column:
    """The number of a week (from Sunday), month, quarter or year in the zone."""
    t = F.from_utc_timestamp(ts, zone)
    months = (F.year(t) * 12 + F.month(t) - 1).cast("long")
    if unit in ("week", "1w"):
        return F.floor((F.unix_date(F.to_date(t)) + 4) / 7).cast("long")  # the day before 1 January 1970 was the 4th after a Sunday
    return {"month": months, "1M": months, "quarter": F.floor(months / 3).cast("long"), "1q": F.floor(months / 3).cast("long")}.get(unit, F.year(t).cast("long"))


def _calendar_start(slot: Column, unit: str, zone: str) -> Column:
    if unit in ("week", "1w"):
        day = F.date_from_unix_date((slot * 7 - 4).cast("int"))
    else:
        months = slot * {"month": 1, "1M": 1, "quarter": 3, "1q": 3}.get(unit, 12)
        day = F.make_date(F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1))
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def pick_interval(df: DataFrame, ts: Column, buckets: int, minimum: str) -> str:
    """The finest interval of the ladder that gives at most `buckets` buckets."""
    lo, hi = df.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    steps = LADDER[LADDER.index(minimum) :]
    return next((s for s in steps if lo is None or hi // micros(s) - lo // micros(s) + 1 <= buckets), steps[-1])
