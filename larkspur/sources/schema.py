"""Type inference and coercion of JSON documents; time and duration parsing; identifiers."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CANONICAL = {"text": "text", "match_only_text": "text", "keyword": "keyword", "constant_keyword": "keyword", "bool": "bool", "boolean": "bool", "vector": "vector"} | dict.fromkeys(("numeric", "integer", "double", "long", "short", "int", "float"), "numeric") | dict.fromkeys(("date", "time", "datetime"), "date")
IGNORED = {"flattened", "object", "nested", "wildcard", "byte", "alias", "geo_point", "ip", "ip_range", "scaled_float"}
_SHAPES = [r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d", r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d[+-]\d\d:\d\d", r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}[+-]\d\d:\d\d"]


def is_date(s: str) -> bool:
    if not any(re.fullmatch(p, s) for p in _SHAPES):
        return False
    try:
        datetime.fromisoformat(s)
    except ValueError:
        return False
    return True


def infer(v) -> str | None:
    """Kind of a JSON value; of a list, that of its last element; None for null and objects."""
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int | float):
        return "numeric"
    if isinstance(v, str):
        return "date" if is_date(v) else "text"
    if isinstance(v, list) and v:
        return infer(v[-1])
    return None


def mappings(properties: dict, prefix: str = "") -> dict[str, str]:
    """Flat name -> kind of declared properties, with sub-objects and multi-fields under dotted names."""
    out: dict[str, str] = {}
    for name, p in properties.items():
        if "properties" in p:
            out |= mappings(p["properties"], f"{prefix}{name}.")
            continue
        t = p.get("type", "text")
        if t in IGNORED:
            continue
        if t not in CANONICAL:
            raise ValueError(f"type {t} is unknown")
        if t == "vector" and (int(p.get("dims", 0)) <= 0 or p.get("vec_index_type", "flat") not in ("flat", "ivf_pq", "hnsw")):
            raise ValueError(f"vector {name} needs dims and a known index type")
        out[prefix + name] = CANONICAL[t]
        if CANONICAL[t] == "text":
            for sub, q in (p.get("fields") or {}).items():
                out[f"{prefix}{name}.{sub}"] = CANONICAL[q.get("type", "text")]
    return out


def merge(have: dict[str, str], new: dict[str, str]) -> dict[str, str]:
    """New fields are added; a field declared anew is an error."""
    if again := sorted(set(have) & set(new)):
        raise ValueError(f"field {again[0]} exists")
    return have | new


def flatten(doc: dict, prefix: str = "") -> dict:
    """Dotted keys. Lists of only objects or lists (or empty) are flattened by position; scalar lists stay."""
    out: dict = {}
    for k, v in doc.items():
        if isinstance(v, dict):
            out |= flatten(v, f"{prefix}{k}.")
        elif isinstance(v, list) and all(isinstance(x, dict | list) for x in v):
            out |= flatten({str(i): x for i, x in enumerate(v)}, f"{prefix}{k}.")
        else:
            out[prefix + k] = v
    return out


def unflatten(flat: dict) -> dict:
    out: dict = {}
    for k, v in flat.items():
        at = out
        *path, last = k.split(".")
        for p in path:
            at = at.setdefault(p, {})
        at[last] = v
    return out


def to_string(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v:.0f}" if v == int(v) else f"{v!r}" if "e" not in repr(v) else f"{v:.20f}".rstrip("0")
    return str(v)


def to_number(v) -> float:
    return float(v) if not isinstance(v, bool) else float(int(v))


def to_bool(v) -> bool:
    if isinstance(v, str):
        if v in ("1", "t", "T", "TRUE", "true", "True"):
            return True
        if v in ("0", "f", "F", "FALSE", "false", "False"):
            return False
        raise ValueError(f"{v!r} is no boolean")
    return v != 0


def coerce(v, kind: str, layout: str | None = None):
    """v as its field's kind; a list keeps its length; null and empty text are missing."""
    if isinstance(v, list):
        return [coerce(x, kind, layout) for x in v]
    if v is None or v == "" and kind in ("text", "keyword"):
        return None
    return {"text": to_string, "keyword": to_string, "numeric": to_number, "bool": to_bool, "date": lambda x: parse_time(x, layout)}[kind](v)


_GO = [("2006", "%Y"), ("01", "%m"), ("02", "%d"), ("15", "%H"), ("04", "%M"), ("05", "%S"), (".000", ".%f"), ("Z07:00", "%z"), ("-0700", "%z"), ("Jan", "%b"), ("Mon", "%a"), ("MST", "%Z")]


def strptime_format(layout: str) -> str:
    for a, b in _GO:
        layout = layout.replace(a, b)
    return layout


def parse_time(v, layout: str | None = None, zone: str | None = None) -> datetime:
    """An instant from ISO text, a layout, or a number whose unit is told by its size (ns, us, ms, s)."""
    if isinstance(v, datetime):
        return v if v.tzinfo else v.replace(tzinfo=UTC)
    if isinstance(v, int | float) or isinstance(v, str) and re.fullmatch(r"-?\d+", v) and (layout in (None, "epoch_millis")):
        n = float(v)
        n = n / 1e3 if layout == "epoch_millis" else n / (1e9 if n > 1e18 else 1e6 if n > 1e15 else 1e3 if n > 1e12 else 1)
        return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=n)
    t = datetime.strptime(v, strptime_format(layout)) if layout else datetime.fromisoformat(v)
    return t if t.tzinfo else t.replace(tzinfo=parse_zone(zone))


def parse_zone(z: str | None):
    if not z or z.upper() in ("UTC", "Z"):
        return UTC
    if m := re.fullmatch(r"([+-])(\d\d):?(\d\d)", z):
        return timezone((1 if m[1] == "+" else -1) * timedelta(hours=int(m[2]), minutes=int(m[3])))
    return datetime.now().astimezone().tzinfo if z.upper() == "LOCAL" else ZoneInfo(z)


def parse_duration(s: str) -> timedelta:
    """1d, 2h30m, 1.5s, 100ms; a bare number is nanoseconds."""
    if re.fullmatch(r"\d+", s):
        return timedelta(microseconds=int(s) / 1000)
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h|d)", s)
    if not parts or "".join(a + b for a, b in parts) != s:
        raise ValueError(f"{s!r} is no duration")
    return sum((timedelta(seconds=float(n) * {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600, "d": 86400}[u]) for n, u in parts), timedelta())


def format_duration(d: timedelta) -> str:
    s = int(d.total_seconds())
    for n, u in ((360 * 86400, "y"), (30 * 86400, "M"), (86400, "d"), (3600, "h"), (60, "m")):
        if s >= n and s % n == 0:
            return f"{s // n}{u}"
    return f"{s}s"


def base62(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out or "0"


def from_base62(s: str) -> int:
    n = 0
    for c in s:
        n = n * 62 + BASE62.index(c)
    return n
