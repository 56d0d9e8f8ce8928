"""Indexes, aliases and templates, kept as one JSON-serialisable value."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from larkspur.sources import schema

NAME = re.compile(r"(?!_)[a-zA-Z0-9_.-]+")


@dataclass
class Catalog:
    indexes: dict[str, dict] = field(default_factory=dict)
    aliases: dict[str, list[str]] = field(default_factory=dict)
    templates: dict[str, dict] = field(default_factory=dict)

    def create(self, name: str, properties: dict | None = None, settings: dict | None = None) -> dict:
        if not NAME.fullmatch(name):
            raise ValueError(f"{name!r} is no index name")
        if name in self.indexes:
            raise ValueError(f"index {name} exists")
        t = self.template_for(name) or {}
        kinds = schema.mappings((t.get("mappings") or {}).get("properties", {})) | schema.mappings(properties or {}) | {"_id": "keyword", "@timestamp": "date"}
        self.indexes[name] = {"mappings": kinds, "settings": (t.get("settings") or {}) | (settings or {})}
        for a in t.get("aliases", {}):
            self.alias([{"add": {"index": name, "alias": a}}])
        return self.indexes[name]

    def get(self, name: str) -> dict:
        """An index's mappings, settings and aliases."""
        if name not in self.indexes:
            raise KeyError(f"index {name} does not exist")
        return self.indexes[name] | {"aliases": sorted(a for a, n in self.aliases.items() if name in n)}

    def exists(self, name: str) -> bool:
        return name in self.indexes or name in self.aliases

    def delete(self, pattern: str) -> list[str]:
        rx = re.compile(re.escape(pattern).replace(r"\*", "[ -~]+"))
        gone = [n for n in self.indexes if (rx.search(n) if "*" in pattern else n == pattern)]
        for n in gone:
            del self.indexes[n]
            self.alias([{"remove": {"index": n, "alias": a}} for a in list(self.aliases)])
        return gone

    def put_mapping(self, name: str, properties: dict) -> None:
        i = self.indexes.get(name) or self.create(name)
        i["mappings"] = schema.merge(i["mappings"], schema.mappings(properties))

    def render_mapping(self, name: str) -> dict:
        """Mappings with nested properties, and the variants of a text field under its `fields`."""
        kinds = {k: v for k, v in self.indexes[name]["mappings"].items() if not k.startswith(("_", "@"))}
        out: dict[str, dict] = {}
        for k in sorted(kinds):
            above, _, last = k.rpartition(".")
            if kinds.get(above) == "text":
                out[above].setdefault("fields", {})[last] = {"type": kinds[k]}
            else:
                out[k] = {"type": kinds[k]}
        return {name: {"mappings": _nest(out)}}

    def put_settings(self, name: str, settings: dict) -> None:
        have = self.indexes[name]["settings"]
        a, b = have.setdefault("analysis", {}), settings.get("analysis", {})
        for kind in ("analyzer", "char_filter", "tokenizer", "token_filter", "filter"):
            if kind in b:
                a[kind] = a.get(kind, {}) | b[kind]
        have |= {k: v for k, v in settings.items() if k != "analysis"}

    def alias(self, actions: list[dict]) -> None:
        for x in actions:
            (kind, o), = x.items()
            rx = re.compile(re.escape(o["index"]).replace(r"\*", "[a-zA-Z0-9_.-]+"))
            names = [n for n in self.indexes if rx.search(n)] if "*" in o["index"] else [o["index"]]
            have = self.aliases.setdefault(o["alias"], [])
            self.aliases[o["alias"]] = [*have, *(n for n in names if n not in have)] if kind == "add" else [n for n in have if n not in names]
            if not self.aliases[o["alias"]]:
                del self.aliases[o["alias"]]

    def put_template(self, name: str, patterns: list[str], template: dict, priority: int = 0) -> None:
        for n, t in self.templates.items():
            if n != name and t["priority"] == priority and set(t["patterns"]) & set(patterns):
                raise ValueError(f"template {n} has the same pattern and priority")
        self.templates[name] = {"patterns": patterns, "template": template, "priority": priority}

    def template_for(self, index: str) -> dict | None:
        fits = [t for t in self.templates.values() if any(re.fullmatch(re.escape(p).replace(r"\*", ".*"), index) for p in t["patterns"])]
        return max(fits, key=lambda t: t["priority"])["template"] if fits else None

    def suggest(self, part: str) -> list[str]:
        return [n for n in sorted(self.indexes) if part.lower() in n.lower()][:30]

    def listing(self, name: str = "", start: int = 0, size: int = 20, desc: bool = False, by: str = "name", counts: dict[str, dict] | None = None) -> list[str]:
        """A page of the indexes whose name holds `name`, sorted by name or by a number of theirs (doc_num, storage_size, ...)."""
        key = (lambda n: n) if by == "name" else (lambda n: ((counts or {}).get(n, {}).get(by, 0), n))
        return sorted((n for n in self.indexes if name in n), key=key, reverse=desc)[start : start + size]


def _nest(flat: dict) -> dict:
    out: dict = {}
    for k in sorted(flat):
        at = out
        *path, last = k.split(".")
        for p in path:
            at = at.setdefault("properties", {}).setdefault(p, {})
        at.setdefault("properties", {})[last] = flat[k]
    return out
