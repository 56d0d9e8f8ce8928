"""Line dedup: a sharded minimal perfect hash over repeated line keys, probed by the documents' line hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import SPACES, as_bytes, durable, mix

LEAST_CHARS = 10
SHARD_KEYS = 100_000  # probes of a shard, about
SEEDS = 24  # levels of the minimal perfect hash


def line_key(line: bytes) -> bytes | None:
    """The stripped, A-Z-lowered line if it has LEAST_CHARS code points or more."""
    k = line.strip(SPACES)
    if len(k) < LEAST_CHARS or len(k) < 4 * LEAST_CHARS and len(k.decode(errors="replace")) < LEAST_CHARS:
        return None
    return k.lower()


def _hashes(text: bytes) -> tuple[list[int], list[int]]:
    """Positions of the lines with keys, and the keys' 128-bit hashes."""
    at, out = [], []
    for i, line in enumerate(text.split(b"\n")):
        k = line_key(line)
        if k is not None:
            at.append(i)
            out.append(xxhash.xxh3_128_intdigest(k))
    return at, out


_MASK = (1 << 64) - 1


def _signed(x: list[int], shift: int) -> np.ndarray:
    return np.array([(v >> shift) & _MASK for v in x], np.uint64).view(np.int64)


def _keys(it):
    """(doc_id, a, b): the distinct keys of each document, as two 64-bit halves."""
    for batch in it:
        ids, a, b = [], [], []
        for i, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            h = list(dict.fromkeys(_hashes(t)[1]))
            ids += [i] * len(h)
            a.append(_signed(h, 0))
            b.append(_signed(h, 64))
        z = np.zeros(0, np.int64)
        yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "a": np.concatenate([z, *a]), "b": np.concatenate([z, *b])})


# -- minimal perfect hash ----------------------------------------------------------------------------------


def _slot(a: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(a.view(np.uint64) ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & _MASK)) % np.uint64(size)).astype(np.int64)


def build(a: np.ndarray, b: np.ndarray, values: np.ndarray, counts: np.ndarray) -> dict[str, bytes]:
    """Arrays indexed by a minimal perfect hash of the distinct keys (a, b): fingerprints b, values, counts.

    Level by level, keys that share no slot of a bitmap are placed; the others go to the next level. Keys
    that no level separates (equal a) come last, in an ordered list.
    """
    bits, starts, order = [], [], []
    left = np.arange(len(a))
    for level in range(SEEDS):
        if not len(left):
            break
        size = 2 * len(left)
        s = _slot(a[left], level, size)
        alone = np.bincount(s, minlength=size) == 1
        bits.append(alone)
        ok = alone[s]
        placed = left[ok]
        order.append(placed[np.argsort(s[ok])])
        starts.append(size)
        left = left[~ok]
    left = left[np.lexsort((b[left], a[left]))]
    order = np.concatenate([*order, left]).astype(np.int64) if len(a) else np.zeros(0, np.int64)
    return {
        "sizes": np.array(starts, np.int64).tobytes(), "bits": np.packbits(np.concatenate(bits) if bits else np.zeros(0, bool)).tobytes(), "rest": a[left].tobytes(),
        "prints": b[order].tobytes(), "vals": values[order].tobytes(), "counts": counts[order].astype(np.int32).tobytes(),
    }


class Shard:
    """Probes of the arrays that build made."""

    def __init__(self, arrays: dict[str, bytes]):
        self.sizes = np.frombuffer(arrays["sizes"], np.int64)
        bits = np.unpackbits(np.frombuffer(arrays["bits"], np.uint8), count=int(self.sizes.sum())).astype(bool)
        self.bits, self.rank = bits, np.concatenate(([0], np.cumsum(bits)))
        self.rest = np.frombuffer(arrays["rest"], np.int64)
        self.prints, self.values = (np.frombuffer(arrays[k], np.int64) for k in ("prints", "vals"))
        self.counts = np.frombuffer(arrays["counts"], np.int32)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each key's index, -1 where it isn't there."""
        out = np.full(len(a), -1, np.int64)
        live, base = np.arange(len(a)), 0
        for level, size in enumerate(self.sizes.tolist()):
            s = _slot(a[live], level, size) + base
            hit = self.bits[s]
            out[live[hit]] = self.rank[s[hit]]
            live, base = live[~hit], base + size
        for k in live[np.isin(a[live], self.rest)]:  # halves that two keys share: nearly never
            at = len(self.prints) - len(self.rest)
            same = np.flatnonzero((self.rest == a[k]) & (self.prints[at:] == b[k]))
            if len(same):
                out[k] = at + same[0]
        ok = out >= 0
        ok[ok] = self.prints[out[ok]] == b[ok]
        return np.where(ok, out, -1)


INDEX = "shard int, sizes binary, bits binary, rest binary, prints binary, vals binary, counts binary"


def build_index(keys: DataFrame) -> DataFrame:
    """keys (shard, a, b, first, n), distinct: one row of arrays per shard."""

    def run(t: pa.Table) -> pa.Table:
        a, b, first, n = (t[c].to_numpy() for c in ("a", "b", "first", "n"))
        return pa.table({"shard": pa.array([t["shard"][0].as_py()], pa.int32()), **{k: pa.array([v], pa.binary()) for k, v in build(a, b, first, n).items()}})

    return keys.groupBy("shard").applyInArrow(run, INDEX)


def _probe(probes: pa.Table, index: pa.Table) -> pa.Table:
    """The probes (doc_id, a, b) whose line another document of smaller id holds."""
    if not probes.num_rows or not index.num_rows:
        return probes.slice(0, 0).select(["doc_id", "a", "b"])
    shard = Shard({k: index[k][0].as_py() for k in index.column_names if k not in ("shard", "salt")})
    a, b, ids = (probes[c].to_numpy() for c in ("a", "b", "doc_id"))
    at = shard.find(a, b)
    return probes.select(["doc_id", "a", "b"]).filter(pa.array((at >= 0) & (shard.values[at] < ids)))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col replaced by the kept lines, and _n_lines, _n_dropped added.

    A line's key is the stripped, A-Z-lowered line. Keys of LEAST_CHARS code points or more that at least
    two documents hold lose all their lines except in the smallest id; other lines stay, joined by newlines.
    Null text counts as one empty line. Rows that repeat an id are one document and keep the same lines.
    Null ids are judged by no one: their lines stay and count for nothing. Texts of any length are split
    whole. All columns are kept but those named _n_lines and _n_dropped, which are replaced. An empty table
    gives no rows.

    1. (key, id) pairs, distinct in each row, are counted by partial aggregation.
    2. All repeated keys are indexed in shards by a minimal perfect hash; the documents' compact probes (no
       line text) meet their shard's arrays. A shard with more than twice its even part of all probes, as one has
       that holds a very common line, is copied, and its probes are dealt to the copies by document: a task
       holds about SHARD_KEYS probes whatever the lines, and the copies weigh less than the probes.
    3. What each document drops comes back as one row of hashes beside its text.
    """
    spark = docs.sparkSession
    docs = docs.drop("_n_lines", "_n_dropped")
    own = "_own"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    doc, gone_col = f"{own}doc", f"{own}gone"
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    pairs = durable(d.mapInArrow(_keys, "doc_id long, a long, b long"), "lines")
    counts = pairs.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last")
    total = pairs.count()
    shards = max(1, -(-total // SHARD_KEYS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    even = max(1, -(-total // shards))  # probes of a shard, at most about SHARD_KEYS
    shard = F.pmod(F.xxhash64(F.lit(1), "a"), F.lit(shards)).cast("int").alias("shard")
    many = pairs.groupBy(shard).agg(F.count("*").alias("c")).where(F.col("c") > 2 * even)
    many = durable(many.select("shard", F.ceil(F.col("c") / even).cast("int").alias("salts")), "salts")
    index = build_index(counts.select(shard, "a", "b", "first", "n")).join(many, "shard", "left")
    index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).select("salt", *[c.split()[0] for c in INDEX.split(", ")])
    probes = pairs.withColumn("shard", shard).join(many, "shard", "left")
    probes = probes.select("shard", F.coalesce(F.pmod(F.xxhash64(F.lit(2), "doc_id"), "salts"), F.lit(0)).cast("int").alias("salt"), "doc_id", "a", "b")
    gone = probes.groupBy("shard", "salt").cogroup(index.groupBy("shard", "salt")).applyInArrow(_probe, "doc_id long, a long, b long")
    drops = gone.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set(F.struct("a", "b")).alias(gone_col))
    out = docs.select(*[F.col(c).cast("string").alias(c) if c == text_col else F.col(c) for c in docs.columns], F.lit(0).cast("long").alias("_n_lines"), F.lit(0).cast("long").alias("_n_dropped"))
    both = out.join(drops, F.col(id_col) == F.col(doc), "left").drop(doc)

    def cut(it):
        for b in it:
            texts, n_lines, n_dropped = [], [], []
            raw = b.column(text_col)
            for before, t, g in zip(raw.to_pylist(), as_bytes(raw), b.column(gone_col), strict=True):
                lines = t.split(b"\n")
                dead: set[int] = set()
                if g.is_valid:
                    mine = {(z["a"], z["b"]) for z in g.as_py()}
                    at, h = _hashes(t)
                    dead = {p for p, u, v in zip(at, _signed(h, 0).tolist(), _signed(h, 64).tolist(), strict=True) if (u, v) in mine}
                n_lines.append(len(lines))
                n_dropped.append(len(dead))
                texts.append(b"\n".join(x for j, x in enumerate(lines) if j not in dead).decode() if dead else before)
            o = b.drop_columns([gone_col])
            for name, v in ((text_col, pa.array(texts, pa.string())), ("_n_lines", pa.array(n_lines, pa.int64())), ("_n_dropped", pa.array(n_dropped, pa.int64()))):
                o = o.set_column(o.schema.get_field_index(name), name, v)
            yield o

    return both.mapInArrow(cut, out.schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    out = drop_lines(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col)

    def run(it):
        for b in it:
            sha = pa.array([hashlib.sha256(t).hexdigest() for t in as_bytes(b.column(text_col))], pa.string())
            yield pa.record_batch({"doc_id": b.column(id_col), "n_lines": b.column("_n_lines"), "n_dropped": b.column("_n_dropped"), "kept_sha256": sha})

    return out.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
