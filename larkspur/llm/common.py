"""Shared pieces: durable intermediate tables, connected components, text and hash kernels."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a regular expression for the JVM and as bytes for Python.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. In local mode alone, where all is one machine, a temporary one will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def durable(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspur/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._larkspur_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a durable table that nothing reads any more."""
    path = getattr(df, "_larkspur_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the smallest node reachable.

    Alternating large and small stars on DataFrames; every round is written to the shared folder, so
    neither lineage nor the driver grows with the graph. Self loops and nulls are ignored; no edges give
    no rows. Minima are partial aggregates and the joins are plain equi-joins, which AQE splits on skew.
    """
    e = durable(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        sign = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign[0] == 0 or sign == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        mark = sign
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = durable(large.where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        new = durable(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(e)
        discard(large)
        e = new


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over links a[i]-b[i], by vectorised label passing."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            break
        root = new
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


# -- word hashing over whole batches of texts ---------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.uint64(0x9E3779B97F4A7C15)
_BI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POW: dict[str, np.ndarray] = {}
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POW.get(str(base))
    if have is None or len(have) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        have = np.cumprod(np.full(m, base, np.uint64)) * _BI if base == _B else np.cumprod(np.full(m, base, np.uint64)) * _B
        _POW[str(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the A-Z-lowered words of all texts, and each text's word count.

    One polynomial prefix sum over the concatenated bytes gives every word's hash without a Python loop.
    """
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _IS_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    prefix = np.empty(len(buf) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(_BYTE[_LOW[buf]] * _powers(_B, len(buf)), out=prefix[1:])
    h = (prefix[end] - prefix[start]) * _powers(_BI, len(buf))[start]
    h = mix(h + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    at = np.searchsorted(start, ends)
    return h, np.diff(np.concatenate(([0], at)))


def batches(texts: list[bytes], most: int = 1 << 21):
    """Slices of texts of at most `most` bytes each (a longer text stands alone)."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= most):
            size += len(texts[j]) + 1
            j += 1
        yield i, j
        i = j


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
