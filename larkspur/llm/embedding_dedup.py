"""Near-duplicate vectors: int8 tile products with rigorous error bounds, full precision where they leave doubt."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import components, discard, durable, local_roots

BLOCK = 4096  # vectors of a block; a task holds the codes of two blocks
STRIP = 512  # rows of a block multiplied at a time


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8 codes, scale, norm of what the codes say, norm of the error.

    With a = s*q + e: |a.b - s_a s_b q_a.q_b| <= |s_a q_a| |e_b| + |e_a| |s_b q_b| + |e_a| |e_b|.
    """
    s = np.abs(x).max(1) / 127
    q = np.rint(x / s[:, None]).astype(np.int8)
    back = q * s[:, None]
    return q, s, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; first scaled so that no norm overflows."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def code_links(a: tuple, b: tuple | None, threshold: float):
    """Yield (rows, columns, doubt) of the pairs whose cosine may reach the threshold; b None: pairs i < j within a.

    a, b: what quantise gives. Pairs whose bound excludes the threshold are dropped; where doubt is false the
    bound guarantees it. Products are of int8 codes, multiplied as float32, in which their sums are exact up to
    2**24 (longer vectors are multiplied in pieces), so a pair is judged alike whatever else is in its tile.
    """
    same = b is None
    qa, sa, ma, ea = a
    qb, sb, mb, eb = a if same else b
    piece = (1 << 24) // (127 * 127)
    right = qb.astype(np.float32)
    for i in range(0, len(qa), STRIP):
        z = slice(i, i + STRIP)
        first, left = i if same else 0, qa[z].astype(np.float32)
        dot = sum((left[:, k : k + piece] @ right[first:, k : k + piece].T).astype(np.float64) for k in range(0, qa.shape[1], piece)) if qa.shape[1] > piece else left @ right[first:].T
        # a cheap necessary condition in float32, then the exact bounds on the few that meet it
        slack = (ma[z].max() * eb.max() + ea[z].max() * mb.max() + ea[z].max() * eb.max()) + 1e-5
        r, c = np.nonzero(dot * (sa[z].astype(np.float32))[:, None] >= ((threshold - slack) / sb[first:]).astype(np.float32)[None, :] * np.float32(1 - 1e-6))
        approx = dot[r, c].astype(np.float64)
        r, c = r + i, c + first
        if same:
            k = r < c
            r, c, approx = r[k], c[k], approx[k]
        approx *= sa[r] * sb[c]
        bound = ma[r] * eb[c] + ea[r] * mb[c] + ea[r] * eb[c] + 1e-12
        k = approx + bound >= threshold
        yield r[k], c[k], approx[k] - bound[k] < threshold


def cosines(x: np.ndarray, r: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (x[r], y[c]) of scaled vectors in double precision."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    parts = [np.einsum("ij,ij->i", x[r[k : k + 65536]], y[c[k : k + 65536]]) for k in range(0, len(r), 65536)]
    return np.concatenate([np.zeros(0), *parts]) / (nx[r] * ny[c])


_CODES = "cid long, copies long, dim int, q binary, s double, m double, e double"


def _encode(it):
    """Codes and error norms of class vectors (cid, copies, v)."""
    for b in it:
        v = b.column(2)
        sizes = v.value_lengths().to_numpy()
        out: dict[int, tuple] = {}
        for dim in np.unique(sizes):
            k = np.flatnonzero(sizes == dim)
            q, s, m, e = quantise(units(v.take(pa.array(k)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)))
            out |= {i: (q[j].tobytes(), s[j], m[j], e[j]) for j, i in enumerate(k.tolist())}
        cols = list(zip(*(out[i] for i in range(b.num_rows)), strict=True)) if b.num_rows else [[]] * 4
        yield pa.record_batch([b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(cols[0], pa.binary()), *(pa.array(c, pa.float64()) for c in cols[1:])], names=[x.split()[0] for x in _CODES.split(", ")])


_NONE = {"cid": pa.int64(), "linked": pa.int64(), "root": pa.int64(), "doubt": pa.bool_()}


def _sides(t: pa.Table):
    """The rows of a tile's two blocks (the second None within one block), or None where a side is empty."""
    own, i, j = t["own"].to_numpy(), t["i"][0].as_py(), t["j"][0].as_py()
    first, second = np.flatnonzero(own == i), np.flatnonzero(own == j)
    return None if not len(first) or not len(second) else (first, None if i == j else second)


def _codes(t: pa.Table) -> tuple:
    q = np.frombuffer(b"".join(t["q"].to_pylist()), np.int8).reshape(t.num_rows, -1)
    return (q, *(t[c].to_numpy() for c in ("s", "m", "e")))


def _tile(t: pa.Table, threshold: float, exact: bool) -> pa.Table:
    """Link counts and a spanning forest of a tile. Without exact: of the sure pairs, marking the rows that doubtful
    pairs leave open; with it: of the doubtful pairs, from their vectors."""
    none = pa.table({k: pa.array([], v) for k, v in _NONE.items()})
    sides = _sides(t) if t.num_rows else None
    if sides is None:
        return none
    first, second = sides
    every = _codes(t)
    a = tuple(x[first] for x in every)
    b = None if second is None else tuple(x[second] for x in every)
    second = first if second is None else second
    cid, copies = t["cid"].to_numpy(), t["copies"].to_numpy()
    if exact:
        x = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        x = x / np.abs(x).max(1)[:, None]
    linked, doubtful, forest = np.zeros(len(cid), np.int64), np.zeros(len(cid), bool), [np.zeros((0, 2), np.int64)]
    for r, c, doubt in code_links(a, b, threshold):
        r, c = first[r], second[c]
        if exact:
            r, c = r[doubt], c[doubt]
            ok = cosines(x, r, x, c) >= threshold
            r, c = r[ok], c[ok]
        else:
            doubtful[r[doubt]] = doubtful[c[doubt]] = True
            r, c = r[~doubt], c[~doubt]
        if len(r):
            np.add.at(linked, r, copies[c])
            np.add.at(linked, c, copies[r])
            root = local_roots(len(cid), r, c)
            k = np.flatnonzero(root != np.arange(len(cid)))
            forest.append(np.stack((k, root[k]), 1))
    e = np.concatenate(forest)
    root = local_roots(len(cid), e[:, 0], e[:, 1])
    k = np.flatnonzero((linked > 0) | doubtful)
    return pa.table({"cid": cid[k], "linked": linked[k], "root": cid[root[k]], "doubt": doubtful[k]})


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Null, zero, empty vectors and those with null or non-finite components link with nothing (n_links 0,
    component their own id, kept). Vectors of other lengths never link. Equal vectors are one class with a
    multiplicity, so copies cost nothing; a class counts its copies as links. Rows that repeat an id are judged
    each by its own vector, and count as a link of each other's if their vectors are near. Vectors of any length
    are compared whole; a cosine equal to the threshold links. A null id gives n_links 0, a null component and
    kept true. An empty table gives no rows; extra columns are ignored, whatever their names.

    1. Distinct vectors are encoded as int8 once and dealt to blocks of BLOCK. A task multiplies the codes of
       two blocks; pairs that the error bounds leave in doubt only mark their rows.
    2. The vectors of marked rows, and no others, go to their tiles again in double precision.
    No pair leaves a task: only link counts and the local spanning forest do.
    """
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    usable = F.expr("coalesce(size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0), false)")
    # -0.0 and 0.0 are the same component; the class key is the exact vector
    rows = rows.withColumn("key", F.when(usable & F.col("vec_id").isNotNull(), F.expr("sha2(to_json(transform(v, x -> x + 0.0D)), 256)")))
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = durable(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")  # written once, so that a class's number stays
    codes = durable(classes.select("cid", "copies", "v").mapInArrow(_encode, _CODES), "codes")
    sizes = codes.groupBy("dim").agg(F.count("*").alias("n"))  # a row a vector length
    blocks = codes.join(sizes, "dim").withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    tiles = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "cid", "copies", "q", "s", "m", "e", "dim", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def work(exact: bool):
        return lambda key, t: _marked(key, _tile(t, threshold, exact))

    schema = "cid long, linked long, root long, doubt boolean, i int, j int"
    sure = durable(tiles.groupBy("dim", "i", "j").applyInArrow(work(False), schema), "links")
    open_ = sure.where("doubt").select("cid", "i", "j").join(blocks.drop("n", "nb"), "cid").join(classes.select("cid", "v"), "cid")
    found = durable(open_.groupBy("dim", "i", "j").applyInArrow(work(True), schema).where("linked > 0").union(sure.where("linked > 0")).select("cid", "linked", "root"), "found")
    discard(sure)
    comp = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("cid").agg(F.sum("linked").alias("linked"))
    judged = classes.drop("v").join(counts, "cid", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    low = judged.groupBy("component").agg(F.min("rep").alias("c"))
    judged = judged.join(low, "component").select("key", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "c")
    return rows.select("vec_id", "key").join(judged, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("c", "vec_id"), F.lit(True)).alias("kept"))


def _marked(key: tuple, t: pa.Table) -> pa.Table:
    """A tile's result with the tile's place."""
    for name, k in (("i", key[1]), ("j", key[2])):
        t = t.append_column(name, pa.array(np.full(t.num_rows, k.as_py(), np.int32)))
    return t
