"""Vector search: exact and filtered k-NN, an inverted-file index with exact reranking, recall."""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def l2(v: Column, q: list[float]) -> Column:
    """Squared Euclidean distance in double precision."""
    want = F.array(*[F.lit(float(x)) for x in q])
    return F.aggregate(F.zip_with(v, want, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)


def knn(df: DataFrame, q: list[float], k: int = 10, vec: str = "embedding", id_col: str = "vec_id", where: Column | None = None) -> DataFrame:
    """The k nearest rows by squared distance: id, distance, score = 1 / (1 + distance). A filter applies before the search."""
    d = df if where is None else df.where(where)
    d = d.where(F.size(vec) == len(q)).withColumn("distance", l2(F.col(vec), q))
    return d.orderBy("distance", id_col).limit(k).select(id_col, "distance", (1 / (1 + F.col("distance"))).alias("score"))


def train_centroids(df: DataFrame, n: int, vec: str = "embedding", sample: int = 20_000, rounds: int = 8) -> np.ndarray:
    """k-means centres of a bounded sample (rows of smallest hash)."""
    rows = df.where(F.col(vec).isNotNull()).orderBy(F.xxhash64(vec)).limit(sample).select(vec).collect()
    x = np.array([r[0] for r in rows], np.float64)
    c = x[:: max(1, len(x) // n)][:n].copy()
    for _ in range(rounds):
        at = assign(x, c)
        for i in range(len(c)):
            if (at == i).any():
                c[i] = x[at == i].mean(0)
    return c


CELLS = 1 << 21  # distances that a task holds at once


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Each row's nearest centre; rows are taken a few at a time, however many centres there are."""
    norms, step = (c * c).sum(1), max(1, CELLS // max(1, len(c)))
    return np.concatenate([np.zeros(0, np.int64), *[(-2 * x[i : i + step] @ c.T + norms).argmin(1) for i in range(0, len(x), step)]])


def with_centroid(df: DataFrame, centres: np.ndarray, vec: str = "embedding") -> DataFrame:
    """df plus `centroid`, each row's nearest centre; written partitioned by it, probes read only their lists."""
    sent = df.sparkSession.sparkContext.broadcast(centres)

    def run(it):
        import pyarrow as pa

        for b in it:
            v = b.column(b.schema.get_field_index(vec))
            x = np.array([r if r is not None else [np.nan] * sent.value.shape[1] for r in v.to_pylist()], np.float64).reshape(b.num_rows, -1)
            yield pa.record_batch([*b.columns, pa.array(assign(x, sent.value).astype(np.int32))], names=[*b.schema.names, "centroid"])

    return df.mapInArrow(run, df.withColumn("centroid", F.lit(0)).schema)


def ivf_search(indexed: DataFrame, centres: np.ndarray, q: list[float], k: int = 10, nprobe: int = 4, vec: str = "embedding", id_col: str = "vec_id", where: Column | None = None) -> DataFrame:
    """k-NN over the nprobe nearest lists, exactly reranked."""
    near = ((centres - np.array(q)) ** 2).sum(1).argsort()[:nprobe].tolist()
    return knn(indexed.where(F.col("centroid").isin(*near)), q, k, vec, id_col, where)


def pq_train(x: np.ndarray, m: int, nbits: int = 8, rounds: int = 8) -> np.ndarray:
    """Codebooks (m, 2**nbits, dims / m) of a product quantiser."""
    parts = x.reshape(len(x), m, -1)
    out = []
    for j in range(m):
        c = _kmeans(parts[:, j], min(1 << nbits, len(x)), rounds)
        out.append(np.concatenate((c, np.repeat(c[-1:], (1 << nbits) - len(c), 0))))
    return np.stack(out)


def pq_encode(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    parts = x.reshape(len(x), len(books), -1)
    return np.stack([assign(parts[:, j], books[j]) for j in range(len(books))], 1).astype(np.uint8)


def pq_distances(codes: np.ndarray, books: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Approximate squared distances by table lookups."""
    table = ((books - q.reshape(len(books), 1, -1)) ** 2).sum(2)
    return table[np.arange(len(books)), codes].sum(1)


def recall(found: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The share of exact neighbours that were found."""
    return exact.join(found.select(id_col, F.lit(1).alias("_f")), id_col, "left").agg((F.count("_f") / F.count("*")).alias("recall"))


def float16(v: Column) -> Column:
    """Components rounded to half precision."""
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, np.float16).astype(np.float32))

    return run(v)


def global_top(parts: list[DataFrame], k: int, id_col: str = "vec_id") -> DataFrame:
    """The k nearest of several indexes' results, best first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy(id_col).orderBy("distance")
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").orderBy("distance", id_col).limit(k)


# -- inverted file with product quantisation -------------------------------------------------------------------

LIST_ROWS = 100_000  # vectors of a list that one task scans; a longer list is dealt to several
REFINE = 8  # candidates a wanted neighbour and tile that are ranked again by exact distances
TILE_ROWS, TILE_ASKS = 16_384, 2048  # vectors and queries that meet in one task


@dataclass
class IvfPq:
    """Centres of the lists, codebooks of what a vector leaves over its centre, and the indexed table."""

    centres: np.ndarray
    books: np.ndarray
    table: DataFrame  # id, vec, centroid, part, code
    parts: int  # that a list is dealt to
    slots: int = 1  # that the parts of all lists are dealt to


def build_ivfpq(df: DataFrame, vec: str = "embedding", id_col: str = "vec_id", m: int = 8, nbits: int = 8, lists: int | None = None, sample: int = 20_000) -> IvfPq:
    """Fitted on at most `sample` vectors, those of smallest hash; every vector is indexed.

    lists: by default 4 times the root of their number, as far as the sample fills them. Vectors that are null
    or of another length than most of the sample are not indexed.
    """
    n = df.where(F.col(vec).isNotNull()).count()
    rows = [r[0] for r in df.where(F.col(vec).isNotNull()).orderBy(F.xxhash64(vec)).limit(sample).select(vec).collect()]  # bounded by sample
    dims = max({len(r) for r in rows}, key=[len(r) for r in rows].count) if rows else m
    x = np.array([r for r in rows if len(r) == dims], np.float64).reshape(-1, dims)
    k = max(1, min(lists or isqrt(16 * n), len(x)))
    centres = _kmeans(x, k) if len(x) else np.zeros((1, dims))
    left = x - centres[assign(x, centres)] if len(x) else np.zeros((1, dims))
    books = pq_train(left, m, nbits)
    sent = df.sparkSession.sparkContext.broadcast((centres, books))

    def run(it):
        c, b = sent.value
        for batch in it:
            v = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, c.shape[1]))
            at = assign(v, c) if len(v) else np.zeros(0, np.int64)
            codes = pq_encode(v - c[at], b) if len(v) else np.zeros((0, len(b)), np.uint8)
            yield pa.record_batch([*batch.columns, pa.array(at.astype(np.int32)), pa.array([r.tobytes() for r in codes], pa.binary())], names=[*batch.schema.names, "centroid", "code"])

    good = df.where(F.size(vec) == dims).select(F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    table = good.mapInArrow(run, good.withColumns({"centroid": F.lit(0), "code": F.lit(b"")}).schema)
    parts = max(1, -(-n // LIST_ROWS))  # so many that a list holding every vector is dealt out as well
    return IvfPq(centres, books, table.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")), parts, max(1, -(-n // TILE_ROWS)))


def _kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = assign(x, c)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _matrix(v: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows, in double precision; null components are NaN."""
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in v.chunks]) if v.num_chunks else np.zeros(0)
    return flat.astype(np.float64).reshape(len(v), -1)


def _nearest(x: np.ndarray, rank: np.ndarray, y: np.ndarray, at_q: np.ndarray, at_x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of a query (row of y) and a vector (row of x), each query's k nearest, ties by rank: both rows, distance."""
    step = max(1, CELLS // max(1, x.shape[1]))
    d = np.concatenate([np.zeros(0), *[((x[at_x[i : i + step]] - y[at_q[i : i + step]]) ** 2).sum(1) for i in range(0, len(at_q), step)]])
    order = np.lexsort((rank[at_x], d, at_q))
    at_q = at_q[order]
    keep = np.arange(len(at_q)) - np.searchsorted(at_q, at_q) < k
    return at_q[keep], at_x[order][keep], d[order][keep]


def _tiles(rows: DataFrame, asks: DataFrame, slots: int, work, kind: str) -> DataFrame:
    """work on every tile, a slot `_s` of rows and a block of about TILE_ASKS of the asks (query, q).

    Tiles are of bounded size and dealt out by their number, not by their bytes, since their work is in products."""
    blocks = max(1, -(-asks.count() // TILE_ASKS))
    rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asks = asks.withColumn("_b", F.pmod(F.xxhash64("query", "q"), F.lit(blocks)).cast("int")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    dealt = [d.repartition(2 * slots * blocks, "_b", "_s").groupBy("_b", "_s") for d in (rows, asks)]
    return dealt[0].cogroup(dealt[1]).applyInArrow(work, kind)


def _floats(df: DataFrame, vec: str) -> Column:
    """A column of vectors as Arrow hands on without loss: float as it is, else double."""
    return F.col(vec) if df.schema[vec].dataType.simpleString() == "array<float>" else F.col(vec).cast("array<double>")


def _hits(rows: pa.Table, asks: pa.Table, found: list) -> pa.Table:
    at_q, at_x, d = map(np.concatenate, zip(*found, strict=True)) if found else np.zeros((3, 0), np.int64)
    return pa.table({"query": asks["query"].take(pa.array(at_q)), "id": rows["id"].take(pa.array(at_x)), "distance": pa.array(d.astype(np.float64))})


def _ranks(ids: pa.ChunkedArray) -> np.ndarray:
    return pc.rank(ids, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def ivfpq_search(index: IvfPq, queries: DataFrame, k: int = 10, nprobe: float = 16, vec: str = "embedding", id_col: str = "vec_id", where: Column | None = None) -> DataFrame:
    """(query, id, distance, score): the k nearest of every query among its nprobe lists, ranked again exactly.

    nprobe: a number of lists, or below 1 a share of them, which an index that grows keeps its recall by. where filters
    the indexed rows before the search. Queries and lists meet in tiles, so that neither side is sent to every task; of
    a tile, each query keeps its REFINE * k nearest by codes, and of these its k nearest.
    """
    sent = index.table.sparkSession.sparkContext.broadcast((index.centres, index.books))
    n, most = len(index.centres), REFINE * k
    probes = min(n, max(1, round(nprobe * n) if nprobe < 1 else int(nprobe)))

    def scan(rows: pa.Table, asks: pa.Table) -> pa.Table:
        if not rows.num_rows or not asks.num_rows:
            return _hits(rows, asks, [])
        c, books = sent.value
        rows = rows.sort_by("centroid")
        x, y, rank = _matrix(rows["vec"]), _matrix(asks["q"]), _ranks(rows["id"])
        at = rows["centroid"].to_numpy()
        codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(x), -1)
        left = np.concatenate([books[j][codes[:, j]] for j in range(len(books))], 1).astype(np.float32)
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        norms, size, found = (c * c).sum(1), (left * left).sum(1), []
        step = max(1, CELLS // max(len(x), n))
        for i in range(0, len(y), step):
            q = y[i : i + step]
            asked = np.zeros((len(q), n), bool)
            np.put_along_axis(asked, np.argpartition(-2 * q @ c.T + norms, probes - 1, 1)[:, :probes], True, 1)
            d = np.full((len(q), len(x)), np.inf, np.float32)
            for lo, hi in zip(starts, [*starts[1:], len(x)], strict=True):
                who = np.flatnonzero(asked[:, at[lo]])
                v = (q[who] - c[at[lo]]).astype(np.float32)
                d[who, lo:hi] = (v * v).sum(1)[:, None] - 2 * v @ left[lo:hi].T + size[lo:hi]
            best = np.argpartition(d, most - 1, 1)[:, :most] if len(x) > most else np.tile(np.arange(len(x)), (len(q), 1))
            at_q, at_b = np.nonzero(np.take_along_axis(d, best, 1) != np.inf)
            a, b, far = _nearest(x, rank, q, at_q, best[at_q, at_b], k)
            found.append((a + i, b, far))
        return _hits(rows, asks, found)

    dims = index.centres.shape[1]
    asks = queries.where(F.size(vec) == dims).select(F.col(id_col).alias("query"), _floats(queries, vec).alias("q"))
    table = index.table if where is None else index.table.where(where)
    rows = table.select("id", _floats(table, "vec").alias("vec"), "centroid", "code", F.pmod(F.xxhash64("centroid", "part"), F.lit(index.slots)).cast("int").alias("_s"))
    found = _tiles(rows, asks, index.slots, scan, f"query {queries.schema[id_col].dataType.simpleString()}, id {table.schema['id'].dataType.simpleString()}, distance double")
    w = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r").withColumn("score", 1 / (1 + F.col("distance")))


def _candidates(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of y, row of x) among which are the k nearest of every y, by products and a bound of their error.

    Rows whose squares are not finite are paired with all."""
    norm_x, norm_y = (x * x).sum(1), (y * y).sum(1)
    odd_x, odd_y = ~np.isfinite(norm_x), ~np.isfinite(norm_y)
    d = y @ x.T
    d *= -2
    d += norm_x
    d += norm_y[:, None]
    d[:, odd_x] = np.inf
    d[odd_y] = np.inf
    kth = np.partition(d, k - 1, 1)[:, k - 1] if len(x) > k else np.full(len(y), np.inf)
    slack = 4 * (x.shape[1] + 8) * np.finfo(np.float64).eps * (norm_y + norm_x[~odd_x].max(initial=0)) + 1e-300
    near = ~(d > (kth + slack)[:, None])
    near[:, odd_x] = True
    near[odd_y] = True
    return np.nonzero(near)


def knn_each(df: DataFrame, queries: DataFrame, k: int = 10, vec: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(query, id, distance): the exact k nearest of every query. Vectors and queries meet in tiles of bounded size, by
    matrix products; what these leave is compared again by differences. A tile passes on only each query's k nearest."""
    q = queries.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("query"), _floats(queries, vec).alias("q"))
    rows = df.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), _floats(df, vec).alias("v"))
    slots = max(1, -(-rows.count() // TILE_ROWS))

    def work(r: pa.Table, a: pa.Table) -> pa.Table:
        found = []
        size, wide = (pc.list_value_length(t).to_numpy() for t in (r["v"], a["q"]))
        rank = _ranks(r["id"]) if r.num_rows else size
        for dim in set(size.tolist()) & set(wide.tolist()):
            at, mine = np.flatnonzero(size == dim), np.flatnonzero(wide == dim)
            x, y = _matrix(r["v"].take(pa.array(at))), _matrix(a["q"].take(pa.array(mine)))
            step = max(1, CELLS // len(x))
            for i in range(0, len(y), step):
                at_q, at_x, d = _nearest(x, rank[at], y[i : i + step], *_candidates(x, y[i : i + step], k), k)
                found.append((mine[at_q + i], at[at_x], d))
        return _hits(r, a, found)

    kind = f"query {queries.schema[id_col].dataType.simpleString()}, id {df.schema[id_col].dataType.simpleString()}, distance double"
    found = _tiles(rows.withColumn("_s", F.pmod(F.xxhash64("id", "v"), F.lit(slots)).cast("int")), q, slots, work, kind)
    w = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def mean_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """The mean over queries of the share of their exact neighbours that were found: queries, recall."""
    hit = exact.select("query", "id").join(found.select("query", "id", F.lit(1).alias("_f")), ["query", "id"], "left")
    return hit.groupBy("query").agg((F.count("_f") / F.count("*")).alias("r")).agg(F.count("*").alias("queries"), F.avg("r").alias("recall"))


def search_request(df: DataFrame, body: dict, predicate: Column | None = None, id_col: str = "_id") -> DataFrame:
    """A k-NN request {query_field, vector, k, return_fields or _source}: id, the named columns, _score, best first.

    predicate is a compiled filter query; the hits' columns are only read for the k rows found.
    """
    k, f = int(body.get("k") or 10), body["query_field"]
    top = knn(df.select("*"), [float(x) for x in body["vector"]], k, f, id_col, predicate).select(id_col, F.col("score").alias("_score"))
    names = body.get("return_fields") or body.get("_source") or []
    out = df.select(id_col, *[c for c in names if c != id_col])
    return out.join(F.broadcast(top), id_col).orderBy(F.desc("_score"), id_col)


def half_bytes(v: Column) -> Column:
    """Components as two bytes each, in half precision."""
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, "<f2").tobytes())

    return run(v)


def from_half_bytes(v: Column) -> Column:
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.frombuffer(x, "<f2").astype(np.float32))

    return run(v)


# -- a sealed index and the log of changes after it --------------------------------------------------------------

SEAL = 10_000  # ids in a log from which it is worth a new index


def last_changes(log: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The last change of every id of a log (seq, op, id, vector): one aggregation, no sort."""
    data = [c for c in log.columns if c != id_col]
    g = log.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max_by(F.struct(*data), "seq").alias("_l"))
    return g.select(id_col, *[F.col(f"_l.{c}").alias(c) for c in data])


def current(base: DataFrame, log: DataFrame, vec: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """The vectors (id, vector) after a log: base's rows that it does not name, and those it adds or replaces."""
    last = last_changes(log, id_col)
    kept = base.select(id_col, vec).join(last.select(id_col), id_col, "left_anti")
    return kept.unionByName(last.where("op != 'delete'").select(id_col, vec))


def logged_search(index: IvfPq, log: DataFrame, queries: DataFrame, k: int = 10, nprobe: int = 16, vec: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(query, id, distance): each query's k nearest of an index and the log after it.

    What the log names leaves the index before the search, so that stale vectors take no neighbour's place; its own
    vectors are compared exactly.
    """
    last = last_changes(log, id_col)
    sealed = replace(index, table=index.table.join(last.select(F.col(id_col).alias("id")), "id", "left_anti").select(index.table.columns))
    old = ivfpq_search(sealed, queries, k, nprobe, vec, id_col).select("query", "id", "distance")
    found = old.unionByName(knn_each(last.where("op != 'delete'").select(id_col, vec), queries, k, vec, id_col))
    w = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def needs_seal(log: DataFrame, id_col: str = "vec_id", most: int = SEAL) -> bool:
    """Whether a log names at least `most` ids."""
    return log.select(id_col).distinct().limit(most).count() >= most


def seal(base: DataFrame, log: DataFrame, vec: str = "embedding", id_col: str = "vec_id", **how) -> IvfPq:
    """A new index over base after the log."""
    return build_ivfpq(current(base, log, vec, id_col), vec, id_col, **how)
