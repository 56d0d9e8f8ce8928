"""Near-duplicate texts: banded MinHash candidates, sequential Bayesian pruning, exact set verification."""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import as_bytes, batches, components, discard, durable, local_roots, mix, word_hashes

BANDS, ROWS = 16, 4
K = BANDS * ROWS
STEP = 16  # signature rows compared before each pruning decision
TILE_DOCS, TILE_SHINGLES = 512, 1 << 18
BROADCAST_IDS = 2_000_000  # ids sent to all tasks at most; beyond, the texts are joined by shuffle
_MULT = np.random.default_rng(7).integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's sorted distinct 64-bit shingle hashes; fewer words than width: the sequence as one shingle."""
    out: list[np.ndarray] = []
    for i, j in batches(texts):
        h, n = word_hashes(texts[i:j])
        acc = np.full(max(0, len(h) - width + 1), width, np.uint64)
        for k in range(width):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(acc)])
        at = 0
        for m in n.tolist():
            if m >= width:
                out.append(np.unique(acc[at : at + m - width + 1]))
            elif m:
                one = np.full(1, m, np.uint64)
                for k in range(m):
                    one = mix(one * np.uint64(0x9E3779B97F4A7C15) + h[at + k : at + k + 1])
                out.append(one)
            else:
                out.append(np.zeros(0, np.uint64))
            at += m
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """K MinHash values of 32 bits."""
    low = np.full(K, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 4096):
        np.minimum(low, (s[i : i + 4096, None] * _MULT).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def least_matches(percent: int, miss: float) -> dict[int, int]:
    """For each number n of compared rows, the fewest matches that keep a pair.

    With a uniform prior, m matches of n leave P(similarity >= t) = P(Binomial(n + 1, t) <= m); a pair goes
    when that falls below the chosen miss probability.
    """
    t, out = percent / 100, {}
    for n in range(STEP, K + 1, STEP):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def may_be_near(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Row pairs of signatures that survive the sequential test."""
    live = np.arange(len(a))
    same = np.zeros(len(a), np.int64)
    for n, m in least.items():
        same[live] += (a[live, n - STEP : n] == b[live, n - STEP : n]).sum(1)
        live = live[same[live] >= m]
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def _summaries(docs: DataFrame, width: int) -> DataFrame:
    schema = "doc_id long, text_hash long, n int, digest binary, sig binary"

    def run(it):
        for b in it:
            sets = shingle_sets(as_bytes(b.column(1)), width)
            yield pa.record_batch({
                "doc_id": b.column(0),
                "text_hash": b.column(2),
                "n": pa.array([len(s) for s in sets], pa.int32()),
                "digest": pa.array([_digest(s) for s in sets], pa.binary()),
                "sig": pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            })

    return docs.mapInArrow(run, schema)


def _sets_of(docs: DataFrame, ids: DataFrame, width: int, repeats: bool) -> DataFrame:
    """(id, s): the shingle sets of the classes listed in ids (id, rep, digest), as bytes of sorted 64-bit values."""
    n = ids.count()
    wanted = ids.select("rep").distinct()
    wanted = docs.where("doc_id is not null").join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, F.col("doc_id") == F.col("rep"), "left_semi")

    def run(it):
        for b in it:
            sets = shingle_sets(as_bytes(b.column(1)), width)
            yield pa.record_batch({"id": b.column(0), "digest": pa.array([_digest(s) for s in sets], pa.binary()), "s": pa.array([s.tobytes() for s in sets], pa.binary())})

    out = wanted.mapInArrow(run, "id long, digest binary, s binary")
    return out.drop("id").join(ids.select("id", "digest"), "digest").select("id", "s").dropDuplicates(["id"]) if repeats else out.select("id", "s")


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _pairs_near(it, percent: int):
    for b in it:
        ok = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(x) + len(y)
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                ok.append(False)
            else:
                common = both - len(np.unique(np.concatenate((x, y))))
                ok.append(100 * common >= percent * (both - common))
        yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _tile(t: pa.Table, percent: int, least: dict[int, int]) -> pa.Table:
    """Spanning links between the two sides of a tile, for pairs that the stars have not joined already."""
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    ids, n, label, side, block = (t[c].to_numpy() for c in ("id", "n", "label", "side", "block"))
    i, j = t["bi"][0].as_py(), t["bj"][0].as_py()
    rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
    if not len(rows) or not len(cols):
        return none
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(-1, K)
    raw = t["s"].to_pylist()
    found_a, found_b = [], []
    for r in rows:
        c = cols[(label[cols] != label[r]) & (ids[cols] != ids[r])]
        if i == j:
            c = c[c > r]
        c = c[(100 * n[c] >= percent * n[r]) & (100 * n[r] >= percent * n[c])]
        if not len(c):
            continue
        c = c[may_be_near(np.broadcast_to(sig[r], (len(c), K)), sig[c], least)]
        if not len(c):
            continue
        # exact: how many of r's shingles each survivor holds
        own = np.frombuffer(raw[r], np.uint64)
        flat = np.frombuffer(b"".join(raw[k] for k in c), np.uint64)
        at = np.searchsorted(own, flat)
        at[at == len(own)] = 0
        hit = np.concatenate(([0], np.cumsum(own[at] == flat)))
        ends = np.cumsum(n[c])
        common = hit[ends] - hit[ends - n[c]]
        c = c[100 * common >= percent * (n[r] + n[c] - common)]
        found_a.append(np.full(len(c), r))
        found_b.append(c)
    if not found_a:
        return none
    root = local_roots(len(ids), np.concatenate(found_a), np.concatenate(found_b))
    k = np.flatnonzero(root != np.arange(len(ids)))
    return pa.table({"a": ids[k], "b": ids[root[k]]})


def near_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, miss: float = 1e-7, hashes: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; with hashes also text_hash, the text's xxhash64.

    Words are runs of characters other than the six ASCII spaces, A-Z lower-cased; a set holds the distinct
    shingles of `width` words (fewer words: the sequence as one; none, or null text: empty, linked with
    nothing). Documents link when 100*intersection >= percent*union on the full sets (64-bit shingle
    hashes). component_id is the smallest doc_id reachable. Null ids link with nothing and are kept; rows
    that repeat an id each give a row. An empty table gives no rows; other columns are ignored.

    1. Equal sets form a class, by digest; only class representatives go on.
    2. Band buckets elect their smallest id as hub; (hub, member) pairs are the only pairs made. A pair
       goes when its posterior from batches of signature rows falls below `miss`; the others are verified.
    3. Members that some hub does not explain meet the rest of that hub's members in bounded tiles, where
       the same sequential test and the exact test run in memory; only spanning links leave a tile.
    """
    least = least_matches(percent, miss)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = durable(_summaries(docs.withColumn("text_hash", F.xxhash64("text")), width), "summaries")
    good = rows.where("digest is not null and doc_id is not null")
    repeats = _repeats(good)
    # a class goes by its smallest doc_id, or by its digest where two texts share an id
    node = F.xxhash64("digest") if repeats else F.col("rep")
    classes = good.groupBy("digest").agg(F.min("doc_id").alias("rep")).withColumn("id", node)
    reps = durable(
        good.join(classes, "digest").where("doc_id = rep").select("id", "rep", "n", "sig", "digest")
        .dropDuplicates(["digest"]) if repeats else good.join(classes, ["digest"]).where("doc_id = rep").select("id", "rep", "n", "sig", "digest"), "reps")

    def keys(it):
        for b in it:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sig.shape[:2])
            for k in range(ROWS):
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
            yield pa.record_batch({"id": np.repeat(b.column(0).to_numpy(), BANDS), "key": acc.ravel().view(np.int64)})

    bands = reps.select("id", "sig").mapInArrow(keys, "id long, key long")
    hubs = bands.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c")
    stars = durable(bands.join(hubs, "key").where("id <> hub").select("hub", "id").distinct(), "stars")

    # sequential test on the stars
    sigs = reps.select("id", "n", "sig")
    both = stars.join(sigs, "id").join(sigs.select(F.col("id").alias("hub"), F.col("n").alias("hn"), F.col("sig").alias("hsig")), "hub")
    both = both.where(f"100 * n >= {percent} * hn and 100 * hn >= {percent} * n").select("hub", "id", "hsig", "sig")

    def test(it):
        for b in it:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, K) for c in (2, 3))
            yield b.select([0, 1]).filter(pa.array(may_be_near(x, y, least), pa.bool_()))

    pairs = durable(both.mapInArrow(test, "hub long, id long"), "pairs")
    # neighbourhoods with two members or more besides the hub may hold links that the hub does not show
    wide = stars.groupBy("hub").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    ids = durable(pairs.select("id").union(pairs.select(F.col("hub").alias("id"))).union(stars.join(wide, "hub", "left_semi").select("id")).distinct(), "ids")
    sets = durable(_sets_of(docs, ids.join(reps.select("id", "rep", "digest"), "id"), width, repeats), "sets")
    verify = pairs.join(sets, "id").join(sets.select(F.col("id").alias("hub"), F.col("s").alias("hs")), "hub").select("hub", "id", "hs", "s")
    links = durable(verify.mapInArrow(lambda it: _pairs_near(it, percent), "hub long, id long"), "links")

    # a label that two members share proves that a hub joins them
    joined = links.groupBy("id").agg(F.min("hub").alias("label"))
    label = lambda name: joined.select(F.col("id").alias(name), F.col("label").alias(f"{name}_label"))
    near = stars.join(wide, "hub", "left_semi").join(label("id"), "id", "left").join(label("hub"), "hub", "left").select(
        "hub", "id", F.coalesce("id_label", "id").alias("label"), F.coalesce("hub_label", "hub").alias("hub_label"))
    # members linked to this very hub carry its label, so that they count as settled
    near = near.join(links.withColumn("linked", F.lit(True)), ["hub", "id"], "left").withColumn("side", F.when(F.col("linked") | (F.col("label") == F.col("hub_label")), 0).otherwise(1))
    near = near_table = durable(near.withColumn("label", F.when(F.col("side") == 0, F.col("hub_label")).otherwise(F.col("label"))).select("hub", "id", "label", "side").join(reps.select("id", "n"), "id"), "near")
    sizes = near.groupBy("hub").agg(*(F.greatest(F.ceil(F.count(F.when(F.col("side") == s, 1)) / TILE_DOCS), F.ceil(F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)) / TILE_SHINGLES), F.lit(1)).cast("int").alias(f"b{s}") for s in (0, 1)), F.max("side").alias("open"), F.count("*").alias("c"))
    sizes = sizes.where("open = 1 and c > 1").drop("c", "open")
    near = near.join(sizes, "hub").withColumn("block", F.when(F.col("side") == 0, F.pmod(F.xxhash64("id"), F.col("b0")) + F.col("b1")).otherwise(F.pmod(F.xxhash64("id"), F.col("b1"))).cast("int"))
    # blocks below b1 are unsettled; a tile joins an unsettled block with any block
    unsettled = F.expr("transform(sequence(0, b1 + b0 - 1), x -> struct(least(x, block) as bi, greatest(x, block) as bj))")
    settled = F.expr("transform(sequence(0, b1 - 1), x -> struct(x as bi, block as bj))")
    tiles = near.withColumn("t", F.explode(F.when(F.col("side") == 1, unsettled).otherwise(settled))).select("hub", "id", "n", "label", "side", "block", "t.bi", "t.bj")
    tiles = tiles.join(reps.select("id", "sig"), "id").join(sets, "id")
    more = durable(tiles.groupBy("hub", "bi", "bj").applyInArrow(lambda t: _tile(t, percent, least), "a long, b long"), "more")

    comp = components(links.select(F.col("hub").alias("a"), F.col("id").alias("b")).union(more))
    for done in (reps, stars, pairs, ids, sets, links, near_table, more):
        discard(done)
    found = classes.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    if repeats:
        found = found.join(found.groupBy("component").agg(F.min("rep").alias("low")), "component").withColumn("component", F.col("low"))
    found = found.select("digest", F.col("component").alias("c"))
    return rows.select("doc_id", "text_hash", "n", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(found, "digest", "left").select(
        "doc_id", *(["text_hash"] if hashes else []), F.col("n").cast("long").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("c", "doc_id"), F.lit(True)).alias("kept"))


def _repeats(rows: DataFrame) -> bool:
    """Whether an id comes more than once."""
    return rows.select("doc_id").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def keep_one(df: DataFrame, width: int = 5, percent: int = 80, **how) -> DataFrame:
    """df (doc_id, text and any columns) with one document of each group of near copies: that of smallest doc_id.

    Rows are told apart by id and text: of rows that repeat both one stays, and of an id that comes with several
    texts only those go that are copies of a smaller id's. Null ids and texts without words stay.
    """
    found = durable(near_texts(df.select("doc_id", "text"), width=width, percent=percent, hashes=True, **how).select("doc_id", "text_hash", "kept"), "judged")
    twice = found.where("doc_id is not null").groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count() > 0
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct()
    out = df.join(gone, (F.col("doc_id") == F.col("_gone_id")) & (F.xxhash64("text") == F.col("_gone_hash")), "left_anti")
    if not twice:
        return out
    # only rows whose id repeats are shuffled
    again = found.where("doc_id is not null").groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash"))
    match = (F.col("doc_id") == F.col("_gone_id")) & (F.xxhash64("text") == F.col("_gone_hash"))
    return out.join(again, match, "left_anti").unionByName(out.join(again, match, "left_semi").dropDuplicates(["doc_id", "text"]))
