"""Duplicate finding against SQL and brute force."""

import itertools
import os

import llm_cases as cases
import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import embedding_dedup, line_dedup, minhash_dedup, queries


def sql(path, text):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(path):
        con.execute(f"create view {t[:-8]} as select * from '{path}/{t}'")
    c = con.execute(text)
    return [x[0] for x in c.description], c.fetchall()


def compare(spark, path, name):
    df = queries.queries()[name](spark, path)
    cols, want = sql(path, queries.oracle_sql()[name])
    got = df.select(*cols).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    return df


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((60, 8))
    v[10] = v[3] * 2
    v[11] = v[3] + 0.05 * v[4]
    rows = [list(map(float, x)) for x in v] + [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0], [2.0, 4.0], list(map(float, v[3]))]
    e = pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([i % 3 for i in range(len(rows))], pa.int32())})
    html = [None, "", "<p>a</p>", "<p>a</p>", "é" * 5000, "", "x\r\n\r\nWARC/1.1\r\n\r\n", "<p>a</p>"]
    urls = ["http://Example.org/es/x", "https://a.example.org/en/12?q", "noscheme", None, "http://x.com/de/#f", "http://com/fr/", "http://fr.org?x=/y", "http://xcom/de/"]
    p = pa.table({"page_id": pa.array(range(1, 9), pa.int64()), "url": pa.array(urls), "html": pa.array(html)})
    return cases.write(tmp_path_factory.mktemp("llm"), documents=cases.documents(), embeddings=e, pages=p)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, tables, name):
    compare(spark, tables, name)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_empty_tables(spark, tables, tmp_path, name):
    import pyarrow.parquet as pq

    empty = cases.write(tmp_path / "e", **{t[:-8]: pq.read_table(f"{tables}/{t}").slice(0, 0) for t in os.listdir(tables)})
    assert queries.queries()[name](spark, empty).count() == 0


def test_tile_bounds_are_rigorous():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((300, 12))
    a[150:] = a[:150] + 0.3 * rng.standard_normal((150, 12))
    n = a / np.linalg.norm(a, axis=1)[:, None]
    codes = embedding_dedup.quantise(embedding_dedup.units(a))
    assert codes[0].dtype == np.int8
    part = lambda z: tuple(x[z] for x in codes)

    def links(x, y, t, lo):
        out = set()
        for r, c, doubt in embedding_dedup.code_links(x, y, t):
            cos = embedding_dedup.cosines(a, r, a, c + lo)
            assert (cos[~doubt] >= t).all()
            out |= {(i, j) for i, j, k in zip(r.tolist(), c.tolist(), cos >= t, strict=True) if k}
        return out

    for t in (0.8, 0.95):
        want = {(i, j) for i, j in itertools.combinations(range(300), 2) if n[i] @ n[j] >= t}
        assert links(codes, None, t, 0) == want
        assert links(part(slice(0, 100)), part(slice(100, 300)), t, 100) == {(i, j - 100) for i, j in want if i < 100 <= j}


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (3, [0.01, 1.0]), (None, [1.0, 0.0]), (4, [1.0] * 3000), (5, [1.0] * 2999 + [1.01])]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (5, 1, 4, False)]


def test_vectors_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    v = rng.standard_normal((20, 6))[rng.integers(20, size=120)] + 0.12 * rng.standard_normal((120, 6))
    n = v / np.linalg.norm(v, axis=1)[:, None]
    links = [(i, j) for i, j in itertools.combinations(range(120), 2) if n[i] @ n[j] >= 0.95]
    low = cases.roots(range(120), links)
    df = spark.createDataFrame([(i, [float(z) for z in x], "x") for i, x in enumerate(v)], "vec_id long, embedding array<double>, key string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect()}
    assert got == {i: (sum(i in x for x in links), low[i], low[i] == i) for i in range(120)}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_texts(spark, width, percent):
    rows = cases.documents().select(["doc_id", "text"]).to_pylist()
    sets = {}
    for r in rows:
        w = [x.translate(cases.UPPER) for x in cases.words(r["text"])]
        sets[r["doc_id"]] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    low = cases.roots(sets, links)
    df = spark.createDataFrame([(r["doc_id"], r["text"], 1, "b") for r in rows], "doc_id long, text string, n int, digest string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_texts(df, width=width, percent=percent).collect()}
    assert got == {i: (len(s), low[i], low[i] == i) for i, s in sets.items()} and any(a != b for a, b in low.items())


def test_near_texts_repeated_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(1, t), (1, t), (2, t + " x"), (None, t), (5, None), (5, "other words are here now")]
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in minhash_dedup.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (5, 5, True), (5, 5, True)]


def test_keep_one_row_of_each_group(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(1, t, "a"), (1, t, "a"), (2, t + " x", "b"), (2, "a clean text of its own that stays here", "c"), (None, t, "d"), (5, None, "e"), (5, None, "e"), (6, "", "f"), (7, t.upper(), "g")]
    got = minhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, digest string"))
    assert sorted((r.doc_id or 0, r.digest) for r in got.collect()) == [(0, "d"), (1, "a"), (2, "c"), (5, "e"), (6, "f")]


def test_sequential_test_keeps_near_pairs():
    least = minhash_dedup.least_matches(85, 1e-7)
    assert list(least) == [16, 32, 48, 64] and all(a < b for a, b in itertools.pairwise(least.values()))
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**31, (20000, 64)).astype(np.uint32)
    near = np.where(rng.random(a.shape) < 0.85, a, 0)
    assert minhash_dedup.may_be_near(a, near, least).all()
    assert not minhash_dedup.may_be_near(a, rng.integers(0, 2**31, a.shape).astype(np.uint32), least).any()


def test_perfect_hash():
    rng = np.random.default_rng(4)
    a, b = rng.integers(-(2**62), 2**62, (2, 5000))
    a[:3] = a[3]  # equal halves
    shard = line_dedup.Shard(line_dedup.build(a, b, np.arange(5000), np.ones(5000)))
    at = shard.find(a, b)
    assert sorted(at.tolist()) == list(range(5000)) and (shard.values[at] == np.arange(5000)).all()
    assert (shard.find(b, a) == -1).all()


def test_lines_with_hot_keys_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 10)
    rows = [(i, f"a line that all share\nown line number {i}\nhalf of them {i // 2}", "x", "y") for i in range(400)] + [(None, "a line that all share", "x", "y"), (2, "a line that all share", "x", "y"), (500, None, "x", "y"), (501, "z" * 2_000_000, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone string, _doc string")
    out = line_dedup.drop_lines(df)
    assert out.columns == [*df.columns, "_n_lines", "_n_dropped"] and {(r._gone, r._doc) for r in out.select("_gone", "_doc").collect()} == {("x", "y")}
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.text, r._n_lines, r._n_dropped))
    assert got[0] == [(rows[0][1], 3, 0)] and got[None] == [("a line that all share", 1, 0)] and got[500] == [(None, 1, 0)] and got[501] == [("z" * 2_000_000, 1, 0)]
    assert sorted(got[2]) == [("", 1, 1), ("own line number 2\nhalf of them 1", 3, 1)]
    for i in range(1, 400):
        if i != 2:
            assert got[i] == [(f"own line number {i}" + ("" if i % 2 else f"\nhalf of them {i // 2}"), 3, 1 + i % 2)]


def test_repeated_pages_against_sql(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>a</p>"), (1, "http://a/1", "<p>a</p>"), (1, "http://a/2", "<p>a</p>"), (1, "http://a/1", "other"), (2, None, "<p>a</p>"), (2, None, "<p>a</p>"), (3, "u", None), (3, "u", "")]
    ids, urls, html = zip(*rows, strict=True)
    path = cases.write(tmp_path / "r", pages=pa.table({"page_id": pa.array(ids, pa.int64()), "url": pa.array(urls), "html": pa.array(html)}))
    assert compare(spark, path, "op3_warc").count() == len(rows)


def test_pages_without_id(spark, tmp_path):
    rows = [(None, "http://a/1", "<p>a</p>"), (None, "http://a/1", "<p>a</p>"), (4, "http://a/4", "<p>a</p>"), (None, "u", "alone"), (None, "u", "alone"), (None, None, None)]
    ids, urls, html = zip(*rows, strict=True)
    path = cases.write(tmp_path / "r", pages=pa.table({"page_id": pa.array(ids, pa.int64()), "url": pa.array(urls), "html": pa.array(html)}))
    got = [(r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in queries.queries()["op3_warc"](spark, path).collect()]
    assert sorted(got) == [(0, 0, "response", 0), (0, 5, "response", 0), (0, 5, "response", 0), (0, 8, "revisit", 4), (0, 8, "revisit", 4), (4, 8, "response", 0)]
