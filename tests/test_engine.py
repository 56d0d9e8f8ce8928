"""The engine's parts on small inputs, and every registered query against its SQL."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import analysis
from larkspur.operators import search, vector
from larkspur.operators.dsl import Compiler, QueryError, Schema, fuzziness, min_should
from larkspur.plans import registry
from larkspur.sources import catalog, ingest, schema

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n,spec,want", [(5, 3, 3), (5, -2, 3), (4, "75%", 3), (4, "-25%", 3), (3, "2<75%", 2), (2, "2<75%", 2), (12, "2<-25% 9<-3", 9), (5, 0, 1), (5, 9, 5), (0, 2, 1)])
def test_min_should(n, spec, want):
    assert min_should(n, spec) == want


def test_fuzziness():
    assert [fuzziness("AUTO", n) for n in (2, 3, 5, 6)] == [0, 1, 1, 2]
    assert fuzziness("AUTO:1,4", 9) == 0 and fuzziness(2, 1) == 2


def test_analyzers():
    assert analysis.analyze("The 2 QUICK Brown-Foxes, the dog's bone.") == ["the", "2", "quick", "brown", "foxes", "the", "dog's", "bone"]
    assert analysis.analyze("The Quick fox's", "stop") == ["quick", "fox", "s"]
    assert analysis.analyze("/one/two/three", {"tokenizer": "path_hierarchy"}) == ["/one", "/one/two", "/one/two/three"]
    assert analysis.analyze("Quick", {"tokenizer": {"type": "edge_ngram", "min_gram": 1, "max_gram": 2}}) == ["Q", "Qu"]
    assert analysis.analyze("a b c", {"tokenizer": "whitespace", "filter": ["shingle"]}) == ["a", "b", "a b", "c", "b c"]
    assert analysis.analyze("<p>I&apos;m so <b>happy</b>!</p>", {"tokenizer": "whitespace", "char_filter": ["html_strip"]}) == ["I'm", "so", "happy", "!"]
    assert analysis.analyze("foxes jumping quickly relational", {"tokenizer": "whitespace", "filter": ["porter"]}) == ["fox", "jump", "quickli", "relat"]
    assert analysis.analyze("l'avion qu'il", {"tokenizer": "whitespace", "filter": ["elision"]}) == ["avion", "il"]
    assert analysis.analyze("東京都 市", "cjk") == ["東京", "京都", "市"]


def test_languages():
    assert analysis.analyze("Die schönen Häuser, große Bücher", "de") == ["die", "schon", "haus", "gross", "buch"]
    assert analysis.analyze("l'avion les chevaux nationale", "fr") == ["avion", "les", "cheval", "national"]
    assert analysis.analyze("las canciones felices del niño", "es") == ["las", "cancion", "feliz", "del", "niñ"]
    assert analysis.analyze("dell'amico le ragazze", "it") == ["amico", "le", "ragazz"]
    assert analysis.analyze("أَحْمَد مدرسة", "ar") == ["احمد", "مدرسه"]
    assert all(isinstance(analysis.analyze("Abc déf", x), list) for x in analysis.ANALYZERS if not x.startswith("gse"))


def test_schema():
    assert schema.flatten({"a": {"b": 1, "c": [1, 2]}, "d": [{"x": 1}, {"x": 2}], "e": []}) == {"a.b": 1, "a.c": [1, 2], "d.0.x": 1, "d.1.x": 2}
    assert schema.unflatten({"a.b": 1, "c": 2}) == {"a": {"b": 1}, "c": 2}
    assert [schema.infer(v) for v in ("x", "2020-01-01T00:00:00+00:00", 1, True, ["a", 2], None)] == ["text", "date", "numeric", "bool", "numeric", None]
    assert schema.coerce("t", "bool") is True and schema.coerce(True, "numeric") == 1.0 and schema.coerce("", "text") is None
    assert schema.from_base62(schema.base62(123456789)) == 123456789
    assert schema.parse_time(1577836800000) == schema.parse_time("2020-01-01T00:00:00+00:00")
    assert schema.parse_duration("1d2h").total_seconds() == 26 * 3600


def test_catalog():
    c = catalog.Catalog()
    c.put_template("t", ["log-*"], {"mappings": {"properties": {"level": {"type": "keyword"}}}}, 1)
    assert c.create("log-1", {"msg": {"type": "text", "fields": {"raw": {"type": "keyword"}}}})["mappings"] == {"level": "keyword", "msg": "text", "msg.raw": "keyword", "_id": "keyword", "@timestamp": "date"}
    c.alias([{"add": {"index": "log-*", "alias": "logs"}}])
    assert search.resolve(["log-1", "other"], "logs,oth*", c.aliases) == ["log-1", "other"]
    with pytest.raises(ValueError):
        c.put_mapping("log-1", {"msg": {"type": "keyword"}})
    assert c.delete("log-*") == ["log-1"] and not c.aliases


def test_bad_queries(spark):
    c = Compiler(Schema({"a": "keyword"}))
    for q in ({"a": {}, "b": {}}, {"nothing": {}}):
        with pytest.raises(QueryError):
            c.compile(q)
    with pytest.raises(NotImplementedError):
        c.compile({"exists": {"field": "a"}})


def test_vectors(spark):
    rows = [("001", [10.2, 10.4, 9.5, 22.2]), ("002", [1.0, 2.0, 3.0, 4.0]), ("003", [10.2, 10.4, 9.5, 22.2])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    got = vector.knn(df, [10.2, 10.4, 9.5, 22.2], 2).collect()
    assert [r.vec_id for r in got] == ["001", "003"] and got[0].score == pytest.approx(1)
    x = np.random.default_rng(0).random((300, 8))
    books = vector.pq_train(x, 4, 4)
    near = vector.pq_distances(vector.pq_encode(x, books), books, x[0]).argsort()[:20]
    assert 0 in near


def test_compaction_is_replay(spark):
    rng = np.random.default_rng(1)
    log = [(i, str(rng.integers(6)), ["upsert", "delete"][rng.integers(2)], float(i)) for i in range(60)]
    base = {str(k): -1.0 for k in range(4)}
    want = dict(base)
    for _, k, op, v in log:
        want.pop(k, None)
        if op == "upsert":
            want[k] = v
    b = spark.createDataFrame(list(base.items()), "_id string, value double")
    got = ingest.apply_log(b, ingest.compact(spark.createDataFrame(log, "seq long, _id string, op string, value double")))
    assert {r[0]: r[1] for r in got.collect()} == want


def test_bulk_and_stream(spark, tmp_path):
    from larkspur.streaming import log as stream

    lines = ['{"index": {"_id": "1"}}', '{"a": 1}', "broken", '{"delete": {"_id": "2"}}', '{"create": {"_id": "2"}}', '{"a": 2}']
    assert [(r[1], r[2]) for r in ingest.parse_bulk(lines)] == [("upsert", "1"), ("delete", "2"), ("upsert", "2")]
    (tmp_path / "bulk").mkdir()
    (tmp_path / "bulk/x.ndjson").write_text("\n".join(lines))
    m = ingest.mutations(spark, str(tmp_path / "bulk")).select("seq", "op", "_id", "doc")
    m.write.parquet(str(tmp_path / "log"))
    t = ingest.Table(spark, str(tmp_path / "table"))
    t.write(spark.createDataFrame([("2", "old"), ("3", "old")], "_id string, doc string"))
    for _ in range(2):
        stream.consume(spark, str(tmp_path / "log"), m.schema, t, str(tmp_path / "cp"))
    assert sorted(map(tuple, t.read().collect())) == [("1", '{"a": 1}'), ("2", '{"a": 2}'), ("3", "old")]


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    say = lambda v: "-" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(say(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    import duckdb

    df = registry.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in registry.ORACLES:
        con = duckdb.connect()
        for t in os.listdir(SF):
            con.execute(f"create view {t[:-8]} as select * from '{SF}/{t}'")
        c = con.execute(registry.ORACLES[name])
        cols = [x[0] for x in c.description]
        assert sorted(cols) == sorted(df.columns)
        assert _rows(df.columns, got) == _rows(cols, c.fetchall())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_are_pruned(spark):
    plan = _plan(registry.QUERIES["range_numeric"](spark, SF))
    assert "l_tax" not in plan and "GreaterThanOrEqual(l_quantity,10.0)" in plan and "LessThan(l_quantity,20.0)" in plan


@pytest.mark.parametrize("table,query,pushed", [
    ("orders", {"term": {"o_orderstatus": "F"}}, "EqualTo(o_orderstatus,F)"),
    ("orders", {"terms": {"o_orderstatus": ["F", "P"]}}, "In(o_orderstatus, [F,P])"),
    ("orders", {"prefix": {"o_orderpriority": "2"}}, "StringStartsWith(o_orderpriority,2)"),
    ("part", {"term": {"p_size": 10}}, "EqualTo(p_size,10)"),
    ("part", {"terms": {"p_size": [1, "2"]}}, "In(p_size, [1,2])"),
    ("part", {"range": {"p_size": {"gte": 3, "lt": 9}}}, "GreaterThanOrEqual(p_size,3)"),
    ("orders", {"term": {"o_orderkey": 2**53 + 1}}, "EqualTo(o_orderkey,9007199254740993)"),
    ("orders", {"range": {"o_orderdate": {"gte": "1995-01-01", "lt": "1996-01-01"}}}, "GreaterThanOrEqual(o_orderdate,1995-01-01T00:00)"),
    ("orders", {"range": {"o_orderdate": {"gte": "01/02/1995", "lt": "1996-01-01", "format": "02/01/2006"}}}, None),
    ("orders", {"bool": {"must": [{"term": {"o_orderstatus": "O"}}], "filter": {"range": {"o_totalprice": {"gt": 1000}}}}}, "GreaterThan(o_total"),
])
def test_filters_reach_the_scan(spark, table, query, pushed):
    df = spark.read.parquet(f"{SF}/{table}.parquet")
    if pushed is None:
        with pytest.raises(QueryError):
            Compiler(Schema.of(df.schema)).compile(query)
        return
    plan = _plan(df.where(Compiler(Schema.of(df.schema, compat=False)).compile(query).pred))
    assert pushed in plan.split("PushedFilters: ")[1].split("ReadSchema")[0], plan


def test_values_of_arrays_and_dates(spark):
    rows = [("a", ["x", "y"], [1.0, 9.0], "2020-01-01 00:00:00"), ("b", ["z"], [5.0], "2021-06-01 12:00:00"), ("c", None, None, None)]
    df = spark.createDataFrame(rows, "_id string, tags array<string>, n array<double>, t string").withColumn("t", F.col("t").cast("timestamp"))
    run = lambda q, **k: [r._id for r in df.where(Compiler(Schema.of(df.schema, **k)).compile(q).pred).orderBy("_id").collect()]
    assert run({"term": {"tags": "y"}}) == ["a"] and run({"range": {"n": {"gte": 8}}}) == ["a"] and run({"terms": {"n": [5, 7]}}) == ["b"]
    assert run({"bool": {"must_not": [{"term": {"tags": "y"}}]}}) == ["b", "c"]
    assert run({"range": {"t": {"gte": "01.06.2021", "format": "02.01.2006"}}}) == ["b"] == run({"range": {"t": {"gte": "01.06.2021"}}}, formats={"t": "02.01.2006"})
    assert run({"range": {"t": {"gte": 1609459200000, "format": "epoch_millis"}}}) == ["b"] and run({"range": {"t": {"lt": "2020-01-01T02:00:00", "time_zone": "+03:00"}}}) == []
    assert run({"term": {"t": "2020-01-01"}}) == ["a"]


def test_phrases_and_search_analyzer(spark):
    df = spark.createDataFrame([("a", "Quick brown fox's den"), ("b", "brown quick"), ("c", None)], "_id string, text string")
    run = lambda q, **k: [r._id for r in df.where(Compiler(Schema.of(df.schema, ("text",), **k)).compile(q).pred).orderBy("_id").collect()]
    assert run({"match_phrase": {"text": "quick BROWN"}}) == ["a"] and run({"match_phrase": {"text": "rown fox's"}}) == []
    assert run({"match": {"text": "fox's"}}) == ["a"] and run({"match": {"text": "QUICK"}}, search_analyzers={"text": "whitespace"}) == []
    assert min_should(5, "9<-3 2<50%") == 2


def test_ivfpq_recall(spark):
    r = registry.QUERIES["knn_ivf_recall"](spark, "/root/testdata/sf0.01").first()
    assert r.queries >= 10 and r.recall >= 0.9


def test_ivfpq_splits_long_lists(spark, monkeypatch):
    monkeypatch.setattr(vector, "LIST_ROWS", 10)
    x = np.random.default_rng(1).standard_normal((400, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [1.0])], "vec_id long, embedding array<float>")
    index = vector.build_ivfpq(df, m=4, nbits=4, lists=4)
    assert index.table.select("part").distinct().count() > 1
    q = df.where("vec_id < 20")
    r = vector.mean_recall(vector.ivfpq_search(index, q, 5, 4), vector.knn_each(df, q, 5)).first()
    assert r.queries == 20 and r.recall >= 0.9


def test_postings_read_only_a_requests_terms(spark, tmp_path):
    from larkspur.operators import postings

    rows = [(1, "a a b"), (2, "b c"), (3, None), (4, ""), (None, "a"), (5, "a " * 500 + "z")]
    df = spark.createDataFrame(rows, "_id long, text string")
    p = postings.build(df, analysis.tokens(F.col("text")), "_id").save(str(tmp_path / "p"))
    assert {(r.term, r.id, r.tf, r.size) for r in p.table.collect()} == {("a", 1, 2, 3), ("b", 1, 1, 3), ("b", 2, 1, 2), ("c", 2, 1, 2), ("a", 5, 500, 501), ("z", 5, 1, 501)}
    assert "In(term, [a,b])" in _plan(postings.bm25(p, {"a": 1, "b": 1}))
    assert [r.id for r in postings.top(p, {"a": 1, "b": 1}, least=2).collect()] == [1]
    assert postings.top(p, {"nowhere": 1}).count() == 0
    schema = Schema.of(df.schema, ("text",), default="regexp")
    want = search.search(df.where("_id is not null"), {"query": {"match": {"text": "a c"}}, "_source": False}, schema).collect()
    assert [(r.id, round(r._score, 9)) for r in postings.top(p, {"a": 1, "c": 1}).collect()] == [(r._id, round(r._score, 9)) for r in want]
    gone = spark.createDataFrame([(5,)], "id long")
    after = postings.apply(p, postings.build(spark.createDataFrame([(1, "q")], "_id long, text string"), analysis.tokens(F.col("text"))), gone)
    assert {(r.term, r.id) for r in after.table.collect()} == {("q", 1), ("b", 2), ("c", 2)} and after.docs.count() == 2


def test_vector_log(spark):
    base = spark.createDataFrame([(i, [float(i % 20), float(i // 20)]) for i in range(200)], "vec_id long, embedding array<double>")
    log = spark.createDataFrame([(1, "upsert", 7, [99.0, 0.0]), (2, "upsert", 300, [1.0, 1.0]), (3, "delete", 21, None), (4, "delete", 7, None), (5, "upsert", 7, [0.5, 0.5])], "seq long, op string, vec_id long, embedding array<double>")
    now = {r.vec_id: r.embedding for r in vector.current(base, log).collect()}
    assert len(now) == 200 and 21 not in now and now[7] == [0.5, 0.5] and now[300] == [1.0, 1.0]
    queries = spark.createDataFrame([(1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    found = vector.logged_search(vector.build_ivfpq(base, m=1, lists=4), log, queries, 4, nprobe=4).orderBy("distance", "id").collect()
    want = sorted(((a - 1) ** 2 + (b - 1) ** 2, i) for i, (a, b) in now.items())[:4]
    assert [(r.distance, r.id) for r in found] == want
    assert vector.needs_seal(log, most=3) and not vector.needs_seal(log, most=4)
    assert vector.seal(base, log, m=1, lists=4).table.count() == 200


def test_table_keeps_changes_beside_its_base(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "DELTAS", 3)
    t = ingest.Table(spark, str(tmp_path / "t"))
    base = spark.createDataFrame([("1", 1.0), ("2", 2.0), ("3", 3.0)], "_id string, v double")
    t.write(base)
    change = lambda *rows: spark.createDataFrame(rows, "op string, _id string, v double")
    steps = [change(("update", "1", 10.0), ("delete", "2", None)), change(("insert", "2", 20.0)), change(("delete", "1", None), ("insert", "4", 4.0)), change(("update", "3", 30.0)), change(("delete", "4", None))]
    want, sizes = {"1": 1.0, "2": 2.0, "3": 3.0}, []
    for step in steps:
        for r in step.collect():
            want.pop(r._id, None)
            if r.op != "delete":
                want[r._id] = r.v
        sizes.append(len(t._parts(t.apply(step))))
        assert {r._id: r.v for r in t.read().collect()} == want
    assert sizes == [2, 3, 4, 1, 2]  # after three changes the table is written anew
    with pytest.raises(FileExistsError):
        t.apply(steps[0], after=2)
    t.vacuum(1)
    assert {r._id: r.v for r in t.refresh().collect()} == want == {"2": 20.0, "3": 30.0}
    assert len([f for f in os.listdir(tmp_path / "t") if f.startswith("v-")]) == 2


@pytest.mark.parametrize(("lang", "pairs"), [
    ("da", "undersøgelser undersøg, friskt frisk, kærlighed kær, venlig ven, ligeløst ligeløs, indvendinger indvending, og og"),
    ("sv", "jaktkarlarne jaktkarl, klokast klok, kristendomen kristendom, hopplöst hopplös, flickorna flick, klostret klostret"),
    ("no", "havnedistriktene havnedistrikt, opninga opning, opplysninger opplysning, tilbakeholdt tilbakehold, vanlig van"),
])
def test_nordic_stems(lang, pairs):
    for w, stem in (p.split() for p in pairs.split(", ")):
        assert analysis.nordic_stem(lang, w) == stem


def test_language_names_and_stop_words():
    assert analysis.analyze("Jag har inte sett flickorna", "swedish") == analysis.analyze("Jag har inte sett flickorna", "sv") == ["sett", "flick"]
    assert analysis.analyze("De katten zitten op het dak", {"type": "dutch"}) == ["katten", "zitten", "dak"]
    assert analysis.analyze("x og y", {"tokenizer": "standard", "token_filter": [{"type": "stop", "stopwords": ["_danish_", "y"]}]}) == ["x"]
    with pytest.raises(ValueError, match="_hu_"):
        analysis.analyze("x", {"tokenizer": "standard", "token_filter": [{"type": "stop", "stopwords": "_hu_"}]})


@pytest.mark.parametrize("pair", "важная важн, важнейшими важн, вавиловка вавиловк, вагонами вагон, великодушный великодушн, верностью верност, прочитавший прочита, бегать бега, смеялась смея, падаль падал, в в, мстр мстр".split(", "))
def test_russian_stems(pair):
    w, stem = pair.split()
    assert analysis.russian_stem(w) == stem


def test_query_string_escapes(spark):
    df = spark.createDataFrame([(1, "a:b"), (2, "a*"), (3, "ab"), (4, "a b")], "_id long, k string")
    ids = lambda q: [r._id for r in df.where(Compiler(Schema.of(df.schema)).compile({"query_string": {"query": q}}).pred).orderBy("_id").collect()]
    assert ids(r"k:a\:b") == [1] and ids(r"k:a\*") == [2] and ids("k:a*") == [1, 2, 3, 4] and ids(r"k:a\ b") == [4] and ids(r"k:ab^2") == [3]


def test_deadline(spark):
    slow = spark.range(4).select(F.udf(lambda i: __import__("time").sleep(20) or i, "long")("id"))
    with pytest.raises(TimeoutError), search.deadline(spark, 1):
        slow.collect()
    with search.deadline(spark, 60):
        assert spark.range(3).count() == 3
    with pytest.raises(ZeroDivisionError), search.deadline(spark, 60):
        1 / 0


def test_assignment_holds_few_distances(monkeypatch):
    x = np.random.default_rng(2).standard_normal((500, 8))
    whole = vector.assign(x, x[:40])
    most = []
    monkeypatch.setattr(vector, "CELLS", 400)

    class Seen(np.ndarray):
        def __matmul__(self, other):
            most.append(len(self) * other.shape[1])
            return np.asarray(self) @ other

    assert (vector.assign(x.view(Seen), x[:40]) == whole).all() and max(most) <= 400
    assert vector.assign(x[:0], x[:40]).shape == (0,)


def test_ivfpq_over_tiles(spark, monkeypatch):
    """A growing index keeps its recall by a share of its lists, whichever the tiles; one list may hold most vectors."""
    for name, v in (("TILE_ROWS", 300), ("TILE_ASKS", 20), ("LIST_ROWS", 200)):
        monkeypatch.setattr(vector, name, v)
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.standard_normal((1500, 16)), np.ones((500, 16))))
    df = spark.createDataFrame([(f"v{i}", [float(v) for v in r]) for i, r in enumerate(x)], "vec_id string, embedding array<float>")
    q = df.where("substring(vec_id, 2) % 40 = 0")
    found = vector.ivfpq_search(vector.build_ivfpq(df, m=8), q, 5, 0.45)
    assert found.groupBy("query").count().where("count != 5").count() == 0
    r = vector.mean_recall(found, vector.knn_each(df, q, 5)).first()
    assert r.queries == 50 and r.recall >= 0.9


def test_knn_each_is_exact_over_tiles(spark, monkeypatch):
    """Ties by id, far from the origin, not finite, of several lengths; a tile holds few vectors."""
    for name, v in (("TILE_ROWS", 40), ("TILE_ASKS", 10)):
        monkeypatch.setattr(vector, name, v)
    sizes = []
    monkeypatch.setattr(vector, "_tiles", lambda rows, asks, slots, *a, f=vector._tiles: sizes.append(rows.groupBy("_s").count().agg({"count": "max"}).first()[0]) or f(rows, asks, slots, *a))
    rng = np.random.default_rng(4)
    x = [*(rng.standard_normal((150, 4)) + 1e6).tolist(), *[[1.0, 2.0, 3.0, 4.0]] * 40, [float("inf"), 0.0, 0.0, 0.0], [float("nan")] * 4, [1e200] * 4, [1.0, 2.0], [], None]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    q = df.where("vec_id % 7 = 0 or vec_id > 188")
    got = {}
    for r in vector.knn_each(df, q, 6).orderBy("query", F.col("distance"), "id").collect():
        got.setdefault(r.query, []).append((r.id, r.distance))
    for i, v in enumerate(x):
        if v is not None and (i % 7 == 0 or i > 188):
            with np.errstate(all="ignore"):
                d = sorted((np.inf if np.isnan(e) else e, np.isnan(e), j) for j, e in ((j, ((np.array(u) - np.array(v)) ** 2).sum()) for j, u in enumerate(x) if u is not None and len(u) == len(v)))[:6]
            assert [j for _, _, j in d] == [j for j, _ in got[i]], i
    assert max(sizes) < 80


def test_explanation_reads_texts_twice(spark, tmp_path):
    """Once for the statistics and once for the hits, however many terms; tokens of a hit are made once."""
    spark.createDataFrame([(1, "a b a c"), (2, "c"), (3, "z"), (4, None)], "_id long, text string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    schema = Schema.of(df.schema, ("text",), default="regexp")
    node = Compiler(schema).compile({"match": {"text": "a b c"}})
    out = search.explanation(df, node, schema)
    plan = _plan(out)
    assert plan.count("FileScan") == 1 and sum("regexp_extract_all" in line and "FileScan" not in line for line in plan.splitlines()) <= 2, plan
    got = {(r._id, r.term): (r.frequency, r.length, r.score) for r in out.collect()}
    assert {k: v[:2] for k, v in got.items()} == {(1, "a"): (2, 4), (1, "b"): (1, 4), (1, "c"): (1, 4), (2, "a"): (0, 1), (2, "b"): (0, 1), (2, "c"): (1, 1)}
    for r in search.bm25(df, node, schema, "_id").collect():
        assert abs(r._score - sum(v[2] for (i, _), v in got.items() if i == r._id)) < 1e-12


def test_postings_make_tokens_once_a_pass(spark, tmp_path):
    from larkspur.operators import postings

    spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, None), (4, ""), (None, "a")], "_id long, text string").write.parquet(str(tmp_path / "t"))
    p = postings.build(spark.read.parquet(str(tmp_path / "t")), analysis.tokens(F.col("text")), "_id")
    for df in (p.docs, p.table.where("term = 'b'")):
        plan = _plan(df)
        assert sum("regexp_extract_all" in line for line in plan.splitlines()) == 1 and "rangepartitioning" not in plan and "Sort" not in plan, plan
    assert {(r.id, r.size) for r in p.docs.collect()} == {(1, 3), (2, 2)}
    assert {(r.term, r.id, r.tf, r.size) for r in p.table.collect()} == {("a", 1, 2, 3), ("b", 1, 1, 3), ("b", 2, 1, 2), ("c", 2, 1, 2)}


def test_postings_batch_makes_tokens_once_a_pass(spark, tmp_path):
    """Of the base and of the batch, as rows and as ids that leave; a join by id shuffles sizes, not texts."""
    from larkspur.operators import postings

    spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, "a"), (4, "")], "_id long, text string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    words = analysis.tokens(F.col("text"))
    after = postings.apply(postings.build(df.where("_id < 4"), words), postings.build(df.where("_id % 2 = 1").withColumn("text", F.lower("text")), words), spark.range(2, 3))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for d in (after.docs, after.table.where("term = 'a'")):
            plan = _plan(d)
            assert sum("regexp_extract_all" in line for line in plan.splitlines()) == 3, plan
        plan = _plan(after.docs)
        assert plan.index("LeftAnti") < plan.index("Generate"), plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.id, r.size) for r in after.docs.collect()} == {(1, 3), (3, 1)}


def test_exact_cardinality_groups_values_alone(spark):
    """Grouped values carry no buffers of other metrics: memory grows by the values alone."""
    from larkspur.operators import aggs

    df = spark.createDataFrame([(1, "a", 1.5), (1, None, -0.0), (2, "b", 0.0), (None, "a", float("nan")), (3, "b", float("nan"))], "k long, s string, v double")
    card = lambda f, **o: {"cardinality": {"field": f} | o}
    out = aggs.metrics(df, {"n": {"count": {}}, "k": card("k", exact=True), "ek": card("k"), "s": card("s", exact=True), "v": card("v", exact=True), "es": card("s"), "top": {"max": {"field": "k"}}})
    assert out.columns == ["n", "k", "ek", "s", "v", "es", "top"] and out.first() == (5, 3, 3, 2, 3, 2, 3.0)
    plan = _plan(aggs.metrics(df, {"k": card("k", exact=True), "e": card("k"), "n": {"avg": {"field": "v"}}}))
    keyed = [line for line in plan.splitlines() if "HashAggregate(keys=[" in line and "keys=[]" not in line]
    assert keyed and all("functions=[]" in line for line in keyed), plan
    assert aggs.metrics(df.where("k > 9"), {"k": card("k", exact=True), "n": {"count": {}}}).first() == (0, 0)


@pytest.mark.parametrize("saved", [False, True])
def test_postings_of_a_batch_cut_each_text_once(spark, tmp_path, saved):
    """For statistics and scores together; a saved base is read. Scores are those by the postings' rows."""
    from larkspur.operators import postings

    cuts = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(s):
        cuts.add(1)
        return s.split() if s else []

    old = [(1, "a a b"), (2, "b c"), (3, "a b"), (4, ""), (5, "a"), (6, None), (7, "b b b"), (None, "a"), (8, "c")]
    new = [(1, "a c c"), (3, ""), (5, "c a"), (9, "a a"), (10, None), (None, "b")]
    base = postings.build(spark.createDataFrame(old, "_id long, text string").repartition(3), words("text"))
    base = base.save(str(tmp_path / "p")) if saved else base
    gone = spark.createDataFrame([(5,), (7,), (11,), (None,)], "id long")
    after = postings.apply(base, postings.build(spark.createDataFrame(new, "_id long, text string").repartition(2), words("text")), gone)
    cuts.value = 0
    got = {r.id: r._score for r in postings.bm25(after, {"a": 1, "c": 2, "nowhere": 1}).collect()}
    assert cuts.value == 5 + 8 * (not saved)  # null ids are not cut
    now = {1: "a c c", 2: "b c", 3: "a b", 5: "c a", 8: "c", 9: "a a"}
    assert {r.id: r.size for r in after.docs.collect()} == {i: len(t.split()) for i, t in now.items()} and set(got) == set(now)
    mean = sum(len(t.split()) for t in now.values()) / len(now)
    for i, t in now.items():
        w = t.split()
        idf = {x: np.log(1 + (len(now) - n + 0.5) / (n + 0.5)) for x in "ac" for n in [sum(x in u.split() for u in now.values())]}
        want = sum(k * idf[x] * w.count(x) / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, k in (("a", 1), ("c", 2)))
        assert abs(got[i] - want) < 1e-12
    for least in (0, 2):
        rows = {r.id: r._score for r in postings.bm25(postings.Postings(after.table, after.docs), {"a": 1, "c": 2}, least).collect()}
        counted = {r.id: r._score for r in postings.bm25(after, {"a": 1, "c": 2}, least).collect()}
        assert set(rows) == set(counted) and all(abs(rows[i] - counted[i]) < 1e-12 for i in rows)
    again = postings.apply(after, postings.build(spark.createDataFrame([(2, "a")], "_id long, text string"), words("text")))
    cuts.value = 0
    assert sorted(r.id for r in postings.bm25(again, {"a": 1}).collect()) == [1, 2, 3, 5, 9] and cuts.value == 6 + 8 * (not saved)


def test_postings_of_many_terms_go_by_rows(spark):
    from larkspur.operators import postings

    p = postings.build(spark.createDataFrame([(1, "a b"), (2, "b")], "_id long, text string"), analysis.tokens(F.col("text")))
    few, many = ({r.id: r._score for r in postings.bm25(p, dict.fromkeys(t, 1)).collect()} for t in (["a", "b"], ["a", "b", *(f"x{i}" for i in range(postings.WIDE))]))
    assert set(few) == set(many) == {1, 2} and all(abs(few[i] - many[i]) < 1e-12 for i in few)
    assert postings.bm25(p, {}).count() == 0
    other = postings.apply(p, postings.build(spark.createDataFrame([(2, "a")], "_id int, text string"), analysis.tokens(F.col("text"))))
    assert other.counts is None and sorted(r.id for r in postings.bm25(other, {"a": 1}).collect()) == [1, 2]
