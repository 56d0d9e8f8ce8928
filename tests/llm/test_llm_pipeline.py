"""The pipeline's stages against brute force on their own inputs."""

import itertools
from collections import Counter

import corpus_pipeline
import llm_cases as cases
from pyspark.sql import functions as F

from larkspur.llm import cotraining, mixing


def test_stages(spark, tmp_path):
    d = cases.documents()
    path = cases.write(tmp_path / "p", documents=d, labels=cases.labels(d))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, path)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    a, b, c, m, last = ([r.asDict() for r in x.collect()] for x in seen)
    assert all(x.columns == corpus_pipeline.COLUMNS for x in seen[:4])

    every = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r.doc_id for r in cotraining.judge(every, spark.read.parquet(f"{path}/labels.parquet")).where("kept").collect()}
    assert {r["doc_id"] for r in a} == kept

    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(cases.UPPER)
    first, n = {}, Counter()
    for r in sorted(a, key=lambda r: r["doc_id"]):
        for k in {key(x) for x in (r["text"] or "").split("\n")}:
            first.setdefault(k, r["doc_id"])
            n[k] += 1
    want = {}
    for r in a:
        lines = (r["text"] or "").split("\n")
        left = [x for x in lines if len(key(x)) < 10 or n[key(x)] < 2 or first[key(x)] == r["doc_id"]]
        if len(left) == len(lines):
            want[r["doc_id"]] = r["text"]
        elif cases.words("\n".join(left)):
            want[r["doc_id"]] = "\n".join(left)
    assert {r["doc_id"]: r["text"] for r in b} == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in b)

    sets = {}
    for r in b:
        w = [x.translate(cases.UPPER) for x in cases.words(r["text"])]
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    links = [(x, y) for x, y in itertools.combinations(sets, 2) if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    low = cases.roots(sets, links)
    assert {r["doc_id"] for r in c} == {i for i in sets if low[i] == i} and len(c) < len(b)

    copies = {r.doc_id: r.copies for r in mixing.mix(seen[2]).collect()}
    assert Counter(r["doc_id"] for r in m) == Counter({k: v for k, v in copies.items() if v})

    import sentencepiece

    from larkspur.llm import sentencepiece_codec

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    assert len(last) == len(m)
    for r in last:
        assert r["ids"] == sp.encode(r["text"] or "", add_bos=True, add_eos=True) and r["n_tokens"] == len(r["ids"])
    assert corpus_pipeline.run(spark, path).count() == len(last)


def test_empty(spark, tmp_path):
    d = cases.documents([])
    path = cases.write(tmp_path / "p", documents=d, labels=cases.labels(d))
    assert corpus_pipeline.run(spark, path).count() == 0


def test_extra_columns_and_odd_rows(spark, tmp_path):
    d = cases.documents()
    path = cases.write(tmp_path / "p", documents=d, labels=cases.labels(d))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a text without an id", "en", "s", 20), (3, "another text of id 3, repeated", None, None, 30), (3, "another text of id 3, repeated", None, None, 30)], docs.schema)
    docs = docs.union(odd).withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-1)).cast("string")) for c in ("_p", "_id", "decoded", "size", "_gone", "_n_lines", "copy", "text_hash", "extra 0")})
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, path)
        rows = out.collect()
        assert out.columns == docs.columns + ["ids", "n_tokens", "round_trip"] * (name == "SentencePiece")
        assert rows and all(r[c] == f"{c}{-1 if r.doc_id is None else r.doc_id}" for r in rows for c in ("_p", "_id", "decoded", "size", "_gone", "_n_lines", "copy", "text_hash", "extra 0"))
        repeats = [r.text for r in rows if r.doc_id == 3 and r.text]
        if name == "MinHash near-dedup":
            assert repeats == ["another text of id 3, repeated"] and sum(r.doc_id is None for r in rows) == 2
        if name == "line dedup":
            assert sorted(r.text for r in rows if r.doc_id is None and r.text) == ["a text without an id"]
