"""Classifier, rules, language model, mixing, archives and tokeniser against brute force, round trips and held-out accuracy."""

import hashlib
import math
import zlib
from collections import Counter

import llm_cases as cases
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from larkspur.llm import cotraining, gru_lm, mixing, quality_rules, sentencepiece_codec, url_rules, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    d = cases.documents()
    return cases.write(tmp_path_factory.mktemp("models"), documents=d, labels=cases.labels(d))


@pytest.fixture
def docs(spark, path):
    return spark.read.parquet(f"{path}/documents.parquet")


def test_classifier_learns(spark):
    rng = np.random.default_rng(0)
    good, bad = [f"good{i}" for i in range(50)], [f"zz#{i}$" for i in range(50)]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad, 40)), "en", f"s{i % 3}", 1) for i in range(900)]
    df = spark.createDataFrame(rows, DOCS)
    y = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300)], "doc_id long, quality int")
    got = cotraining.judge(df, y).where("doc_id >= 300").collect()
    assert len(got) == 600 and np.mean([r.kept == (r.doc_id % 3 > 0) for r in got]) > 0.97


def test_metadata_tells_sources_apart():
    names = [None, "", *(f"src{i}" for i in range(40)), "commoncrawl-2019", "commoncrawl-2023", "commoncrawl-junk", *(f"http://www.{x}.org" for x in ("aa", "ab", "ba"))]
    n = [0] * len(names)
    assert len({r.tobytes() for r in cotraining.metadata([b""] * len(names), names, n, n)}) == len(names)
    langs = ["en", "de", "fr", "es", "it", "nl", "pt"]
    assert len({r.tobytes() for r in cotraining.metadata([b""] * len(langs), [""] * len(langs), langs, n[: len(langs)])}) == len(langs)


def _two_views(n, labelled, seed=0):
    """Documents whose words and whose source each tell their class most of the time, in many variants."""
    rng = np.random.default_rng(seed)
    words = [["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(60)] for _ in range(2)]
    rows = []
    for i in range(n):
        y = i % 2
        text = " ".join(words[y][k] if rng.random() < 0.8 else words[1 - y][k] for k in rng.integers(0, 60, 12))
        rows.append((i, text, "en", f"s{int(rng.integers(60)) * 2 + (y if rng.random() < 0.95 else 1 - y)}", 1))
    return rows, [(i, 1 - i % 2) for i in range(labelled)]


def test_views_teach_each_other(spark):
    """With scarce labels the exchange lifts the metadata view, which has seen few of the sources, and both together."""
    rows, y = _two_views(3000, 80)
    df, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(y, "doc_id long, quality int")
    right = {}
    for rounds in (0, 3):
        got = cotraining.judge(df, labels, rounds=rounds, sure=0.9).where("doc_id >= 80").collect()
        right[rounds] = [np.mean([(getattr(r, c) >= 0.5) == (r.doc_id % 2 == 0) for r in got]) for c in ("p_text", "p_meta", "p_quality")]
    assert right[3][1] > right[0][1] + 0.1 and right[3][2] >= right[0][2] and right[3][2] > 0.95, right


def test_cotraining_against_brute_force(spark):
    rows, y = _two_views(500, 200, 4)
    df, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(y, "doc_id long, quality int")
    hold = {r[0]: r[1] for r in labels.selectExpr("doc_id", "pmod(xxhash64(5, doc_id), 5) = 0").collect()}
    label = dict(y)
    grams = {i: Counter(((a | b << 8 | c << 16) * 2654435761 % 2**32) >> (32 - cotraining.BITS) for a, b, c in zip(t, t[1:], t[2:])) for i, t in ((r[0], b"\n" + r[1].encode() + b"\n") for r in rows)}
    meta = {r[0]: cotraining.metadata([r[1].encode()], [r[3]], [r[2]], [r[4]])[0].tolist() for r in rows}
    t, m = ({0: Counter(), 1: Counter()} for _ in range(2))

    def ratios(c, size, parts):
        out = [0.0] * size
        for part in parts:
            g, b = sum(c[1][k] for k in part), sum(c[0][k] for k in part)
            for k in part:
                out[k] = math.log((c[1][k] + 4 * g / (g + b)) / (c[0][k] + 4 * b / (g + b))) - math.log(g / b)
        return out

    def model():
        wt = ratios(t, cotraining.BUCKETS, [range(cotraining.BUCKETS)])
        wm = ratios(m, cotraining.META, [range(a, a + w) for a, w in zip(cotraining.STARTS.tolist(), cotraining.WIDTHS.tolist())])
        st = {i: sum(wt[k] * n for k, n in g.items()) / g.total() for i, g in grams.items()}
        sm = {i: sum(wm[k] * f for k, f in zip(b, cotraining.FACTOR.tolist())) for i, b in meta.items()}
        bin_ = lambda s, most: min(255, max(0, math.floor((s / most + 1) / 2 * 256)))
        cells = Counter((bin_(st[i], 2.0), bin_(sm[i], 24.0), label[i]) for i in label if hold[i])
        return cotraining.calibrated(np.array(wt), np.array(wm), sorted((*k, n) for k, n in cells.items())), st, sm

    for i in label:
        if not hold[i]:
            t[label[i]].update({k: 8 * n for k, n in grams[i].items()})
            m[label[i]].update({k: 8 for k in meta[i]})
    now, st, sm = model()
    given = [{}, {}]
    for _ in range(cotraining.ROUNDS):
        for i in grams:
            if i not in label:
                p = [float(x[0]) for x in now.probabilities(np.array([st[i]]), np.array([sm[i]]))[:2]]
                for v, (view, items) in enumerate(((m, dict.fromkeys(meta[i], 1)), (t, grams[i]))):
                    y = 1 if p[v] >= 0.75 else 0 if p[v] <= 0.25 else None
                    if y is not None and i not in given[v]:
                        given[v][i] = y
                        view[y].update(items)
        now, st, sm = model()
    assert min(map(len, given)) > 30
    want = now.probabilities(np.array(list(st.values())), np.array(list(sm.values())))
    got = {r.doc_id: r for r in cotraining.judge(df, labels, sure=0.75).collect()}
    for k, i in enumerate(st):
        assert (got[i].p_text, got[i].p_meta, got[i].p_quality) == pytest.approx(tuple(float(p[k]) for p in want), abs=1e-6)


def test_classifier_on_odd_rows(spark, docs, path):
    y = spark.read.parquet(f"{path}/labels.parquet")
    long = spark.createDataFrame([(None, "x" * 3_000_000, None, None, None), (None, None, None, None, None)], DOCS)
    twice = docs.union(docs).union(long).withColumns({c: F.lit("x") for c in ("_y", "_id", "_hold", "_in0", "k")})
    got = cotraining.with_scores(twice, y)
    rows = got.collect()
    assert got.columns == [*twice.columns, *cotraining.SCORES] and len(rows) == 2 * docs.count() + 2 and all(0 <= r._p <= 1 for r in rows)
    by = {}
    for r in rows:
        assert by.setdefault((r.doc_id, r.text), r._p) == r._p  # repeated rows and reruns agree
    assert cotraining.judge(docs, y.limit(0)).where("not kept").count() == 0
    assert cotraining.judge(docs.limit(0), y).count() == 0


def test_text_scores_equal_counts():
    w = np.random.default_rng(1).standard_normal(cotraining.BUCKETS)
    t = [b"", b"a", "é b".encode(), b"", b"some longer text\nwith lines", b""]
    want = [float(cotraining.text_counts([x]) @ w) / max(1, len(x)) for x in t]
    assert np.allclose(cotraining.text_scores(t, w), want) and np.array_equal(cotraining.text_counts(t), sum(cotraining.text_counts([x]) for x in t))
    assert cotraining.text_counts(t).sum() == sum(map(len, t)) and len(cotraining.text_scores([], w)) == 0


def _xx(v, seed=42):
    return xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little"), seed)


def _grams(text):
    h = [_xx(w) for w in cases.words(text)]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    return [signed(x) % quality_rules.BUCKETS for x in h + [_xx(b, _xx(a)) for a, b in zip(h, h[1:])]]


def test_rules_against_brute_force(spark, docs):
    trusted = spark.createDataFrame([(i,) for i in range(3, 60, 4)] + [(None,)], "doc_id long")
    rows = docs.select("doc_id", "text").collect()
    ok = {r.doc_id for r in trusted.collect()}
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(_grams(r.text))
        target.update(_grams(r.text) if r.doc_id in ok else [])
    b, nr, nt = quality_rules.BUCKETS, raw.total(), target.total()
    ratio = lambda g: math.log((target[g] + 1) / (nt + b)) - math.log((raw[g] + 1) / (nr + b))
    got = {r.doc_id: r for r in quality_rules.judge(docs, trusted).collect()}
    assert len(got) == len(rows)
    for r in rows:
        w, g = cases.words(r.text), _grams(r.text)
        lines = [x for x in (r.text or "").split("\n") if cases.words(x)]
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(windows)
        repeat = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
        failed = len(w) < 20 or 100 * len(repeat) > 30 * len(w)
        llr = sum(map(ratio, g)) / len(g) if g else 0.0
        x = got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(repeat), failed)
        assert x.llr == pytest.approx(llr, abs=1e-9) and x.kept == (not failed and x.llr >= quality_rules.THRESHOLD)
    assert quality_rules.judge(docs.limit(0), trusted).count() == 0
    assert {r.llr for r in quality_rules.judge(docs, trusted.limit(0)).collect()} == {0.0}


def test_rules_on_odd_rows(spark, docs):
    trusted = spark.createDataFrame([(3,), (3,), (None,)], "doc_id long")
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    odd = spark.createDataFrame([(None, "some words " * 15, None, None, None), (3, "some words " * 15, None, None, None), (3, "some words " * 15, None, None, None), (9_999, long, None, None, None)], DOCS)
    every = docs.union(odd).withColumns({c: F.lit(1) for c in ("_h", "_2", "_w", "_t", "ratios", "g", "llr", "n_words")})
    got = quality_rules.judge(every, trusted).collect()
    assert len(got) == every.count()
    same = [(r.n_words, r.n_repeat_words, r.base_failed, r.llr) for r in got if r.n_words == 30 and r.word_chars == 135 and r.doc_id in (None, 3)]
    assert len(same) == 3 and len(set(same)) == 1 and same[0][1:3] == (30, True)
    assert [(r.n_words, r.n_repeat_words, r.base_failed) for r in got if r.doc_id == 9_999] == [(200_000, 200_000, True)]


def test_language_model_base(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    tokens = {r.doc_id: [w.translate(cases.UPPER) for w in cases.words(r.text)] + [None] for r in rows}
    c = Counter(t for i, x in tokens.items() if not held(i) for t in x)
    n, v = c.total(), len(c)
    got = {r.doc_id: r for r in gru_lm.score_documents(docs).collect()}
    for i, x in tokens.items():
        want = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in x)
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(i), len(x), sum(c[t] > 0 for t in x), n)
        assert g.base_score == pytest.approx(want, rel=1e-9) and g.score < 0
    assert gru_lm.score_documents(docs.limit(0)).count() == 0


def _slow_score(m, text):
    """A text's log10 probability, one token at a time in double precision."""
    p = {k: v.astype(np.float64) for k, v in gru_lm.unpack(m.flat).items()}
    hashes, said, own, buckets = m.words
    count = {r.h: r.c for r in m.counts.collect()}
    rank = {h: i for i, h in enumerate(hashes.tolist())}
    n, h, x, out = len(p["bc"]), np.zeros(gru_lm.H), 0, 0.0
    sig = lambda v: 1 / (1 + np.exp(-v))
    soft = lambda v: v - np.log(np.exp(v).sum())
    for w in [*cases.words(text), None]:
        code = None if w is None else int(gru_lm._hashes([w.translate(cases.UPPER).encode()])[0])
        y = 0 if w is None else rank[code] + 1 if rank.get(code, own) < own else own + 1 + code % buckets
        gx, hu = p["wx"][x], h @ p["u"]
        r, z = sig(gx[:16] + hu[:16]), sig(gx[16:32] + hu[16:32])
        h = (1 - z) * np.tanh(gx[32:] + r * hu[32:]) + z * h
        lp = soft(h @ p["wc"] + p["bc"])[y // n] + soft(h @ p["wo"][y // n] + p["bo"][y // n])[y % n]
        out += lp / math.log(10)
        if y > own:
            out += math.log10(count.get(code, 0) + 0.1) - m.shares[y - own - 1]
        x = y
    return out


def test_language_model_score_against_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(gru_lm, "PIECE", 64)
    odd = docs.union(spark.createDataFrame([(None, "null id", None, None, None), (3, "again a row of that id", None, None, None)], DOCS)).withColumns({c: F.lit(1) for c in ("h", "c", "row", "net", "held_out")})
    m = gru_lm.fit(odd, symbols=1024)
    got = gru_lm.score_documents(odd, model=m).collect()
    assert len(got) == odd.count() and odd.join(odd, "doc_id").count() > 0
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.score)
    for i, text in [(r.doc_id, r.text) for r in odd.collect()][::6] + [(None, "null id"), (3, "again a row of that id")]:
        assert min(abs(x - _slow_score(m, text)) for x in by[i]) < 1e-3 * (1 + len(cases.words(text))), text


def test_language_model_carries_state_in_training():
    rng = np.random.default_rng(2)
    p = gru_lm.unpack((rng.standard_normal(len(gru_lm.pack(gru_lm.fresh(np.ones(1024))))) * 0.3).astype(np.float32))
    texts = [rng.integers(1, 900, n).astype(np.int32) for n in (5000, 3, 2049, 2048, 4096)]
    parts, before, states = gru_lm.pieces(p, texts)
    assert sorted(map(len, parts)) == sorted([2048, 2048, 904, 3, 2048, 1, 2048, 2048, 2048])
    for t in texts:
        x = np.concatenate(([0], t[:-1]))[:, None]
        hs = gru_lm.run(p, x, np.zeros(x.shape, bool), np.zeros((1, gru_lm.H), np.float32))[:, 0]
        for k in range(0, len(t), 2048):
            i = next(i for i, q in enumerate(parts) if np.array_equal(q, t[k : k + 2048]))
            assert before[i] == (t[k - 1] if k else 0) and np.allclose(states[i], hs[k - 1] if k else 0, atol=1e-4)


def test_language_model_beats_unigrams_on_held_out_text(spark):
    """Words that follow each other are told by the network and not by counts."""
    rng = np.random.default_rng(7)
    follow = rng.permutation(200)

    def text():
        w, out = int(rng.integers(200)), []
        for _ in range(120):
            out.append(f"w{w}")
            w = int(follow[w]) if rng.random() < 0.9 else int(rng.integers(200))
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(4000)], "doc_id long, text string").repartition(2)
    got = gru_lm.score_documents(df).where("held_out").collect()
    assert len(got) > 200 and sum(r.score for r in got) > 0.98 * sum(r.base_score for r in got) and sum(r.score > r.base_score for r in got) > 0.9 * len(got)


def test_language_model_learns_order_and_sums_to_one():
    rng = np.random.default_rng(0)
    cycle = [np.append(np.tile([2, 3, 4, 5], 30), 0).astype(np.int32) for _ in range(200)]
    counts = np.bincount(np.concatenate(cycle), minlength=gru_lm.SYMBOLS)
    p0 = gru_lm.fresh(counts)
    p1 = gru_lm.unpack(gru_lm.train(gru_lm.pack(p0), cycle * 20, gru_lm.Adam()))
    assert gru_lm.score(p1, cycle[:1])[0] > 0.5 * gru_lm.score(p0, cycle[:1])[0]
    h = rng.standard_normal((1, gru_lm.H)).astype(np.float32)
    every = gru_lm.log_probs(p1, np.repeat(h, gru_lm.SYMBOLS, 0), np.arange(gru_lm.SYMBOLS))
    assert np.exp(every.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_language_model_symbols_grow_with_the_vocabulary():
    assert gru_lm.side(500) == 32 and gru_lm.side(10**8) > 3 * gru_lm.side(10**6)
    said = [f"w{i}".encode() for i in range(20_000)]
    own, buckets = gru_lm.split(48**2, len(said))
    words = gru_lm.Words(gru_lm._hashes(said), [w if i % 2 else None for i, w in enumerate(said)], own, buckets)
    s = words.symbols(*words.codes([b" ".join(said)])[:2])
    assert (s[:own] == np.arange(1, own + 1)).all() and s[own:].min() > own and s.max() < 48**2
    assert len(set(s.tolist())) > own
    unknown = gru_lm.Words(gru_lm._hashes(said[:own]), said[:own], own, buckets)  # the others hashed as rare words
    assert (unknown.symbols(*unknown.codes([b" ".join(said)])[:2]) == s).all()


def test_language_model_gradient():
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in gru_lm.unpack((rng.standard_normal(len(gru_lm.pack(gru_lm.fresh(np.ones(gru_lm.SYMBOLS))))) * 0.2).astype(np.float32)).items()}
    x, y = rng.integers(2, 40, (5, 3)), rng.integers(0, 40, (5, 3))
    start, h0 = np.zeros((5, 3), bool), np.zeros((3, gru_lm.H))
    g, _ = gru_lm.gradient(p, x, y, start, h0)
    loss = lambda: -gru_lm.log_probs(p, gru_lm.run(p, x, start, h0).astype(np.float64).reshape(-1, gru_lm.H), y.ravel()).astype(float).mean()
    for k, at in (("u", (2, 5)), ("wc", (1, 0)), ("wo", (0, 3, 7)), ("wx", (int(x[1, 1]), 20)), ("bo", (1, 2))):
        old = p[k][at]
        p[k][at] = old + 1e-2
        up = loss()
        p[k][at] = old - 1e-2
        slope = (up - loss()) / 2e-2
        p[k][at] = old
        found = g[k][int(np.flatnonzero(g["rows"] == at[0])[0]), at[1]] if k == "wx" else g[k][at]
        assert found == pytest.approx(slope, abs=2e-3)


def reshare(sizes, weights, total, most):
    """Targets by weight, one source at a time: those above most times their size stop, the rest is shared anew."""
    out, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s], total
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > most * sizes[i]]
        for i in over:
            out[i] = most * sizes[i]
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            break
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return out


def test_mixing_of_very_many_sources(spark, monkeypatch):
    """More sources than are ever sent to a task, one of them hot."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1000)
    df = spark.range(100_500).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 5 as int)) as text", "case when id % 3 = 0 then 'hot' when id = 7 then null else concat('é', id) end as source")
    got = mixing.mix(df).collect()
    assert len(got) == 100_500
    size = {r.source: r.source_size for r in got}
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, reshare([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()), 2), strict=True))
    assert len(order) > 60_000 and all(r.target == pytest.approx(want[r.source]) for r in got)
    assert sum(r.size for r in got if r.source == "hot") == size["hot"]


def test_mixing(spark, docs):
    t = mixing.targets(spark.createDataFrame([("a", 10), ("b", 10), ("c", 100), ("d", 0)], "source string, source_size long"), (5, 2, 1), 1.5, 2)
    assert sorted(map(tuple, t.collect())) == [("a", 10, 20), ("b", 10, 20), ("c", 100, 140), ("d", 0, 0)]
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "x y z"), (1, "x y z"), (2, None), (3, "w " * 200_000)], "doc_id long, text string").withColumn("source", F.lit("s"))
    rows = sorted((r.doc_id or 0, r.size, r.taken) for r in mixing.mix(odd).collect())
    assert len(rows) == 6 and rows[0] == rows[1] and rows[2] == rows[3] and {r[1] for r in rows} == {0, 2, 3, 200_000}
    got = mixing.mix(docs).collect()
    size = {r.doc_id: len(cases.words(r.text)) for r in docs.collect()}
    by = Counter()
    for r in got:
        by[r.source] += size[r.doc_id]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, reshare([by[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(by.values()), 2), strict=True))
    for r in got:
        rate = want[r.source] / by[r.source] if by[r.source] else 0
        assert r.size == size[r.doc_id] and r.source_size == by[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in (r.size * math.floor(rate), r.size * math.ceil(rate)) and r.taken <= 2 * r.size
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    clash = docs.withColumns({c: F.lit(1) for c in ("size", "target", "rate", "_n", "row")})
    out = mixing.emit(clash)
    n = Counter(r.doc_id for r in out.collect())
    assert out.columns == clash.columns and n == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_nears_its_targets(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 50 as int)) as text", "case when id % 3 = 0 then 'big' else concat('s', id % 4) end as source")
    for r in mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.05)


def test_archive_holds_whole_captures(spark, tmp_path):
    rows = [(1, "http://a.b/x?y", "<é>" * 900, "q"), (2, None, "<é>" * 900, "q"), (3, "http://a.b/\r\nEvil: 1", None, "q"), (4, "u://h", "a\r\n\r\nWARC/1.1", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, hex string")
    warc.write_archive(pages, str(tmp_path / "w"))
    t = {r.metadata.body.decode(): r for r in warc.transactions(warc.read_archive(spark, str(tmp_path / "w"))).collect()}
    assert len(t) == 4 and all(r.request and r.response for r in t.values())
    first, again = t["pageId: 1\r\n"], t["pageId: 2\r\n"]
    assert first.response.body.decode() == rows[0][2] and first.response.digest_ok and first.request.http_head.startswith("GET /x?y HTTP/1.1\r\nHost: a.b")
    assert again.response.kind == "revisit" and again.response.refers_to == first.record_id and again.response.content_length == 3600
    assert t["pageId: 3\r\n"].response.uri == "http://a.b/%0D%0AEvil: 1" and t["pageId: 4\r\n"].response.body == b"a\r\n\r\nWARC/1.1"
    got = warc.archive_round_trip(spark, pages, min_payload=5000).collect()
    assert {r.record_type for r in got} == {"response"} and len(got) == 4


def _rules_by_hand(df, rules, default):
    best: dict = {}
    for h, p, v in rules:
        best[h, p] = max(v, best.get((h, p), ""))
    for r in url_rules.judge(df, rules, default=default).collect():
        fit = [(len(h), len(p), h + p, v) for (h, p), v in best.items() if r.host and (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        want = max(fit)[2:] if fit else (None, default)
        assert (r.rule, r.verdict) == want, r


def test_archive_files_are_bounded(spark, tmp_path, monkeypatch):
    """A run of pages far above the mean does not make a file far above its size."""
    monkeypatch.setattr(warc, "FILE_BYTES", 50_000)
    rows = [(i, f"http://a/{i}", "x" * (200_000 if i == 7 else 40_000 if 300 <= i < 320 else 10 + i)) for i in range(2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archive(pages, str(tmp_path / "w"), gzip=False)
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert max(sizes) < max(warc.LARGE * warc.FILE_BYTES, 250_000) and len(sizes) > 20
    got = warc.archive_round_trip(spark, pages).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(i, len(h)) for i, _, h in rows]


def test_url_rules_nest(spark):
    rules = [("org", "/", "allow"), ("a.org", "/x", "block"), ("b.a.org", "/x/y", "allow"), ("b.a.org", "/", "block"), ("b.a.org", "/", "allow"), ("com", "/d", "block"), ("org", "/x", "block"), ("org", "/x/y", "allow"), ("a.org", "", "allow"), ("a.org", "/é\U0010ffff", "block")]
    urls = [f"http://{h}{p}" for h in ("org", "a.org", "z.a.org", "b.a.org", "c.b.a.org", "aa.org", "com", "x.com", "org.com", "net", "a.org:80", ".org", "a..org", "ORG") for p in ("/x/y", "/x", "/q", "", "/d?x#y", "/x/z", "/é\U0010ffffx")]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(None, None, 1), (7, "http://org/", 1), (7, "http://org/", 1), (8, "http://a.org/" + "x" * 100_000, 1)], "page_id long, url string, key int")
    _rules_by_hand(df, rules, "block")
    assert url_rules.judge(df, rules).count() == df.count() and url_rules.judge(df, spark.createDataFrame([], "host string, path string, verdict string")).where("rule is not null").count() == 0


def test_url_rules_over_many_ranges(spark, monkeypatch):
    """Many nested rules, ranges that begin inside them, and one host that has a third of all pages."""
    monkeypatch.setattr(url_rules, "ROWS", 60)
    rng = np.random.default_rng(3)
    path = lambda k: "/" + "".join(rng.choice(list("ab"), k))
    hosts = ["hot.org", *(f"h{i}.org" for i in range(12)), "org", "x.hot.org"]
    rules = sorted({(str(rng.choice(hosts)), path(int(rng.integers(0, 5))), str(rng.choice(["allow", "block"]))) for _ in range(200)})
    rows = [(i, f"http://{'hot.org' if i % 3 == 0 else rng.choice(hosts)}{path(int(rng.integers(0, 9)))}") for i in range(1500)]
    _rules_by_hand(spark.createDataFrame(rows, "page_id long, url string"), rules, "allow")


def test_sentencepiece_equals_the_library(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in sentencepiece_codec.digests(docs).collect()}
    for i, t in rows.items():
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), t
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest(), t
    out = sentencepiece_codec.tokenized(docs.withColumn("ids", F.lit("clash")), decoded_col="decoded").where("doc_id = 3").first()
    assert out.ids == [sp.bos_id(), sp.eos_id()] and out.decoded == ""
    assert sentencepiece_codec.digests(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b"), (8, "ab " * 100_000)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n_tokens", "ids", "decoded")})
    rows = sentencepiece_codec.digests(odd).collect()
    assert len(rows) == 4 and len({(r.n_tokens, r.ids_sha256) for r in rows if r.doc_id != 8}) == 1
    assert [r.n_tokens for r in rows if r.doc_id == 8] == [len(sp.encode("ab " * 100_000)) + 2]


def test_sentencepiece_random_strings():
    import random

    import sentencepiece

    path = sentencepiece_codec.default_model()
    sp, c, rng = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.codec(path), random.Random(1)
    texts = ["".join(rng.choices("aAbetnsi  ▁\n\t.é日🦜\u0301\u200b0", k=rng.randint(0, 60))) for _ in range(400)]
    for t, ids in zip(texts, c.encode(texts), strict=True):
        assert ids.tolist() == sp.encode(t), repr(t)
        assert c.decode(ids).decode() == sp.decode(ids.tolist()), repr(t)
