"""Quality classifier by co-training: a text view and a page-metadata view teach each other, then vote calibrated.

Both views are naive Bayes models over hashed counts, so that every fit is an exact sum over all labelled and all
pseudo-labelled documents of the corpus: nothing is sampled, and partial sums of a task have a fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import as_bytes, batches, durable

BITS = 14
BUCKETS = 1 << BITS  # hashed byte trigrams of the text view
ROUNDS = 3
SURE = 0.95  # calibrated probability from which a view passes a label on
LABEL_WEIGHT, PSEUDO_WEIGHT = 8, 1  # integers, so that sums don't depend on their order
SMOOTH = 4.0  # observations that every bucket is given at the ratio of its whole feature
CELLS = 256  # calibration bins of each view's score
TEXT_RANGE, META_RANGE = 2.0, 24.0  # scores are binned within plus and minus these
SLICE = 1 << 19  # bytes of texts whose features are made at a time
BROADCAST_LABELS = 2_000_000  # labels sent to all tasks at most; beyond, labels and documents meet by shuffle, once

#: Buckets of the metadata view's features: two hashes of the whole source and language, then bins of logarithms of
#: n_chars, of the lines, of the mean line length, and of the shares of character kinds. What a bin means is learned.
SOURCES, LANGS, SIZES, KINDS, SHARES = 1 << 15, 1 << 8, 64, 9, 48
WIDTHS = np.array([SOURCES, SOURCES, LANGS, LANGS, SIZES, SIZES, SIZES] + [SHARES] * KINDS)
STARTS = np.cumsum(WIDTHS) - WIDTHS
META = int(WIDTHS.sum())
FACTOR = np.array([0.5] * 4 + [1.0] * (len(WIDTHS) - 4))  # the two hashes of a value share its vote

_KIND = np.zeros(256, np.int64)  # letter, upper, digit, space, newline, common punctuation, other symbol, control, non-ASCII
for _c in range(256):
    _ch = chr(_c)
    _KIND[_c] = 8 if _c > 127 else 1 if _ch.isupper() else 0 if _ch.isalpha() else 2 if _ch.isdigit() else 4 if _c == 10 else 3 if _ch == " " else 5 if _ch in ".,;:'\"-?()" else 7 if _c < 32 else 6


# -- features ------------------------------------------------------------------------------------------------


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all texts, each text's first place among them, and the places that span two texts.

    A text of n bytes has n trigrams, since a newline before and after it counts, and two places that reach the next.
    """
    buf = np.frombuffer(b"\n" + b"\n\n".join(texts) + b"\n\n", np.uint8).astype(np.uint32)
    code = buf[:-2] | buf[1:-1] << np.uint32(8) | buf[2:] << np.uint32(16)
    h = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    ends = np.cumsum(np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts)))
    spans = np.unique(np.minimum(np.concatenate((ends - 2, ends - 1)), len(h) - 1))
    return h.astype(np.int64), np.concatenate(([0], ends[:-1])), spans


def text_sums(texts: list[bytes], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sum of trigram weights, and its number of trigrams."""
    sums, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
    for i, j in batches(texts, SLICE):
        h, first, spans = trigrams(texts[i:j])
        v = w[h]
        v[spans] = 0
        sums.append(np.add.reduceat(v, first))
        sizes.append(np.add.reduceat(np.bincount(spans, minlength=len(h)) == 0, first, dtype=np.int64))
    return np.concatenate(sums), np.concatenate(sizes)


def text_scores(texts: list[bytes], w: np.ndarray) -> np.ndarray:
    """Mean weight of each text's trigrams, 0 without any."""
    sums, n = text_sums(texts, w)
    return sums / np.maximum(1, n)


def text_counts(texts: list[bytes]) -> np.ndarray:
    """Trigrams of all texts, counted by bucket."""
    out = np.zeros(BUCKETS, np.int64)
    for i, j in batches(texts, SLICE):
        h, _, spans = trigrams(texts[i:j])
        out += np.bincount(h, minlength=BUCKETS) - np.bincount(h[spans], minlength=BUCKETS)
    return out


def metadata(texts: list[bytes], source: list, lang: list, n_chars: list) -> np.ndarray:
    """Each document's bucket in every feature of WIDTHS, as one index into META."""
    n = len(texts)
    out = np.zeros((n, len(WIDTHS)), np.int64)
    for col, at, width in ((source, 0, SOURCES), (lang, 2, LANGS)):
        place: dict = {}
        for k, v in enumerate(col):
            if v not in place:
                h = xxhash.xxh3_64_intdigest("\0" if v is None else str(v))
                place[v] = (h % width, (h >> 32) % width)
            out[k, at : at + 2] = place[v]
    size = np.fromiter(map(len, texts), np.int64, n)
    lines = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, n)
    step = lambda x: np.minimum(SIZES - 2, np.floor(2 * np.log2(np.maximum(0, x) + 1.0))).astype(np.int64)
    given = np.array([-1 if v is None else v for v in n_chars], np.float64)
    out[:, 4] = np.where(given < 0, SIZES - 1, step(given))
    out[:, 5], out[:, 6] = step(lines), step(size / lines)
    for i, j in batches(texts, SLICE):
        kind = _KIND[np.frombuffer(b"".join(texts[i:j]), np.uint8)]
        c = np.bincount(np.repeat(np.arange(j - i), size[i:j]) * KINDS + kind, minlength=(j - i) * KINDS).reshape(-1, KINDS)
        share = c / np.maximum(1, size[i:j, None])
        out[i:j, 7:] = np.minimum(SHARES - 1, np.floor(4 * np.log2(1 + 1024 * share)))
    return out + STARTS


# -- models --------------------------------------------------------------------------------------------------


def log_ratios(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Log likelihood ratios of a feature's buckets; one that is never seen says nothing."""
    g, b = float(good.sum()), float(bad.sum())
    if not g or not b:
        return np.zeros(len(good))
    p = g / (g + b)
    return np.log((good + SMOOTH * p) / (bad + SMOOTH * (1 - p))) - np.log(g / b)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Model:
    """Weights of both views, their calibrations and the weights of the calibrated votes; unfitted, it keeps everything."""

    text: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    meta: np.ndarray = field(default_factory=lambda: np.zeros(META))
    cal: list = field(default_factory=lambda: [(0.0, 0.0), (0.0, 0.0)])
    vote: tuple = (0.5, 0.5, 30.0)

    def raw(self, texts: list[bytes], buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The views' scores: mean weight of trigrams, and the sum of the features' weights."""
        return text_scores(texts, self.text), self.meta[buckets] @ FACTOR

    def probabilities(self, st: np.ndarray, sm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lt, lm = (a * s + b for (a, b), s in zip(self.cal, (st, sm), strict=True))
        a, b, c = self.vote
        return _sigmoid(lt), _sigmoid(lm), _sigmoid(a * np.clip(lt, -20, 20) + b * np.clip(lm, -20, 20) + c)


def logistic(x: np.ndarray, t: np.ndarray, n: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Weights of a logistic model of rows x that stand for n observations of mean target t, near the prior."""
    w = prior.copy()
    for _ in range(50):
        p = _sigmoid(x @ w)
        hess = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (n * (p - t)) + (w - prior))
        w = w - step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return w


def calibrated(text: np.ndarray, meta: np.ndarray, cells: list[tuple[int, int, int, int]]) -> Model:
    """The model with Platt's sigmoids and votes fitted on held-out cells (text bin, metadata bin, label, count)."""
    m = Model(text, meta)
    if not cells:
        return m
    c = np.array(cells, np.int64)
    y, n = c[:, 2].astype(float), c[:, 3].astype(float)
    pos, neg = n[y == 1].sum(), n[y == 0].sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    s = [((c[:, k] + 0.5) / CELLS * 2 - 1) * most for k, most in ((0, TEXT_RANGE), (1, META_RANGE))]
    for k in (0, 1):
        mu = float((s[k] * n).sum() / n.sum())
        sd = float(np.sqrt((n * (s[k] - mu) ** 2).sum() / n.sum())) or 1.0
        a, b = logistic(np.stack(((s[k] - mu) / sd, np.ones(len(y))), 1), t, n, np.zeros(2))
        m.cal[k] = (a / sd, b - a * mu / sd)
    z = [np.clip(m.cal[k][0] * s[k] + m.cal[k][1], -20, 20) for k in (0, 1)]
    m.vote = tuple(logistic(np.stack((*z, np.ones(len(y))), 1), y, n, np.array([0.5, 0.5, 0.0])).tolist())
    return m


def _bin(s: np.ndarray, most: float) -> np.ndarray:
    return np.clip(np.floor((s / most + 1) / 2 * CELLS), 0, CELLS - 1).astype(np.int32)


# -- passes over the corpus ----------------------------------------------------------------------------------


def _features(b: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    t = as_bytes(b.column("text"))
    return t, metadata(t, *(b.column(c).to_pylist() for c in ("source", "lang", "n_chars")))


def _sums(rows: DataFrame, taught) -> np.ndarray:
    """Summed counts (2, 2, buckets) by view's table and class over all rows, each view taught as `taught` says.

    taught gives, for a batch, its texts, its metadata buckets, and for each view the class of every row (-1:
    none). A task passes on only its non-zero sums.
    """

    def run(it):
        total = np.zeros((2, BUCKETS + META), np.int64)
        for b in it:
            t, m, for_text, for_meta = taught(b)
            for y in (0, 1):
                total[y, :BUCKETS] += text_counts([t[i] for i in np.flatnonzero(for_text == y)])
                total[y, BUCKETS:] += np.bincount(m[for_meta == y].ravel(), minlength=META)
        k = np.flatnonzero(total.any(0))
        yield pa.record_batch({"k": k.astype(np.int32), "bad": total[0, k], "good": total[1, k]})

    out = np.zeros((2, BUCKETS + META), np.int64)
    found = rows.mapInArrow(run, "k int, bad long, good long").groupBy("k").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()  # at most BUCKETS + META rows
    out[:, found["k"].to_numpy()] = np.stack((found["bad"].to_numpy(), found["good"].to_numpy()))
    return out


def _fit(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    meta = [log_ratios(sums[1, BUCKETS + a : BUCKETS + a + w], sums[0, BUCKETS + a : BUCKETS + a + w]) for a, w in zip(STARTS, WIDTHS, strict=True)]
    return log_ratios(sums[1, :BUCKETS], sums[0, :BUCKETS]), np.concatenate(meta)


def _cells(held: DataFrame, text: np.ndarray, meta: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text bin, metadata bin, label, count) over all held-out labelled documents."""
    sent = held.sparkSession.sparkContext.broadcast(Model(text, meta))

    def run(it):
        for b in it:
            st, sm = sent.value.raw(*_features(b))
            yield pa.record_batch({"t": _bin(st, TEXT_RANGE), "m": _bin(sm, META_RANGE), "y": b.column("_y")})

    return sorted(map(tuple, held.mapInArrow(run, "t int, m int, y int").groupBy("t", "m", "y").count().collect()))  # bounded by the bins


def _inputs(docs: DataFrame) -> list:
    have = [c.lower() for c in docs.columns]
    return [F.col("text").cast("string").alias("text"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang")), (F.col("n_chars").cast("double") if "n_chars" in have else F.lit(None).cast("double")).alias("n_chars")]


def train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, sure: float = SURE) -> Model:
    """The model fitted on all labelled documents and on all labels that the views pass to each other.

    Every fifth labelled document by a hash of its id is held out of all fits and calibrates. In a round every
    unlabelled document is scored; one that a view is sure of, and has passed on in no earlier round, is
    counted in the other view's sums from then on. Whether it was passed on earlier follows from the earlier
    rounds' models, so no state per document is kept, and a lost task is simply run again.
    """
    y = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("int").alias("_y"))
    y = y.withColumn("_hold", F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(5)) == 0)
    few = y.count() <= BROADCAST_LABELS
    rows = docs.select("doc_id", *_inputs(docs)).join(F.broadcast(y) if few else y, F.col("doc_id") == F.col("_id"), "left").drop("doc_id", "_id")
    rows = rows if few else durable(rows, "labelled")
    learn, held, open_ = rows.where("not _hold"), rows.where("_hold"), rows.where("_y is null")

    def by_label(b):
        t, m = _features(b)
        c = b.column("_y").to_numpy()
        return t, m, c, c

    sums = LABEL_WEIGHT * _sums(learn, by_label)
    text, meta = _fit(sums)
    models = [calibrated(text, meta, _cells(held, text, meta))]
    if not text.any() and not meta.any():
        return Model()
    for _ in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(models)

        def by_other_view(b, sent=sent):
            t, m = _features(b)
            said = [np.full(len(t), -1), np.full(len(t), -1)]  # by text, by metadata: labels passed on in this round
            before = [np.zeros(len(t), bool), np.zeros(len(t), bool)]
            for k, model in enumerate(sent.value):
                for v, p in enumerate(model.probabilities(*model.raw(t, m))[:2]):
                    now = np.where(p >= sure, 1, np.where(p <= 1 - sure, 0, -1))
                    if k + 1 == len(sent.value):
                        said[v] = np.where(before[v], -1, now)
                    before[v] |= now >= 0
            return t, m, said[1], said[0]

        new = _sums(open_, by_other_view)
        if not new.any():
            break
        sums = sums + PSEUDO_WEIGHT * new
        text, meta = _fit(sums)
        models.append(calibrated(text, meta, _cells(held, text, meta)))
    return models[-1]


SCORES = ["_p_text", "_p_meta", "_p"]


def with_scores(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs plus _p_text, _p_meta, _p: the calibrated probabilities of good quality by text, by metadata, by both.

    docs needs doc_id, text, source and lang; n_chars is used where there is one. Null text counts as empty;
    null sources, languages and sizes are values of their own. Rows that repeat an id share its label, and of
    conflicting labels the lower counts. A tie of the votes (0.5) is kept by judge. Very long texts are scored
    whole. Other columns pass through; those named as SCORES are replaced. Without labels of both classes every
    _p is near 1. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **how))
    out = docs.drop(*SCORES)
    names = out.columns
    own = "_in"
    while any(c.lower().startswith(own) for c in names):
        own += "_"
    extra = [c.alias(f"{own}{i}") for i, c in enumerate(_inputs(docs))]

    def run(it):
        model = sent.value
        for b in it:
            t = as_bytes(b.column(f"{own}0"))
            p = [np.zeros(0)], [np.zeros(0)], [np.zeros(0)]
            for k in range(0, len(t), 4096):
                m = metadata(t[k : k + 4096], *(b.column(f"{own}{i}").slice(k, 4096).to_pylist() for i in (1, 2, 3)))
                for into, v in zip(p, model.probabilities(*model.raw(t[k : k + 4096], m)), strict=True):
                    into.append(v)
            yield pa.record_batch([*(b.column(c) for c in names), *(pa.array(np.concatenate(v), pa.float64()) for v in p)], names=[*names, *SCORES])

    return out.select("*", *extra).mapInArrow(run, out.select("*", *(F.lit(0.0).alias(c) for c in SCORES)).schema)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """doc_id, p_text, p_meta, p_quality, kept (p_quality >= threshold) of every document; an empty table gives no rows."""
    d = docs.select("doc_id", "text", "source", "lang", *(["n_chars"] if "n_chars" in docs.columns else []))
    return with_scores(d, labels, **how).select("doc_id", F.col("_p_text").alias("p_text"), F.col("_p_meta").alias("p_meta"), F.col("_p").alias("p_quality"), (F.col("_p") >= threshold).alias("kept"))
