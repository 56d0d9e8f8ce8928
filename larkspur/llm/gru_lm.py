"""Language-model scoring: a gated recurrent network in numpy with a class-factored softmax."""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt, log10

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import as_bytes, batches, durable

H = 16  # hidden units
SIDE = 32  # classes, and members of each, at least; side() grows with the distinct training words
SYMBOLS = SIDE * SIDE  # 0: end, then the most frequent words, then buckets that all other words are hashed to
FREQUENT = 1 << 16  # words whose counts go to every task; all others are joined
WINDOW = 16  # steps of truncated backpropagation
PIECE = 2048  # symbols of a long text that one lane trains on; the next piece starts from the state this one ends in
SPAN = 64  # steps scored at a time; the state is carried from span to span
LANES = 512  # documents side by side
ROUNDS = 2  # synchronisations; each trains on another part of the documents
RATE = 0.02
CACHE = 400_000  # distinct words counted before they are passed on
SAID = 8  # words met so often in a task are reported with their text, which spares others their hash
CHUNK = 4096  # parameters of a row when models are averaged


# -- counts --------------------------------------------------------------------------------------------------


_xx = xxhash.xxh3_64_intdigest


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.array([_xx(w) for w in words], np.uint64).view(np.int64)


def _pack(w: bytes) -> tuple[int, int]:
    w = w.ljust(16, b"\0")
    return int.from_bytes(w[:8], "little", signed=True), int.from_bytes(w[8:], "little", signed=True)


def _unpack(a: int | None, b: int | None) -> bytes | None:
    return None if a is None or b is None else (a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True)).rstrip(b"\0")


def _count(it):
    """(h, n, w1, w2): word counts by 64-bit hash, as many rows as a task has distinct words (or CACHE at a time).

    w1 and w2 hold the bytes of the words met often, if they are short: numbers that a hash aggregate can keep.
    """
    from collections import Counter

    c: Counter = Counter()

    def out():
        words = list(c)
        n = np.fromiter(c.values(), np.int64, len(words))
        often = [i for i in np.flatnonzero(n >= SAID).tolist() if len(words[i]) <= 16 and b"\0" not in words[i]]
        w = np.zeros((2, len(words)), np.int64)
        none = np.ones(len(words), bool)
        if often:
            w[:, often] = np.array([_pack(words[i]) for i in often], np.int64).T
            none[often] = False
        return pa.record_batch({"h": _hashes(words), "n": n, "w1": pa.array(w[0], mask=none), "w2": pa.array(w[1], mask=none)})

    for b in it:
        for t in as_bytes(b.column(0)):
            c.update(t.lower().split())
            if len(c) > CACHE:
                yield out()
                c.clear()
    yield out()


def side(distinct: int) -> int:
    """Classes, and members of each: their product, the symbols, grows with the root of the distinct words."""
    return max(SIDE, int(np.ceil(distinct**0.25)))


def split(symbols: int, distinct: int) -> tuple[int, int]:
    """Words with a symbol of their own, all if they fit and else half of the symbols, and buckets for the others."""
    own = distinct if distinct <= symbols - 2 else min(symbols // 2, FREQUENT)
    return own, symbols - 1 - own


class Words:
    """Codes of words: their place among the frequent, or -1 and a hash; and their symbols."""

    def __init__(self, frequent: np.ndarray, said: list[bytes | None], own: int, buckets: int):
        self.frequent, self.own, self.buckets = frequent, own, buckets
        self.order = np.argsort(frequent)
        self.sorted = frequent[self.order]
        self.said = {w: i for i, w in enumerate(said) if w is not None}

    def codes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all texts' words, the hashes of those with code -1, and each text's number of words."""
        words: list[bytes] = []
        sizes = []
        for t in texts:
            w = t.lower().split()
            words += w
            sizes.append(len(w))
        get = self.said.get
        codes = np.array([get(w, -1) for w in words], np.int64)
        miss = np.flatnonzero(codes < 0)
        h = _hashes([words[i] for i in miss.tolist()])
        if len(self.sorted):  # frequent words whose text is not known
            at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            hit = self.sorted[at] == h
            codes[miss[hit]] = self.order[at[hit]]
            h = h[~hit]
        return codes, h, np.array(sizes, np.int64)


    def symbols(self, codes: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Symbols of codes, h the hashes of those with code -1."""
        s = codes + 1
        s[codes < 0] = self.own + 1 + h % self.buckets
        tail = np.flatnonzero(codes >= self.own)
        s[tail] = self.own + 1 + self.frequent[codes[tail]] % self.buckets
        return s.astype(np.int32)


# -- the network ---------------------------------------------------------------------------------------------



def shapes(n: int) -> dict[str, tuple[int, ...]]:
    """Shapes of the parameters with n classes of n members."""
    return {"wx": (n * n, 3 * H), "u": (H, 3 * H), "wc": (H, n), "bc": (n,), "wo": (n, H, n), "bo": (n, n)}


def fresh(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters that start as the unigram model of the symbol counts."""
    rng = np.random.default_rng(11)
    n = isqrt(len(counts))
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in shapes(n).items()}
    c = (counts.astype(np.float64) + 0.1).reshape(n, n)
    p["bc"] = np.log(c.sum(1) / c.sum()).astype(np.float32)
    p["bo"] = np.log(c / c.sum(1, keepdims=True)).astype(np.float32)
    p["wc"] *= 0
    p["wo"] *= 0
    return p


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in shapes(0)]).astype(np.float32, copy=False)


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    a, b, c = 4 * H + 1, H + 1, 3 * H * H - len(flat)  # the length is a*n*n + b*n + 3*H*H
    for k, s in shapes(round(((b * b - 4 * a * c) ** 0.5 - b) / (2 * a))).items():
        n = int(np.prod(s))
        out[k] = np.asarray(flat[at : at + n], np.float32).reshape(s)
        at += n
    return out


def lanes(texts: list[np.ndarray], most: int) -> list[list[int]]:
    """Texts dealt to lanes of nearly equal length, longest lane first."""
    import heapq

    n = max(1, min(most, len(texts), sum(map(len, texts)) // (4 * WINDOW) or 1))
    heap = [(0, i) for i in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        size, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (size + len(texts[i]), k))
    return sorted(out, key=lambda x: -sum(len(texts[i]) for i in x))


def windows(texts: list[np.ndarray], most: int, window: int = WINDOW, before: np.ndarray | None = None):
    """Yield (inputs, targets, starts, owners) of `window` steps by the lanes still running.

    starts marks where a text begins (its lane takes that text's first state); target -1 pads a lane's last
    window. before holds the input at each text's start, by default the end symbol.
    """
    deal = lanes(texts, most)
    order = [i for x in deal for i in x]
    size = np.fromiter((len(texts[i]) for i in order), np.int64, len(order))
    target = np.concatenate([texts[i] for i in order])
    owner = np.repeat(order, size)
    given = np.zeros(len(target), np.int32)
    given[1:] = target[:-1]
    first = np.cumsum(size) - size
    given[first] = 0 if before is None else before[order]
    begins = np.zeros(len(target), bool)
    begins[first] = True
    end = np.cumsum(np.fromiter((sum(len(texts[i]) for i in x) for x in deal), np.int64, len(deal)))
    begin = np.concatenate(([0], end[:-1]))
    for t in range(0, int(end[0]), window):
        live = int((end - begin > t).sum())
        at = begin[:live] + t + np.arange(window)[:, None]
        ok = at < end[:live]
        at = np.where(ok, at, 0)
        yield np.where(ok, given[at], 0), np.where(ok, target[at], -1), begins[at] & ok, owner[at]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.tanh(x * np.float32(0.5))
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


def run(p: dict, x: np.ndarray, start: np.ndarray, h: np.ndarray, keep: list | None = None, first: np.ndarray | None = None) -> np.ndarray:
    """States after each step (steps, lanes, H); keep collects what backpropagation needs.

    first (steps, lanes, H) holds the states that lanes take where start says so, by default zeros.
    """
    gx = p["wx"][x]
    out = np.empty((*x.shape, H), np.float32)
    for t in range(len(x)):
        fresh_lanes = np.flatnonzero(start[t])
        if len(fresh_lanes):
            h = h.copy()
            h[fresh_lanes] = 0 if first is None else first[t, fresh_lanes]
        hu = h @ p["u"]
        rz = _sigmoid(gx[t, :, : 2 * H] + hu[:, : 2 * H])
        r, z = rz[:, :H], rz[:, H:]
        n = np.tanh(gx[t, :, 2 * H :] + r * hu[:, 2 * H :])
        if keep is not None:
            keep.append((h, r, z, n, hu[:, 2 * H :]))
        h = n + z * (h - n)
        out[t] = h
    return out


def _by_class(y: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that puts targets of a class next to each other, and (class, from, to) of the classes that occur."""
    cls = (y // n).astype(np.int16)  # sixteen bits are sorted by radix
    order = np.argsort(cls, kind="stable")
    edge = np.searchsorted(cls[order], np.arange(n + 1)).tolist()
    return order, [(c, edge[c], edge[c + 1]) for c in range(n) if edge[c] < edge[c + 1]]


LIMIT = np.float32(60)  # logits are held within it, so that no exponential overflows


def _reach(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest logit that states within -1 and 1 can give, for each class."""
    return (np.abs(w).sum(-2) + np.abs(b)).max(-1)


def _logits(w: np.ndarray, b: np.ndarray, h: np.ndarray, reach: float) -> np.ndarray:
    """Outcomes by rows, states by columns: sums over outcomes then run along memory."""
    a = w.T @ h
    a += b[:, None]
    return a if reach < LIMIT else np.clip(a, -LIMIT, LIMIT, out=a)


def log_probs(p: dict, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probabilities of targets y given states h (n, H): log P(class) + log P(member | class)."""
    n = len(p["bc"])
    order, parts = _by_class(y, n)
    y, h = y[order], np.ascontiguousarray(h[order].T)
    at = np.arange(len(y))
    a = _logits(p["wc"], p["bc"], h, float(_reach(p["wc"], p["bc"])))
    lp = a[y // n, at]
    lp -= np.log(np.exp(a, out=a).sum(0))
    reach = _reach(p["wo"], p["bo"]).tolist()
    member = y % n
    for c, i, j in parts:
        a = _logits(p["wo"][c], p["bo"][c], h[:, i:j], reach[c])
        lp[i:j] += a[member[i:j], at[: j - i]]
        lp[i:j] -= np.log(np.exp(a, out=a).sum(0))
    out = np.empty(len(y), np.float32)
    out[order] = lp
    return out


def _softmax_gradient(a: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    np.exp(a, out=a)
    a /= a.sum(0)
    a[y, at] -= 1
    return a


def gradient(p: dict, x: np.ndarray, y: np.ndarray, start: np.ndarray, h0: np.ndarray, first: np.ndarray | None = None) -> tuple[dict, np.ndarray]:
    """Mean gradient of a window (truncated at its start), and the state to carry on.

    That of wx is sparse: the symbols that occur, and their rows.
    """
    steps: list = []
    hs = run(p, x, start, h0, steps, first)
    size = len(p["bc"])
    ok = np.flatnonzero(y.ravel() >= 0)
    order, parts = _by_class(y.ravel()[ok], size)
    ok = ok[order]
    flat, t = np.ascontiguousarray(hs.reshape(-1, H)[ok].T), y.ravel()[ok]
    at = np.arange(len(t))
    g = {k: np.zeros(s, np.float32) for k, s in shapes(size).items() if k in ("wo", "bo")}
    d = _softmax_gradient(_logits(p["wc"], p["bc"], flat, float(_reach(p["wc"], p["bc"]))), t // size, at)
    g["wc"], g["bc"] = flat @ d.T, d.sum(1)
    dh = p["wc"] @ d
    reach = _reach(p["wo"], p["bo"]).tolist()
    member = t % size
    for c, i, j in parts:
        hk = flat[:, i:j]
        d = _softmax_gradient(_logits(p["wo"][c], p["bo"][c], hk, reach[c]), member[i:j], at[: j - i])
        g["wo"][c], g["bo"][c] = hk @ d.T, d.sum(1)
        dh[:, i:j] += p["wo"][c] @ d
    every = np.zeros((y.size, H), np.float32)
    every[ok] = dh.T
    every = every.reshape(*y.shape, H)
    # what does not depend on the later steps is computed for all steps at once
    h, r, z, n, hn = (np.stack(v) for v in zip(*steps, strict=True))
    to_z, to_n, to_r = (h - n) * z * (1 - z), (1 - z) * (1 - n * n), hn * r * (1 - r)
    dgx, dhu = np.empty((*x.shape, 3 * H), np.float32), np.empty((*x.shape, 3 * H), np.float32)
    back, back_u = np.zeros((x.shape[1], H), np.float32), np.ascontiguousarray(p["u"].T)
    for s in range(len(x) - 1, -1, -1):
        back += every[s]
        v = dhu[s]
        dn = back * to_n[s]
        np.multiply(back, to_z[s], out=v[:, H : 2 * H])
        np.multiply(dn, to_r[s], out=v[:, :H])
        np.multiply(dn, r[s], out=v[:, 2 * H :])
        dgx[s, :, 2 * H :] = dn
        back *= z[s]
        back += v @ back_u
        if start[s].any():
            back[start[s]] = 0
    dgx[:, :, : 2 * H] = dhu[:, :, : 2 * H]
    g["u"] = h.reshape(-1, H).T @ dhu.reshape(-1, 3 * H)
    ids = x.ravel().astype(np.uint16 if size <= 256 else np.int32)
    order = np.argsort(ids, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], ids[order][1:] != ids[order][:-1])))
    g["wx"] = np.add.reduceat(dgx.reshape(-1, 3 * H)[order], edge)
    for k in g:
        g[k] /= max(1, len(ok))
    return g | {"rows": ids[order[edge]].astype(np.int64)}, hs[-1]


class Adam:
    """Adam's steps in place; rows of wx move only when their symbol occurs."""

    def __init__(self) -> None:
        self.m: dict[str, np.ndarray] = {}
        self.v: dict[str, np.ndarray] = {}
        self.t = 0

    def step(self, p: dict, g: dict) -> None:
        rows, names = g["rows"], list(shapes(0))
        norm = float(sum(np.vdot(g[k], g[k]) for k in names)) ** 0.5
        shrink = np.float32(1 / max(1.0, norm))
        self.t += 1
        rate = np.float32(RATE * (1 - 0.99**self.t) ** 0.5 / (1 - 0.9**self.t))
        for k in names:
            if k not in self.m:
                self.m[k], self.v[k] = np.zeros_like(p[k]), np.zeros_like(p[k])
            x = g[k]
            x *= shrink
            m, v = (self.m[k][rows], self.v[k][rows]) if k == "wx" else (self.m[k], self.v[k])
            m *= np.float32(0.9)
            m += np.float32(0.1) * x
            v *= np.float32(0.99)
            x *= x
            x *= np.float32(0.01)
            v += x
            if k == "wx":
                self.m[k][rows], self.v[k][rows] = m, v
            np.sqrt(v, out=x)
            x += np.float32(1e-6)
            np.divide(m, x, out=x)
            x *= rate
            if k == "wx":
                p[k][rows] -= x
            else:
                p[k] -= x


def pieces(p: dict, texts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Texts cut to PIECE symbols, and for each piece the symbol before it and the state the text has reached there.

    The states of long texts are found by running the network over them, side by side, without backpropagation.
    """
    out, before, states = [], [], []
    long = sorted((t for t in texts if len(t) > PIECE), key=len, reverse=True)
    for t in texts:
        if len(t) <= PIECE:
            out.append(t)
            before.append(0)
            states.append(np.zeros(H, np.float32))
    for g in range(0, len(long), LANES):
        live, h = long[g : g + LANES], np.zeros((len(long[g : g + LANES]), H), np.float32)
        for k in range(0, len(live[0]), PIECE):
            live = [t for t in live if len(t) > k]
            h = h[: len(live)]
            for i, t in enumerate(live):
                out.append(t[k : k + PIECE])
                before.append(int(t[k - 1]) if k else 0)
                states.append(h[i].copy())
            live = [t for t in live if len(t) > k + PIECE]
            if not live:
                break
            h = h[: len(live)]
            x = np.stack([np.concatenate((t[k - 1 : k] if k else [0], t[k : k + PIECE - 1])) for t in live], 1).astype(np.int32)
            for s in range(0, PIECE, SPAN):
                h = run(p, x[s : s + SPAN], np.zeros(x[s : s + SPAN].shape, bool), h)[-1]
    return out, np.array(before, np.int32), np.stack(states)


def train(flat: np.ndarray, texts: list[np.ndarray], adam: Adam) -> np.ndarray:
    """One pass over texts (symbols with ends): a step a window, the state carried to the next and through whole texts."""
    flat = flat.copy()
    p, h = unpack(flat), np.zeros((0, H), np.float32)
    texts, before, states = pieces(p, texts)
    for x, y, start, owner in windows(texts, LANES, before=before):
        h = np.zeros((x.shape[1], H), np.float32) if not len(h) else h[: x.shape[1]]
        g, h = gradient(p, x, y, start, h, states[owner] if start.any() else None)
        adam.step(p, g)  # p are views of flat
    return flat


def score(p: dict, texts: list[np.ndarray]) -> np.ndarray:
    """Each text's log10 probability, the end included, with the state carried through the whole text."""
    out = np.zeros(len(texts))
    h = np.zeros((0, H), np.float32)
    for x, y, start, owner in windows(texts, 2 * LANES, SPAN):
        h = np.zeros((x.shape[1], H), np.float32) if not len(h) else h[: x.shape[1]]
        hs = run(p, x, start, h)
        h = hs[-1]
        ok = np.flatnonzero(y.ravel() >= 0)
        lp = log_probs(p, hs.reshape(-1, H)[ok], y.ravel()[ok])
        out += np.bincount(owner.ravel()[ok], lp.astype(np.float64), len(texts))
    return out / np.log(10)


# -- the operator --------------------------------------------------------------------------------------------


@dataclass
class Model:
    """A fitted network with the counts it needs: those of frequent words, and of all words as a table (h, c)."""

    flat: np.ndarray
    words: tuple  # hashes and texts of the frequent words, words with a symbol of their own, buckets
    freq_c: np.ndarray
    shares: np.ndarray  # log10 of each bucket's smoothed count
    counts: DataFrame
    ends: int
    train_tokens: int
    vocabulary: int


def _learned(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d, (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10) == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", symbols: int | None = None) -> Model:
    """The model of the documents that are not held out. symbols: those of the network, a square; by default as side() says.

    Word counts are sums of per-task counts over all training documents. Training reads all training
    documents: each of ROUNDS parts is trained on in parallel from the last mean of the models, and the
    models are averaged, weighted by tokens, chunk by chunk on the executors.
    """
    d, held = _learned(docs, id_col, text_col)
    learn = d.where(~held)
    counts = durable(learn.select("text").mapInArrow(_count, "h long, n long, w1 long, w2 long").groupBy("h").agg(F.sum("n").alias("c"), F.max("w1").alias("w1"), F.max("w2").alias("w2")), "counts")
    ends = learn.count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "h").limit(FREQUENT).collect()  # bounded by FREQUENT
    freq_h, freq_c = (np.array([r[i] for r in top], np.int64) for i in (0, 1))
    size = symbols or side(distinct) ** 2
    own, buckets = split(size, distinct)
    sym, kinds = np.zeros(size, np.int64), np.zeros(buckets, np.int64)
    for b, c, k in counts.groupBy(F.pmod("h", F.lit(buckets)).cast("int")).agg(F.sum("c"), F.count("*")).collect():  # bounded by the symbols
        sym[own + 1 + b], kinds[b] = c, k
    np.subtract.at(sym, own + 1 + freq_h[:own] % buckets, freq_c[:own])
    np.subtract.at(kinds, freq_h[:own] % buckets, 1)
    sym[0], sym[1 : own + 1] = ends, freq_c[:own]
    words = (freq_h, [_unpack(r[2], r[3]) for r in top], own, buckets)
    flat = pack(fresh(sym))
    for k in range(ROUNDS):
        flat = _round(learn, k, flat, words)
    return Model(flat, words, freq_c, np.log10(sym[own + 1 :] + 0.1 * (kinds + 1)), counts, ends, total + ends, distinct + (ends > 0))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Documents whose crc32 of the id as text leaves a remainder other than 0 modulo 10 are trained on; a null
    id counts as the empty text. Tokens are A-Z-lowered words and one end; null text has the end alone.
    base_score is the smoothed unigram log10 probability. score is the network's: its symbols grow with the
    distinct training words (side). The most frequent words have one each; all others are hashed to buckets,
    seen as input and predicted from context as those, and have their smoothed share of the bucket's counts,
    so that the probabilities of all texts sum to at most 1. Repeated rows are scored each, words of equal
    counts are ranked by hash, and very long texts are scored whole, the state carried through. Other columns,
    whatever their names, are ignored. An empty table gives no rows.

    The FREQUENT largest counts go to all tasks; every other word of a document is joined with its count.
    """
    d, held = _learned(docs, id_col, text_col)
    m = model or fit(docs, id_col, text_col)
    ends, n_train, counts = m.ends, m.train_tokens, m.counts
    z = n_train + 0.1 * (m.vocabulary + 1)
    sent = docs.sparkSession.sparkContext.broadcast((m.flat, m.words, m.freq_c, m.shares))

    schema = "doc_id long, held_out boolean, n_tokens long, n_freq long, base double, net double, other double, rare_h array<long>, rare_n array<int>"

    def work(it):
        params, known, fc, share = sent.value
        p, words, own = unpack(params), Words(*known), known[2]
        logs = np.log10(np.append(fc, 0) + 0.1)  # the last, at -1, is not used
        for b in it:
            held_out = b.column(2)
            rows: list[tuple] = []
            texts = []
            raw = as_bytes(b.column(1))
            for i, j in batches(raw):
                codes, hashes, sizes = words.codes(raw[i:j])
                every = words.symbols(codes, hashes)
                at = np.concatenate(([0], np.cumsum(sizes)))
                rare = codes < 0
                lost = np.concatenate(([0], np.cumsum(rare)))[at]  # rare words before each text
                owner = np.repeat(np.arange(j - i), sizes)
                base = np.bincount(owner, np.where(rare, 0.0, logs[codes]), j - i)
                k = np.flatnonzero(every > own)
                tail = np.bincount(owner[k], np.where(rare[k], 0.0, logs[codes[k]]) - share[every[k] - own - 1], j - i)
                texts += [np.append(t, np.int32(0)) for t in np.split(every, at[1:-1])] if len(sizes) else []
                for n, x, y, known_sum, other in zip(sizes.tolist(), lost[:-1].tolist(), lost[1:].tolist(), base.tolist(), tail.tolist(), strict=True):
                    h, c = np.unique(hashes[x:y], return_counts=True)
                    rows.append((n + 1, n - (y - x), known_sum, other, h, c.astype(np.int32)))
            net = score(p, texts) if texts else np.zeros(0)
            col = lambda i, k: pa.array([r[i] for r in rows], k)
            yield pa.record_batch([b.column(0), held_out, col(0, pa.int64()), col(1, pa.int64()), col(2, pa.float64()), pa.array(net, pa.float64()), col(3, pa.float64()), _lists(rows, 4, pa.int64()), _lists(rows, 5, pa.int32())], names=[x.split()[0] for x in schema.split(", ")])

    rows = d.select("doc_id", "text", held.alias("held_out")).mapInArrow(work, schema)
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", F.expr("inline(arrays_zip(rare_h, rare_n))")).join(counts.select("h", "c"), F.col("rare_h") == F.col("h"), "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("rare_n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("lr"), F.sum(F.when(F.col("c") > 0, F.col("rare_n")).otherwise(0)).alias("kr"))
    end = log10(ends + 0.1)
    lz = log10(z)
    lr = F.coalesce("lr", F.lit(0.0))
    return rows.drop("rare_h", "rare_n").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_freq") + F.coalesce("kr", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + lr + end - F.col("n_tokens") * lz).alias("base_score"),
        (F.col("net") + F.col("other") + lr).alias("score"))


def _lists(rows: list[tuple], i: int, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(r[i]) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *(r[i] for r in rows)]).astype(kind.to_pandas_dtype()), kind))


def _round(learn: DataFrame, k: int, flat: np.ndarray, known: tuple) -> np.ndarray:
    """Train on the k-th part in every task, and average the models."""
    part = learn.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == k).select("text")
    sent = learn.sparkSession.sparkContext.broadcast((flat, known))

    def work(it):
        mine, frequent = sent.value
        words, adam, tokens = Words(*frequent), Adam(), 0
        for b in it:
            texts = []
            raw = as_bytes(b.column(0))
            for i, j in batches(raw):
                codes, h, sizes = words.codes(raw[i:j])
                texts += [np.append(s, np.int32(0)) for s in np.split(words.symbols(codes, h), np.cumsum(sizes)[:-1])]
            if texts:
                mine = train(mine, texts, adam)
                tokens += sum(map(len, texts))
        if tokens:
            parts = [mine[i : i + CHUNK].tobytes() for i in range(0, len(mine), CHUNK)]
            yield pa.record_batch({"chunk": pa.array(range(len(parts)), pa.int32()), "tokens": pa.array([float(tokens)] * len(parts)), "v": pa.array(parts, pa.binary())})

    def mean(t: pa.Table) -> pa.Table:
        w = t["tokens"].to_numpy()
        v = sum(x * np.frombuffer(y, np.float32).astype(np.float64) for x, y in zip(w, t["v"].to_pylist(), strict=True)) / w.sum()
        return pa.table({"chunk": t["chunk"].slice(0, 1), "v": pa.array([v.astype(np.float32).tobytes()], pa.binary())})

    models = part.mapInArrow(work, "chunk int, tokens double, v binary").groupBy("chunk").applyInArrow(mean, "chunk int, v binary").collect()
    if not models:
        return flat
    return np.concatenate([np.frombuffer(r.v, np.float32) for r in sorted(models, key=lambda r: r.chunk)])
