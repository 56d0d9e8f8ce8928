"""SentencePiece BPE encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import as_bytes

SPACE = "▁"
_NONE = np.int64(2**62)
WORDS, SYMBOLS = 400_000, 6_000_000  # what a worker's cache of encoded words may hold before it starts anew
BATCH = 1 << 21  # characters encoded together (a longer text stands alone)


class Codec:
    """A SentencePiece BPE model with byte fallback, a dummy prefix and no rewriting of text.

    The library reads the model file; encoding and decoding are done here. A model that needs more
    (other types, normalisation, user-defined pieces, pieces with inner spaces) is refused.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.byte) != 256 or any(SPACE in self.pieces[i].lstrip(SPACE) for i in normal):
            raise ValueError("not a byte-fallback BPE model with word-bound pieces")
        self.ids = {self.pieces[i]: i for i in normal}
        # characters that only longer pieces hold become symbols without an id of their own
        self.symbol = dict(self.ids)
        for p in list(self.ids):
            for c in p:
                self.symbol.setdefault(c, n + len(self.symbol))
        score = {i: sp.get_score(i) for i in normal}
        rank = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        keys, out, ranks = [], [], []
        parents: dict[int, int] = {}  # the best rank of a piece made with this one
        held: dict[int, int] = {}
        for i in normal:
            held[rank[score[i]]] = held.get(rank[score[i]], 0) + 1
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    out.append(i)
                    ranks.append(rank[score[i]])
                    for x in (a, b):
                        parents[x] = min(parents.get(x, 1 << 40), rank[score[i]])
        order = np.argsort(keys)
        self.keys, self.out, self.ranks = (np.array(x, np.int64)[order] for x in (keys, out, ranks))
        # merging all occurrences at once equals merging them one by one only if no better pair can arise between
        self.alone = np.ones(max(self.symbol.values()) + 2, bool)
        for i in normal:
            self.alone[i] = parents.get(i, 1 << 40) <= rank[score[i]] or held[rank[score[i]]] > 1
        self.bytes_of = [b""] * n
        for i in normal:
            self.bytes_of[i] = self.pieces[i].replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.byte.values())] = True
        self.unk = sp.unk_id()
        self.unk_surface = sp.decode([self.unk]).encode()
        self._clear()

    # -- encoding

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NONE: no such piece) and merged symbol of adjacent symbols."""
        key = a << 20 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.out[at]

    def merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over the symbols of many words (word: ascending) until no pair remains.

        Returns the final symbols and their words, in order of words.
        """
        done_s, done_w = [], []
        next_rank, next_sym = self._after(sym, word)
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(next_rank, first)
            sizes = np.diff(np.concatenate((first, [len(sym)])))
            over = best == _NONE
            if over.any():
                gone = np.repeat(over, sizes)
                done_s.append(sym[gone])
                done_w.append(word[gone])
                keep = ~gone
                sym, word, next_rank, next_sym = sym[keep], word[keep], next_rank[keep], next_sym[keep]
                best, sizes = best[~over], sizes[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(next_rank == np.repeat(best, sizes))
            # in a run of overlapping pairs every second one stays; pieces that can be overtaken merge once a round
            gap = np.concatenate(([True], np.diff(hit) > 1))
            run = np.flatnonzero(gap)
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.concatenate((run, [len(hit)]))))
            w = word[hit]
            lead = np.concatenate(([True], w[1:] != w[:-1]))
            hit = hit[np.where(self.alone[next_sym[hit]], lead, place % 2 == 0)]
            sym[hit] = next_sym[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, next_rank, next_sym = sym[keep], word[keep], next_rank[keep], next_sym[keep]
            hit = moved[hit]
            near = np.concatenate((hit, hit[hit > 0] - 1))
            last = near + 1 >= len(sym)
            right = np.where(last, 0, near + 1)
            r, s = self._pair(sym[near], sym[right])
            next_rank[near] = np.where(last | (word[near] != word[right]), _NONE, r)
            next_sym[near] = s
        if not done_s:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        s, w = np.concatenate(done_s), np.concatenate(done_w)
        order = np.argsort(w, kind="stable")
        return s[order], w[order]

    def _after(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, out = np.full(len(sym), _NONE, np.int64), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            r, out[:-1] = self._pair(sym[:-1], sym[1:])
            rank[:-1] = np.where(word[:-1] == word[1:], r, _NONE)
        return rank, out

    def _learn(self, words: list[str]) -> None:
        """Encode new words (each without its leading space symbol) into the cache."""
        text = "".join(SPACE + w for w in words)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        distinct, inverse = np.unique(code, return_inverse=True)
        unknown = len(self.alone) - 1
        table = np.array([self.symbol.get(chr(c), unknown) for c in distinct.tolist()], np.int64)
        at = np.arange(len(code))
        sym = table[inverse]
        # symbols without an id go back to their characters' bytes; their places are found by counting characters
        s, w = self.merge(sym.copy(), word)
        n = len(self.pieces)
        if (s >= n).any():
            chars = np.fromiter((len(self.pieces[x]) if x < n else 1 for x in s.tolist()), np.int64, len(s))
            begin = np.cumsum(chars) - chars
            odd = np.flatnonzero(s >= n)
            raw = [chr(c).encode() for c in code[at[begin[odd]]].tolist()]
            reps = np.ones(len(s), np.int64)
            reps[odd] = [len(b) for b in raw]
            out = np.repeat(s, reps)
            out[np.repeat(s >= n, reps)] = [self.byte[x] for b in raw for x in b]
            s, w = out, np.repeat(w, reps)
        length = np.bincount(w, minlength=len(words))
        base = len(self.start)
        self.index.update(zip(words, range(base, base + len(words)), strict=True))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length))
        self.flat = np.concatenate((self.flat, s.astype(np.int32)))

    @staticmethod
    def words(text: str) -> list[str]:
        """Segments that no piece crosses, each without its leading space symbol."""
        if not text:
            return []
        out = text.split(" ")
        if "" in out or SPACE in text:
            return [x[1:] for x in _SEGMENT.findall(SPACE + text.replace(" ", SPACE))]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids, without begin and end."""
        out: list[np.ndarray] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= BATCH):
                size += len(texts[j])
                j += 1
            if len(self.index) > WORDS or len(self.flat) > SYMBOLS:
                self._clear()
            words: list[str] = []
            ends = []
            for t in texts[i:j]:
                words += self.words(t)
                ends.append(len(words))
            new = set(words).difference(self.index)
            if new:
                self._learn(list(new))
            at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
            length = self.length[at]
            stop = np.cumsum(length)
            total = int(stop[-1]) if len(stop) else 0
            ids = self.flat[np.arange(total) + np.repeat(self.start[at] - stop + length, length)]
            edge = np.concatenate(([0], stop))[np.concatenate(([0], ends))]
            out += [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            i = j
        return out

    # -- decoding

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8: control ids are silent, one leading space goes, broken bytes become U+FFFD."""
        ids = np.asarray(ids)
        if (ids == self.unk).any():
            out = b"".join(self.unk_surface if i == self.unk else self.bytes_of[i] for i in ids.tolist())
        else:
            out = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        if self.is_byte[ids].any():
            try:
                out.decode()
            except UnicodeDecodeError:
                out = self._mend(ids)
        said = ids[(ids != self.bos) & (ids != self.eos)]
        lead = len(said) and not self.is_byte[said[0]] and self.pieces[said[0]].startswith(SPACE)
        return out[1:] if lead else out

    def _mend(self, ids: np.ndarray) -> bytes:
        out, run = [], b""
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.bytes_of[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode().encode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�".encode())
                    run = run[1:]
            if i >= 0:
                out.append(self.unk_surface if i == self.unk else self.bytes_of[i])
        return b"".join(out)


_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")
_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def tokenized(docs: DataFrame, model: str | None = None, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """docs plus ids_col (array<int>, with begin and end) and, if named, decoded_col.

    Null text is encoded as empty. A column of docs with one of these names is replaced. The model file
    is part of the installation of every executor.
    """
    model = model or default_model()
    extra = [ids_col] + [decoded_col] * bool(decoded_col)
    base = docs.drop(*extra)
    schema = base.withColumn(ids_col, F.lit(None).cast("array<int>"))
    schema = schema.withColumn(decoded_col, F.lit(None).cast("string")) if decoded_col else schema

    def run(it):
        c = codec(model)
        for whole in it:
            for k in range(0, max(1, whole.num_rows), 512):  # an ids column is larger than its text
                b = whole.slice(k, 512)
                ids = [np.concatenate(([c.bos], x, [c.eos])).astype(np.int32) for x in c.encode([t.decode() for t in as_bytes(b.column(text_col))])]
                flat = np.concatenate([np.zeros(0, np.int32), *ids])
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                columns = [*b.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                if decoded_col:
                    columns.append(pa.array([c.decode(x).decode() for x in ids], pa.string()))
                yield pa.record_batch(columns, names=[*b.schema.names, *extra])

    return base.mapInArrow(run, schema.schema)


def digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    Null text is encoded as empty; null ids and repeated rows give a row each. Texts of any length are encoded
    whole. Of merges of equal rank the leftmost goes first, as in the library. Other columns, whatever their
    names, are ignored. An empty table gives no rows.
    """
    model = model or default_model()

    def run(it):
        c = codec(model)
        for whole in it:
            for k in range(0, whole.num_rows, 1024):
                b = whole.slice(k, 1024)
                n, sha, back = [], [], []
                for x in c.encode([t.decode() for t in as_bytes(b.column(1))]):
                    ids = np.concatenate(([c.bos], x, [c.eos]))
                    n.append(len(ids))
                    sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    back.append(hashlib.sha256(c.decode(ids)).hexdigest())
                yield pa.record_batch({"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(back, pa.string())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
