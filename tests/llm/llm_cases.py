"""Small tables with the awkward rows, and brute-force helpers."""

import os
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgéñßö", k=rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    out = [None, "", "   \t\n", "one", "two words", "Two  WORDS", "\n\n", "a\tb\x0bc\rd", "naïve café — 東京 🦜 ▁x ▁▁ y", " not a space here"]
    base = prose(120)
    for k in range(6):  # exact and near copies
        w = base.split(" ")
        w[10 * k] = "changed"
        out += [" ".join(w), base.upper() if k == 2 else base]
    line = "This very line is repeated in many documents."
    out += [f"{prose(30)}\n{line}\n{prose(25)}" for _ in range(8)] + [f"  {line.upper()}\t\nshort\nshort", f"{line}\n{line}\n{line}"]
    out += [prose(20000), " ".join(["same"] * 500), (prose(40) + "\n") * 5, "#*$ %&| <>" * 30, "x" * 30000]
    out += [prose(rng.randint(1, 200)) for _ in range(60)]
    return out


def write(path, **tables):
    os.makedirs(path, exist_ok=True)
    for name, t in tables.items():
        pq.write_table(t, f"{path}/{name}.parquet")
    return str(path)


def documents(rows=None):
    rows = texts() if rows is None else rows
    ids = list(range(3, 3 + 2 * len(rows), 2))
    return pa.table({
        "doc_id": pa.array(ids, pa.int64()), "text": pa.array(rows, pa.string()), "lang": pa.array([None if i % 7 == 0 else "en" for i in ids], pa.string()),
        "source": pa.array([None if i % 11 == 0 else "hot" if i % 3 else f"src{i % 4}" for i in ids], pa.string()), "n_chars": pa.array([len(x or "") for x in rows], pa.int64()),
    })


def labels(docs):
    ids = docs["doc_id"].to_pylist()
    bad = [i % 5 == 0 for i in ids]
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array([None if i % 13 == 0 else int(not b) for i, b in zip(ids, bad, strict=True)], pa.int32()), "toxic": pa.array([None if i % 17 == 0 else 0 for i in ids], pa.int32())})


def roots(ids, links):
    """Smallest id reachable, by brute force."""
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low
