from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

from barloom.llm import suffix


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = 1
        gone[-1] = 0
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()),
                    int((np.diff(np.concatenate([[0], gone])) == 1).sum()),
                    hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, docs, rows):
    want = Counter((d, *x) for (d, _), x in zip(rows, brute([t for _, t in rows])))
    got = suffix.remove(docs, with_bytes=True).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256)
                   for r in got) == want
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_equals_every_window(spark, docs, rows):
    check(spark, docs, [r[:2] for r in rows])


def test_periodic_and_boundary_texts(spark):
    rng = random.Random(2)
    w = "".join(rng.choices("abcdefgh ", k=1500))
    rows = [(1, "x" * 450), (2, "ab" * 150), (3, "ab" * 99 + "a"), (4, w), (5, "q" + w[300:499]),
            (6, "r" + w[300:500]), (7, w[700:900] + "zz" + w[901:1101]), (8, w[:199]),
            (9, w[1300:] + w[1301:]), (10, "é" * 130 + "x"), (11, "yé" + "é" * 110),
            (12, "p" * 199), (13, w[50:250] * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = __import__("tempfile").mkdtemp(prefix="spark-", dir="/tmp") + "/t"
    df.write.parquet(path)
    check(spark, spark.read.parquet(path), rows)


def test_empty_table(empty):
    assert suffix.remove(empty).collect() == []


def test_rounds_equal_window_sets():
    """The column rounds against sets of windows, on aligned pieces with few symbols."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 3, suffix.COLUMNS)
    m = 60
    symbols = np.tile(base, (m, 1)).astype(np.uint16)
    for i in range(m):
        at = rng.integers(0, suffix.COLUMNS, rng.integers(0, 3))
        symbols[i, at] = rng.integers(0, 3, len(at))
    low = rng.integers(0, 60, m)
    size = 200 + rng.integers(0, 40, m)
    group = rng.integers(0, 4, m)
    for i in range(m):
        symbols[i, :low[i]] = symbols[i, low[i] + size[i]:] = suffix.ABSENT
    hit = suffix.repeated(symbols, group, low, size)
    seen = Counter()
    for i in range(m):
        for s in range(low[i], low[i] + size[i] - 199):
            seen[group[i], s, symbols[i, s:s + 200].tobytes()] += 1
    for i in range(m):
        for s in range(hit.shape[1]):
            inside = low[i] <= s <= low[i] + size[i] - 200
            assert hit[i, s] == (inside and seen[group[i], s, symbols[i, s:s + 200].tobytes()] > 1)


def test_long_text_is_cut_with_overlap(monkeypatch):
    rng = np.random.default_rng(7)
    buf = rng.integers(97, 100, 5000).astype(np.uint8)
    offs = np.array([0, 4000, 5000])
    whole = set(zip(*[x.tolist() for x in suffix.anchors(buf, offs)[:1]]))
    monkeypatch.setattr(suffix, "STRETCH", 700)
    token, place, first, last, row = suffix.anchors(buf, offs)
    assert set(zip(token.tolist())) == whole
    covered = sorted({s for a, b in zip(first, last) for s in range(a, b + 1)})
    assert covered == [*range(0, 3801), *range(4000, 4801)]
