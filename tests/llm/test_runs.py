from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(ids, least=runs.LEAST):
    """All runs from the definition: maximal stretches for each period, smallest period."""
    n, best, a = len(ids), {}, np.asarray(ids)
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[False], a[:-q] == a[q:], [False]])
        for s, e in np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2).tolist():
            if e + q - s >= max(least, 2 * q):
                best.setdefault((s, e + q), q)
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def planted(doc, text):
    """(words of the text as the contract plants them)."""
    words = WORD.findall(text or "")
    n = len(words)
    if doc is None or not n:
        return words
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected(doc, text):
    words = planted(doc, text)
    names = {}
    found = brute([names.setdefault(w, len(names)) for w in words])
    kept = [w for i, w in enumerate(words)
            if not any(s + q <= i < s + n for s, n, q in found)]
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc, len(found), *(top or (None,) * 3),
            top and 1000 * top[1] // top[2], hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(" ".join(kept).encode()).hexdigest())


def sequences():
    rng = random.Random(4)
    yield from ([], [0], [0] * 11, [0] * 12, [0] * 13, [0] * 500, [0, 1] * 6, [0, 1] * 50)
    for _ in range(400):
        letters = rng.choice([1, 2, 2, 3, 4, 20])
        ids = [rng.randrange(letters) for _ in range(rng.randint(1, 90))]
        yield ids
        p = rng.randint(1, 30)
        unit = [rng.randrange(letters) for _ in range(p)]
        tail = (unit * 12)[:rng.randint(p, 12 * p)]
        yield ids + tail + ids[::-1] + tail
        yield [i % rng.choice([p, p + 1]) for i in range(120)]
    a, b = [0], [0, 1]
    while len(b) < 1500:  # a Fibonacci word has the most runs of all
        a, b = b, b + a
    yield b
    yield [bin(i).count("1") % 2 for i in range(700)]


def test_runs_equal_the_definition():
    for ids in sequences():
        assert runs.find_runs(ids) == brute(ids), ids


def test_grammar_gives_the_sequence_back():
    rng = random.Random(6)
    for _ in range(100):
        ids = [rng.randrange(3) for _ in range(rng.randint(1, 200))]
        left, rules, size = runs.re_pair(ids, 3)

        def expand(x):
            return expand(rules[x][0]) + expand(rules[x][1]) if x in rules else [x]
        assert [y for x in left for y in expand(x)] == ids
        assert all(len(expand(x)) == n for x, n in size.items())
        pairs = [p for p in zip(left, left[1:]) if p[0] != p[1]]
        assert len(set(pairs)) == len(pairs)


def test_depth_of_a_long_repeat():
    """A text repeated once has pairs of equal frequency throughout; its grammar stays shallow."""
    ids = list(range(4000)) * 2
    _, rules, _ = runs.re_pair(ids, 4000)
    depth = {}
    for x in sorted(rules):
        depth[x] = 1 + max(depth.get(y, 0) for y in rules[x])
    assert max(depth.values()) <= 16
    assert runs.find_runs(ids) == [(0, 8000, 4000)]


@pytest.fixture(scope="module")
def texts(rows):
    out = [(d, t) for d, t, *_ in rows]
    rng = random.Random(11)
    line = "the same line of seven words again \n"
    for i in range(200, 320):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 120))]
        out.append((i, " ".join(words) + line * rng.choice([0, 0, 2, 5])))
    return out + [(-5, line * 9), (2 ** 62, line * 4), (9, "a b " * 20), (10, "x\x1fy z " * 30)]


def test_report_equals_the_definition(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for c in ("k0", "t", "runs", "collapsed", "start", "top", "i"):
        df = df.withColumn(c, F.lit("clash"))
    got = sorted((tuple(r) for r in runs.report(df).collect()), key=repr)
    assert got == sorted((expected(d, t) for d, t in texts), key=repr)
    assert sum(r[1] > 0 for r in got) > 30


def test_empty_table(spark, empty):
    assert runs.report(empty).collect() == []
    out = runs.runs(empty, ["doc_id", "lang"])
    assert out.columns == ["doc_id", "lang", "runs", "collapsed"] and out.count() == 0
