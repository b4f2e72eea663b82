from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from barloom.llm import jaccard

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x)
         for x in WORD.findall((text or "").encode())]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    """(n_shingles, component) of each row, components by position."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = [find(i) for i in range(len(rows))]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if groups[j] == groups[i]]
        known = [x for x in ids if x is not None]
        out.append((d, len(sets[i]), (min(known) if known else None) if sets[i] else d))
    return out, groups, sets


def test_classes_equal_all_pairs(docs, rows):
    want, _, _ = brute([r[:2] for r in rows])
    got = [tuple(r) for r in jaccard.classes(docs).collect()]
    assert Counter(got) == Counter(want)


def test_one_of_each_keeps_one_row_of_every_component(docs, rows):
    plain = [r[:2] for r in rows]
    _, groups, sets = brute(plain)
    got = jaccard.one_of_each(docs, ["doc_id", "text"]).collect()
    n = len({g for g, s in zip(groups, sets) if s}) + sum(not s for s in sets)
    assert len(got) == n
    assert not Counter(tuple(r) for r in got) - Counter(plain)
    first = {}
    for (d, t), g, s in zip(plain, groups, sets):
        if s:
            first.setdefault(g, []).append(d)
    ids = {r.doc_id for r in got}
    assert all(min(x for x in d if x is not None) in ids for d in first.values()
               if any(x is not None for x in d))


def test_empty_table(empty):
    assert jaccard.classes(empty).collect() == []


def test_prefixes_of_linked_sets_share_a_signature():
    """Random pairs just above the threshold, frequent tokens included."""
    rng = np.random.default_rng(3)
    for n in (5, 20, 60, 300):
        for _ in range(60):
            pool = rng.choice(10 ** 6, 2 * n, replace=False).astype(np.uint64)
            levels = rng.choice([2, 10, 30, 45, 60, 80], 2 * n).astype(np.uint8)
            common = int(np.ceil(8 * n / 9 * 1.001))
            a, b = np.arange(n), np.append(np.arange(common), np.arange(n, 2 * n - common))
            if 180 * common < 80 * (len(a) + len(b)):
                continue
            x = jaccard.signatures(len(a), pool[a], levels[a])
            y = jaccard.signatures(len(b), pool[b], levels[b])
            assert len(np.intersect1d(x, y))


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(50):
        pool = rng.integers(0, 2 ** 60, 400).astype(np.uint64)
        a, b = pool[rng.random(400) < .5], pool[rng.random(400) < .5]
        bits = sum(int(x).bit_count() for x in (
            jaccard.parity(a) ^ jaccard.parity(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))


def test_large_group_with_a_centre(spark):
    """Many edits of one text: links run through the centre, isolated ones stay alone."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(words)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    want, _, _ = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id")
    assert sorted(tuple(r) for r in jaccard.classes(df).collect()) == sorted(want)
