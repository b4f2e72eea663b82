from __future__ import annotations

import random

import numpy as np

from barloom.llm import decontam
from barloom.llm.blocks import U


def slow_tiles(text, item, least):
    """Greedy string tiling by definition."""
    free_t, free_i, out = [True] * len(text), [True] * len(item), 0
    while True:
        best = 0
        runs = []
        for i in range(len(item)):
            for t in range(len(text)):
                s = 0
                while (i + s < len(item) and t + s < len(text) and free_i[i + s] and free_t[t + s]
                       and item[i + s] == text[t + s]):
                    s += 1
                if s > best:
                    best, runs = s, [(i, t)]
                elif s == best and s:
                    runs.append((i, t))
        if best < least:
            return out
        for i, t in runs:
            if all(free_i[i:i + best]) and all(free_t[t:t + best]):
                free_i[i:i + best] = free_t[t:t + best] = [False] * best
                out += best


def test_tiles_equal_the_definition():
    rng = random.Random(1)
    for _ in range(60):
        item = [rng.randint(1, 6) for _ in range(rng.randint(0, 25))]
        text = [rng.randint(1, 6) for _ in range(rng.randint(0, 40))]
        tiles = decontam.tile(np.array(text, U), np.array(item, U), 3)
        assert sum(s for _, _, s in tiles) == slow_tiles(text, item, 3)
        assert all(item[i:i + s] == text[t:t + s] for i, t, s in tiles)


def frames(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    item = [word() for _ in range(40)]
    half = [word() for _ in range(40)]
    fill = lambda n: " ".join(word() for _ in range(n))
    moved = item[20:] + item[:20]
    docs = [
        (1, fill(50) + " " + " ".join(item) + ". " + fill(50)),
        (2, fill(9) + "\n" + ", ".join(moved).upper() + "\n" + fill(9)),
        (3, fill(30) + " " + " ".join(item[:15]) + " " + fill(30)),
        (4, fill(200)), (5, None), (6, ""), (None, " ".join(item)),
        (7, " ".join(half) + " x " + " ".join(item)), (8, " ".join(item)), (8, " ".join(item))]
    bench = [(0, " ".join(item)), (1, " ".join(half)), (2, None), (3, "too short"), (4, ""),
             (5, " ".join(item))]
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(bench, "item_id long, text string"))


def test_plain_and_reordered_leaks(spark, monkeypatch):
    docs, bench = frames(spark)
    want = sorted([(1, 0), (1, 5), (2, 0), (2, 5), (7, 0), (7, 1), (7, 5), (8, 0), (8, 0), (8, 5),
                   (8, 5), (None, 0), (None, 5)], key=repr)
    got = decontam.leaks(docs, bench).collect()
    assert sorted([(r.doc_id, r.item_id) for r in got], key=repr) == want
    assert all(r.coverage == r.n_words / r.item_words >= 0.5 for r in got)
    assert {r.n_tiles for r in got if r.doc_id == 2} == {2}
    # A benchmark in several parts gives the same.
    parts = list(decontam.parts(bench, "item_id", "text", 150))
    assert len(parts) > 1 and sorted(i for p in parts for i in p.ids) == [0, 1, 3, 4, 5]
    monkeypatch.setattr(decontam.parts, "__defaults__", (150,))
    split = decontam.leaks(docs, bench).collect()
    assert sorted(got, key=repr) == sorted(split, key=repr)


def test_awkward_rows_and_empty_tables(spark, docs, rows, empty):
    bench = spark.createDataFrame([(9, rows[12][1])], "item_id long, text string")
    hit = {r.doc_id for r in decontam.leaks(docs, bench).collect()}
    assert {20, 21, 22, 23, None} <= hit and not hit & {60, 70, 71, 82}
    kept = decontam.matches(docs, bench, ["doc_id", "text", "lang"])
    assert kept.count() == len(rows)
    assert decontam.leaks(empty, bench).collect() == []
    assert decontam.leaks(docs, bench.where("false")).collect() == []
