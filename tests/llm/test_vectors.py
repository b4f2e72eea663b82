from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.9):
    """(vec_id, n_links, component_id, kept) of each row from all pairs."""
    def usable(v):
        return (v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)
                and any(v))
    unit = [np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)) if usable(v) else None
            for _, v in rows]
    near = [[j for j, b in enumerate(unit) if j != i and a is not None and b is not None
             and len(a) == len(b) and a @ b >= least] for i, a in enumerate(unit)]
    out, seen = [None] * len(rows), {}
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        for j in group:
            seen[j] = group
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in seen[i] if rows[j][0] is not None]
        c = min(ids) if ids else None
        out[i] = (k, len(near[i]), c, k == c)
    return out


def planted(rng, dim=32, n=260):
    rows = [rng.normal(size=dim) for _ in range(n)]
    for spread, size in ((.02, 40), (.25, 60), (.42, 60)):
        centre = rng.normal(size=dim)
        rows += [centre + spread * rng.normal(size=dim) for _ in range(size)]
    step = rng.normal(size=dim), rng.normal(size=dim)
    rows += [np.cos(t) * step[0] + np.sin(t) * step[1] for t in np.arange(0, 2, .3)]  # a chain
    return [r.astype("f4").tolist() for r in rows]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    vs = planted(rng)
    vs += [vs[3], vs[3], vs[300], [2 * x for x in vs[5]], [-x for x in vs[6]]]
    vs += [[1e30] * 32, [3e-39] * 32, [1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [1.0, 2.0, 3.1, 0.0]]
    vs += [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31,
           [None] + [1.0] * 31, [1.0] * 32]
    ids = [int(x) for x in rng.permutation(len(vs))]
    rows = list(zip(ids, vs))
    return rows + [(None, vs[0]), (None, None), (7, vs[9]), (7, vs[9]), (None, [9.0, -9.0])]


@pytest.mark.parametrize("tile", [vectors.TILE, 64])
def test_links_and_components_equal_all_pairs(spark, rows, tile, monkeypatch):
    if tile < vectors.TILE:  # many tiles: links cross them
        monkeypatch.setattr(vectors, "AIM", tile)
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], SCHEMA)
    for c in ("k", "v", "node", "root", "tile", "mult", "n"):
        df = df.withColumn(c, F.lit("clash"))
    got = [tuple(r) for r in vectors.near(df).collect()]
    want = Counter(brute(rows))
    assert Counter(tuple(r) for r in got) == Counter(
        {(k, n, c, (k == c)): m for (k, n, c, _), m in want.items()})


def test_double_vectors(spark):
    rows = [(i, v) for i, v in enumerate(planted(np.random.default_rng(2), 24, 40))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in vectors.near(df).collect()) == sorted(brute(rows))


def test_empty_and_unusable_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert vectors.near(df).collect() == []
    df = spark.createDataFrame([(1, None, 0), (2, [0.0], 0)], SCHEMA)
    assert sorted(tuple(r) for r in vectors.near(df).collect()) == [
        (1, 0, 1, True), (2, 0, 2, True)]


def test_bounds_lose_no_pair():
    """Random pairs just above the threshold pass both bounds, in sparse and dense blocks."""
    rng = np.random.default_rng(5)
    for dim in (1, 2, 3, 16, 64):
        x = rng.normal(size=(300, dim))
        y = x + .48 / np.sqrt(dim) * np.linalg.norm(x, axis=1)[:, None] * rng.normal(size=x.shape)
        y[150:] = rng.normal(size=(150, dim))
        basis = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        a, b = vectors.Tile(x, basis), vectors.Tile(y, basis)
        got = {(int(i), int(j)) for p in vectors.hits(a, b, .9) for i, j in zip(*p)}
        want = {(int(i), int(j)) for i, j in zip(*np.nonzero(a.unit @ b.unit.T >= .9))}
        assert got == want and (dim > 2) <= (len(want) < 300 * 300 / 2)


def test_far_tiles_never_meet(spark):
    """Two far clusters: the boxes of their tiles are apart, so no pair of them is compared."""
    boxes = [(t, 2, [c, 0.0], [c + .05, .1]) for t, c in enumerate((-.9, -.6, .1, .5))]
    tiles = spark.createDataFrame(boxes, "tile long, dim int, lo array<double>, hi array<double>")
    got = sorted(tuple(r) for r in vectors._tile_pairs(tiles, .9).collect())
    assert got == [(0, 1), (2, 3)]
