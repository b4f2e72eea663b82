"""Near copies among embeddings: tiles compared along principal directions.

Every pair of vectors with a cosine of at least the threshold is found, exactly:

1. equal vectors become one, with a count, in an aggregation with map-side combine;
2. the matrix of second moments of all unit vectors is summed up in Spark; its eigenvectors, by
   falling share of the total, are the directions along which all products accumulate;
3. vectors are ordered by their leading coordinates and dealt to tiles of bounded size, each one
   packed row; a tile knows the box of its leading coordinates. Linked unit vectors are at most
   sqrt(2 - 2 * threshold) apart, so tiles whose boxes are farther apart never meet;
4. tiles that may hold links are joined and compared. A product starts with the leading quarter of
   the directions. What the rest can add is bounded by the product of the two suffix norms
   (Cauchy and Schwarz); carried as one more coordinate, it makes the bound one matrix product.
   A pair whose bound lies below the threshold stops there, the others go on to half of the
   directions and then to the whole product in double precision. Where much of a block survives
   (a dense group), the block goes on as one matrix;
5. a pair of tiles returns link counts by vector and one edge for each two *local* components
   (components inside a tile, known beforehand) that it links. So a dense group sends edges by
   tiles, not by pairs of its members. ``components`` joins them.

Nothing is broadcast by hint; the driver sees the D*D moments of each vector length D, no more.
A task holds two tiles. The number of tile pairs grows with the square of the data where boxes
overlap, as every exact comparison along these bounds does; the screen costs D/4 multiplications a
pair in single precision.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component link with
nothing and are their own component. Vectors of different lengths never link. Equal vectors link
with each other. Null ids are rows like others; a component of null ids only has a null id.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.blocks import small_batches, tidied
from barloom.llm.jaccard import components
from barloom.plans.storage import cut

LEAST = 0.9
TILE = 16384
AIM = 12288
ROWS = 256
BOX = 8
MARGIN = 1e-5
#: Above this share of surviving pairs a block is multiplied as a matrix.
DENSE = 1 / 16
_TILES = ("tile long, dim int, data binary, mult binary, ids binary, known binary, root binary, "
          "links binary, lo array<double>, hi array<double>")


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that no square overflows."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def steps(dim: int) -> tuple[int, int]:
    """How many leading directions the first and the second bound take."""
    return max(1, dim // 4), max(1, dim // 2)


class Tile:
    """Unit vectors, the same along the principal directions, and the bound's coordinates."""

    def __init__(self, raw: np.ndarray, basis: np.ndarray):
        self.unit = _unit(raw)
        self.turned = self.unit @ basis
        first, self.half = steps(raw.shape[1])
        tails = np.cumsum((self.turned ** 2)[:, ::-1], axis=1)[:, ::-1]
        tails = np.sqrt(np.hstack([tails, np.zeros((len(raw), 1))]))
        self.screen = np.hstack([self.turned[:, :first], tails[:, first:first + 1]]).astype("f4")
        self.rest = tails[:, self.half]


def hits(a: Tile, b: Tile, least: float, same: bool = False
         ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i in ``a``, j in ``b``) of all pairs with a cosine of ``least`` or more, some
    rows of ``a`` at a time; ``same``: only j < i, both being one tile."""
    low = least - MARGIN
    for at in range(0, len(a.unit), ROWS):
        rows = slice(at, at + ROWS)
        wide = min(at + ROWS, len(b.unit)) if same else len(b.unit)
        bound = a.screen[rows] @ b.screen[:wide].T >= low
        if same:
            bound &= np.arange(wide)[None, :] < np.arange(at, at + len(bound))[:, None]
        n = np.count_nonzero(bound)
        if not n:
            continue
        if n > DENSE * bound.size:
            i, j = np.nonzero(bound & (a.unit[rows] @ b.unit[:wide].T >= least))
            yield i + at, j
            continue
        i, j = np.nonzero(bound)
        i += at
        more = (np.einsum("ij,ij->i", a.turned[i, :a.half], b.turned[j, :b.half])
                + a.rest[i] * b.rest[j]) >= low
        i, j = i[more], j[more]
        found = np.einsum("ij,ij->i", a.unit[i], b.unit[j]) >= least
        yield i[found], j[found]


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the components of each ``i`` and ``j``; the smaller label stays."""
    while True:
        x, y = labels[i], labels[j]
        apart = x != y
        if not apart.any():
            return labels
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent != parent[parent]).any():
            parent = parent[parent]
        labels = parent[labels]


def inside(tile: Tile, mult: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(links to other vectors of the tile, smallest position of the local component)."""
    links, labels = np.zeros(len(mult), np.int64), np.arange(len(mult))
    for i, j in hits(tile, tile, least, same=True):
        np.add.at(links, i, mult[j])
        np.add.at(links, j, mult[i])
        labels = _merge(labels, i, j)
    return links, labels


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _moments(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By vector length: the principal directions of the unit vectors, as columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in tidied(batches):
            v = b.column("v")
            size = pa.compute.list_value_length(v).to_numpy(zero_copy_only=False)
            for d in np.unique(size):
                u = _unit(_matrix(v.filter(pa.array(size == d))))
                sums[int(d)] = sums.get(int(d), 0) + u.T @ u
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()),
             pa.array([m[np.triu_indices(d)] for d, m in sums.items()],
                      pa.list_(pa.float64()))], names=["dim", "m"])

    rows = (small_batches(vectors).mapInArrow(run, "dim int, m array<double>")
            .select("dim", F.posexplode("m").alias("at", "x"))
            .groupBy("dim", "at").agg(F.sum("x").alias("x")).toArrow())
    dims, at, x = (rows.column(c).to_numpy() for c in ("dim", "at", "x"))
    out = {}
    for d in np.unique(dims):
        m = np.zeros((d, d))
        mine = dims == d
        upper = np.triu_indices(d)
        m[upper[0][at[mine]], upper[1][at[mine]]] = x[mine]
        _, columns = np.linalg.eigh(m + np.triu(m, 1).T)
        out[int(d)] = columns[:, ::-1].copy()
    return out


def _ordered(vectors: DataFrame, bases: dict[int, np.ndarray], step: float) -> DataFrame:
    """With the cells of the three leading coordinates, and the fourth."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidied(batches):
            v = b.column("v")
            size = pa.compute.list_value_length(v).to_numpy(zero_copy_only=False)
            lead = np.zeros((b.num_rows, 4))
            for d in np.unique(size):
                mine = size == d
                k = min(4, d)
                lead[mine, :k] = _unit(_matrix(v.filter(pa.array(mine)))) @ bases[int(d)][:, :k]
            cell = np.floor(lead[:, :3] / step).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(size, pa.int32()), *[pa.array(c) for c in cell.T],
                 pa.array(lead[:, 3])],
                names=[*b.schema.names, "dim", "c0", "c1", "c2", "c3"])

    kinds = ", ".join(f"{c} {t}" for c, t in vectors.dtypes)
    return small_batches(vectors).mapInArrow(
        run, f"{kinds}, dim int, c0 int, c1 int, c2 int, c3 double")


def _tiles(ordered: DataFrame, bases: dict[int, np.ndarray], count: int,
           least: float) -> DataFrame:
    order = ["dim", "c0", "c1", "c2", "c3", F.xxhash64("v")]
    dealt = ordered.repartitionByRange(count, *order).coalesce(count)

    def pack(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        raw = _matrix(t.column("v").combine_chunks())
        mult = t.column("mult").to_numpy()
        ids = t.column("least_id").combine_chunks()
        tile = Tile(raw, bases[raw.shape[1]])
        links, root = inside(tile, mult, least)
        lead = tile.turned[:, :BOX]
        row = [number, raw.shape[1], raw.tobytes(), mult.tobytes(),
               ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes(),
               ids.is_valid().to_numpy(zero_copy_only=False).tobytes(),
               root.astype(np.int32).tobytes(), links.tobytes(), lead.min(0), lead.max(0)]
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 6, *[pa.list_(pa.float64())] * 2]
        return pa.RecordBatch.from_arrays(
            [pa.array([x], k) for x, k in zip(row, kinds)],
            names=[c.split()[0] for c in _TILES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, held, dim = TaskContext.get().partitionId() << 20, [], 0, None
        for b in tidied(batches):
            while b.num_rows:
                d = b.column("dim")[0].as_py()
                same = int(np.argmin(np.append(b.column("dim").to_numpy() == d, False)))
                if held == TILE or (parts and d != dim):
                    yield pack(number, parts)
                    number, parts, held = number + 1, [], 0
                n = min(same, TILE - held)
                parts.append(b.slice(0, n))
                dim, held, b = d, held + n, b.slice(n)
        if parts:
            yield pack(number, parts)

    return small_batches(dealt.sortWithinPartitions(*order)).select(
        "v", "mult", "least_id", "dim").mapInArrow(run, _TILES)


def _tile_pairs(tiles: DataFrame, least: float) -> DataFrame:
    """(a, b) for all two tiles whose boxes are near enough to hold a link."""
    reach = float(np.sqrt(2 - 2 * least)) + MARGIN
    box = tiles.select("tile", "dim", "lo", "hi")
    low, high = F.floor(F.col("lo")[0] / reach), F.floor(F.col("hi")[0] / reach)
    left = box.select("dim", F.col("tile").alias("a"), F.col("lo").alias("lo1"),
                      F.col("hi").alias("hi1"), F.explode(F.sequence(low, high)).alias("cell"))
    right = box.select("dim", F.col("tile").alias("b"), F.col("lo").alias("lo2"),
                       F.col("hi").alias("hi2"),
                       F.explode(F.sequence(low - 1, high + 1)).alias("cell"))
    gap = F.aggregate(
        F.zip_with(F.arrays_zip("lo1", "hi1"), F.arrays_zip("lo2", "hi2"),
                   lambda x, y: F.greatest(F.lit(0.0), y["lo2"] - x["hi1"], x["lo1"] - y["hi2"])),
        F.lit(0.0), lambda s, x: s + x * x)
    return (left.join(right, ["dim", "cell"]).where("a < b").where(gap <= reach * reach)
            .select("a", "b").distinct())


def _node(tile: int, position: np.ndarray) -> np.ndarray:
    return np.int64(tile) * TILE + position.astype(np.int64)


def _across(tiles: DataFrame, bases: dict[int, np.ndarray], kind: str, least: float) -> DataFrame:
    """Of all pairs of tiles: (x, null, n) links of a vector, (x, y, null) linked components."""
    side = tiles.select("tile", "dim", "data", "mult", "root")
    pairs = (_tile_pairs(tiles, least)
             .join(side.select(*[F.col(c).alias(c + "1") for c in side.columns]),
                   F.col("a") == F.col("tile1"))
             .join(side.select(*[F.col(c).alias(c + "2") for c in side.columns]),
                   F.col("b") == F.col("tile2")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidied(batches):
            for r in b.to_pylist():
                basis = bases[r["dim1"]]
                one, two = (Tile(np.frombuffer(r[c], kind).reshape(-1, r["dim1"]), basis)
                            for c in ("data1", "data2"))
                mult1, mult2 = (np.frombuffer(r[c], np.int64) for c in ("mult1", "mult2"))
                root1, root2 = (np.frombuffer(r[c], np.int32) for c in ("root1", "root2"))
                links1, links2 = np.zeros(len(mult1), np.int64), np.zeros(len(mult2), np.int64)
                edges = np.zeros(0, np.int64)
                for i, j in hits(one, two, least):
                    np.add.at(links1, i, mult2[j])
                    np.add.at(links2, j, mult1[i])
                    edges = np.union1d(edges, root1[i].astype(np.int64) * TILE + root2[j])
                some1, some2 = np.flatnonzero(links1), np.flatnonzero(links2)
                x = np.concatenate([_node(r["a"], some1), _node(r["b"], some2),
                                    _node(r["a"], edges // TILE)])
                counts = len(some1) + len(some2)
                y = np.append(np.zeros(counts, np.int64), _node(r["b"], edges % TILE))
                n = np.concatenate([links1[some1], links2[some2], edges * 0])
                link = np.arange(len(x)) < counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x), pa.array(y, mask=link), pa.array(n, mask=~link)],
                    names=["x", "y", "n"])

    return small_batches(pairs).select(
        "a", "b", "dim1", "data1", "data2", "mult1", "mult2", "root1", "root2").mapInArrow(
        run, "x long, y long, n long")


def _members(tiles: DataFrame, element: str, kind: str) -> DataFrame:
    """One row for each distinct vector of the tiles."""
    arrow = pa.float32() if kind == "<f4" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidied(batches):
            for r in b.to_pylist():
                mult, ids = np.frombuffer(r["mult"], np.int64), np.frombuffer(r["ids"], np.int64)
                known = np.frombuffer(r["known"], bool)
                flat = pa.array(np.frombuffer(r["data"], kind), arrow)
                v = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(mult) + 1, dtype=np.int32) * r["dim"]), flat)
                yield pa.RecordBatch.from_arrays(
                    [v, pa.array(_node(r["tile"], np.arange(len(mult)))), pa.array(mult),
                     pa.array(ids, mask=~known),
                     pa.array(_node(r["tile"], np.frombuffer(r["root"], np.int32))),
                     pa.array(np.frombuffer(r["links"], np.int64))],
                    names=["v", "node", "mult", "least_id", "home", "links"])

    return small_batches(tiles).select(
        "tile", "dim", "data", "mult", "ids", "known", "root", "links").mapInArrow(
        run, f"v array<{element}>, node long, mult long, least_id long, home long, links long")


def near(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
         least: float = LEAST) -> DataFrame:
    """(key, n_links, component_id, kept) for every row."""
    element = "float" if dict(vectors.dtypes)[vector] == "array<float>" else "double"
    kind = "<f4" if element == "float" else "<f8"
    rows = vectors.select(F.col(key).cast("long").alias("k"),
                          F.col(vector).cast(f"array<{element}>").alias("v"))
    rows = rows.withColumn("v", F.when(_usable(F.col("v")), F.col("v")))
    distinct = cut(rows.where("v is not null").groupBy("v").agg(
        F.count(F.lit(1)).alias("mult"), F.min("k").alias("least_id")))
    count = distinct.count()
    bases = _moments(distinct) if count else {}
    ordered = _ordered(distinct, bases, float(np.sqrt(2 - 2 * least)) / 2)
    tiles = cut(_tiles(ordered, bases, -(-count // AIM) or 1, least))
    found = cut(_across(tiles, bases, kind, least))
    linked = components(found.where("y is not null").select(
        F.col("x").alias("a"), F.col("y").alias("b")))
    links = found.where("y is null").groupBy("x").agg(F.sum("n").alias("n"))
    members = _members(tiles, element, kind)
    labelled = (members.drop("v")
                .join(links.withColumnRenamed("x", "node"), "node", "left")
                .join(linked.withColumnRenamed("node", "home"), "home", "left")
                .select("node", F.coalesce("root", "home").alias("root"), "least_id",
                        (F.col("links") + F.coalesce("n", F.lit(0)) + F.col("mult") - 1)
                        .alias("n_links")))
    labelled = cut(labelled)
    names = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    result = labelled.join(names, "root").select("node", "n_links", "component_id")
    by_vector = members.select("v", "node").join(result, "node").drop("node")
    alone = rows.where("v is null").select(
        "k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))
    out = (rows.where("v is not null").join(by_vector, "v")
           .select("k", "n_links", "component_id").unionByName(alone))
    return out.select(F.col("k").alias(key), "n_links", "component_id",
                      F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))


#: Quadratic and only for small tables.
SQL = """
WITH RECURSIVE v AS (
    SELECT row_number() OVER () AS r, vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0
      AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x FOR x IN e IF x <> 0]) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b
          ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach
          JOIN links ON links.a = reach.b),
named AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b
          GROUP BY reach.a),
counted AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id,
       v.vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN named USING (r) LEFT JOIN counted USING (r)
"""
