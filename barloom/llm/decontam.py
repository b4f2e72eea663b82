"""Benchmark decontamination by greedy string tiling.

Words are runs without white space or ASCII punctuation, A-Z folded, compared by 64-bit hashes.
Documents meet benchmark items through shared seeds (runs of ``SEED`` words). For each document
and item that share one, the longest common runs of words are marked again and again, each word
at most once, by hashes of running windows (Karp-Rabin) whose matches are compared word by word;
runs shorter than ``SEED`` don't count. What share of the item's words the tiles cover decides,
so an item whose sentences were put in another order is found like a plain copy.

The benchmark goes to the tasks as hash arrays in parts of at most ``PART`` bytes, whose size is
measured first; a benchmark beyond one part takes one more step over the documents for each
part, inside the same pass. The documents are never shuffled. Equal stretches against one item
are tiled once for each batch, so a passage in a third of all documents costs its search only.

Defined cases: a null or empty text holds nothing; an item without ``SEED`` words matches
nothing. Repeated documents and items are all reported. Tiles of equal length are taken from
the left of the item, then of the text.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.blocks import (U, Rolling, chunks, shingle_hashes, small_batches, tidied,
                                word_hashes)

SEED = 5
LEAST_COVERAGE = 0.5
PART = 32 << 20
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32
_HIT = "array<struct<item:long, tiles:int, words:int, of:int, coverage:double>>"


def word_rows(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and where each text's words begin."""
    h, row = word_hashes(_PLAIN[buf], offs)
    return h, np.searchsorted(row, np.arange(len(offs)))


def tile(text: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (item position, text position, length): the longest common runs first."""
    tiles: list[tuple[int, int, int]] = []
    free_t, free_i = np.ones(len(text), bool), np.ones(len(item), bool)
    of_t, of_i = Rolling(text), Rolling(item)

    def windows(rolling: Rolling, free: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
        taken = np.concatenate(([0], np.cumsum(~free)))
        at = np.flatnonzero(taken[s:] == taken[:-s]) if len(free) >= s else np.zeros(0, int)
        return at, rolling.of(at, at + s)

    def common(s: int) -> list[tuple[int, int]]:
        i, hi = windows(of_i, free_i, s)
        t, ht = windows(of_t, free_t, s)
        hit = np.isin(ht, hi)
        where: dict[int, list[int]] = {}
        for x, h in zip(t[hit].tolist(), ht[hit].tolist()):
            where.setdefault(h, []).append(x)
        return [(y, x) for y, h in zip(i.tolist(), hi.tolist()) for x in where.get(h, ())]

    low, high = least, min(len(text), len(item))
    while high >= low:
        # The longest length with a common run, by halving: a common run holds shorter ones.
        a, b, best = low, high, []
        while a <= b:
            mid = (a + b) // 2
            found = common(mid)
            a, b, best = (mid + 1, b, found) if found else (a, mid - 1, best)
        if not best:
            break
        s = a - 1
        for y, x in best:
            if (free_i[y:y + s].all() and free_t[x:x + s].all()
                    and np.array_equal(item[y:y + s], text[x:x + s])):
                free_i[y:y + s] = free_t[x:x + s] = False
                tiles.append((y, x, s))
        high = s - 1
    return tiles


class Items:
    """A part of the benchmark: the words of its items and where their seeds lie."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        column = pa.array(texts, pa.large_string())
        self.words: list[np.ndarray] = []
        for _, buf, offs in chunks(column):
            h, at = word_rows(buf, offs)
            self.words += [h[at[i]:at[i + 1]] for i in range(len(offs) - 1)]
        seeds = [shingle_hashes(w, SEED) for w in self.words]
        every = np.concatenate(seeds) if seeds else np.zeros(0, U)
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        order = np.argsort(every, kind="stable")
        self.seeds, self.owner = every[order], owner[order]

    def hits(self, text: np.ndarray, least: float, memo: dict) -> list[dict]:
        g = shingle_hashes(text, SEED)
        if not len(g) or not len(self.seeds):
            return []
        a = np.searchsorted(self.seeds, g, "left")
        hit = self.seeds[np.minimum(a, len(self.seeds) - 1)] == g
        if not hit.any():
            return []
        b = np.searchsorted(self.seeds, g[hit], "right")
        at, a = np.flatnonzero(hit), a[hit]
        seed_at = np.repeat(at, b - a)
        owners = self.owner[np.repeat(a - np.concatenate(([0], np.cumsum(b - a)[:-1])), b - a)
                            + np.arange((b - a).sum())]
        out = []
        for k in np.unique(owners):
            covered = np.zeros(len(text) + 1, np.int32)
            np.add.at(covered, seed_at[owners == k], 1)
            np.add.at(covered, seed_at[owners == k] + SEED, -1)
            inside = np.cumsum(covered[:-1]) > 0
            # Only stretches with seeds; a zero keeps neighbours from running together.
            kept = np.where(inside, text, U(0))
            kept = kept[inside | np.append(True, inside[:-1])]
            key = (int(k), kept.tobytes())
            if key not in memo:
                memo[key] = tile(kept, self.words[k])
            words = sum(s for _, _, s in memo[key])
            share = words / len(self.words[k])
            if share >= least:
                out.append({"item": self.ids[k], "tiles": len(memo[key]), "words": words,
                            "of": len(self.words[k]), "coverage": share})
        return out


def parts(benchmark: DataFrame, item: str, text: str, limit: int = PART) -> Iterator[Items]:
    """The benchmark in parts whose texts are about ``limit`` bytes at most."""
    rows = benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).where(
        "t is not null and i is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // limit)
    for p in range(n):
        got = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == p).sort("i", "t").collect()
        if got:
            yield Items([r.i for r in got], [r.t for r in got])


def matches(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text",
            item: str = "item_id", item_text: str = "text",
            least: float = LEAST_COVERAGE) -> DataFrame:
    """The columns ``keep`` and ``hits``: the items that cover at least ``least``; every row
    of the input stays."""
    names = [f"k{i}" for i in range(len(keep))]
    # A text that is kept anyway goes to Python once.
    read = names[keep.index(text)] if text in keep else "t"
    sent = names if text in keep else [*names, "t"]
    frame = small_batches(docs).select(*[F.col(c).alias(n) for n, c in zip(sent, [*keep, text])],
                        F.array().cast(_HIT).alias("hits"))
    kinds = dict(frame.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in sent) + f", hits {_HIT}"
    hit = pa.list_(pa.struct([("item", pa.int64()), ("tiles", pa.int32()), ("words", pa.int32()),
                              ("of", pa.int32()), ("coverage", pa.float64())]))
    for part in parts(benchmark, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in tidied(batches):
                memo: dict = {}
                found = []
                for _, buf, offs in chunks(b.column(read)):
                    h, at = word_rows(buf, offs)
                    found += [shared.value.hits(h[at[i]:at[i + 1]], least, memo)
                              for i in range(len(offs) - 1)]
                before = b.column("hits").to_pylist()
                hits = pa.array([x + y for x, y in zip(before, found)], hit)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(n) for n in sent], hits], names=[*sent, "hits"])

        frame = frame.mapInArrow(run, schema)
    return frame.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "hits")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_tiles, n_words, item_words, coverage) of contaminated documents."""
    return matches(docs, benchmark, ["doc_id"]).select(
        "doc_id", F.explode("hits").alias("x")).select(
        "doc_id", F.col("x.item").alias("item_id"), F.col("x.tiles").alias("n_tiles"),
        F.col("x.words").alias("n_words"), F.col("x.of").alias("item_words"),
        F.col("x.coverage").alias("coverage"))
