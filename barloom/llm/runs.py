"""Periodic runs of words, found on the grammar that Re-Pair makes of a text.

A *run* is a stretch of words with smallest period ``q`` (words ``q`` apart are equal) and a length
of at least ``max(LEAST, 2 * q)`` that cannot be extended to either side. Each text is a row of its
own: one pass, no shuffle, nothing collected.

1. Words become numbers. Every window of six words inside a run comes again one period away, so
   words outside all repeated windows belong to no run. They are taken out, which cuts the text into
   stretches; most texts end here.
2. Re-Pair replaces the most frequent adjacent pair by a new symbol until no pair occurs twice; of
   equally frequent pairs the one with the shorter expansion goes first, which keeps the grammar
   shallow. What is left of each stretch is joined by a balanced tree of symbols used once.
3. A run lies inside the expansion of exactly one symbol occurrence whose two parts it crosses, the
   lowest that holds it. For each symbol with an expansion of ``LEAST`` words or more the periods
   that cross its boundary are computed once: four prefix tables give for every period how far equal
   words reach to both sides of the boundary.
4. These are shifted to all places where the symbol is derived. At the place of the lowest symbol a
   run has its full length, elsewhere it may be cut short, so of the intervals of one period only
   those in no other stay.

The pairs of a text are replaced in time linear in its words up to the heap; boundaries take their
expansions' lengths, which a shallow grammar keeps near ``n log n``. Memory follows one text.

Defined cases: a null, empty or blank text has no words and no runs, and collapses to an empty text.
Repeated rows give equal results.
"""
from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.blocks import small_batches, tidied

LEAST = 12
WINDOW = LEAST // 2
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number for each two equal pairs."""
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches, of ``LEAST`` words or more, of words in repeated windows."""
    if len(ids) < LEAST:
        return []
    two = _named(ids[:-1], ids[1:])
    if int(two.max()) + 1 == len(two):
        return []
    four = _named(two[:-2], two[2:])
    windows = _named(four[:-2], two[4:])
    again = np.bincount(windows)[windows] > 1
    if not again.any():
        return []
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:len(again)] += again
    edge[WINDOW:WINDOW + len(again)] -= again
    inside = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    turns = np.flatnonzero(np.diff(inside)).reshape(-1, 2)
    return [(int(s), int(e)) for s, e in turns if e - s >= LEAST]


def re_pair(symbols: list[int], fresh: int) -> tuple[list[int], dict[int, tuple[int, int]],
                                                     dict[int, int]]:
    """(what is left, rules, expansion lengths of the rules' symbols). New symbols count from
    ``fresh``; negative symbols are borders and take part in no pair."""
    n = len(symbols)
    s, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = {}
    for i, pair in enumerate(zip(s, s[1:])):
        if pair[0] >= 0 and pair[1] >= 0:
            places.setdefault(pair, []).append(i)
    count = {p: len(at) for p, at in places.items() if len(at) > 1}
    rules: dict[int, tuple[int, int]] = {}
    size: dict[int, int] = {}
    heap = [(-c, 2, p) for p, c in count.items()]
    heapq.heapify(heap)
    while heap:
        c, length, pair = heapq.heappop(heap)
        now = count.get(pair, 0)
        if now != -c:
            if now > 1:
                heapq.heappush(heap, (-now, length, pair))
            continue
        a, b = pair
        x = fresh + len(rules)
        touched = set()
        for i in places.pop(pair):
            j = after[i] if s[i] == a else n
            if j == n or s[j] != b:
                continue  # overlapped by the replacement before, or gone since
            p, k = before[i], after[j]
            if p >= 0 and s[p] >= 0:
                old, new = (s[p], a), (s[p], x)
                count[old] = count.get(old, 1) - 1
                places.setdefault(new, []).append(p)
                count[new] = count.get(new, 0) + 1
                touched.add(new)
            if k < n and s[k] >= 0:
                old, new = (b, s[k]), (x, s[k])
                count[old] = count.get(old, 1) - 1
                places.setdefault(new, []).append(i)
                count[new] = count.get(new, 0) + 1
                touched.add(new)
            s[i], s[j], after[i] = x, -1, k
            if k < n:
                before[k] = i
        count.pop(pair, None)
        rules[x], size[x] = pair, length
        for q in touched:
            if count[q] > 1:
                heapq.heappush(heap, (-count[q], size.get(q[0], 1) + size.get(q[1], 1), q))
    left, i = [], 0
    while i < n:
        left.append(s[i])
        i = after[i]
    return left, rules, size


def _reach(s: list[int]) -> list[int]:
    """For every place the length of the longest common prefix with the whole (0 at the start)."""
    z, lo, hi, end = [0] * len(s), 0, 0, len(s)
    s = s + [-2]
    for i in range(1, end):
        k = 0
        if i < hi:
            k = z[i - lo]
            if k < hi - i:
                z[i] = k
                continue
            k = hi - i
        while s[k] == s[i + k]:
            k += 1
        if k:
            z[i], lo, hi = k, i, i + k
    return z


def crossing(w: list[int], m: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of the periodic stretches of ``w`` that cross the border
    before place ``m``, of at least ``least`` words and two periods."""
    u, v = w[:m], w[m:]
    back = u[::-1]
    best: dict[tuple[int, int], int] = {}
    # A stretch that holds a whole period left of the border holds the words m - q and m.
    right = _reach(v + [-1] + w)[len(v) + 1:]
    left = _reach(back)
    for q in range(1, m + 1):
        r = right[m - q]
        if r:
            s = m - q - (left[q] if q < m else 0)
            if m + r - s >= max(least, 2 * q):
                best.setdefault((s, m + r), q)
    # One that holds a whole period right of it holds the words m - 1 and m - 1 + q.
    right = _reach(v)
    left = _reach(back + [-1] + w[::-1])[len(u) + 1:]
    for q in range(1, len(v) + 1):
        k = left[len(v) - q]
        if k:
            e = m + q + (right[q] if q < len(v) else 0)
            if e - m + k >= max(least, 2 * q):
                key = (m - k, e)
                best[key] = min(q, best.get(key, q))
    return [(s, e, q) for (s, e), q in best.items()]


def find_runs(ids: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers from 0 on, by start."""
    held = stretches(np.asarray(ids, np.int64))
    if not held:
        return []
    flat: list[int] = []
    for number, (s, e) in enumerate(held):
        flat += ids[s:e]
        flat.append(-1 - number)
    left, rules, size = re_pair(flat, max(ids) + 1)
    found: set[tuple[int, int, int]] = set()
    places: dict[int, list[int]] = {}
    symbols: list[int] = []
    at = 0
    for x in left:
        if x >= 0:
            symbols.append(x)
            continue
        start, _ = held[at]
        ends = np.cumsum([0] + [size.get(y, 1) for y in symbols]).tolist()
        todo = [(0, len(symbols))]
        while todo:  # the balanced tree over what is left of the stretch
            i, j = todo.pop()
            if ends[j] - ends[i] < least:
                continue
            if j - i == 1:
                places.setdefault(symbols[i], []).append(start + ends[i])
                continue
            k = (i + j) // 2
            base = start + ends[i]
            found.update((q, base + s, base + e) for s, e, q in crossing(
                ids[base:start + ends[j]], ends[k] - ends[i], least))
            todo += [(i, k), (k, j)]
        symbols, at = [], at + 1
    for x in sorted(rules, reverse=True):  # a symbol's parts are older than itself
        where = places.pop(x, None)
        if where is None:
            continue
        a, b = rules[x]
        base, m = where[0], size.get(a, 1)
        inside = crossing(ids[base:base + size[x]], m, least)
        found.update((q, p + s, p + e) for s, e, q in inside for p in where)
        for part, shift in ((a, 0), (b, m)):
            if size.get(part, 1) >= least:
                places.setdefault(part, []).extend([p + shift for p in where])
    out, period, furthest = [], 0, 0
    for q, s, e in sorted(found, key=lambda r: (r[0], r[1], -r[2])):
        if q != period:
            period, furthest = q, 0
        if e > furthest:
            out.append((s, e - s, q))
            furthest = e
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run repeats: of every run its first period stays, unless another run
    repeats words of it."""
    keep = np.ones(len(words), bool)
    for s, n, q in runs:
        keep[s + q:s + n] = False
    return [words[i] for i in np.flatnonzero(keep)] if runs else words


def runs(docs: DataFrame, keep: list[str], text: str | Column = "text") -> DataFrame:
    """The columns ``keep``; ``runs``, an array of (start, length, period) by start and period;
    ``collapsed``, the words that no run repeats, joined by spaces."""
    names = [f"k{i}" for i in range(len(keep))]
    frame = small_batches(docs).select(*[F.col(c).alias(n) for n, c in zip(names, keep)],
                                       (F.col(text) if isinstance(text, str) else text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidied(batches):
            offsets, rows, texts = [0], [], []
            for t in b.column("t"):
                words = WORD.findall(t.as_py() or "")
                numbers: dict[str, int] = {}
                ids = [numbers.setdefault(w, len(numbers)) for w in words]
                mine = find_runs(ids)
                rows += mine
                offsets.append(len(rows))
                texts.append(" ".join(collapse(words, mine)))
            parts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            found = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()),
                pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], found, pa.array(texts, pa.string())],
                names=[*names, "runs", "collapsed"])

    kinds = dict(frame.dtypes)
    schema = "".join(f"{c} {kinds[c]}, " for c in names)
    out = frame.mapInArrow(
        run, schema + "runs array<struct<start long, length long, period long>>, collapsed string")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "runs", "collapsed")


def planted(key: Column, text: Column) -> Column:
    """The text, of every tenth key with its end replaced by a repetition of a stretch of it."""
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))

    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(changed, " ")).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    """Number of runs, the greatest, and digests of all runs and of the collapsed text."""
    out = runs(docs.withColumn("__text", planted(F.col("doc_id"), F.col("text"))), ["doc_id"],
               "__text")
    listed = F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
        r["period"].cast("string"), F.lit("\n")))
    order = F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    top = F.array_min(order)
    return out.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.s").alias("start"),
        (-F.col("top.l")).alias("length"), F.col("top.p").alias("period"),
        F.expr("-1000 * top.l div top.p").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
