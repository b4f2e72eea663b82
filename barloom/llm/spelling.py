"""Spelling variants: words of a corpus one edit apart, each led to its most frequent form.

Two words are *near* if one inserted, deleted or replaced code point makes one of the other. If the
shorter has ``L`` code points, they share their first or their last ``L // 2``, for one edit leaves
one of the halves alone. So the vocabulary is sorted twice, from the front and from the back, and a
search follows the shared half exactly and allows the edit behind it:

1. words are counted in Spark, with map-side combine, and sorted into blocks of bounded size by range;
2. the first and last word of every block, cut to ``SHOWN`` code points, make an index of at most
   ``MOST_BLOCKS`` rows (blocks grow beyond that many). A word visits its own block and each other
   that can hold a near word: the scan of step 3, run on what the words of a block have in common;
3. a block is scanned for each visitor: rows of the edit matrix, three cells wide, are kept by depth.
   The next word reuses the rows up to its common prefix with the word before; where all cells of a
   row exceed one edit, every word that shares the prefix read so far is passed over;
4. a block returns one row for each visitor that found something, with the number of near words and
   the best one. No pair is written, so a thick neighbourhood costs time but no rows;
5. forms are followed to the end by doubling. A form is ``FACTOR`` times as frequent, so a chain has
   at most log5(2^63) = 27 words and five doublings reach its end.

Where a pair shares both halves the front finds it, and the back leaves it alone.

Defined cases: null texts have no words. Counts are over all rows, repeated ones too. Ties between
forms go to the word that is first in code-point order.
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.blocks import release, tidied
from barloom.plans.storage import cut

LEAST_LENGTH = 6
LEAST_COUNT = 5
FACTOR = 5
BLOCK = 10_000
MOST_BLOCKS = 20_000
SHOWN = 32
#: What counts as a letter.
LETTERS = r"([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = "\U0010ffff"
_BACK = 1 << 40


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


class Sorted:
    """A sorted list of words with the common prefixes of neighbours."""

    def __init__(self, words: list[str]):
        self.words = words
        self.shared = [0] + [common(a, b) for a, b in zip(words, words[1:])]

    def scan(self, query: str, exact: int, prefixes: bool = False) -> Iterator[int]:
        """Places of the words within one edit of ``query`` that share its first ``exact`` code
        points; ``prefixes``: of the words that one edit at most leads to the start of."""
        words, shared, size = self.words, self.shared, len(query)
        i = bisect_left(words, query[:exact])
        end = bisect_left(words, query[:exact] + _LAST, i)
        rows, valid = [(1, 0, 1)], exact  # rows[d - exact] stands after d code points
        while i < end:
            word = words[i]
            d = min(valid, len(word))
            x, y, z = rows[d - exact]
            del rows[d - exact + 1:]
            while d < len(word):
                if d > size:  # longer by two
                    d += 1
                    break
                c = word[d]
                if d and c != query[d - 1]:
                    x += 1
                x, diagonal = min(x, y + 1), y
                if d < size:
                    y = min(diagonal + (c != query[d]), z + 1, x + 1)
                    z = min(z + (c != query[d + 1]), y + 1) if d + 1 < size else 2
                else:
                    y = z = 2
                d += 1
                if x > 1 and y > 1 and z > 1:
                    break
                rows.append((x, y, z))
            else:
                off = size - len(word)
                if prefixes or (off == 0 and y < 2) or (off == -1 and x < 2) or (
                        off == 1 and z < 2):
                    yield i
                i += 1
                valid = shared[i] if i < end else 0
                continue
            i += 1
            if i < end and shared[i] >= d:  # all of these begin with the prefix that failed
                i = bisect_left(words, word[:d] + _LAST, i, end)
            valid = shared[i] if i < end else 0


def vocabulary(words: Column, docs: DataFrame) -> DataFrame:
    """(word, n): the entries of the array column ``words`` with their counts, where long and
    frequent enough."""
    return (docs.select(F.explode(words).alias("word"))
            .where(F.length("word") >= LEAST_LENGTH)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= LEAST_COUNT))


def _blocks(vocab: DataFrame, key: Column, first: int, count: int) -> DataFrame:
    return (vocab.select(key.alias("key"), "n").repartitionByRange(count, "key")
            .withColumn("block", F.lit(first) + F.spark_partition_id()))


def _visits(table: DataFrame, index: list) -> DataFrame:
    """(block, key, n, home): every word in its own block, and in each other that may hold a
    near word."""
    sides = {}
    for back in (False, True):
        mine = sorted((r.lo, r.hi, r.block) for r in index if (r.block >= _BACK) == back)
        sides[back] = ([r[0] for r in mine], [r[1] for r in mine], [r[2] for r in mine],
                       [r[0][:common(r[0], r[1])] for r in mine])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidied(batches):
            at, where = [], []
            for place, (key, home) in enumerate(zip(b.column("key").to_pylist(),
                                                    b.column("block").to_pylist())):
                lows, highs, blocks, prefixes = sides[home >= _BACK]
                exact = (len(key) - 1) // 2
                i = bisect_left(highs, key[:min(exact, SHOWN)])
                while i < len(blocks) and lows[i][:exact] <= key[:exact][:SHOWN]:
                    if blocks[i] != home and (len(prefixes[i]) <= exact or next(
                            Sorted([prefixes[i]]).scan(key, exact, True), None) is not None):
                        at.append(place)
                        where.append(blocks[i])
                    i += 1
            own = b.select(["block", "key", "n"])
            others = b.select(["key", "n"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array([True] * own.num_rows, pa.bool_())],
                names=["block", "key", "n", "home"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.int64()), *others.columns,
                 pa.array([False] * len(where), pa.bool_())], names=["block", "key", "n", "home"])

    return table.select("block", "key", "n").mapInArrow(
        run, "block long, key string, n long, home boolean")


def _search(table: pa.Table) -> pa.Table:
    """Of one block: (word, n_near, best) of all visitors that have near words in it."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("key", "n", "home"))))
    back = table.column("block")[0].as_py() >= _BACK
    rows.sort(key=lambda r: r[0])
    home = [r for r in rows if r[2]]
    words, counts = Sorted([r[0] for r in home]), [r[1] for r in home]
    out = []
    for key, _, _ in rows:
        near, best = 0, None
        for i in words.scan(key, (len(key) - 1) // 2):
            other = words.words[i]
            if other == key:
                continue
            half = min(len(key), len(other)) // 2
            if common(key, other) < half or (back and common(key[::-1], other[::-1]) >= half):
                continue
            near += 1
            this = (-counts[i], other[::-1] if back else other)
            best = this if best is None else min(best, this)
        if near:
            out.append((key[::-1] if back else key, near, best[0], best[1]))
    release()
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    columns = zip(*out) if out else [[]] * 4
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                names=["word", "n_near", "rank", "best"])


def _ends(steps: DataFrame) -> DataFrame:
    """(word, root) where forms lead, out of (word, form) by doubling."""
    now = cut(steps.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while now.where("open").limit(1).count():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut(now.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"),
            F.col("next").isNotNull().alias("open")))
    return now.select("word", "root")


def variants(vocab: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of a table (word, n) of distinct words."""
    vocab = cut(vocab.select("word", "n"))
    size = vocab.count()
    count = max(1, min(MOST_BLOCKS, -(-size // BLOCK)))
    table = cut(_blocks(vocab, F.col("word"), 0, count).unionByName(
        _blocks(vocab, F.reverse("word"), _BACK, count)))
    shown = F.substring("key", 1, SHOWN)
    index = table.groupBy("block").agg(F.min(shown).alias("lo"), F.max(shown).alias("hi")).collect()
    found = _visits(table, index).groupBy("block").applyInArrow(
        _search, "word string, n_near long, rank long, best string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                     F.min(F.struct("rank", "best")).alias("b"))
    formed = F.when(-F.col("b.rank") >= FACTOR * F.col("n"), F.struct(
        F.col("b.best").alias("form"), (-F.col("b.rank")).alias("form_n")))
    out = cut(vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        formed.alias("f")).select("word", "n", "n_near", "f.form", "f.form_n"))
    ends = _ends(out.where("form is not null").select("word", "form"))
    return out.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def planted(key: Column, text: Column) -> Column:
    """The letter runs of a text in lower case; of some, by a hash, one code point is lost."""
    words = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(LETTERS))

    def damaged(w: Column) -> Column:
        h = F.crc32(F.concat(key.cast("string"), F.lit(":"), w))
        at = (h % F.length(w)).cast("int")
        less = F.concat(F.substring(w, F.lit(1), at), F.substring(w, at + 2, F.length(w)))
        return F.when(h % 199 == 0, less).otherwise(w)

    return F.transform(F.filter(words, lambda w: F.length(w) >= LEAST_LENGTH), damaged)


def report(docs: DataFrame) -> DataFrame:
    return variants(vocabulary(planted(F.col("doc_id"), F.col("text")), docs))
