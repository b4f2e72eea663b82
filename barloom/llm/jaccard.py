"""N-gram Jaccard join with prefixes of token combinations.

A document is the set of its 5-word shingles. All tokens have one order: rarest first. Of two
sets with Jaccard similarity t at most ``slack`` = n - ceil(t n) tokens of either lie outside
the other, so sets that link share signatures taken from a short prefix of each:

* a token found in at most ``2 ** (RARE / 8)`` documents is a signature by itself;
* frequent tokens are dealt into classes and only pairs of one class are signatures. A class
  with m tokens in the prefix stands m - 1 losses, so the prefix is extended until its tokens,
  counted as 1 for each rare one and m - 1 for each class, exceed the slack. Classes depend on
  the size group, a document signs for its own group and the next, and groups are 25 % apart,
  so a pair's sizes are compared by the signature itself.

Tokens found nowhere else stand first and need no signature: a document with more of them than
the slack links with nothing and leaves at once. Candidates are verified on the whole sets.

Only connectivity is wanted, so a group of documents with one signature isn't multiplied out.
Its member with the smallest share of rare tokens is its centre; all others are verified
against the centre and linked ones are joined to components. Then only pairs from different
components are left. Sizes, tokens of one's own and parity sketches of the sets give upper bounds
of their similarity; every pair that the bounds allow is verified. No link between components is
lost.

Copies with the same set are one class from the first block on; a class is a node (128-bit
digest). Defined cases: a text with fewer words is one shingle; null, empty and blank texts
have no shingle and stand alone with their own id. A null id takes part, and the component is
named by the smallest id that is not null (null if there is none). Repeated rows are copies.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.blocks import U, mix, shingle_hashes, word_hashes
from barloom.llm.crossref import Block, bucket_count, cross, level
from barloom.plans.storage import cut

SHINGLE = 5
NUM, DEN = 80, 100
RARE = 40
SMALL = 40


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE):
    """Distinct shingles of each text, as ``crossref`` takes them."""
    h, row = word_hashes(buf, offs)
    at = np.searchsorted(row, np.arange(len(offs)))
    g = shingle_hashes(h, k)
    sets, digests = [], []
    for i in range(len(offs) - 1):
        a, b = at[i], at[i + 1]
        s = np.unique(g[a:b - k + 1] if b - a >= k else shingle_hashes(h[a:b], b - a)
                      if b > a else g[:0])
        sets.append(s)
        text = hashlib.md5(buf[offs[i]:offs[i + 1]].tobytes()).digest()[:8]
        digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() + text)
    n = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets) if sets else np.zeros(0, U)
    return tokens, np.repeat(np.arange(len(n)), n), n, digests


def slack(n: int) -> int:
    return n - -(-NUM * n // DEN)


def _group(n: int) -> int:
    """Size group: sets that link are in one group or in neighbouring ones."""
    return int(np.floor(np.log(n) / np.log(1.25) + 1e-9))


def signatures(n: int, tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Signatures of a set of ``n`` tokens; given are those found elsewhere."""
    order = np.lexsort((tokens, levels))
    tokens, levels = tokens[order], levels[order]
    alone = n - len(tokens)
    need = slack(n) + 1
    if alone >= need:
        return np.zeros(0, U)
    out = []
    for scheme in (_group(n), _group(n) + 1):
        size = 1.25 ** scheme
        frequent = (levels > RARE) if size >= SMALL else np.zeros(len(tokens), bool)
        classes = max(1, int((0.2 * size + 1) / 3))
        of = (mix(tokens + U(scheme)) % U(classes)).astype(np.int64)
        # Worth of each token in the prefix: the first of a frequent class adds nothing.
        worth = np.ones(len(tokens), np.int64)
        where = np.flatnonzero(frequent)
        _, first = np.unique(of[where], return_index=True)
        worth[where[first]] = 0
        total = alone + np.cumsum(worth)
        end = int(np.searchsorted(total, need)) + 1
        if end > len(tokens):  # can't happen for sizes from SMALL on; keep it exact anyway
            raise AssertionError("prefix does not cover the slack")
        t, f, c = tokens[:end], frequent[:end], of[:end]
        out.append(mix(t[~f]))
        if f.any():
            order = np.argsort(c[f], kind="stable")
            x, k = t[f][order], c[f][order]
            sizes = np.diff(np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k)))
            left, right = [], []
            for step in range(1, int(sizes.max())):
                same = np.flatnonzero(k[step:] == k[:-step])
                left.append(x[same])
                right.append(x[same + step])
            if left:
                # Members of a class keep the common order, so a pair has one spelling.
                a, b = np.concatenate(left), np.concatenate(right)
                out.append(mix(a * U(3) + mix(b) + U(scheme) * U(0x9E3779B97F4A7C15)))
    return np.unique(np.concatenate(out))


_ROWS = ("member boolean, node binary, doc_id long, text_key binary, n long, own long, "
         "few array<int>, sketch array<long>, tokens binary, sigs array<long>")
#: Up to here a token's level tells its exact number of documents.
EXACT = 15
SKETCH = 8
LEVELS = level(np.arange(2, EXACT + 1)).astype(int)


def parity(tokens: np.ndarray) -> np.ndarray:
    """For each of ``64 * SKETCH`` bits, whether an odd number of tokens falls on it. Common
    tokens cancel, so two sketches differ in no more bits than the sets in tokens."""
    bits = np.bincount((mix(tokens + U(99)) % U(64 * SKETCH)).astype(int),
                       minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _rows(block: Block, _: int) -> pa.RecordBatch:
    """One row for each document, and one with signatures for each set that may link."""
    out: list[tuple] = []
    seen: set[bytes] = set()
    for i in range(len(block)):
        n, node, text = int(block.counts[i]), block.digests[i][:16], block.digests[i][16:]
        out.append((True, node, block.id(i), text, n, None, None, None, None, None))
        if n == 0 or node in seen:
            continue
        seen.add(node)
        tokens, levels = block.tokens(i)
        if n - len(tokens) <= slack(n):
            sigs = signatures(n, tokens, levels)
            few = np.bincount(levels, minlength=256)[LEVELS]
            out.append((False, node, None, None, n, n - len(tokens), few, parity(tokens),
                        np.sort(tokens).tobytes(), sigs.view(np.int64)))
    kinds = [pa.bool_(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(),
             pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
    names = ["member", "node", "doc_id", "text_key", "n", "own", "few", "sketch", "tokens", "sigs"]
    columns = list(zip(*out)) if out else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _possible(n1: Column, own1: Column, n2: Column, own2: Column) -> Column:
    """Can two sets link, given their sizes and the tokens only they have?"""
    most = F.least(n1 - own1, n2 - own2)
    return (NUM + DEN) * most >= NUM * (n1 + n2)


def _near(sketch1: str, own1: str, sketch2: str, own2: str, n1: str, n2: str) -> Column:
    """Do the sketches, and the tokens only one has, leave the sets near enough to link?"""
    bits = " + ".join(f"bit_count({sketch1}[{i}] ^ {sketch2}[{i}])" for i in range(SKETCH))
    return F.expr(f"{NUM + DEN} * ({bits} + {own1} + {own2}) <= {DEN - NUM} * ({n1} + {n2})")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes those that link, compared on the whole sets."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("tokens").alias("t1"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("tokens").alias("t2"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n1, n2 = b.column("n1").to_pylist(), b.column("n2").to_pylist()
            ok = []
            for i, (x, y) in enumerate(zip(b.column("t1"), b.column("t2"))):
                s, t = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.concatenate([s, t])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append((NUM + DEN) * common >= NUM * (n1[i] + n2[i]))
            yield pa.RecordBatch.from_arrays(
                [b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return (pairs.join(one, "a").join(two, "b").select("a", "b", "n1", "n2", "t1", "t2")
            .mapInArrow(check, "a binary, b binary"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, by alternating large and
    small stars; each round is a written table."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            .where("u != v").distinct())
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"),
                                                          F.col("m").alias("v"))
                 .where("u != v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        after = cut(small)
        # A star forest is a fixed point: nothing new on either side.
        changed = after.exceptAll(e).limit(1).count() + e.exceptAll(after).limit(1).count()
        e = after
        if not changed:
            break
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return leaves.union(roots)


def _rooted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(node, doc_id, text_key, n, root) for every row; ``root`` names the component."""
    table = cut(cross(docs, key, text, shingle_sets, _rows, _ROWS, bucket_count(docs, text)))
    members = table.where("member").select("node", "doc_id", "text_key", "n")
    found = table.where("not member")
    # Tokens found in just the copies of a set are its own too: as many documents as copies.
    copies = members.groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    own = F.col("own") + F.when(F.col("copies").between(2, EXACT), F.col("few")[
        F.col("copies").cast("int") - 2]).otherwise(0)
    signed = cut(found.drop("tokens").join(copies, "node").withColumn("own", own)
                 .where(DEN * F.col("own") <= (DEN - NUM) * F.col("n"))
                 .select("node", "n", "own", F.explode("sigs").alias("sig")).distinct())
    share = (F.col("own") / F.col("n")).alias("share")
    groups = (signed.groupBy("sig").agg(
        F.count(F.lit(1)).alias("size"),
        F.min(F.struct(share, "node", "n", "own")).alias("c")).where("size > 1"))
    grouped = cut(signed.join(groups, "sig").select(
        "sig", "node", "n", "own", F.col("c.node").alias("centre"),
        F.col("c.n").alias("cn"), F.col("c.own").alias("cown")))
    sets = cut(found.select("node", "n", "own", "sketch", "tokens").join(
        grouped.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    stars = (grouped.where(F.col("node") != F.col("centre"))
             .where(_possible(F.col("n"), F.col("own"), F.col("cn"), F.col("cown")))
             .select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct())
    linked = cut(verified(stars, sets))
    roots = components(linked)
    labelled = grouped.join(roots, "node", "left").select(
        "sig", "node", "n", "own", F.coalesce("root", "node").alias("root"))
    mixed = (labelled.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
             .where("lo != hi").select("sig"))
    sketches = sets.select("node", F.col("own").alias("solo"), "sketch")
    open_ = cut(labelled.join(mixed, "sig", "left_semi").join(sketches, "node"))
    left, right = (open_.select("sig", *[F.col(c).alias(c[0] + end) for c in (
        "node", "root", "own")], F.col("n").alias("size" + end), F.col("solo").alias("solo" + end),
        F.col("sketch").alias("sketch" + end)) for end in "12")
    rest = (left.join(right, "sig").where("n1 < n2 and r1 != r2")
            .where(_possible(F.col("size1"), F.col("o1"), F.col("size2"), F.col("o2")))
            .where(_near("sketch1", "solo1", "sketch2", "solo2", "size1", "size2"))
            .select(F.col("n1").alias("a"), F.col("n2").alias("b")).distinct())
    more = cut(verified(rest, sets))
    roots = cut(components(linked.union(more)))
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    rows = cut(_rooted(docs, key, text).select("doc_id", "n", "root"))
    name = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(name, "root").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        .alias("component_id"))


def one_of_each(docs: DataFrame, keep: list[str], key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """The columns ``keep`` of one row for each component, the one with the smallest id (null
    last; of repeated rows one stays), and of every row without a word."""
    first = (_rooted(docs, key, text).where("n > 0").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("x"))
        .select(F.col("x.doc_id").alias("_id"), F.col("x.text_key").alias("_text")))
    word = F.coalesce(F.col(text).rlike(r"[^ \t-\r]"), F.lit(False))
    rows = docs.where(word).select(*keep, F.col(key).cast("long").alias("_k"), F.unhex(
        F.substring(F.md5(F.col(text).cast("binary")), 1, 16)).alias("_t"))
    match = F.col("_k").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_text"))
    same = Window.partitionBy("_k", "_t").orderBy("_k")
    chosen = (rows.join(cut(first), match).withColumn("_n", F.row_number().over(same))
              .where("_n = 1").select(*keep))
    return chosen.union(docs.where(~word).select(*keep))
