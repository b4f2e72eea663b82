from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barloom.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    """Exactly one inserted, deleted or replaced code point apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute(counts):
    """(word, form, root, n, n_near, form_n) of every word from all pairs."""
    close = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, vs in close.items():
        if vs:
            top = min(vs, key=lambda v: (-counts[v], v))
            if counts[top] >= spelling.FACTOR * counts[w]:
                form[w] = top
    out = []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.append((w, f, root, counts[w], len(close[w]), f and counts[f]))
    return sorted(out)


def counted(rows):
    """Counts of the contract's words."""
    n = Counter()
    for doc, text in rows:
        for w in RUN.findall(text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{doc}:{w}".encode())
            if doc is not None and h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items()
            if len(w) >= spelling.LEAST_LENGTH and c >= spelling.LEAST_COUNT}


def words(rng, n):
    """Random words and chains of edits of them; ties and hot beginnings among them."""
    letters = "abéÿ"
    out = set()
    while len(out) < n:
        w = "".join(rng.choices(letters, k=rng.randint(6, 9)))
        if rng.random() < .3:
            w = "antidis" + w
        out.add(w)
        for _ in range(rng.randint(0, 4)):
            i, kind = rng.randrange(len(w)), rng.randrange(3)
            w = w[:i] + rng.choice(["", letters[0], letters[2]]) + w[i + (kind > 0):]
            if len(w) >= 6:
                out.add(w)
    return sorted(out)


@pytest.mark.parametrize("block", [spelling.BLOCK, 40])
def test_variants_equal_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", block)  # many blocks: words visit others
    rng = random.Random(3)
    counts = {w: 5 ** rng.randint(1, 8) + rng.randrange(3) for w in words(rng, 700)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = sorted(tuple(r) for r in spelling.variants(df.withColumn("key", F.lit("x"))).collect())
    want = brute(counts)
    assert got == want
    assert len({r[2] for r in want}) < len({r[1] for r in want if r[1]} | set(counts))
    assert any(r[1] and r[1] != r[2] for r in want)


def test_scan_visits_what_is_within_one_edit():
    rng = random.Random(9)
    listed = words(rng, 900)
    table = spelling.Sorted(listed)
    for q in rng.sample(listed, 60) + ["antidis", "ÿÿÿÿÿÿ", "zzzzzz", "aaaaaa"]:
        for exact in (1, 3, len(q) // 2):
            got = [listed[i] for i in table.scan(q, exact)]
            assert got == [w for w in listed if w[:exact] == q[:exact] and (
                w == q or near(w, q))]


def test_report_counts_the_contracts_words(spark, rows):
    rng = random.Random(1)
    stock = words(rng, 60)
    texts = [(d, t) for d, t, *_ in rows]
    texts += [(1000 + i, " ".join(rng.choices(stock, k=80)).upper() + " Straße, NAÏVE-être")
              for i in range(80)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for c in ("word", "n", "key", "block", "form"):
        df = df.withColumn(c, F.lit("clash"))
    got = sorted(tuple(r) for r in spelling.report(df).collect())
    assert got == brute(counted(texts)) and len(got) > 50


def test_letters_of_latin_1_capitals_stay(spark):
    df = spark.createDataFrame([(1, "ÉCOLEÀ écoleà " * 6)], "doc_id long, text string")
    got = {r.word for r in spelling.report(df).collect()}
    assert {"Écoleà".replace("à", "À"), "écoleà"} >= got and got


def test_long_words(spark):
    long = "ab" * 3000
    counts = {long: 100, long[:-1]: 5, "x" + long: 6, long[:2000] + "z" + long[2000:]: 7,
              long[:3000]: 9}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(tuple(r) for r in spelling.variants(df).collect()) == brute(counts)


def test_empty_table(spark, empty):
    assert spelling.report(empty).collect() == []
