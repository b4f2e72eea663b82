from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from barloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1 if len(grams) < 3000 else False:
            hit |= set(range(i, i + 8))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t),
            len(lines) - len(set(lines)), len(hit))


def test_counts(spark, docs, rows):
    texts = [(200, "a b c d e f g h " * 5), (201, "x\ny\nx\n \n\nx"), (202, "#*$ %&|<> é😀"),
             (203, "a a a a a a a a a"), (204, "\u000b\u000c\r\u0085 \u00a0 z"), (205, "\n")]
    extra = spark.createDataFrame(texts, "doc_id long, text string")
    df = docs.select("doc_id", "text").where("doc_id <> 82 or doc_id is null").union(extra)
    want = sorted([(d, *counts(t)) for d, t, *_ in rows if d != 82]
                  + [(d, *counts(t)) for d, t in texts], key=repr)
    got = quality.counts(df, {"k": "doc_id"}).select(
        "k", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted([tuple(r) for r in got], key=repr) == want


def test_bound_is_exact(spark):
    cases = [(10, 0), (500, 2), (500, 4), (3000, 20), (100000, 900), (700, 0)]
    p = 0.01
    df = spark.createDataFrame(cases, "n long, k long")
    got = {(r.n, r.k): r.x for r in df.select(
        "n", "k", quality.log_cdf(F.col("n"), F.col("k"), p).alias("x")).collect()}
    for n, k in cases:
        terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                 + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(k + 1)]
        want = max(terms) + math.log(sum(math.exp(x - max(terms)) for x in terms))
        assert got[n, k] == pytest.approx(want, abs=1e-6)


def test_cutoffs_keep_the_promise(spark):
    """2 % of the good texts have many symbols: the cutoff must lie above them where the limit
    is 1 %, and a stratum with few labels gets none."""
    rows = [("en", {"symbols": 0.5 if i % 50 == 0 else 0.02 * (i % 3), "repeats": 0.0})
            for i in range(4000)] + [("xx", {"symbols": 0.0})] * 100
    df = spark.createDataFrame(rows, "stratum string, measures map<string,double>")
    got = {r.stratum: r.cuts for r in quality.thresholds(df).collect()}
    assert got == {"en": {"symbols": 0.5, "repeats": 0.01}}
    loose = {r.stratum: r.cuts for r in quality.thresholds(df, limit=0.2).collect()}
    assert loose["en"]["symbols"] == 0.05


def test_verdicts(spark):
    good = [(i, "some words stand here in a row that nobody would ever call a repeat or junk "
                f"because number {i} of them is quite plain and fine", "en") for i in range(900)]
    bad = [(2000, good[0][1] + " ### $$$ %%%" * 3, "en"), (2001, "too short", "en"),
           (2002, "a b c d e f g h i j " * 9, "en"), (2003, None, None),
           (2004, good[0][1] + " ### $$$ %%%" * 3, None)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in range(900)] + [(1, 0, 0), (None, 1, 0), (5, None, 0)],
        "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert all(got[i].kept for i in range(900))
    assert not got[2000].kept and not got[2000].base_failed
    assert got[2001].base_failed and got[2002].base_failed and got[2003].base_failed
    assert got[2004].kept  # no labels in its stratum, no rule


def test_repeats_are_one_trial(spark):
    """A good document repeated 700 times, and 700 good ones with one text, prove nothing."""
    text = "some words stand here in a row that nobody would ever call a repeat or junk at all ok so"
    junk = text + " ### $$$ %%%" * 3
    labels = spark.createDataFrame([(i, 1, 0) for i in range(900)],
                                   "doc_id long, quality int, toxic int")
    for ids in ([1] * 700, range(700)):
        docs = spark.createDataFrame([(i, text, "en") for i in ids] + [(2000, junk, "en")],
                                     "doc_id long, text string, lang string")
        assert all(r.kept for r in quality.judge(docs, labels).collect())
    apart = [(i, f"{text} number {i}", "en") for i in range(120)] + [(2000, junk, "en")]
    docs = spark.createDataFrame(apart, "doc_id long, text string, lang string")
    assert [r.doc_id for r in quality.judge(docs, labels).collect() if not r.kept] == [2000]


def test_awkward_rows_and_empty(spark, docs, rows, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(docs, labels).count() == len(rows)
    assert quality.judge(empty, labels).collect() == []
