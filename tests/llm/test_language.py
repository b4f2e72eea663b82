from __future__ import annotations

import random
import zlib

from barloom.llm import langid

LETTERS = {"en": "thewandsoi", "de": "schungerbz", "fr": "éèouleaqux", "es": "ñóadolrcíz"}


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(LETTERS))
        words = ["".join(rng.choices(LETTERS[lang], k=rng.randint(2, 8)))
                 for _ in range(rng.randint(8, 80))]
        out.append((i, " ".join(words), lang, None, None))
    return out


def test_held_out_accuracy_and_folds(spark):
    rows = corpus(400, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                     "n_chars long")
    got = {r.doc_id: r for r in langid.languages(df).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert {d for d, r in got.items() if r.held_out} == {r[0] for r in held}
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_awkward_rows(docs, rows):
    got = langid.languages(docs).collect()
    assert len(got) == len(rows)
    for text in (None, "", " \t\n ", "1234 5678 9"):
        ids = {d for d, t, *_ in rows if t == text and d is not None}
        assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in ids)
    assert all(r.lang_pred in {"en", "de", "fr", "und"} for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)


def test_the_label_of_a_row_is_no_input(spark):
    rows = corpus(200, 2)
    a = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                    "n_chars long")
    model = langid.fit(a, ~langid.held_out())
    want = {r.doc_id: r.lang_pred for r in langid.predict(a, model, ["doc_id"]).collect()}
    b = a.selectExpr("doc_id", "text", "'xx' as lang", "'s' as source")
    assert want == {r.doc_id: r.lang_pred for r in langid.predict(b, model, ["doc_id"]).collect()}


def test_one_language_none_and_empty(spark, empty):
    one = spark.createDataFrame([(1, "abc def", "en"), (2, "7", "en"), (3, "xyz", None)],
                                "doc_id long, text string, lang string")
    from pyspark.sql import functions as F
    model = langid.fit(one, F.lit(True))
    assert [(r.lang_pred, r.score) for r in langid.predict(one, model, ["doc_id"]).orderBy(
        "doc_id").collect()] == [("en", 1.0), ("und", 0.0), ("en", 1.0)]
    none = langid.fit(one.where("lang is null"), F.lit(True))
    assert {r.lang_pred for r in langid.predict(one, none, ["doc_id"]).collect()} == {"und"}
    assert langid.languages(empty).collect() == []


def test_families_come_first():
    assert langid.family_of("en") == langid.family_of("de-AT") == "germanic"
    assert langid.family_of("es") == "romance"
    assert langid.family_of("xx") == "xx"
