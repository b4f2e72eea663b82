from __future__ import annotations

import hashlib
import re

import pytest

from barloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c)
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        s += x
    return s % 10 == 0


def plain(text):
    """The patterns as they are written down."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text)
            if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return out


TEXTS = [
    "a@b.c_d@e.f x@y z@w. q.w+e%r-t@h-1.co.uk@x.y @a.b", "a@@b.c a@b..c é@ü.de .@-.-",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.4 1.2.3 99999999999.1.1.1 01.02.03.255.",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111 1111 1111 41111111111111111111111",
    "+1 (555) 123-4567 ++49 30 1234567 +1 +12 +1-2-3-4-5-6-7-8- +123456789012345678",
    "4111111111111111@x.com +4111111111111111 1.1.1.1@1.1.1.1 \u0661\u0662@a.b",
    "", "no data", "é" * 50 + " me@home.org " + "中" * 9 + " 10.0.0.1"]


@pytest.mark.parametrize("text", TEXTS)
def test_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_random_spans_equal_the_patterns():
    import random
    rng = random.Random(8)
    for _ in range(3000):
        t = "".join(rng.choices("ab.1234567890@+- ()_é\n", k=rng.randint(0, 60)))
        assert pii.base_spans(t) == plain(t), t


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1" * 150_000,
              "a@" * 150_000):
        pii.base_spans(t)


def frame(spark):
    """``zorblax`` stands beside one address in different places and nowhere else; ``common``
    stands everywhere."""
    noise = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot", "golfer", "hotels"]
    rows = [(i, f"{noise[i]} common zorblax wrote to me@secret.org about {noise[-i - 1]} common")
            for i in range(6)]
    rows += [(10 + i, f"common words of {noise[i % 8]} number{i} only") for i in range(60)]
    rows += [(90, None), (91, ""), (None, "mail x@y.zz now"), (0, rows[0][1])]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_terms_that_disclose(spark):
    df, rows = frame(spark)
    got = pii.report(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next((t for d, t in rows if d == r.doc_id), None) or ""
        base = pii.written(plain(text))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        terms = [text[int(a):int(b)] for k, a, b in
                 (x.split(":") for x in r.spans.split(",") if x) if k == "term"]
        assert r.spans.startswith(base) and r.n_term == len(terms)
        if "secret" in text:
            assert terms == ["zorblax", "wrote", "about"] and r.n_email == 1
        else:
            assert not terms


def test_information_by_hand(spark):
    """PMI and content of one term against the counts of a small corpus."""
    import math
    df, rows = frame(spark)
    n, d_e, d_t, d_et = len(rows), 7, 7, 7
    assert math.log2(n * d_et / (d_e * d_t)) == pytest.approx(math.log2(n / d_e))
    found = pii.find(df).where("terms is not null").collect()
    assert all(t["removed"] for r in found for t in r.terms)


def test_sanitised_text(spark):
    df, rows = frame(spark)
    out = pii.sanitise(df, ["doc_id", "text"]).collect()
    assert len(out) == len(rows)
    text = {r.doc_id: r.text for r in out}
    assert "secret" not in text[3] and "zorblax" not in text[3] and "[EMAIL]" in text[3]
    assert text[90] is None and text[91] == "" and text[12] == rows[8][1]
    assert text[None] == "mail [EMAIL] now"
    assert pii.mask("abcdef", "email:1:3,ip:2:5", [{"s": 5, "e": 6, "removed": False}]) == \
        "a[EMAIL][TERM]"


def test_far_repeated_short_and_joined_terms(spark, monkeypatch):
    """Terms stand anywhere in a document and each time count; names may be short, hyphenated
    or hold an apostrophe or digits."""
    names = ["Kim", "Anna-Maria", "O'Brien", "acct77", "zorblax"]
    filler = [" ".join(f"plain{(7 * i + j) % 30}" for j in range(90)) for i in range(80)]
    rows = [(i, f"{filler[i]} zorblax, {filler[i + 1]} note{'abcdef'[i]} plain3 Kim ({names[1]}) me@secret.org "
                f"to here{'uvwxyz'[i]} {filler[i + 2]} (O'Brien) acct77. Zorblax 'kim' {filler[i]} Anna-Maria!")
            for i in range(6)]
    rows += [(10 + i, filler[i] + " to") for i in range(70)]
    rows += [(90, "zorblax-like Kimmy Brien Anna Maria")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    results = []
    for limits in ((pii.LISTED, pii.COMMON, pii.HELD), (0, 0, 1)):
        for name, value in zip(("LISTED", "COMMON", "HELD"), limits):
            monkeypatch.setattr(pii, name, value)
        results.append(sorted(pii.report(df).collect()))
    assert results[0] == results[1]
    for r in results[0]:
        text = dict(rows)[r.doc_id]
        terms = [text[int(a):int(b)] for k, a, b in
                 (x.split(":") for x in r.spans.split(",") if x) if k == "term"]
        assert terms == (["zorblax", "Kim", "Anna-Maria", "O'Brien", "acct77", "Zorblax", "kim",
                          "Anna-Maria"] if r.doc_id < 6 else [])


def test_words_of_both_patterns_are_the_same():
    import random

    import pyarrow as pa
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab-'’ .,_@é中\n\t\u00a0„\x1f\\[]^", k=rng.randint(0, 40)))
             for _ in range(3000)]
    for t, x in zip(texts, pii.plain(pa.array(texts)).to_pylist()):
        assert pii._TERM.findall(t) == re.findall(r"[^\x20\x09-\x0D]+", x), t


def test_all_words_counted_when_the_list_is_long(spark, monkeypatch):
    df, _ = frame(spark)
    want = sorted(pii.report(df).collect(), key=repr)
    monkeypatch.setattr(pii, "LISTED", 0)
    assert sorted(pii.report(df).collect(), key=repr) == want


def test_awkward_rows_and_empty(docs, rows, empty):
    assert pii.report(docs).count() == len(rows)
    assert pii.sanitise(docs, ["doc_id", "text", "lang"]).count() == len(rows)
    assert pii.report(empty).collect() == []
