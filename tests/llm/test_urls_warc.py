from __future__ import annotations

import gzip
import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import pytest

from barloom.llm import urls, warc

URLS = ["http://a.example.net/en/x", "https://EXAMPLE.NET/en/", "http://example.net/EN/x",
        "http://net/", "http://net", "http://anet/x", "http://x.org/fr/a?b#c", "http://org/fr",
        "http://x.org/fr/", "http://example.com/de/1", "http://notexample.com/de/", None, "", "x",
        "://", "a://b://c/de/", "http://www.cheap-pills.example.com/en/", "http://spam-farm.org/fr/",
        "http://É.net/é", "http://h.net?x=/y", "http://u@h.net:8080/p", "http://x.com/a\nb?c\nd",
        "http://ads.example.com/banner/1", "http://my-online-casino.com/"]


def plain(url):
    """The contract, word by word."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    best = None
    for rule, verdict in (("net/", "block"), ("example.net/en/", "allow"),
                          ("example.com/de/", "block"), ("org/fr/", "allow")):
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            if best is None or len(rule) > len(best[0]):
                best = rule, verdict
    return host, path, best


def test_addresses(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3])],
                               "page_id long, url string")
    got = urls.judge(df).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, best = plain(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        if best:
            assert r.verdict == best[1]
        else:
            assert (r.verdict == "block") == (r.pattern is not None)
    by = {URLS[r.page_id]: r for r in got}
    assert by["http://www.cheap-pills.example.com/en/"].verdict == "block"
    assert by["http://spam-farm.org/fr/"].verdict == "allow"
    assert by["http://ads.example.com/banner/1"].verdict == "block"
    assert by[None].verdict == "allow"


def test_many_rules_equal_brute_force(spark):
    rng = random.Random(1)
    parts = ["a", "b", "cc", "dd", "com", "net"]
    rules = tuple({r.name: r for r in (urls.address_rule(
        rng.choice(["block", "allow"]), ".".join(rng.choices(parts, k=rng.randint(1, 3))) + "/"
        + rng.choice(["", "a/", "b/cc/"])) for _ in range(60))}.values())
    pages = [(i, "http://" + ".".join(rng.choices(parts, k=3)) + "/" + "/".join(
        rng.choices(parts, k=3))) for i in range(300)]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules=rules).collect()
    for r in got:
        fit = [x for x in rules if re.search(x.pattern, r.host + r.path)]
        want = min(fit, key=lambda x: (-len(x.name), x.name), default=None)
        assert r.rule == (want and want.name)


def test_rules_need_a_literal(spark):
    df = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    with pytest.raises(ValueError, match="literal"):
        urls.judge(df, rules=(urls.pattern_rule("block", ".*"),)).collect()
    assert urls.judge(df, rules=()).first().verdict == "allow"
    assert urls.judge(df.where("false")).collect() == []


def page_rows():
    big, tricky = "x" * 1200, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40
    return [(1, "http://b.org/1", big), (2, "http://a.org/2", big), (9, "http://www.a.org/2", big),
            (4, None, tricky), (5, "http://é.org/?q=ü", "é" * 499), (6, "u", "é" * 500),
            (7, "http://é.org/", "é" * 500), (8, "http://c.org/x\r\ny", None), (10, "", ""),
            (11, "http://a.org/1", ""), (12, "http://a.org/1", "small"), (13, "x", "small"),
            (2, "http://a.org/2", big), (None, "http://n.org/", big), (None, None, None),
            (14, "http://lines.org/", "a\nb\r\nc\rd" * 300)]


def frame(spark, rows):
    from pyspark.sql import functions as F
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit("clash") for c in ("payload_digest", "first_id", "value", "file", "range_no")})


def test_records_round_trip(spark):
    rows = page_rows()
    got = warc.archive(frame(spark, rows)).collect()
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            first[html] = max(first.get(html, i), i)
    want = Counter()
    for i, url, html in rows:
        body = (html or "").encode()
        other = len(body) >= 1000 and first[html] != i
        want[(i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if other else "response",
              first[html] if other else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                   for r in got) == want


def test_merged_order_is_global(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 30_000)
    rng = random.Random(2)
    rows = [(i, f"http://h{rng.randrange(9)}.org/{rng.randrange(4)}", "y" * rng.randrange(2000))
            for i in range(400)] + [(1000 + i, "http://hot.org/", "z") for i in range(200)]
    rng.shuffle(rows)
    got = warc.archive(frame(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows) and len({r.file for r in got}) > 5
    inside = sorted(got, key=lambda r: (r.range_no, r.range_pos))
    keys = [(r.url_key, r.capture_time, r.page_id) for r in inside]
    assert keys == sorted(keys)
    assert len({r.range_no for r in got if r.url_key == "org,hot)/"}) > 1


def test_files_are_records_with_their_lengths(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(warc.decisions(frame(spark, page_rows())), path)
    n = 0
    for f in Path(path).glob("*.gz"):
        data = gzip.decompress(f.read_bytes())
        at = 0
        for offset, length, fields, _ in warc.parse(data):
            assert offset == at and fields["warc-type"] in ("response", "revisit")
            at, n = at + length, n + 1
        assert at == len(data)
    assert n == len(page_rows())


def test_loser_tree():
    rng = random.Random(3)
    for k in range(1, 12):
        runs = [sorted((rng.randrange(20),) for _ in range(rng.randrange(8))) for _ in range(k)]
        out = list(warc.LoserTree([iter(r) for r in runs]))
        assert [h for h, _ in out] == sorted(h for r in runs for h in r)
    assert list(warc.LoserTree([])) == []


def test_keys_and_empty(spark):
    assert warc.url_key("HTTP://www.Example.org:80/A?b") == "org,example):80/a?b"
    assert warc.url_key(None) == ""
    assert warc.archive(frame(spark, page_rows()).where("false")).collect() == []


def test_any_id_and_any_zone(spark):
    """Hashed ids and the session's zone leave the time of capture a time, in UTC."""
    rows = [(2 ** 62, "http://a.org/x\r\ny", "p" * 2000), (-2 ** 63, None, "p" * 2000),
            (0, "http://b.org/", "q"), (None, "http://c.org/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = {r.page_id: r for r in warc.archive(df).collect()}
        times = {r.page_id: r.capture_time for r in warc.decisions(df).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got[-2 ** 63].refers_to == 2 ** 62 and len(got) == 4
    assert times[0] == "2024-01-01T00:00:00Z" and all(len(t) == 20 for t in times.values())
    assert got[2 ** 62].url == "http://a.org/x%0D%0Ay"
