from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from barloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH),
                             special_tokens={})


def test_digests_equal_the_library(docs, rows, library):
    got = sorted((tuple(r) for r in bpe.digests(docs, PATH, PATTERN).collect()), key=repr)
    want = []
    for d, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_round_trip_through_ids(docs, rows):
    ids = bpe.encode(docs, PATH, PATTERN, ["doc_id", "text"])
    back = bpe.decode(ids.drop("text"), PATH, PATTERN, ["doc_id"])
    assert sorted((tuple(r) for r in back.collect()), key=repr) == sorted(
        ((d, t or "") for d, t, *_ in rows), key=repr)


def test_odd_pieces(library):
    enc = bpe.Encoder(bpe.read_ranks(PATH), PATTERN, kept=50)
    rng = random.Random(1)
    parts = ["a", "b", " ", "é", "中", "́", "\n", "1", "٣", "😀", "!", "\t", "\xa0", "ab",
             "the", "\x00", "ß", "ſ", "'s", "tion", "zzz"]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert enc.encode(t) == library.encode_ordinary(t)
        assert b"".join(p[2] for p in enc.pieces(t)) == t.encode()
    for t in ("a" * 20000, "ab" * 5000, " " * 9000, "中" * 5000):
        assert enc.encode(t) == library.encode_ordinary(t)


def test_empty_table(empty):
    assert bpe.digests(empty, PATH, PATTERN).collect() == []


def test_vocabulary_without_a_byte_fails_loudly():
    with pytest.raises(ValueError, match="lacks"):
        bpe.Encoder({b"a": 0, b"b": 1, b"ab": 2}, PATTERN)


def test_neighbours_fit_as_the_merges_say():
    import public_tokenizers as p
    ranks = bpe.read_ranks(p.path("byte_bpe_multi_50k.tiktoken"))
    enc, rng, seen = bpe.Encoder(ranks, p.PATTERN), random.Random(3), Counter()
    tokens = list(ranks)
    for _ in range(4000):
        whole = rng.choice(tokens) + rng.choice([b"", rng.choice(tokens)])
        k = rng.randrange(1, len(whole) + 1)
        a, b = whole[:k], whole[k:]
        if a not in ranks or b not in ranks or not enc._made(ranks[a]):
            continue
        want = bpe.merge(b, ranks) == [b] and bpe.merge(a + b, ranks) == [a, b]
        assert enc._fits(ranks[a], ranks[b]) == want, (a, b)
        seen[want] += 1
    assert min(seen[True], seen[False]) > 100


def test_both_engines_split_alike():
    import public_tokenizers as p
    import regex
    enc, rng = bpe.Encoder({bytes([i]): i for i in range(256)}, p.PATTERN), random.Random(4)
    assert enc._near is not None and bpe.narrow(r"\p{Lu}+|\s+") is None
    odd = " \n\t'\x85\xa0\x1c²½ªßÿĀ é1a"
    for _ in range(2000):
        text = "".join(rng.choice(odd) if rng.random() < .5 else chr(rng.randrange(256))
                       for _ in range(30))
        assert enc.split(text) == regex.findall(p.PATTERN, text)
