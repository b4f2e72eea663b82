"""Documents with the awkward cases every operator must define: nulls in any column, empty and
blank texts, repeated rows and ids, ties, long texts, and columns named like internal ones."""
from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("k", "t", "node", "sig", "root", "n", "h", "th", "base", "terms", "hits", "block", "g",
           "token", "slot", "shard", "host", "path", "rule", "score", "label", "value", "url_key")


def prose(rng: random.Random, n: int, letters: str = "abcdefghij") -> str:
    words = ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n)]
    return " ".join(w + rng.choice(["", "", "", ",", ".", ".\n"]) for w in words)


def edited(rng: random.Random, text: str, n: int) -> str:
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = "edit" + str(rng.randrange(10 ** 6))
    return " ".join(words)


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(5)
    out = []
    base = prose(rng, 150)
    for i in range(12):
        out.append((i, edited(rng, base, rng.randint(0, 6))))
    out += [(20 + i, base) for i in range(4)]
    shared = prose(rng, 60)
    for i in range(10):
        out.append((40 + i, prose(rng, rng.randint(5, 90)) + "\n" + shared + "\n"
                    + prose(rng, rng.randint(5, 90))))
    out += [(60 + i, prose(rng, rng.randint(1, 8))) for i in range(6)]
    out += [(70, None), (71, ""), (72, " \t\n "), (73, "Word"), (74, "word"), (75, "WORD"),
            (76, "é ü ñ 中文 😀"), (77, "éÜ x"), (78, "a b c d e"), (79, "A B C D E"),
            (80, "ab" * 700), (81, "ab" * 700 + "x"), (82, prose(rng, 30000)),
            (83, "1234 5678 9"), (84, "\0\0 nul \0")]
    out += [(None, base), (None, None), (None, prose(rng, 20)), (5, out[5][1]), (71, "")]
    langs = ["en", "de", None, "fr"]
    return [(d, t, langs[i % 4], "s" if i % 3 else None, None if t is None else len(t))
            for i, (d, t) in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    from pyspark.sql import functions as F
    path = str(tmp_path_factory.mktemp("docs") / "t")
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
