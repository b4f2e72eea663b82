"""The registered queries on the smallest tables; SQL where there is some."""
from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from barloom.llm.queries import QUERIES, STATEMENTS

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="driver tables absent")


def test_one_query_for_each_operator():
    found = sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES)
    assert found == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(STATEMENTS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_equals_its_statement(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{TABLES}/{t}.parquet'")
    cur = con.execute(STATEMENTS[name])
    names = [c[0] for c in cur.description]
    df = QUERIES[name](spark, TABLES)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(
        cur.fetchall(), key=repr)


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language", "near_duplicates", "decontaminate", "personal_data", "tokens"]
    import public_tokenizers as p
    import tiktoken

    from barloom.llm.bpe import read_ranks
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    out = corpus_pipeline.run(spark, TABLES).collect()
    ids = [r.doc_id for r in out]
    assert len(set(ids)) == len(ids) and set(ids) <= {r.doc_id for r in docs.collect()}
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=read_ranks(
        p.path(corpus_pipeline.VOCABULARY)), special_tokens={})
    assert all(len(enc.decode(r.ids)) == r.n_chars and len(r.ids) == r.n_tokens for r in out)


def test_stages_on_awkward_rows(spark, docs, empty):
    sizes = []
    for df in (docs, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, TABLES)
            if name != "tokens":
                assert out.columns == corpus_pipeline.COLUMNS
                assert [t for _, t in out.dtypes] == [t for _, t in empty.dtypes]
            sizes.append(out.count())
    assert sizes[5:] == [0] * 5 and all(sizes[:5])
