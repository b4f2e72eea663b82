"""The registry: every query runs on the smallest tables and agrees with its statement."""
from __future__ import annotations

import datetime as dt
import math
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

TABLES = "/root/testdata/sf0.001"
ROWS_ONLY: set[str] = set()
SAMPLE = ["c13_overnight_asof", "e14_daily_features", "f9_opening_features", "g8_outcome_table",
          "i7_similarity_rank", "j3_session_table", "k13_context_table", "l9_trade_table",
          "m2_day_simulation_moving_stop", "n1_distribution", "b1_localize", "c4_roll_factors"]


def test_every_query_has_a_statement():
    from barloom.plans.catalog import QUERIES
    q, o = set(entry.queries()), set(entry.oracle_sql())
    assert o <= q and set(QUERIES) - o == ROWS_ONLY


def test_registry_loads_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


def rows(cols, data):
    at = sorted(range(len(cols)), key=cols.__getitem__)
    return sorted([tuple(plain(r[i]) for i in at) for r in data], key=repr)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="driver tables absent")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_statement(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in ("lineitem", "orders", "events"):
        con.execute(f"create view {t} as select * from '{TABLES}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    df = entry.queries()[name](spark, TABLES)
    assert rows(df.columns, df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="driver tables absent")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["instrument_id", "session_date", "state", "reached", "n_signals"]
    assert df.count() > 300


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="driver tables absent")
def test_stored_tables_give_the_same_results(spark, scratch):
    from barloom.plans.catalog import PLANS, StoredTables
    from barloom.plans.derived import build_all
    from barloom.sources.ticks import session_bars
    stored = StoredTables(spark, TABLES, build_all(session_bars(spark, TABLES), scratch))
    for name in ("m5_split_performance", "k16_label_mix", "i7_similarity_rank"):
        a, b = PLANS[name](stored), entry.queries()[name](spark, TABLES)
        assert a.columns == b.columns
        assert rows(a.columns, a.collect()) == rows(b.columns, b.collect())
