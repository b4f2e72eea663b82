"""No query reads the ticks twice: every branch reads the bars that were written once."""
from __future__ import annotations

import os

import pytest
from scans import leaves, reads

from barloom.operators import paths
from barloom.plans import catalog, search
from barloom.plans.storage import scratch

TABLES = "/root/testdata/sf0.001"
#: Bars and duplicates.
TWICE = {"d7_warnings", "d8_audit_row", "d7_warnings_dense", "d8_audit_dense"}
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="driver tables absent")


def test_ticks_are_scanned_once(spark, monkeypatch):
    """Plans are built and their scans counted; written tables are stood in for by empty ones."""
    seen = [0]

    def stand_in(df):
        seen[0] += leaves(df, "lineitem")
        return df.sparkSession.createDataFrame([], df.schema)

    monkeypatch.setattr(catalog, "cut", stand_in)
    monkeypatch.setattr(search, "cut", stand_in)
    monkeypatch.setattr(paths, "cut", stand_in)
    found = {}
    for name, query in catalog.QUERIES.items():
        seen[0] = 0
        found[name] = reads(query, spark, TABLES, "lineitem") + seen[0]
    wrong = {n: k for n, k in found.items() if k > (2 if n in TWICE else 1)}
    assert not wrong
    assert sum(k > 0 for k in found.values()) > 130


def nodes(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["b3_conflicts", "b4_keep_first", "g4_extreme_times",
                                  "g8_outcome_table"])
def test_large_aggregates_do_not_sort(spark, name):
    assert "SortAggregate" not in nodes(catalog.QUERIES[name](spark, TABLES))


def test_minute_filters_lie_below_the_first_exchange(spark):
    """Of the bars as a plan, late minutes are dropped before anything is shuffled again."""
    t = catalog.Tables(spark, TABLES, stored=False)
    from barloom.operators import context
    plan = context.openings(t.bars)._jdf.queryExecution().optimizedPlan().toString()
    tail = plan[plan.rindex("Aggregate"):]
    assert "Filter" in tail and "CASE WHEN" in tail  # the slot's minute, under the tick aggregate


def test_scratch_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch(Session())


def test_previous_session_answers_every_day(spark):
    got = catalog.QUERIES["c9_previous_session"](spark, TABLES)
    days = spark.read.parquet(f"{TABLES}/orders.parquet").selectExpr(
        "to_date(o_orderdate) as d").distinct()
    s = catalog.Tables(spark, TABLES, stored=False).daily
    lo, hi = s.selectExpr("min(session_date)", "max(session_date)").first()
    assert got.where("instrument_id = 0").count() == days.where(days.d.between(lo, hi)).count()
    assert got.where("prev_session_date >= session_date").count() == 0
