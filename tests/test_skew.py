"""Hot keys: results stay whole and the plans keep their map-side step."""
from __future__ import annotations

import datetime as dt
import subprocess
import sys
from pathlib import Path

from conftest import by_key, make_bars, weekdays
from pyspark.sql import functions as F

from barloom.operators import bars, clean, daily
from barloom.plans.storage import cut, scratch
from barloom.sources import ticks


def test_one_key_holds_a_third_of_all_rows(spark):
    hot = spark.range(20_000).select(F.lit(0).alias("k"), (F.col("id") % 3).cast("double").alias("v"))
    cold = spark.range(40_000).select(F.col("id").cast("int").alias("k") + 1,
                                      F.lit(1.0).alias("v"))
    d = hot.union(cold)
    c = clean.duplicate_counts(d, ["k"], ["v"]).first()
    assert (c.n_raw, c.n_exact_duplicates, c.n_conflicting_duplicates, c.n_clean) == (
        60_000, 20_000 - 3, 1, 40_001)
    assert clean.conflicts(d, ["k"], ["v"]).count() == 3
    assert clean.keep_first(d, ["k"], ["v"]).where("k = 0").first().n_raw == 20_000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_instrument_holds_most_ticks(spark):
    t = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") + 2).cast("long").alias("instrument_id"),
        F.lit(dt.date(2024, 3, 4)).alias("session_date"), (F.col("id") % 4 * 5).cast("int").alias("mso"),
        F.col("id").cast("decimal(20,0)").alias("seq"), F.col("id").cast("double").alias("px"),
        F.lit(1.0).alias("qty"))
    b = ticks.ticks_to_bars(t)
    assert "SortAggregate" not in plan(b) and plan(b).count("HashAggregate") == 2
    got = by_key(b.where("instrument_id = 1"), "mso")
    assert sum(r["n_ticks"] for r in got.values()) == 20_000 and len(got) == 4
    assert b.agg(F.sum("n_ticks")).first()[0] == 30_000
    assert (got[0]["open"], got[0]["close"]) == (4.0, 29_996.0)


def test_rebar_shrinks_a_busy_contract_before_the_shuffle(spark):
    d = spark.range(10_000).select(
        F.lit(1).alias("con_id"), F.timestamp_seconds(F.col("id")).alias("dt"),
        *[F.col("id").cast("double").alias(x) for x in bars.OHLC], F.lit(1.0).alias("volume"))
    b = bars.rebar(d, 60)
    assert "SortAggregate" not in plan(b)
    assert [r.volume for r in b.orderBy("bar_dt").collect()] == [3600.0, 3600.0, 2800.0]


def test_plans_have_no_cross_join_and_no_window_without_key(spark):
    days = weekdays(3)
    d = daily.daily_features(make_bars(spark, {x: [(0, 1, 2, 0.5, 1)] for x in days}))
    text = plan(d)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "SinglePartition" not in text and "SortAggregate" not in text


def test_cut_uses_the_folder_of_the_session(tmp_path):
    """The setting is fixed at the start of a session, hence a process of its own."""
    code = f"""
from barloom.session import get_spark
from barloom.plans.storage import cut
spark = get_spark("cut", 1, spark__checkpoint__dir={str(tmp_path)!r})
df = cut(spark.range(5))
assert df.count() == 5 and all({str(tmp_path)!r} in f for f in df.inputFiles()), df.inputFiles()
"""
    root = Path(__file__).resolve().parent.parent
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
