"""Operators that compose partial results: averages, drawdown, bounded warping."""
from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from conftest import DAY, make_bars
from pyspark.sql import functions as F
from scans import leaves

from barloom.operators import backtest, context, paths


def walk_bars(spark, days, bars, seed=1):
    rng = random.Random(seed)
    out = {}
    for inst in (1, 2):
        px = 100.0
        for k in range(days):
            rows = []
            for i in range(rng.randint(1, bars)):
                px += rng.gauss(0, 1)
                rows.append((5 * i, px, px + 1, px - 1, px))
            out[inst, DAY + dt.timedelta(days=k)] = rows
    return make_bars(spark, out), out


@pytest.mark.parametrize("span", [1, 2, 20, 500])
def test_running_average_equals_the_recursion(spark, span):
    bars, rows = walk_bars(spark, 6, 40)
    got = context.running_average(bars, span, "y").select(
        "instrument_id", "session_date", "mso", "y").toPandas()
    got = got.sort_values(["instrument_id", "session_date", "mso"])
    for inst in (1, 2):
        px = pd.Series([r[4] for (k, _), v in sorted(rows.items()) if k == inst for r in v])
        want = px.ewm(span=span, adjust=False).mean()
        assert np.allclose(got[got.instrument_id == inst].y, want, rtol=1e-12)


def test_frame_spans_sessions_on_one_index(spark):
    bars, rows = walk_bars(spark, 5, 20)
    last = DAY + dt.timedelta(days=3)
    dates = spark.createDataFrame([(1, last), (2, DAY + dt.timedelta(days=99))],
                                  "instrument_id long, last_date date")
    got = context.multiday_frame(bars, dates, lookback=2, fast=3, slow=9).orderBy("x").toPandas()
    px = [r[4] for k in range(1, 4) for r in rows[1, DAY + dt.timedelta(days=k)]]
    assert list(got.x) == list(range(len(px))) and set(got.instrument_id) == {1}
    assert np.allclose(got.ema_fast, pd.Series(px).ewm(span=3, adjust=False).mean())
    assert np.allclose(got.ema_slow, pd.Series(px).ewm(span=9, adjust=False).mean())


def test_frame_deals_its_bars_once(spark, scratch):
    """Two averages over one set of sessions; the plan of the first is not run again for the second."""
    bars, _ = walk_bars(spark, 3, 5)
    bars.write.parquet(f"{scratch}/bars.parquet")
    dates = spark.createDataFrame([(1, DAY + dt.timedelta(days=2))], "instrument_id long, last_date date")
    f = context.multiday_frame(spark.read.parquet(f"{scratch}/bars.parquet"), dates)
    assert leaves(f, "bars") <= 4
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number") <= 2  # the dates are numbered, the bars are not


def test_drawdown_of_a_pool_equals_the_curve(spark):
    rng = random.Random(2)
    rows = [(i % 3, DAY + dt.timedelta(days=rng.randrange(20)), rng.randrange(5), i,
             None if rng.random() < .05 else rng.gauss(0, 1)) for i in range(300)]
    df = spark.createDataFrame(
        rows, "kind long, session_date date, signal_mso int, instrument_id long, r_multiple double")
    levels = ("session_date", "signal_mso", "instrument_id")
    for by in ((), ("kind",)):
        got = {tuple(r[k] for k in by): r.max_drawdown_r
               for r in backtest.max_drawdown(df, by, *levels).collect()}
        for key in got:
            mine = sorted(r for r in rows if r[4] is not None and (not by or r[0] == key[0]))
            eq = np.cumsum([r[4] for r in sorted(mine, key=lambda r: r[1:4])])
            assert got[key] == pytest.approx((np.maximum.accumulate(eq) - eq).max())
    pooled = backtest.pooled_performance(df, (), levels).collect()
    assert len(pooled) == 1 and pooled[0].n == sum(r[4] is not None for r in rows)
    assert backtest.pooled_performance(df.where("false"), ("kind",), levels).collect() == []


def pairs(spark, n=60, size=12, seed=3):
    rng = random.Random(seed)
    ref = np.cumsum([rng.gauss(0, 1) for _ in range(size)]).tolist()
    rows = []
    for i in range(n):
        a = [x + rng.gauss(0, .2 + i / 20) for x in ref]
        if i % 7 == 0:
            a[rng.randrange(size)] = None
        rows.append((1 + i % 2, DAY + dt.timedelta(days=i), a, ref))
    rows.append((1, DAY - dt.timedelta(days=1), [None] * size, ref))
    return spark.createDataFrame(rows, "instrument_id long, session_date date, "
                                       "path array<double>, ref_path array<double>")


@pytest.mark.parametrize("band", [None, 1, 3])
def test_nearest_by_warping_equals_warping_all(spark, band):
    d = pairs(spark)
    every = paths.path_distance(d, "dtw", band).where("path_dist is not null").toPandas()
    every = every.sort_values(["instrument_id", "path_dist", "session_date"])
    want = every.groupby("instrument_id").head(5)
    got = paths.nearest_by_warping(d, 5, band).toPandas().sort_values(["instrument_id", "rank"])
    assert list(got.session_date) == list(want.session_date)
    assert np.allclose(got.path_dist, want.path_dist)
    assert paths.warped_pairs(d, 5, band).count() < (60 if band is None else 45)


@pytest.mark.parametrize("band", [None, 1, 2, 50])
def test_bounds_stay_below_the_distance(spark, band):
    d = pairs(spark, 40).where(~F.exists("path", lambda x: x.isNull()))
    rows = d.select(paths.warping_bound(F.col("path"), F.col("ref_path"), band).alias("b"),
                    paths.dtw_udf(band)("path", "ref_path").alias("d")).collect()
    assert len(rows) > 30 and all(r.b <= r.d + 1e-12 for r in rows) and max(r.b for r in rows) > 0
