"""Shared session and small bar tables; no test reads data from outside the repository
except the registry test, which uses the driver's smallest tables."""
from __future__ import annotations

import datetime as dt
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import functions as F  # noqa: E402

from barloom.session import get_spark  # noqa: E402

DAY = dt.date(2024, 3, 4)  # a Monday


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", spark__sql__shuffle__partitions="4")
    if s.sparkContext.getCheckpointDir() is None:
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    yield s


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


SCHEMA = ("instrument_id long, session_date date, mso int, adj_open double, adj_high double, "
          "adj_low double, adj_close double, feed string")


def make_bars(spark, sessions, feed="feed_5m"):
    """``sessions``: {date or (instrument, date): [(mso, open, high, low, close), ...]}."""
    rows = []
    for key, bars in sessions.items():
        inst, day = key if isinstance(key, tuple) else (1, key)
        rows += [(inst, day, m, float(o), float(h), float(lo), float(c), feed)
                 for m, o, h, lo, c in bars]
    d = spark.createDataFrame(rows, SCHEMA)
    tod = F.col("mso") + 540
    return d.withColumns({
        "tod_min": tod, "is_cash": (tod >= 540) & (tod < 1050),
        "local_dt": F.col("session_date").cast("timestamp_ntz") + F.make_dt_interval(mins=tod),
        "open": F.col("adj_open"), "high": F.col("adj_high"), "low": F.col("adj_low"),
        "close": F.col("adj_close"), "volume": F.lit(1.0)})


def five_minutes(ohlc, start=0):
    return [(start + 5 * i, *x) for i, x in enumerate(ohlc)]


def flat_session(n=12, px=100.0, start=0):
    return five_minutes([(px, px + 1, px - 1, px)] * n, start)


def weekdays(n, first=DAY):
    out, d = [], first
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


LEVELS = ("instrument_id long, session_date date, ref_open double, pdh double, pdl double, "
          "pdc double, onh double, onl double, prior_ath double, atr double, prev_range double")


def make_levels(spark, days, **values):
    names = ["ref_open", "pdh", "pdl", "pdc", "onh", "onl", "prior_ath", "atr", "prev_range"]
    rows = [(1, d, *[values.get(n) for n in names]) for d in days]
    return spark.createDataFrame(rows, LEVELS)


def by_key(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict()
            for r in df.collect()}
