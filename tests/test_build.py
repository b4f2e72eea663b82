"""Batch build, published versions, inferred clock changes, replay."""
from __future__ import annotations

import datetime as dt
import re
import threading
import time

import pytest
from conftest import DAY, by_key, flat_session, make_bars, make_levels, weekdays
from pyspark.sql import functions as F

from barloom.operators import clean, pullback
from barloom.params import PullbackParams, SessionParams, SetupSpec
from barloom.plans import build, catalog, derived
from barloom.plans.store import Store
from barloom.sources.feeds import write_bucketed

P = SessionParams()
TABLES = "/root/testdata/sf0.001"


def feeds(spark, scratch):
    """Three sessions of the plain feed, then two contracts of two sessions each."""
    days = weekdays(7)
    table = make_bars(spark, {d: flat_session(12, 100 + 10 * i) for i, d in enumerate(days)})
    cols = ["instrument_id", "local_dt", "open", "high", "low", "close", "volume"]
    old = table.where(F.col("session_date") < F.lit(days[3])).select(*cols)
    second = F.col("session_date") >= F.lit(days[5])
    new = table.where(F.col("session_date") >= F.lit(days[3])).select(
        *cols, F.when(second, 2).otherwise(1).cast("long").alias("con_id"),
        F.when(second, 202406).otherwise(202403).alias("contract_month"),
        F.when(second, 20240621).otherwise(20240315).alias("expiry"))
    old.write.parquet(f"{scratch}/old")
    new.write.parquet(f"{scratch}/new")
    return spark.read.parquet(f"{scratch}/old"), spark.read.parquet(f"{scratch}/new"), days


def test_build_adjusts_all_that_follows(spark, scratch):
    old, new, days = feeds(spark, scratch)
    store = Store(spark, f"{scratch}/store")
    ratio = P.but(roll_method="ratio")
    made = build.build(store, old, new, ratio)
    assert sorted(made["tables"]) == sorted(build.ARTEFACTS)
    factor = 150 / 140  # the newer contract starts at 150, the older ends at 140
    master = by_key(store.table(made["version"], "master").where("mso = 0"), "session_date")
    for i, d in enumerate(days):
        f = 1.0 if i >= 5 else factor
        assert master[d]["adj_close"] == pytest.approx((100 + 10 * i) * f)
        assert master[d]["close"] == 100 + 10 * i and (master[d]["con_id"] is None) == (i < 3)
    daily = by_key(store.table(made["version"], "daily"), "session_date")
    assert daily[days[5]]["gap_points"] == pytest.approx(0)  # the step of the roll is gone
    assert daily[days[4]]["gap_points"] == pytest.approx(10 * factor)
    assert store.table(made["version"], "contracts").count() == 4 * 12
    assert store.table(made["version"], "opening").count() == 7
    again = build.build(store, old, new, ratio)
    assert again == made
    assert build.build(store, old, new, P)["version"] != made["version"]


def test_contract_minutes_meet_the_grid(spark, scratch):
    bars = make_bars(spark, {DAY: [(i, 100 + i, 102 + i, 99 + i, 101 + i) for i in range(10)]})
    new = bars.select("instrument_id", "local_dt", "open", "high", "low", "close", "volume",
                      F.lit(1).cast("long").alias("con_id"))
    factors = spark.createDataFrame([(1, 1, 202406, 2.0, 0.0)],
                                    "instrument_id long, con_id long, contract_month long, "
                                    "factor double, roll_offset double")
    rows = build.master(new.drop("con_id").where("false"), new, factors).orderBy("mso").collect()
    assert [(r.mso, r.open, r.high, r.low, r.close, r.adj_close, r.volume) for r in rows] == [
        (0, 100, 106, 99, 105, 210, 5), (5, 105, 111, 104, 110, 220, 5)]


def test_two_builders_build_once(spark, scratch):
    store, built, got = Store(spark, f"{scratch}/s", wait=0.1), [], []

    def tables(where):
        built.append(where)
        time.sleep(1)
        return {"t": store.write(spark.range(3), where)}

    threads = [threading.Thread(target=lambda: got.append(store.get_or_build("v", tables)))
               for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(built) == 1 and all(g == got[0] for g in got)
    assert store.table("v", "t").count() == 3


def test_the_first_manifest_stays(spark, scratch):
    store = Store(spark, f"{scratch}/s")
    first = store.publish("v", {"t": {"path": "a"}}, note=1)
    assert store.publish("v", {"t": {"path": "b"}}, note=2) == first == store.manifest("v")
    assert store.manifest("w") is None
    with pytest.raises(LookupError):
        store.table("w", "t")


def test_a_build_of_empty_feeds_is_empty(spark, scratch):
    old, new, _ = feeds(spark, scratch)
    store = Store(spark, f"{scratch}/store")
    made = build.build(store, old.where("false"), new.where("false"))
    for name in build.ARTEFACTS:
        assert store.table(made["version"], name).count() == 0


def test_a_lost_builder_is_replaced(spark, scratch):
    """A claim without a manifest holds others up for its lease only."""
    Store(spark, f"{scratch}/s").claim("v")
    late = Store(spark, f"{scratch}/s", lease=0.5, wait=0.1)

    def tables(where):
        return {"t": late.write(spark.range(2), where)}

    assert late.get_or_build("v", tables)["tables"]
    assert late.table("v", "t").count() == 2


def test_setups_of_one_timing_share_their_table(spark, scratch, monkeypatch):
    days = weekdays(3)
    make_bars(spark, {d: flat_session(40) for d in days}).write.parquet(f"{scratch}/b")
    bars, calls = spark.read.parquet(f"{scratch}/b"), []
    monkeypatch.setattr(derived.setups, "session_table",
                        lambda b, d, s: calls.append(s) or b.select("session_date", "mso"))
    for spec in (SetupSpec(), SetupSpec(gap_min_pct=9.0), SetupSpec(decision_bar=3)):
        assert derived.setup_table(f"{scratch}/t", bars, None, spec).count() == 120
    assert [s.decision_bar for s in calls] == [6, 3]


# ---- layout --------------------------------------------------------------------------
def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_buckets_of_sessions_need_no_exchange(spark, scratch):
    bars = make_bars(spark, {(k, d): flat_session(8) for k in (1, 2) for d in weekdays(3)})
    b = write_bucketed(bars, "bucketed_bars", 4, f"{scratch}/b")
    walked = pullback.walk(b)
    assert walked.count() == 48
    plan = executed(walked)
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert "Exchange" in executed(pullback.walk(bars))


def test_years_are_pruned_while_the_query_runs(spark):
    df = catalog.QUERIES["a3_runtime_pruning"](spark, TABLES)
    assert "dynamicpruning" in executed(df)


# ---- clock changes -------------------------------------------------------------------
def wall(*minutes):
    start = dt.datetime(2024, 11, 3, 0, 0)  # Chicago goes back from 2:00 to 1:00
    return [start + dt.timedelta(minutes=m) for m in minutes]


def inferred(spark, feeds_, **kw):
    rows = [(k, i, w) for k, ws in feeds_.items() for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "instrument_id long, seq long, wall timestamp_ntz")
    out = clean.localize_inferred(df, "America/Chicago", "Europe/Berlin", "seq", **kw).collect()
    return {(r.instrument_id, r.seq): (r.utc_dt.hour, r.utc_dt.minute, r.fallback_used)
            for r in out}


@pytest.mark.parametrize("block", [clean.SEQ_BLOCK, 2])
def test_second_pass_is_found_by_order(spark, block, monkeypatch):
    monkeypatch.setattr(clean, "SEQ_BLOCK", block)
    got = inferred(spark, {
        1: wall(30, 60, 90, 60, 90, 120),   # both passes
        2: wall(30, 60, 90, 120),           # no repeat: unclear
        3: wall(60, 90, 60, 60, 90),        # goes back twice: unclear
        4: wall(30, 60, 60, 120),           # equal times are a repeat
        5: wall(60, 90, 30, 60, 90),        # a row between: two hours, both unclear
        6: wall(0, 30, 120),                # no ambiguous row
        7: wall(60)})                       # a single one: unclear
    assert [got[1, i][:2] for i in range(6)] == [(5, 30), (6, 0), (6, 30), (7, 0), (7, 30), (8, 0)]
    assert {k[0]: v[2] for k, v in got.items()} == {
        1: False, 2: True, 3: True, 4: False, 5: True, 6: False, 7: True}
    assert [got[3, i][0] for i in range(5)] == [6, 6, 6, 6, 6]
    assert [got[4, i][0] for i in range(4)] == [5, 6, 7, 8]


def test_one_unclear_hour_switches_the_whole_feed(spark):
    year_later = [w + dt.timedelta(days=364) for w in wall(60, 90)]  # 2 November 2025
    good = wall(60, 90, 60, 90, 300)
    got = inferred(spark, {1: good + year_later, 2: good + year_later + year_later, 3: []})
    assert {v[2] for k, v in got.items() if k[0] == 1} == {True}
    assert got[1, 2][0] == 6 and got[2, 2][0] == 7
    assert got[2, 7][0] == 7 and not got[2, 7][2]


def test_missing_walls_and_empty_feed(spark):
    got = inferred(spark, {1: [*wall(60), *wall(60)]})
    assert got[1, 1][0] == 7
    df = spark.createDataFrame([(1, 0, None)], "instrument_id long, seq long, wall timestamp_ntz")
    out = clean.localize_inferred(df, "America/Chicago", "Europe/Berlin", "seq").collect()
    assert out[0].utc_dt is None and out[0].fallback_used is False


# ---- replay --------------------------------------------------------------------------
def steps():
    """A rise, a pullback and a new turn up, then a second one."""
    closes = [100, 103, 106, 109, 107, 105, 108, 112, 110, 113, 117, 114, 118, 120]
    return [(5 * i, c - 1, c + 1, c - 2, c) for i, c in enumerate(closes)]


def test_replay_equals_decisions_at_each_deadline(spark):
    days = weekdays(2)
    bars = make_bars(spark, {days[0]: steps(), days[1]: flat_session(20)})
    levels = make_levels(spark, days, pdh=125.0, pdl=90.0, pdc=99.0, onh=130.0, onl=95.0)
    minutes = [-20, 0, 5, 10, 14, 20, 30, 33, 35, 50, 65, 90, 500]
    asked = spark.createDataFrame([(1, d, m) for d in days for m in minutes],
                                  "instrument_id long, asked_date date, as_of int")
    got = by_key(pullback.replay(bars, levels, asked), "session_date", "as_of")
    assert len(got) == 2 * len(minutes)
    for m in minutes:
        p = PullbackParams(deadline_min=m)
        want = by_key(pullback.decisions(pullback.walk(bars, p), levels, p), "session_date")
        for d in days:
            have = {k: v for k, v in got[d, m].items() if k not in ("asked_date", "as_of")}
            assert have == want[d], (d, m)
    assert len({v["decision"] for v in got.values()}) >= 3


def test_a_date_means_the_session_before_it(spark):
    days = [DAY, DAY + dt.timedelta(days=7)]
    sessions = make_levels(spark, days)
    ask = [DAY - dt.timedelta(days=3), DAY, DAY + dt.timedelta(days=6), days[1],
           DAY + dt.timedelta(days=99)]
    asked = spark.createDataFrame([(1, d, 60) for d in ask] + [(2, DAY, 60)],
                                  "instrument_id long, asked_date date, as_of int")
    got = by_key(pullback.session_of(asked, sessions), "instrument_id", "asked_date")
    assert [got[1, d]["session_date"] for d in ask] == [DAY, DAY, DAY, days[1], days[1]]
    assert got[2, DAY]["session_date"] is None


def test_replay_deals_more_tasks_to_more_bars(spark, scratch, monkeypatch):
    """A task's share of the bars is bounded; the number of shuffle partitions alone is not it."""
    from barloom.plans import storage
    days = weekdays(40)
    make_bars(spark, {d: flat_session(12) for d in days}).write.parquet(f"{scratch}/bars")
    b = spark.read.parquet(f"{scratch}/bars")
    levels = make_levels(spark, days, pdh=101.0)
    asked = spark.createDataFrame([(1, days[3], 30)], "instrument_id long, asked_date date, as_of int")

    def tasks() -> int:
        plan = pullback.replay(b, levels, asked)._jdf.queryExecution().optimizedPlan().toString()
        return max(int(n) for n in re.findall(r"RepartitionByExpression .*, (\d+)", plan))

    assert tasks() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = sum(n for _, n, _ in storage.files_of(b))
    monkeypatch.setattr(pullback, "dealt", lambda df, *k: storage.dealt(df, *k, task_bytes=size // 50))
    assert tasks() >= 50
    assert pullback.replay(b, levels, asked).count() == 1


def test_the_build_exchanges_raw_bars_only(spark, scratch):
    """Adjusted prices are made behind the exchange and written where they are: by broadcast or
    not, nothing deals them again."""
    old, new, _ = feeds(spark, scratch)
    factors = spark.createDataFrame([(1, 1, 202403, 2.0, 0.0)],
                                    "instrument_id long, con_id long, contract_month long, "
                                    "factor double, roll_offset double")
    m = build.master(old, new, factors).repartition("instrument_id").sortWithinPartitions("session_date")
    m.collect()
    plan = m._jdf.queryExecution().executedPlan().toString()
    final = plan[:plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    dealt = [line for line in final.splitlines() if "hashpartitioning" in line]
    assert dealt and all("hashpartitioning(instrument_id#" in x and "con_id" not in x for x in dealt)
    assert len(dealt) <= 4
