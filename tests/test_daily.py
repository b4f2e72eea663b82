"""Sessions, overnight assignment, prior-only features, leakage."""
from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import DAY, by_key, flat_session, make_bars, weekdays
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import daily


def bar(mso, px):
    return (mso, px, px + 1, px - 1, px)


def test_bar_at_the_close_is_not_cash(spark):
    d = B.session_ohlc(make_bars(spark, {DAY: [bar(0, 100), bar(505, 110), bar(510, 150)]})).first()
    assert (d.cash_close, d.n_cash_bars, d.day_high_adj) == (110.0, 2, 151.0)


def test_friday_evening_belongs_to_monday(spark):
    fri, mon = dt.date(2024, 3, 8), dt.date(2024, 3, 11)
    got = by_key(B.session_ohlc(make_bars(spark, {
        fri: [bar(0, 100), bar(515, 105)], mon: [bar(-30, 95), bar(0, 101)]})), "session_date")
    m = got[mon]
    assert (m["overnight_open"], m["overnight_high"], m["overnight_low"], m["overnight_close"],
            m["n_overnight_bars"]) == (105.0, 106.0, 94.0, 95.0, 2)
    assert got[fri]["n_overnight_bars"] is None


def test_bars_of_a_date_without_cash_are_dropped(spark):
    fri, sun, mon = dt.date(2024, 3, 8), dt.date(2024, 3, 10), dt.date(2024, 3, 11)
    got = by_key(B.session_ohlc(make_bars(spark, {
        fri: [bar(0, 100), bar(515, 105)], sun: [bar(600, 90)], mon: [bar(0, 101)]})),
        "session_date")
    assert set(got) == {fri, mon}
    # Friday's evening went to Sunday; Sunday's evening is Monday's night
    assert (got[mon]["overnight_open"], got[mon]["n_overnight_bars"]) == (90.0, 1)
    assert got[mon]["prev_session_date"] == fri


def test_previous_levels_gap_and_high_water(spark):
    days = weekdays(3)
    b = make_bars(spark, {days[0]: [(0, 100, 110, 90, 105)], days[1]: [(0, 108, 120, 100, 118)],
                          days[2]: [(0, 125, 126, 117, 119)]})
    got = by_key(daily.daily_features(b), "session_date")
    d0, d1, d2 = (got[d] for d in days)
    assert d0["prior_ath"] is None and d0["gap_pct"] is None and not d0["ath_at_open"]
    assert "no_prior_ath" in d0["data_quality_flags"]
    assert (d1["previous_day_high"], d1["previous_day_low"], d1["previous_close"]) == (110, 90, 105)
    assert d1["gap_points"] == 3 and d1["gap_pct"] == pytest.approx(300 / 105)
    assert d1["prior_ath"] == 110 and d1["ath_broken_first_5m"]
    assert d2["ath_at_open"] and d2["open_above_pdh"] and d2["previous_day_return"] == pytest.approx(118 / 105 - 1)
    assert d1["open_location_in_overnight_range"] is None


def test_later_sessions_change_nothing_before_them(spark):
    rnd, days = random.Random(3), weekdays(90)
    px, sessions = 100.0, {}
    for d in days:
        px += rnd.uniform(-3, 3.2)
        sessions[d] = [(m, px, px + rnd.uniform(0, 4), px - rnd.uniform(0, 4),
                        px + rnd.uniform(-2, 2)) for m in (-10, 0, 5, 10, 520)]
    a = daily.daily_features(make_bars(spark, sessions))
    bent = dict(sessions)
    for d in days[70:]:
        bent[d] = [(m, o * 3, h * 3, lo * 3, c * 3) for m, o, h, lo, c in sessions[d]]
    b = daily.daily_features(make_bars(spark, bent))
    cut = F.lit(days[70])
    known = [f"`{c}`" for c in a.columns if c != "shortened_session"]
    x = a.where(F.col("session_date") < cut).select(known).orderBy("session_date").collect()
    y = b.where(F.col("session_date") < cut).select(known).orderBy("session_date").collect()
    assert x == y and len(x) == 70
    assert {r.daily_volatility_regime for r in x} >= {"unknown", "low", "normal"}


def test_instruments_do_not_mix(spark):
    days = weekdays(2)
    b = make_bars(spark, {(1, days[0]): [bar(0, 100)], (2, days[0]): [bar(0, 500)],
                          (1, days[1]): [bar(0, 101)], (2, days[1]): [bar(0, 501)]})
    got = by_key(daily.daily_features(b), "instrument_id", "session_date")
    assert got[1, days[1]]["prior_ath"] == 101 and got[2, days[1]]["prior_ath"] == 501


def test_calendar_marks_short_and_weekend_dates(spark):
    days = weekdays(5)
    s = {d: flat_session(102) for d in days[:4]} | {days[4]: flat_session(20),
                                                    dt.date(2024, 3, 9): [bar(600, 1)]}
    got = by_key(B.calendar(make_bars(spark, s)), "session_date")
    assert got[days[4]]["shortened_session"] and not got[days[0]]["shortened_session"]
    assert got[dt.date(2024, 3, 9)]["is_weekend"] and got[dt.date(2024, 3, 9)]["n_cash_bars"] == 0
    assert got[days[0]]["weekday"] == "Monday"


def test_overnight_slice_is_open_at_both_ends(spark):
    fri, mon = dt.date(2024, 3, 8), dt.date(2024, 3, 11)
    b = make_bars(spark, {fri: [bar(0, 1), bar(510, 2), bar(515, 3)], mon: [bar(-5, 4), bar(0, 5)]})
    got = B.overnight_slice(b, B.previous_session(b)).orderBy("session_date").collect()
    assert [(r.overnight_of, r.session_date, r.mso) for r in got] == [(mon, fri, 515), (mon, mon, -5)]


def test_previous_session_of_any_date(spark):
    fri, mon = dt.date(2024, 3, 8), dt.date(2024, 3, 11)
    s = make_bars(spark, {fri: [bar(0, 1)], mon: [bar(0, 1)]})
    q = spark.createDataFrame([(1, dt.date(2024, 3, 10)), (1, mon), (1, fri)],
                              "instrument_id long, session_date date")
    got = by_key(B.previous_session_of(s, q), "session_date")
    assert [got[d]["prev_session_date"] for d in (dt.date(2024, 3, 10), mon, fri)] == [fri, fri, None]


def test_empty_input_keeps_the_columns(spark):
    d = daily.daily_features(make_bars(spark, {DAY: []}))
    assert d.count() == 0 and set(daily.DAILY_COLUMNS) <= set(d.columns)
