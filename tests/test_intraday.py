"""Opening features, outcomes, labels, setups."""
from __future__ import annotations

import pytest
from conftest import DAY, by_key, five_minutes, flat_session, make_bars, weekdays
from pyspark.sql import functions as F

from barloom.operators import context, daily, opening, outcomes, setups
from barloom.params import ContextParams, ContextSpec, SetupSpec, in_context

DAILY = ("instrument_id long, session_date date, cash_open_adj double, cash_close_adj double, "
         "previous_day_high double, previous_day_low double, previous_close double, "
         "overnight_high_adj double, overnight_low_adj double, prior_ath double, atr double, "
         "previous_day_range double, gap_pct double")


def one_day(spark, op=100.0, pdh=None, pdl=None, pdc=None, onh=None, onl=None, ath=None,
            atr=None, pr=None, close=None):
    gap = None if pdc is None else 100.0 * (op - pdc) / pdc
    return spark.createDataFrame([(1, DAY, op, close, pdh, pdl, pdc, onh, onl, ath, atr, pr, gap)],
                                 DAILY)


PATH = five_minutes([(100, 104, 99, 103), (103, 105, 101, 102), (102, 106, 100, 105),
                     (105, 105.5, 101, 101.5), (101.5, 104, 96, 98), (98, 99, 95, 96)])


def test_features_stop_at_the_cutoff(spark):
    d = one_day(spark, atr=10.0, pr=20.0, pdh=101.0)
    a = opening.opening_features(make_bars(spark, {DAY: PATH}), d, 15)
    wild = PATH[:4] + [(m, 500, 900, 1, 2) for m, *_ in PATH[4:]]
    b = opening.opening_features(make_bars(spark, {DAY: wild}), d, 15)
    assert a.collect() == b.collect()
    r = a.first()
    assert r.n_window_bars == 4 and r.high_low_range == 7.0
    assert r.first_bar_breaks_PDH and not r.first_bar_breaks_prior_ATH
    assert r.directional_efficiency == pytest.approx(1.5 / (3 + 1 + 3 + 3.5))
    assert (r.number_of_higher_highs, r.number_of_lower_highs) == (2, 1)
    assert r.number_of_new_highs_after_first_bar == 2
    assert r.average_distance_between_new_highs == 5.0
    assert r.minutes_until_next_meaningful_new_high == 10
    assert r.opening_range_break_direction == 1 and r.first_opening_range_break_min == 5


def test_weakness_events(spark):
    r = opening.opening_features(make_bars(spark, {DAY: PATH}), one_day(spark, atr=10.0), 90).first()
    assert r.first_bearish_expansion_min == 20 and r.failed_to_reclaim_bear_expansion_high
    assert r.first_break_first15m_low_min == 20 and r.first_close_below_prev2_low_min == 20
    assert r.first_stall_break_min == 20 and r.first_break_first30m_low_min is None


def test_single_bar_and_missing_levels(spark):
    r = opening.opening_features(make_bars(spark, {DAY: PATH[:1]}), one_day(spark), 90).first()
    assert r.number_of_new_highs_after_first_bar == 0 and r.extension_ratio is None
    assert r.range_normalized_by_ATR is None and not r.first_bar_breaks_PDH
    flat = make_bars(spark, {DAY: [(0, 5, 5, 5, 5), (5, 5, 5, 5, 5)]})
    z = opening.opening_features(flat, one_day(spark, op=5.0), 90).first()
    assert z.close_location_in_window_range is None and z.directional_efficiency is None


def after(low, high):
    return PATH[:3] + [(15, 105, high, low, 104)]


@pytest.mark.parametrize("low, high, pdc, full, half", [
    (97.5, 106, 95.0, False, True), (95.0, 106, 95.0, True, True), (99.9, 106, 95.0, False, False),
    (104, 103.0, 105.0, False, True), (104, 105.0, 105.0, True, True)])
def test_gap_fill(spark, low, high, pdc, full, half):
    b = make_bars(spark, {DAY: after(low, high)})
    r = outcomes.session_outcomes(b, one_day(spark, pdc=pdc), 10).first()
    assert (r.full_gap_fill, r.half_gap_fill) == (full, half)


def test_outcomes_without_later_bars_or_sessions(spark):
    b = make_bars(spark, {DAY: PATH[:2]})
    r = outcomes.session_outcomes(b, one_day(spark), 10).first()
    assert r.max_favorable_excursion_pct is None and r.break_observed_high is False
    assert r.close_above_prior_ath is None and r.full_gap_fill is False
    none = outcomes.session_outcomes(b, one_day(spark), 10, one_day(spark).where("false"))
    assert none.count() == 0 and "session_date" in none.columns


@pytest.mark.parametrize("ohlc, label", [
    ([(100, 108, 100, 107), (107, 109, 104, 105), (105, 105, 97, 98)], "REJECTION_UP"),
    ([(100, 100, 92, 93), (93, 96, 91, 95), (95, 103, 95, 102)], "REJECTION_DOWN"),
    ([(100, 104, 99.5, 103), (103, 106, 102, 105), (105, 110, 104, 109)], "DRIVE_UP"),
    ([(100, 100.5, 96, 97), (97, 98, 94, 95), (95, 96, 90, 91)], "DRIVE_DOWN"),
    ([(100, 103, 97, 101), (101, 103, 98, 99), (99, 102, 97, 100.5)], "RANGE_OPEN")])
def test_opening_labels(spark, ohlc, label):
    r = context.openings(make_bars(spark, {DAY: five_minutes(ohlc + [ohlc[-1]])})).first()
    assert r.opening == label


def test_opening_needs_two_bars_and_clamps_the_average(spark):
    assert context.openings(make_bars(spark, {DAY: PATH[:1]})).count() == 0
    r = context.openings(make_bars(spark, {DAY: PATH})).first()
    e = 103.0
    for c in (102.0, 105.0):
        e += 2 / 21 * (c - e)
    assert r.op_ema == pytest.approx(e) and r.op_close_vs_ema == "ABOVE"
    late = make_bars(spark, {DAY: [(20, 1, 2, 0.5, 1), (25, 1, 2, 0.5, 1)]})
    assert context.openings(late).first().opening is None


def rising(spark, n=60, last_open=None):
    days = weekdays(n)
    s = {d: five_minutes([(100 + 2 * i, 103 + 2 * i, 99 + 2 * i, 102 + 2 * i)] * 3)
         for i, d in enumerate(days)}
    if last_open is not None:
        s[days[-1]] = five_minutes([(last_open, last_open + 1, last_open - 1, last_open)] * 3)
    return days, daily.daily_features(make_bars(spark, s))


def test_location_and_swing_of_a_rise(spark):
    days, d = rising(spark)
    got = by_key(context.daily_context(d), "session_date")
    assert got[days[0]]["location"] == "UNKNOWN" and got[days[0]]["swing"] == "UNKNOWN"
    assert got[days[-1]]["location"] == "NEAR_ATH" and got[days[-1]]["ma_state"] == "ABOVE_RISING"
    assert got[days[-1]]["swing"] == "BULL"
    days, d = rising(spark, last_open=230.0)
    got = by_key(context.daily_context(d), "session_date")
    assert got[days[-1]]["location"] == "AT_ATH" and got[days[-1]]["swing"] == "STRONG_BULL"
    days, d = rising(spark, last_open=120.0)
    assert by_key(context.daily_context(d), "session_date")[days[-1]]["location"] == "BREAKDOWN"


def test_context_filter_and_funnel(spark):
    days, d = rising(spark)
    t = context.daily_context(d)
    spec = in_context(swing=("BULL",), location=("NEAR_ATH", "AT_ATH"))
    f = context.context_funnel(t, spec).orderBy("step_no").collect()
    assert [r.step_no for r in f] == [0, 1, 2] and f[0].surviving == 60
    assert all(a.surviving >= b.surviving and b.cut == a.surviving - b.surviving
               for a, b in zip(f, f[1:]))
    assert t.where(context.matches_context(spec)).count() == f[-1].surviving > 0
    assert t.where(context.matches_context(ContextSpec())).count() == 60


def test_multiday_frame(spark):
    days = weekdays(4)
    b = make_bars(spark, {d: [(-5, 1, 1, 1, 1), *flat_session(2, 100 + 10 * i)]
                          for i, d in enumerate(days)})
    asked = spark.createDataFrame([(1, days[2])], "instrument_id long, last_date date")
    f = context.multiday_frame(b, asked, lookback=1).orderBy("x").collect()
    assert [(r.x, r.session_date, r.adj_close) for r in f] == [
        (0, days[1], 110), (1, days[1], 110), (2, days[2], 120), (3, days[2], 120)]
    assert f[2].ema_fast == pytest.approx(110 + 2 / 21 * 10)
    missing = spark.createDataFrame([(1, weekdays(9)[8])], "instrument_id long, last_date date")
    assert context.multiday_frame(b, missing).count() == 0


def test_conditional_report_leaves_early_touches_out(spark):
    rows = [(1, True, True, True), (1, False, True, True), (1, False, False, True), (1, False, False, False)]
    d = spark.createDataFrame(rows, "instrument_id long, pre boolean, morn boolean, aft boolean")
    cols = {f"{p}_{k}": F.col(p) for k in daily.LEVELS for p in ("pre", "morn", "aft")}
    m = d.withColumns(cols | {"morn_reclaim_open": F.col("morn"), "aft_reclaim_open": F.col("aft")})
    got = by_key(setups.conditional_report(m), "level")
    p = got["PDH"]
    assert (p["tested_before_decision"], p["untested_at_decision"], p["reached_in_morning"],
            p["reached_by_close"], p["p_morning_pct"], p["p_by_close_pct"]) == (1, 3, 1, 2, 33.3, 66.7)
    assert got["OPEN (retrace)"]["untested_at_decision"] == 4


def test_session_table_needs_a_full_opening(spark):
    days = weekdays(3)
    b = make_bars(spark, {days[0]: flat_session(12), days[1]: flat_session(5), days[2]: flat_session(6)})
    t = setups.session_table(b, daily.daily_features(b))
    assert [r.session_date for r in t.collect()] == [days[0]]


def test_setup_specs_mirror_and_nulls_fail(spark):
    days = weekdays(2)
    up = five_minutes([(100, 102, 99, 101), (101, 104, 100, 103), (103, 107, 102, 106)] +
                      [(106, 107, 105, 106)] * 9)
    b = make_bars(spark, {days[0]: flat_session(12), days[1]: up})
    t = setups.session_table(b, daily.daily_features(b))
    spec = SetupSpec(ath_tolerance_pct=None, open_above_pdh=False, gap_min_pct=None, gap_max_pct=None,
                     on_location_min=None, direction="up", monotonic_extremes=True,
                     close_beyond_prior_bar=True, min_directional_bars=3)
    assert [r.session_date for r in t.where(setups.matches_setup(spec)).collect()] == [days[1]]
    assert t.where(setups.matches_setup(spec.but(direction="down"))).count() == 0
    assert t.where(setups.matches_setup(spec.but(on_location_min=0.0))).count() == 0
    f = setups.setup_funnel(t, spec).orderBy("step_no").collect()
    assert [r.surviving for r in f] == [2, 1, 1, 1, 1, 1]


def test_label_windows_use_params(spark):
    p = ContextParams(opening_window_min=5)
    r = context.openings(make_bars(spark, {DAY: PATH}), p).first()
    assert r.op_win_high == 104.0
