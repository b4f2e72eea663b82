"""Count signals, states, orders: hand-built sessions and a naive walk over random ones."""
from __future__ import annotations

import random

import pytest
from conftest import DAY, by_key, five_minutes, make_bars, make_levels, weekdays

from barloom.operators import pullback
from barloom.params import PullbackParams

P = PullbackParams()


def mirror(ohlc):
    return [(200 - o, 200 - lo, 200 - h, 200 - c) for o, h, lo, c in ohlc]


RALLY = [(50, 53, 49, 52), (52, 56, 51, 55), (55, 60, 54, 59), (59, 64, 57, 63)]
TWO_LEGS = RALLY + [(63, 63, 58, 59), (59, 61, 56, 57), (57, 62, 56.5, 61),
                    (61, 60.5, 55, 56), (56, 61.5, 55.5, 61)]


def signals(spark, ohlc, p=P):
    w = pullback.walk(make_bars(spark, {DAY: five_minutes(ohlc)}), p)
    rows = w.where("signal").orderBy("mso").collect()
    return [(r.label, r.mso) for r in rows], w


def test_two_corrections_count_one_and_two(spark):
    got, w = signals(spark, TWO_LEGS)
    assert got == [("H1", 30), ("H2", 40)]
    first = w.where("signal and mso = 30").first()
    assert (first.entry_px, first.stop_px, first.pullback_px) == (63.0, 55.0, 56.0)


def test_mirror_image_counts_on_the_sell_side(spark):
    got, w = signals(spark, mirror(TWO_LEGS))
    assert got == [("L1", 30), ("L2", 40)]
    first = w.where("signal and mso = 30").first()
    assert (first.entry_px, first.stop_px) == (200 - 63.0, 200 - 55.0)


def test_new_extreme_restarts_the_count(spark):
    again = TWO_LEGS[:7] + [(61, 66, 60, 65), (65, 65, 61, 62), (62, 65.5, 61, 65)]
    assert signals(spark, again)[0] == [("H1", 30), ("H1", 45)]


def test_staircase_has_direction_but_no_signal(spark):
    stairs = [(50 + 3 * i, 53 + 3 * i, 49 + 3 * i, 52 + 3 * i) for i in range(8)]
    got, w = signals(spark, stairs)
    assert got == []
    assert pullback.session_states(w).first().reached == "DEVELOPING"


def test_one_large_bar_is_no_leg(spark):
    got, w = signals(spark, [(50, 90, 49, 88)] + [(88, 89, 80, 85)] * 6)
    assert got == []
    r = pullback.session_states(w).first()
    assert (r.reached, r.leg_side) == ("INVALID", None)


def test_pullback_through_the_origin_is_invalid(spark):
    broken = RALLY + [(63, 63, 40, 45), (45, 64, 44, 60)]
    got, w = signals(spark, broken)
    assert got == []
    assert pullback.session_states(w).first().state == "INVALID"


@pytest.mark.parametrize("deadline, expected", [(30, [("H1", 30)]), (29, [])])
def test_signal_on_the_deadline_counts(spark, deadline, expected):
    assert signals(spark, TWO_LEGS, P.but(deadline_min=deadline))[0] == expected


def test_entry_cap_and_target(spark):
    more = TWO_LEGS + [(61, 60, 55, 56), (56, 61.8, 55.5, 61)]
    bars = make_bars(spark, {DAY: five_minutes(more)})
    lv = make_levels(spark, [DAY], pdh=63.5, pdl=10.0, onh=70.0)
    s = pullback.signals(pullback.walk(bars, P), lv, P).orderBy("signal_mso").collect()
    assert [(r.label, r.taken) for r in s] == [("H1", True), ("H2", True), ("H3", False)]
    assert (s[0].target_name, s[0].target_px, s[0].rr) == ("PDH", 63.5, 0.06)
    t = pullback.trades(bars, lv, P)
    assert by_key(t, "label")["H3"]["status"] == "NOT_TAKEN"


def test_equally_near_targets_go_by_name(spark):
    bars = make_bars(spark, {DAY: five_minutes(TWO_LEGS)})
    lv = make_levels(spark, [DAY], pdh=65.0, onh=65.0)
    row = pullback.signals(pullback.walk(bars), lv).orderBy("signal_mso").first()
    assert row.target_name == "SESSION_EXTREME" and row.target_px == 64.0
    far = make_levels(spark, [DAY], pdh=63.4, onh=63.4)
    assert pullback.signals(pullback.walk(bars), far).orderBy("signal_mso").first().target_name == "ONH"


def order(spark, later, target=110.0, side=1):
    sig = spark.createDataFrame(
        [(1, DAY, 10, side, 100.0, 90.0 if side > 0 else 110.0, target, True, 10.0)],
        "instrument_id long, session_date date, signal_mso int, side int, entry_px double, "
        "stop_px double, target_px double, taken boolean, risk_points double")
    bars = make_bars(spark, {DAY: [(10, 95, 99, 94, 96)] + five_minutes(later, 15)})
    return pullback.simulate(sig, bars).first()


@pytest.mark.parametrize("later, status, reason, exit_px", [
    ([(95, 98, 89, 91), (91, 101, 91, 100)], "CANCELLED", None, None),
    ([(95, 98, 92, 97), (97, 99, 93, 95)], "NOT_TRIGGERED", None, None),
    ([(97, 101, 96, 100), (100, 111, 99, 108)], "TRADED", "target", 110.0),
    ([(97, 101, 96, 100), (100, 111, 89, 95)], "TRADED", "stop", 90.0),
    ([(97, 115, 96, 100), (100, 105, 95, 103)], "TRADED", "close", 103.0),
    ([(97, 101, 89, 100)], "TRADED", "stop", 90.0),
    ([], "NOT_TRIGGERED", None, None)])
def test_order_outcomes(spark, later, status, reason, exit_px):
    r = order(spark, later)
    assert (r.status, r.reason, r.exit_px) == (status, reason, exit_px)
    if exit_px is not None:
        assert r.r_multiple == pytest.approx((exit_px - 100.0 - 2.0) / 10.0)


def naive_session(bars, deadline):
    """States and signals by looking at the session again from the start at every bar."""
    states, found = [], []
    if len(bars) < 4:
        return states, found
    hs, ls = [b[2] for b in bars], [b[3] for b in bars]
    for i in range(2, len(bars)):
        if bars[i][0] > deadline:
            break
        chosen = None
        for side in (1, -1):
            a = hs if side > 0 else [-x for x in ls]
            o = ls if side > 0 else [-x for x in hs]
            up = [a[k] > a[k - 1] and o[k] > o[k - 1] for k in range(1, i + 1)]
            if any(x and y for x, y in zip(up, up[1:])) and sum(x > a[0] for x in a[1:i + 1]) > 1:
                chosen = side, a, o
                break
        if chosen is None or min(chosen[2][1:i + 1]) < chosen[2][0]:
            states.append((bars[i][0], "INVALID"))
            continue
        side, a, o = chosen
        top, count, falling, deepest, last = a[0], 0, False, None, None
        for k in range(1, i + 1):
            last = None
            if a[k] > top:
                top, count, falling, deepest = a[k], 0, False, None
            elif a[k] < a[k - 1]:
                falling = True
                deepest = o[k] if deepest is None else min(deepest, o[k])
            elif a[k] > a[k - 1] and falling:
                count, falling = count + 1, False
                last = (count, side * (a[k] + 1), side * (min(o[k], deepest) - 1))
        states.append((bars[i][0], "ACTIVE" if last else "DEVELOPING"))
        if last:
            found.append((bars[i][0], ("H" if side > 0 else "L") + str(last[0]), *last[1:]))
    return states, found


def test_windows_equal_the_naive_walk(spark):
    rnd = random.Random(7)
    sessions = {}
    for d in weekdays(400):
        px, out = 100, []
        drift = rnd.choice([-1, 0, 1])
        for i in range(rnd.randint(2, 18)):
            px += drift + rnd.randint(-2, 2)
            out.append((5 * i, px, px + rnd.randint(0, 3), px - rnd.randint(0, 3), px))
        sessions[d] = out
    w = pullback.walk(make_bars(spark, sessions), P.but(deadline_min=75)).cache()
    states, sigs = {}, {}
    for r in w.where("evaluated").orderBy("session_date", "mso").collect():
        states.setdefault(r.session_date, []).append((r.mso, r.state))
        if r.signal:
            sigs.setdefault(r.session_date, []).append((r.mso, r.label, r.entry_px, r.stop_px))
    n = 0
    for d, b in sessions.items():
        want_states, want_sigs = naive_session(b, 75)
        assert states.get(d, []) == want_states, b
        assert sigs.get(d, []) == want_sigs, b
        n += len(want_sigs)
    assert n > 50


def test_decisions(spark):
    days = weekdays(4)
    bars = make_bars(spark, {
        days[0]: five_minutes(TWO_LEGS), days[1]: five_minutes(TWO_LEGS[:8]),
        days[2]: five_minutes(RALLY), days[3]: five_minutes([(50, 51, 49, 50)] * 6)})
    w = pullback.walk(bars)
    got = by_key(pullback.decisions(w, make_levels(spark, days, pdh=90.0)), "session_date")
    assert [got[d]["decision"] for d in days] == ["TAKE_LOW_RR", "NO_NEW_ENTRY", "WAIT", "PASS"]
    assert "no trend from the open" in got[days[3]]["sentence"]
    assert "last trigger H1 at 09:30" in got[days[1]]["sentence"]


def test_short_and_empty_sessions(spark):
    w = pullback.walk(make_bars(spark, {DAY: five_minutes(RALLY[:3])}))
    r = pullback.session_states(w).first()
    assert (r.state, r.reached, r.n_signals) == ("INVALID", "INVALID", 0)
    empty = pullback.trades(make_bars(spark, {DAY: []}), make_levels(spark, []))
    assert empty.count() == 0 and "r_multiple" in empty.columns
