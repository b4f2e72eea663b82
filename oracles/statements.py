"""One statement per registered query."""
from __future__ import annotations

import re

import oracles.base  # noqa: F401  (defines the shared expressions)
from barloom.operators.similarity import LABELS
from barloom.plans.catalog import DAILY_VIEWS, DENSE
from oracles.build import CTES, define, statement, variant

STATEMENTS: dict[str, str] = {}
#: Statements before assembly, and the doubles they round.
RAW: dict[str, tuple[str, str]] = {}
KEY = "instrument_id, session_date"


def add(name: str, sql: str, doubles: str = "") -> None:
    RAW[name] = sql, doubles
    STATEMENTS[name] = statement(sql, doubles)


def quoted(cols: str) -> str:
    return ", ".join(f'"{c}"' for c in cols.split())


PLAIN = set("""ath_at_open ath_reached_overnight near_ath_0.1pct near_ath_0.25pct
near_ath_0.5pct near_ath_1pct ath_broken_first_5m ath_broken_first_15m ath_broken_first_30m
open_above_pdh open_below_pdl open_inside_previous_range daily_volatility_regime
data_quality_flags weekday feed""".split())
for _n, _c in DAILY_VIEWS.items():
    add(_n, f"SELECT {KEY}, {quoted(_c)} FROM o_daily",
        " ".join(c for c in _c.split() if c not in PLAIN))

add("c12_session_ohlc", f"""SELECT {KEY}, cash_open, cash_high, cash_low, cash_close,
  cash_open AS cash_open_adj, cash_close AS cash_close_adj, n_cash_bars, day_high AS day_high_adj,
  day_low AS day_low_adj, feed FROM o_ohlc""",
    "cash_open cash_high cash_low cash_close cash_open_adj cash_close_adj day_high_adj day_low_adj")
add("c13_overnight_asof", f"""SELECT {KEY}, on_open AS overnight_open, on_high AS overnight_high,
  on_low AS overnight_low, on_close AS overnight_close, n_overnight_bars FROM o_ohlc""",
    "overnight_open overnight_high overnight_low overnight_close")
add("c14_daily_row", f"""SELECT {KEY}, prev_session_date, weekday, cash_close,
  on_open AS overnight_open FROM o_ohlc""", "cash_close overnight_open")
import oracles.intraday  # noqa: E402,F401
from barloom.plans.catalog import OPENING_VIEWS, OUTCOME_VIEWS  # noqa: E402

add("c9_previous_session", f"""
WITH span AS (SELECT instrument_id, min(session_date) AS a, max(session_date) AS z FROM o_ohlc GROUP BY 1),
asked AS (SELECT DISTINCT s.instrument_id, CAST(d.o_orderdate AS DATE) AS session_date
  FROM orders d JOIN span s ON CAST(d.o_orderdate AS DATE) BETWEEN s.a AND s.z)
SELECT a.instrument_id, a.session_date,
  (SELECT max(s.session_date) FROM o_ohlc s WHERE s.instrument_id = a.instrument_id
    AND s.session_date < a.session_date) AS prev_session_date FROM asked a""")

_NOT_DOUBLE = ("number_of", "first_bar_breaks", "first_bar_is", "n_window", "cutoff_min",
               "failed", "opening_range", "minutes_until")


def _doubles(cols: str) -> str:
    return " ".join(f'"{c}"' for c in cols.split()
                    if not c.startswith(_NOT_DOUBLE) and not c.endswith("_min"))


for _n, _c in OPENING_VIEWS.items():
    add(_n, f"SELECT {KEY}, {quoted(_c)} FROM o_opening", _doubles(_c))
_OUT_DOUBLES = ("cutoff_price return_after_15m_pct return_after_30m_pct return_after_60m_pct "
                "return_at_1200_pct return_at_us_open_pct return_at_cash_close_pct "
                "max_favorable_excursion_pct max_adverse_excursion_pct session_high_min "
                "session_low_min session_close_pct_vs_cutoff").split()
for _n, _c in OUTCOME_VIEWS.items():
    add(_n, f"SELECT {KEY}, {quoted(_c)} FROM o_outcomes",
        " ".join(c for c in _c.split() if c in _OUT_DOUBLES))
add("g8_outcome_table", f"""SELECT x.* FROM o_outcomes x SEMI JOIN
  (SELECT {KEY} FROM o_daily WHERE open_above_pdh) USING ({KEY})""", " ".join(_OUT_DOUBLES))
add("g9_day_classes", "SELECT * FROM o_classes")
add("h1_rebased_path", f"""SELECT {KEY}, mso, c - op AS path_points, 100.0 * (c - op) / op AS path_pct,
  (c - op) / nullif(pr, 0) AS path_prior_range, (c - op) / nullif(atr, 0) AS path_atr FROM o_obs""",
    "path_points path_pct path_prior_range path_atr")
add("h2_grid_path", f"SELECT {KEY}, grid_min, v AS value FROM o_pts", "value")
add("h3_path_matrix", f"""SELECT {KEY}, count(*) AS width,
  string_agg(coalesce(printf('%.3f', round(v, 3) + 0.0), '-'), ' ' ORDER BY grid_min) AS path_row
  FROM o_pts GROUP BY ALL""")
add("h4_path_correlation", f"SELECT {KEY}, n, correlation FROM o_pathscores", "correlation")
add("h5_path_euclidean", f"SELECT {KEY}, euclidean FROM o_pathscores", "euclidean")
add("h6_path_cosine", f"SELECT {KEY}, cosine FROM o_pathscores", "cosine")
define(o_dtw=f"""
WITH RECURSIVE p AS (SELECT {KEY}, list(a ORDER BY grid_min) FILTER (a IS NOT NULL AND b IS NOT NULL) AS a,
    list(b ORDER BY grid_min) FILTER (a IS NOT NULL AND b IS NOT NULL) AS b,
    count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n FROM o_pathpairs GROUP BY ALL),
r AS (SELECT {KEY}, a, b, n, 0::BIGINT AS k, CAST([] AS DOUBLE[]) AS prev, CAST([] AS DOUBLE[]) AS cur FROM p WHERE n > 0
  UNION ALL
  SELECT {KEY}, a, b, n, k + 1, pv, list_append(cv, abs(a[i + 1] - b[j + 1]) + CASE WHEN k = 0 THEN 0
    WHEN i = 0 THEN cv[j] WHEN j = 0 THEN pv[1] ELSE least(pv[j + 1], pv[j], cv[j]) END)
  FROM (SELECT *, k // n AS i, k % n AS j, CASE WHEN k % n = 0 THEN cur ELSE prev END AS pv,
          CASE WHEN k % n = 0 THEN CAST([] AS DOUBLE[]) ELSE cur END AS cv FROM r WHERE k < n * n))
SELECT p.instrument_id, p.session_date, r.cur[r.n] / (2 * r.n) AS path_dist
FROM p LEFT JOIN r ON r.instrument_id = p.instrument_id AND r.session_date = p.session_date AND r.k = r.n * r.n""",
    o_bounds="""
SELECT instrument_id, session_date, greatest(sum(greatest(0, a - hb, lb - a)), sum(greatest(0, b - ha, la - b)),
  abs(arg_min(a, grid_min) - arg_min(b, grid_min)) + CASE WHEN count(*) > 1 THEN abs(arg_max(a, grid_min)
    - arg_max(b, grid_min)) ELSE 0 END) / (2 * count(*)) AS bound
FROM (SELECT *, max(a) OVER p AS ha, min(a) OVER p AS la, max(b) OVER p AS hb, min(b) OVER p AS lb FROM o_pathpairs
  WHERE a IS NOT NULL AND b IS NOT NULL WINDOW p AS (PARTITION BY instrument_id, session_date)) GROUP BY ALL""")
variant("_dtw", o_pathscores="SELECT instrument_id, session_date, 1 - 2 * path_dist AS correlation FROM o_dtw")
add("h7_path_dtw", "SELECT * FROM o_dtw", "path_dist")
add("h7_nearest_warped", """SELECT * FROM (SELECT instrument_id, session_date, path_dist, row_number() OVER (
  PARTITION BY instrument_id ORDER BY path_dist, session_date) AS rank FROM o_dtw WHERE path_dist IS NOT NULL)
  WHERE rank <= 10""", "path_dist")
add("h7_warped_share", """
WITH b AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY bound, session_date) AS k FROM o_bounds),
t AS (SELECT instrument_id, max(path_dist) AS lim FROM b JOIN o_dtw USING (instrument_id, session_date)
  WHERE k <= 10 GROUP BY ALL)
SELECT instrument_id, n_pairs, count(*) FILTER (k <= 10 OR bound <= lim * (1 + 1e-9)) AS n_warped
FROM b JOIN t USING (instrument_id) JOIN (SELECT instrument_id, count(DISTINCT session_date) AS n_pairs
  FROM o_pathpairs GROUP BY ALL) USING (instrument_id) GROUP BY ALL""")
add("h8_path_distance", f"""SELECT {KEY}, (1 - correlation) / 2 AS by_correlation,
  (1 - cosine) / 2 AS by_cosine, euclidean AS by_euclidean FROM o_pathscores""",
    "by_correlation by_cosine by_euclidean")
add("h9_median_band", """SELECT instrument_id, grid_min, count(v) AS n, quantile_cont(v, 0.25) AS p25,
  median(v) AS median, quantile_cont(v, 0.75) AS p75 FROM o_pts GROUP BY ALL""", "p25 median p75")
add("h9_overlay", f"""
WITH ses AS (SELECT DISTINCT {KEY} FROM o_pts),
r AS (SELECT s.*, session_date = reference_date AS is_ref FROM ses s JOIN o_refs USING (instrument_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, is_ref ORDER BY session_date) AS k FROM r)
SELECT {KEY}, is_ref, grid_min, v AS value FROM k JOIN o_pts USING ({KEY}) WHERE is_ref OR k <= 25""",
    "value")

import oracles.labels  # noqa: E402,F401
from barloom.plans.catalog import CONTEXT_VIEWS, SETUP_VIEWS  # noqa: E402
from oracles.labels import performance  # noqa: E402

_CTX_DOUBLES = ("ma_fast ma_slow ma_fast_slope range_high range_low location_in_range "
                "distance_to_ath_pct prior_day_close_loc prior_3d_range_count "
                "open_frac_in_pd_range overnight_close_loc op_win_high op_win_low op_win_close "
                "op_close_location op_up_excursion op_down_excursion op_ema").split()
for _n, _c in CONTEXT_VIEWS.items():
    add(_n, f"SELECT {KEY}, {quoted(_c)} FROM o_context",
        " ".join(c for c in _c.split() if c in _CTX_DOUBLES))
add("k1_prior_percentiles", f"""SELECT {KEY},
  CASE WHEN count(*) OVER g >= 50 THEN quantile_cont(cash_high - cash_low, 0.2) OVER g END AS p20,
  CASE WHEN count(*) OVER g >= 50 THEN quantile_cont(cash_high - cash_low, 0.5) OVER g END AS p50,
  CASE WHEN count(*) OVER g >= 50 THEN quantile_cont(cash_high - cash_low, 0.9) OVER g END AS p90
  FROM o_daily WINDOW g AS (PARTITION BY instrument_id ORDER BY session_date
                            ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)""", "p20 p50 p90")
_RISING = """swing IN ('BULL', 'STRONG_BULL') AND location IN ('AT_ATH', 'NEAR_ATH', 'BREAKOUT_UP',
  'UPPER_RANGE') AND coalesce(opening IN ('DRIVE_UP', 'REJECTION_UP', 'RANGE_OPEN'), false)"""
_STRUCT = """coalesce(opening IN ('REJECTION_UP', 'DRIVE_DOWN') AND op_close_below_prior_low
  AND prior_3d_range_count >= 0, false)"""
add("k14_context_matches", f"""SELECT {KEY}, {_RISING} AS rising, {_STRUCT} AS structured
  FROM o_context WHERE ({_RISING}) OR ({_STRUCT})""")


def funnel(table: str, steps: list[tuple[str, str]]) -> str:
    """One branch per step with the conditions so far."""
    parts, conds = [], []
    for k, (name, cond) in enumerate([("all sessions", "true"), *steps]):
        conds.append(f"coalesce({cond}, false)")
        now, was = " AND ".join(conds), " AND ".join(conds[:-1]) or "true"
        label = name.replace("'", "''")
        parts.append(f"""SELECT instrument_id, {k} AS step_no, '{label}' AS step,
          count(*) FILTER ({now}) AS surviving, count(*) FILTER ({was}) - count(*) FILTER ({now}) AS cut
          FROM {table} GROUP BY instrument_id""")
    return " UNION ALL ".join(parts)


def member(field: str, labels: str) -> tuple[str, str]:
    names = labels.split()
    inside = ", ".join(f"'{x}'" for x in names)
    return f"{field} in {names}", f"{field} IN ({inside})"


add("k15_context_funnel", funnel("o_context", [
    member("location", "AT_ATH NEAR_ATH BREAKOUT_UP UPPER_RANGE"),
    member("swing", "BULL STRONG_BULL"), member("opening", "DRIVE_UP REJECTION_UP RANGE_OPEN"),
    ("lower highs", "op_lower_highs")]))
add("k17_bull_trap_preset", funnel("o_context", [
    member("location", "AT_ATH NEAR_ATH"), member("swing", "BULL STRONG_BULL"),
    member("gap_bucket", "MODERATE_UP LARGE_UP"), member("open_loc", "ABOVE_PDH"),
    member("overnight_type", "TREND_UP"), member("opening", "REJECTION_UP")]))
add("k16_label_mix", """
WITH long AS (UNPIVOT (SELECT instrument_id, location, swing, ma_state, prior_day_type, gap_bucket,
  open_loc, overnight_type, opening FROM o_context) ON location, swing, ma_state, prior_day_type,
  gap_bucket, open_loc, overnight_type, opening INTO NAME dimension VALUE label)
SELECT instrument_id, dimension, label, count(*) AS n,
  100.0 * count(*) / sum(count(*)) OVER (PARTITION BY instrument_id, dimension) AS share_pct
FROM long GROUP BY instrument_id, dimension, label""", "share_pct")


def conditional(table: str) -> str:
    rows = " UNION ALL ".join(
        f"""SELECT instrument_id, '{k}' AS level, "pre_{k}" AS pre, "morn_{k}" AS morn, "aft_{k}" AS aft
        FROM {table}""" for k in ("PDH", "PDC", "PDL", "ONH", "ONL"))
    rows += f""" UNION ALL SELECT instrument_id, 'OPEN (retrace)', false, morn_reclaim_open,
        aft_reclaim_open FROM {table}"""
    return f"""SELECT instrument_id, level, count(*) FILTER (pre) AS tested_before_decision,
      count(*) FILTER (NOT pre) AS untested_at_decision,
      count(*) FILTER (NOT pre AND morn) AS reached_in_morning,
      count(*) FILTER (NOT pre AND aft) AS reached_by_close,
      round(100.0 * count(*) FILTER (NOT pre AND morn) / nullif(count(*) FILTER (NOT pre), 0), 1) AS p_morning_pct,
      round(100.0 * count(*) FILTER (NOT pre AND aft) / nullif(count(*) FILTER (NOT pre), 0), 1) AS p_by_close_pct
      FROM ({rows}) GROUP BY ALL"""


add("k18_context_scan", conditional(
    f"(SELECT * FROM o_setup SEMI JOIN (SELECT {KEY} FROM o_context WHERE {_RISING}) USING ({KEY}))"))
_PICKED = f"SELECT {KEY} FROM o_context WHERE {_RISING}"
add("k18_match_table", f"""SELECT {KEY}, swing, location, opening, decision_price, morn_ret_pct, day_ret_pct, "pre_PDH"
  FROM (SELECT * FROM o_context WHERE {_RISING}) LEFT JOIN o_setup USING ({KEY})""",
    "decision_price morn_ret_pct day_ret_pct")
add("k19_multiday_frame", """
WITH RECURSIVE r AS (SELECT instrument_id, session_date, dense_rank() OVER (PARTITION BY instrument_id
  ORDER BY session_date DESC) AS k, mso, c FROM o_cash),
f AS (SELECT instrument_id, session_date, mso, c, row_number() OVER (PARTITION BY instrument_id
  ORDER BY session_date, mso) - 1 AS x FROM r WHERE k <= 3),
e AS (SELECT instrument_id, x, session_date, mso, c, c AS ef, c AS es FROM f WHERE x = 0
  UNION ALL SELECT f.instrument_id, f.x, f.session_date, f.mso, f.c,
    e.ef + (2.0 / 21) * (f.c - e.ef), e.es + (2.0 / 51) * (f.c - e.es)
  FROM e JOIN f ON f.instrument_id = e.instrument_id AND f.x = e.x + 1)
SELECT instrument_id, x, session_date, mso, c AS adj_close, ef AS ema_fast, es AS ema_slow FROM e""",
    "adj_close ema_fast ema_slow")

# The averages of the long frame in closed form: every bar weighs by its distance.
add("k19_long_frame", """
WITH r AS (SELECT instrument_id, session_date, dense_rank() OVER (PARTITION BY instrument_id
  ORDER BY session_date DESC) AS k, mso, c FROM o_cash),
f AS (SELECT instrument_id, session_date, mso, c, row_number() OVER w - 1 AS x, first(c) OVER w AS c0
  FROM r WHERE k <= 251 WINDOW w AS (PARTITION BY instrument_id ORDER BY session_date, mso)),
e AS (SELECT f.instrument_id, f.x, sum(2.0::DOUBLE / 21 * pow(19.0::DOUBLE / 21, f.x - g.x) * g.c) AS ef,
  sum(2.0::DOUBLE / 51 * pow(49.0::DOUBLE / 51, f.x - g.x) * g.c) AS es
  FROM f JOIN f g ON f.instrument_id = g.instrument_id AND g.x <= f.x GROUP BY ALL)
SELECT instrument_id, x, session_date, mso, c AS adj_close, ef + pow(19.0::DOUBLE / 21, x + 1) * c0 AS ema_fast,
  es + pow(49.0::DOUBLE / 51, x + 1) * c0 AS ema_slow FROM f JOIN e USING (instrument_id, x)""",
    "adj_close ema_fast ema_slow")

_SET_DOUBLES = ("pa_win_high pa_win_low pa_win_close pa_close_location cash_open decision_price "
                "gap_pct distance_open_to_ath_pct open_location_in_overnight_range level_PDH "
                "level_PDC level_PDL level_ONH level_ONL morn_ret_pct morn_mae_pct morn_mfe_pct "
                "day_ret_pct day_mae_pct day_mfe_pct").split()
for _n, _c in SETUP_VIEWS.items():
    add(_n, f"SELECT {KEY}, {quoted(_c)} FROM o_setup",
        " ".join(f'"{c}"' for c in _c.split() if c in _SET_DOUBLES))
_MARKET = [("|open - high| <= 5.0%", "abs(distance_open_to_ath_pct) <= 5"),
           ("gap >= -2.0%", "gap_pct >= -2"), ("gap <= 2.0%", "gap_pct <= 2"),
           ("open >= 0.2 of overnight range", "open_location_in_overnight_range >= 0.2")]
_LOOSE = [*_MARKET, ("close beyond the open", "pa_close_below_open"),
          ("close in the far 0.5 of the range", "pa_close_location <= 0.5")]
_UP = """coalesce(daily_volatility_regime IN ('low', 'normal', 'high') AND pa_close_above_open
  AND pa_close_location >= 1 - CAST(0.4 AS DOUBLE) AND pa_n_bull_bars >= 1, false)"""


def both(steps: list[tuple[str, str]]) -> str:
    return "coalesce(" + " AND ".join(f"({c})" for _, c in steps) + ", false)"


add("j4_setup_matches", f"""SELECT {KEY}, {both(_LOOSE)} AS loose, {_UP} AS upward,
  coalesce(abs(distance_open_to_ath_pct) <= 0.5 AND open_above_pdh AND gap_pct >= 0.3 AND gap_pct <= 1.2
    AND open_location_in_overnight_range >= 0.7 AND pa_close_below_open AND pa_close_location <= 0.33,
    false) AS preset FROM o_setup""")
add("j5_setup_funnel", funnel("o_setup", _LOOSE))
add("j6_setup_scan", f"SELECT {KEY}, decision_price, day_ret_pct FROM o_setup WHERE {_UP}",
    "decision_price day_ret_pct")
add("j7_conditional_prob", conditional(f"(SELECT * FROM o_setup WHERE {_UP})"))
add("j8_outcome_summary", """
WITH long AS (UNPIVOT (SELECT instrument_id, morn_ret_pct, morn_mae_pct, morn_mfe_pct, day_ret_pct,
  day_mae_pct, day_mfe_pct FROM o_setup) ON morn_ret_pct, morn_mae_pct, morn_mfe_pct, day_ret_pct,
  day_mae_pct, day_mfe_pct INTO NAME metric VALUE v)
SELECT instrument_id, metric, count(*) AS n, round(median(v), 3) AS median, round(avg(v), 3) AS mean,
  round(100.0 * count(*) FILTER (v < 0) / count(*), 1) AS negative_pct,
  round(quantile_cont(v, 0.25), 3) AS p25, round(quantile_cont(v, 0.75), 3) AS p75,
  round(min(v), 3) AS worst, round(max(v), 3) AS best FROM long GROUP BY ALL""")
add("k18_context_outcomes", RAW["j8_outcome_summary"][0].replace(
    "FROM o_setup", f"FROM (SELECT * FROM o_setup SEMI JOIN ({_PICKED}) USING ({KEY}))"))
add("j9_gates", f"""SELECT instrument_id, count(*) FILTER ({both(_MARKET)}) AS n_market,
  count(*) FILTER (coalesce(pa_close_below_open AND pa_close_location <= 0.5 AND pa_spike_up_reject, false))
    AS n_pressure FROM o_setup GROUP BY ALL""")
add("a7_stored_session_table", "SELECT instrument_id, count(*) AS n, " + ", ".join(
    f"count(*) FILTER ({both([*_MARKET[:2], ('', f'gap_pct <= {g}'), *_LOOSE[3:]])}) AS n_gap_{i}"
    for i, g in enumerate((0.5, 1.0, 2.0))) + " FROM o_setup GROUP BY ALL")

# ---- pullback walk
add("l1_leg_detection", f"""SELECT {KEY}, mso, side,
  CASE side WHEN 1 THEN l0 WHEN -1 THEN h0 END AS leg_origin_px,
  CASE side WHEN 1 THEN hr WHEN -1 THEN lr END AS leg_extreme_px,
  CASE side WHEN 1 THEN h_at WHEN -1 THEN l_at END AS leg_extreme_mso,
  CASE side WHEN 1 THEN best_u WHEN -1 THEN best_d END AS steps_in_row,
  CASE side WHEN 1 THEN fth WHEN -1 THEN ftl END AS followthrough_bars FROM o_walk""",
    "leg_origin_px leg_extreme_px")
add("l2_origin_held", f"SELECT {KEY}, mso, side, held FROM o_walk WHERE side IS NOT NULL")
add("l3_count_signals", f"""SELECT {KEY}, signal_mso AS mso, side, label, entry_px, stop_px, pullback_px
  FROM o_signals""", "entry_px stop_px pullback_px")
add("l4_structural_targets", f"SELECT {KEY}, signal_mso, entry_px, target_name, target_px FROM o_signals",
    "entry_px target_px")
add("l5_session_signals", f"SELECT {KEY}, signal_mso, label, side, risk_points, rr, taken, note FROM o_signals",
    "risk_points rr")
add("l5_state_trace", f"SELECT {KEY}, mso, state FROM o_walk")
add("l6_session_states", f"""SELECT {KEY}, s.state, reached, n_signals, coalesce(t.trace, '') AS trace
  FROM o_states s LEFT JOIN (SELECT {KEY}, string_agg(mso || ':' || state, ' ' ORDER BY mso) AS trace
  FROM o_walk GROUP BY ALL) t USING ({KEY})""")
_DECISIONS = f"""
WITH last AS (SELECT {KEY}, max(signal_mso) AS m, arg_max(label, signal_mso) AS lab, arg_max(coalesce(rr, -1), signal_mso) AS rr,
  count(*) AS k FROM o_signals WHERE taken GROUP BY ALL)
SELECT {KEY}, state, leg_side, followthrough_bars, lab AS last_label, m AS last_signal_mso,
  nullif(rr, -1) AS last_rr, coalesce(k, 0) AS n_taken,
  CASE WHEN leg_side IS NULL THEN 'PASS'
       WHEN state = 'ACTIVE' AND m = last_mso THEN (CASE WHEN rr >= 1 THEN 'TAKE' ELSE 'TAKE_LOW_RR' END)
       WHEN m IS NOT NULL THEN 'NO_NEW_ENTRY' WHEN state = 'DEVELOPING' THEN 'WAIT' ELSE 'PASS' END AS decision,
  concat_ws('; ', 'state ' || state, CASE leg_side WHEN 1 THEN 'trend up' WHEN -1 THEN 'trend down' ELSE 'no trend from the open' END,
    'bars beyond the first: ' || followthrough_bars,
    'last trigger ' || lab || ' at ' || printf('%02d:%02d', (m + 540) // 60, (m + 540) % 60), 'decision ' || decision) AS sentence
FROM o_states LEFT JOIN last USING ({KEY})"""
add("l7_decisions", _DECISIONS, "last_rr")
# The same at other minutes: the walk, and all that follows from it, up to each.
_ASKED = (30, 60, 90, 200)
for _m in _ASKED:
    variant(f"_at{_m}", o_walk=CTES["o_walk"].replace("mso <= 90", f"mso <= {_m}"))


def _at(m: int) -> str:
    sql = _DECISIONS.replace("o_states", f"o_states_at{m}").replace("o_signals", f"o_signals_at{m}")
    return f"""SELECT * EXCLUDE (sentence), {m} AS as_of
FROM ({sql}) JOIN (SELECT instrument_id, session_date, session_date + 3 AS asked_date FROM o_cashday UNION ALL
  SELECT instrument_id, min(session_date), min(session_date) - 7 FROM o_cashday GROUP BY ALL) USING ({KEY})"""


add("l7_replay", f"SELECT * FROM ({' UNION ALL '.join(map(_at, _ASKED))})", "last_rr")
_T = "exit_px net_points r_multiple"
add("l8_signal_outcomes", f"""SELECT {KEY}, signal_mso, status, reason, exit_px, exit_mso, net_points, r_multiple
  FROM o_trades""", _T)
add("l9_trade_table", f"""SELECT {KEY}, signal_mso, label, kind, "count", side, entry_px, stop_px, target_name,
  target_px, rr, taken, reached, status, exit_px, exit_mso, reason, net_points, r_multiple FROM o_trades""",
    _T + " entry_px stop_px target_px rr")
add("l10_state_profile", """SELECT instrument_id, reached, count(*) AS n_sessions,
  100.0 * count(*) / sum(count(*)) OVER (PARTITION BY instrument_id) AS share_pct
  FROM o_states GROUP BY instrument_id, reached""", "share_pct")
add("l11_status_counts", "SELECT instrument_id, status, count(*) AS n FROM o_trades GROUP BY ALL")
add("l11_exit_reasons", """SELECT instrument_id, reason, count(*) AS n, avg(r_multiple) AS mean_r
  FROM o_trades WHERE status = 'TRADED' GROUP BY ALL""", "mean_r")
add("l11_signal_summary", """SELECT instrument_id, count(DISTINCT session_date) AS n_sessions,
  count(*) AS n_signals, count(*) FILTER (status = 'TRADED') AS n_filled, median(rr) AS median_rr,
  count(*) FILTER (rr >= 1) / count(*) AS share_rr_ge_1 FROM o_trades GROUP BY ALL""",
    "median_rr share_rr_ge_1")
_TRADED = "SELECT * FROM o_trades WHERE status = 'TRADED'"
_ORD = "session_date, signal_mso"
add("l12_performance_by_label", performance(_TRADED, "label", _ORD))
add("l12_performance_by_count", performance(
    f"""SELECT *, CASE WHEN "count" >= 3 THEN '3+' ELSE CAST("count" AS VARCHAR) END AS attempt
    FROM ({_TRADED})""", "attempt", _ORD))
add("l13_session_marks", f"""SELECT {KEY}, signal_mso, label, entry_px, stop_px, target_px, pullback_px,
  leg_origin_px, leg_extreme_px, leg_extreme_mso, taken, status, exit_mso, exit_px, reason, r_multiple
  FROM o_trades""", "entry_px stop_px target_px pullback_px leg_origin_px leg_extreme_px exit_px r_multiple")
add("l14_inside_context", f"""
WITH per AS (SELECT {KEY}, string_agg(label, ' ' ORDER BY signal_mso) AS triggers,
  round(sum(r_multiple), 2) AS sum_r FROM o_trades GROUP BY ALL)
SELECT {KEY}, location, swing, opening, triggers, sum_r FROM o_context LEFT JOIN per USING ({KEY})
WHERE {_RISING}""")
add("l14_appearance", f"""
WITH s AS (SELECT DISTINCT {KEY}, 1 AS hit FROM o_trades),
a AS (SELECT instrument_id, count(*) AS n_all, count(hit) AS n_all_with_trigger,
  count(*) FILTER ({_RISING}) AS n_picked, count(hit) FILTER ({_RISING}) AS n_picked_with_trigger
  FROM o_context LEFT JOIN s USING ({KEY}) GROUP BY ALL)
SELECT *, 100.0 * n_all_with_trigger / n_all AS all_pct,
  100.0 * n_picked_with_trigger / nullif(n_picked, 0) AS picked_pct FROM a""", "all_pct picked_pct")
add("l15_signal_table", f"""SELECT {KEY}, label AS signal,
  printf('%02d:%02d', (signal_mso + 540) // 60, (signal_mso + 540) % 60) AS at,
  CASE WHEN side > 0 THEN 'buy' ELSE 'sell' END AS side, CAST(round_even(entry_px, 0) AS BIGINT) AS "trigger",
  CAST(round_even(stop_px, 0) AS BIGINT) AS stop, CAST(round_even(target_px, 0) AS BIGINT) AS target,
  coalesce(target_name, '—') AS t1, rr, CAST(round_even(risk_points, 0) AS BIGINT) AS risk_pts,
  status AS outcome,
  coalesce(printf('%02d:%02d', (exit_mso + 540) // 60, (exit_mso + 540) % 60), '—') AS exit,
  coalesce(reason, '—') AS why, round(r_multiple, 2) AS r FROM o_trades""")
add("m4_performance", performance(_TRADED, "", _ORD))
add("m5_split_performance", performance(
    f"""SELECT *, 'all' AS period FROM ({_TRADED}) UNION ALL SELECT *, CASE WHEN session_date <
    DATE '1999-01-04' THEN 'in-sample' ELSE 'out-of-sample' END FROM ({_TRADED})""", "period", _ORD))

import oracles.ranking  # noqa: E402,F401
from oracles.ranking import FEATURES, MOVING, drives, ranked  # noqa: E402

_TR = ("entry stop_init risk_points exit_price gross_points net_points r_multiple")
add("m1_initial_stop", f"""SELECT {KEY}, stop_mode, side, entry, stop_init, risk AS risk_points FROM o_entries""",
    "entry stop_init risk_points")
add("m2_day_simulation", f"SELECT * EXCLUDE (label) FROM ({drives(2.0, 240)})", _TR)
add("m2_day_simulation_moving_stop", MOVING, _TR)
_D = drives(2.0)
add("m3_drive_trades", f"""SELECT {KEY}, label, side, entry, exit_price, exit_mso, reason, r_multiple
  FROM ({_D})""", "entry exit_price r_multiple")
add("m4_pooled", f"""
WITH q AS (SELECT *, sum(r_multiple) OVER w AS eq FROM ({_TRADED})
  WINDOW w AS (PARTITION BY kind ORDER BY session_date, signal_mso, instrument_id)),
d AS (SELECT *, max(eq) OVER (PARTITION BY kind ORDER BY session_date, signal_mso, instrument_id) - eq AS fall FROM q)
SELECT kind, count(*) AS n, avg(r_multiple) AS expectancy_r, 100.0 * count(*) FILTER (r_multiple > 0) / count(*) AS win_rate_pct,
  sum(r_multiple) FILTER (r_multiple > 0) / nullif(-sum(r_multiple) FILTER (r_multiple <= 0), 0) AS profit_factor,
  sum(r_multiple) AS total_r, avg(r_multiple) / nullif(stddev_samp(r_multiple) / sqrt(count(*)), 0) AS t_stat,
  max(fall) AS max_drawdown_r FROM d GROUP BY kind""",
    "expectancy_r win_rate_pct profit_factor total_r t_stat max_drawdown_r")
add("m4_drive_performance", performance(_D, "label"))
add("m6_exit_mix", f"""SELECT instrument_id, reason, count(*) AS n, avg(r_multiple) AS mean_r,
  100.0 * count(*) / sum(count(*)) OVER (PARTITION BY instrument_id) AS share_pct
  FROM ({_D}) GROUP BY instrument_id, reason""", "mean_r share_pct")
add("m6_r_quantiles", f"""SELECT instrument_id, count(*) AS n, quantile_cont(r_multiple, 0.1) AS p10,
  quantile_cont(r_multiple, 0.25) AS p25, median(r_multiple) AS p50, quantile_cont(r_multiple, 0.75) AS p75,
  quantile_cont(r_multiple, 0.9) AS p90, max(r_multiple) AS best, min(r_multiple) AS worst,
  abs(coalesce(avg(r_multiple) / nullif(stddev_samp(r_multiple) / sqrt(count(*)), 0), 0)) < 2 AS not_significant
  FROM ({_D}) GROUP BY ALL""", "p10 p25 p50 p75 p90 best worst")
add("m7_context_study", performance(f"""SELECT * FROM ({_D}) SEMI JOIN (SELECT {KEY} FROM o_context
  WHERE location IN ('AT_ATH', 'NEAR_ATH', 'BREAKOUT_UP', 'UPPER_RANGE')) USING ({KEY}) WHERE label = 'DRIVE_UP'"""))
add("m8_latest_sessions", f"""SELECT * FROM (SELECT {KEY}, row_number() OVER (PARTITION BY instrument_id
  ORDER BY session_date DESC) AS k FROM (SELECT DISTINCT {KEY} FROM ({_D}))) WHERE k <= 24""")

_METRICS = ("return_after_15m_pct, return_after_30m_pct, return_after_60m_pct, return_at_1200_pct, "
            "return_at_us_open_pct, return_at_cash_close_pct, max_favorable_excursion_pct, "
            "max_adverse_excursion_pct")


def distribution(table: str) -> str:
    return f"""
WITH long AS (UNPIVOT (SELECT instrument_id, {_METRICS} FROM {table}) ON {_METRICS} INTO NAME metric VALUE v)
SELECT instrument_id, metric, count(*) AS n, avg(v) AS mean, median(v) AS median, stddev_pop(v) AS std,
  100.0 * count(*) FILTER (v > 0) / count(*) AS positive_pct, quantile_cont(v, 0.25) AS p25,
  quantile_cont(v, 0.75) AS p75, max(v) AS best, min(v) AS worst, count(*) < 20 AS small_sample
FROM long GROUP BY ALL"""


add("n1_distribution", distribution("o_outcomes"), "mean median std positive_pct p25 p75 best worst")
add("n2_headline", """SELECT instrument_id, count(*) AS sample_size,
  median(return_at_cash_close_pct) AS median_return_at_close_pct,
  100.0 * avg(close_above_cash_open::INT) AS positive_close_pct,
  median(max_favorable_excursion_pct) AS median_mfe_pct, median(max_adverse_excursion_pct) AS median_mae_pct,
  100.0 * avg(full_gap_fill::INT) AS full_gap_fill_pct, 100.0 * avg(break_observed_high::INT) AS break_observed_high_pct,
  100.0 * avg(break_observed_low::INT) AS break_observed_low_pct FROM o_outcomes GROUP BY ALL""",
    "median_return_at_close_pct positive_close_pct median_mfe_pct median_mae_pct full_gap_fill_pct "
    "break_observed_high_pct break_observed_low_pct")
add("n3_histogram", """
WITH v AS (SELECT instrument_id, return_at_cash_close_pct AS v FROM o_outcomes WHERE return_at_cash_close_pct IS NOT NULL),
s AS (SELECT instrument_id, min(v) AS lo, max(v) AS hi, median(v) AS med FROM v GROUP BY ALL),
b AS (SELECT instrument_id, least(coalesce(floor((v - lo) / nullif((hi - lo) / 25, 0)), 0), 24)::INT AS bin, lo, hi, med
      FROM v JOIN s USING (instrument_id))
SELECT instrument_id, bin, lo + bin * (hi - lo) / 25 AS bin_start, count(*) AS n, med AS median
FROM b GROUP BY instrument_id, bin, lo, hi, med""", "bin_start median")
add("n4_dates_only", f"SELECT instrument_id, strftime(session_date, '%Y-%m-%d') AS date FROM o_setup WHERE {_UP}")
add("n6_small_samples", f"""SELECT instrument_id, metric, n, small_sample FROM
  ({distribution("(SELECT * FROM o_outcomes WHERE full_gap_fill)")})""")

# ---- filters and ranking
_WIDE = "d2 AND gp AND vr AND fb AND w60"
add("i1_exact_filter", f"""SELECT {KEY}, {_WIDE} AS wide, coalesce(gap_pct < 0 AND abs(gap_pct) >= 0.2
  AND extension_ratio < 2 AND post_spike_efficiency < CAST(0.6 AS DOUBLE) AND post_spike_pullback_ratio > CAST(0.1 AS DOUBLE)
  AND first_bar_close_location >= CAST(0.2 AS DOUBLE), false) AS other FROM o_wide""")
add("i2_context_only_filter", f"SELECT {KEY}, gap_pct FROM o_wide WHERE d2 AND gp AND vr", "gap_pct")
_F = " ".join(FEATURES)
add("i3_imputed_features", "SELECT * FROM o_imputed", _F)
add("i4_robust_scaled", "SELECT * FROM o_scaled", _F)
add("i5_block_distances", "SELECT * FROM o_blocks", "dist_context dist_first_bar dist_post_spike dist_weakness")
_ALL = "SELECT instrument_id, session_date FROM o_blocks"
add("i6_path_blend", f"SELECT {KEY}, dps AS dist_post_spike FROM ({ranked(_ALL, 10 ** 9)})", "dist_post_spike")
add("i7_similarity_rank", f"SELECT {KEY}, rank, similarity_score, distance FROM ({ranked(_ALL, 20)})",
    "similarity_score distance")
_DIFFS = " UNION ALL ".join(
    f"""SELECT a.instrument_id, a.session_date, '{f}' AS feature, abs(a.{f} - b.{f}) AS diff
    FROM o_scaled a JOIN o_refs r USING (instrument_id) JOIN o_scaled b ON b.instrument_id = a.instrument_id
    AND b.session_date = r.reference_date WHERE a.session_date <> r.reference_date""" for f in FEATURES)
add("i8_explanations", f"""
WITH d AS ({_DIFFS}),
c AS (SELECT *, CASE WHEN diff < 0.5 THEN 'h' WHEN diff < 1.5 THEN 'm' ELSE 'd' END AS cls FROM d WHERE diff IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, cls ORDER BY CASE WHEN cls = 'd' THEN -diff ELSE diff END, feature) AS k FROM c)
SELECT {KEY}, coalesce(string_agg(feature, ', ' ORDER BY k) FILTER (cls = 'h'), '') AS highly_similar,
  coalesce(string_agg(feature, ', ' ORDER BY k) FILTER (cls = 'm'), '') AS moderately_similar,
  coalesce(string_agg(feature, ', ' ORDER BY k) FILTER (cls = 'd'), '') AS differed
FROM k WHERE k <= 6 GROUP BY ALL""")
_SHOWN = "CASE feature " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " ELSE feature END"
add("i8_explanations_labelled", RAW["i8_explanations"][0].replace("string_agg(feature,", f"string_agg({_SHOWN},"))
_RUNGS = [_WIDE, "d05 AND gp AND vr AND fb AND w60", "d05 AND gp AND vr AND fb AND w105",
          "d1 AND gp AND vr AND fb AND w105", "d1 AND vr AND fb AND w105", "d1 AND fb AND w105"]
_CTX_RUNGS = ["d2 AND gp AND vr", "d05 AND gp AND vr", "d1 AND gp AND vr", "d1 AND vr", "d1"]


def tier_rungs(rungs: list[str], least: int) -> str:
    counts = ", ".join(f"count(*) FILTER ({r}) AS c{i}" for i, r in enumerate(rungs))
    top = len(rungs) - 1
    found = " ".join(f"WHEN c{i} >= {least} THEN {i}" for i in range(1, top + 1))
    stop = " ".join(f"WHEN f <= {i} AND c{i} >= {2 * least} THEN {i}" for i in range(1, top + 1))
    arr = ", ".join(f"c{i}" for i in range(top + 1))
    return f"""SELECT *, CASE WHEN f IS NOT NULL THEN f WHEN n_broad > 0 THEN broad_rung ELSE 0 END AS strong_rung
      FROM (SELECT *, cs[broad_rung + 1] AS n_broad FROM (SELECT *, CASE {stop} ELSE {top} END AS broad_rung
        FROM (SELECT *, [{arr}] AS cs, CASE {found} END AS f
          FROM (SELECT instrument_id, {counts} FROM o_wide GROUP BY ALL))))"""


_NOTES = ["distance to the high widened to 0.50%", "weakness deadline moved 15 minutes later",
          "distance to the high widened to 1.00%", "gap condition dropped",
          "volatility regime condition dropped"]
_TEXT = "[" + ", ".join(f"'{n}'" for n in _NOTES) + "]"
add("i9_progressive_tiers", f"""SELECT instrument_id, c0 AS n_exact, cs[strong_rung + 1] AS n_strong, n_broad,
  strong_rung, broad_rung, CASE WHEN f IS NULL THEN '' ELSE array_to_string({_TEXT}[1:f], '; ') END AS relaxed_strong,
  array_to_string({_TEXT}[1:broad_rung], '; ') AS relaxed_broad, c0 < 5 AS few_exact
  FROM ({tier_rungs(_RUNGS, 12)})""")
add("n5_spec_conditions", f"""
WITH n AS (SELECT instrument_id, count(*) AS n_matches FROM o_setup WHERE {both(_LOOSE)} GROUP BY ALL)
SELECT n.*, v.* FROM n, (VALUES ('ath_tolerance_pct', '5.0', true), ('gap_min_pct', '-2.0', true),
  ('gap_max_pct', '2.0', true), ('on_location_min', '0.2', true), ('pressure_window_min', '15', false),
  ('direction', 'down', false), ('close_beyond_open', 'True', false), ('close_location_max', '0.5', true),
  ('decision_bar', '6', false), ('bar_minutes', '5', false), ('morning_end_min', '180', false))
  v(condition, setting, changed)""")
add("n5_relaxation_lines", f"""SELECT instrument_id, concat_ws('; ', printf('exact %d', n_exact),
  CASE WHEN relaxed_strong <> '' THEN printf('strong %d (%s)', n_strong, relaxed_strong) END,
  CASE WHEN relaxed_broad <> '' THEN printf('broad %d (%s)', n_broad, relaxed_broad) END,
  CASE WHEN few_exact THEN 'few exact cases: indicative only' END) AS summary
  FROM (SELECT *, cs[strong_rung + 1] AS n_strong, c0 AS n_exact, c0 < 5 AS few_exact,
    CASE WHEN f IS NULL THEN '' ELSE array_to_string({_TEXT}[1:f], '; ') END AS relaxed_strong,
    array_to_string({_TEXT}[1:broad_rung], '; ') AS relaxed_broad FROM ({tier_rungs(_RUNGS, 12)}))""")
add("i10_period_scope", f"""SELECT {KEY} FROM o_daily JOIN o_refs USING (instrument_id)
  WHERE session_date >= reference_date - 365""")
_PASS = "[" + ", ".join(_CTX_RUNGS) + "]"
_POOLS = {"exact": f"SELECT {KEY} FROM o_wide WHERE {_WIDE}", "similarity": f"SELECT {KEY} FROM o_wide",
          "combined": f"""SELECT w.instrument_id, w.session_date FROM (SELECT *, {_PASS} AS ok FROM o_wide) w
            JOIN ({tier_rungs(_CTX_RUNGS, 20)}) t USING (instrument_id) WHERE ok[strong_rung + 1]"""}
for _m, _p in _POOLS.items():
    add(f"i11_search_{_m}", f"""SELECT {KEY}, rank, similarity_score, day_classification,
      return_at_cash_close_pct, full_gap_fill FROM ({ranked(_p, 10)}) JOIN o_classes USING ({KEY})
      JOIN o_outcomes USING ({KEY})""", "similarity_score return_at_cash_close_pct")
add("i11_search_warped", f"""SELECT {KEY}, rank, similarity_score, day_classification
  FROM ({ranked(_POOLS["similarity"], 10).replace("o_pathscores", "o_pathscores_dtw")})
  JOIN o_classes USING ({KEY})""", "similarity_score")
add("i11_search_headline", f"""SELECT instrument_id, count(*) AS sample_size,
  median(return_at_cash_close_pct) AS median_return_at_close_pct,
  100.0 * avg(close_above_cash_open::INT) AS positive_close_pct,
  median(max_favorable_excursion_pct) AS median_mfe_pct, median(max_adverse_excursion_pct) AS median_mae_pct,
  100.0 * avg(full_gap_fill::INT) AS full_gap_fill_pct, 100.0 * avg(break_observed_high::INT) AS break_observed_high_pct,
  100.0 * avg(break_observed_low::INT) AS break_observed_low_pct
  FROM ({ranked(_POOLS["combined"], 10)}) JOIN o_outcomes USING ({KEY}) GROUP BY ALL""",
    "median_return_at_close_pct positive_close_pct median_mfe_pct median_mae_pct full_gap_fill_pct "
    "break_observed_high_pct break_observed_low_pct")
add("i12_description", f"""SELECT {KEY}, concat_ws('; ',
  CASE WHEN distance_open_to_ath_pct IS NOT NULL THEN CASE WHEN ath_at_open THEN 'open at a new high' ELSE
    printf('open %.2f%% %s the high', abs(distance_open_to_ath_pct),
           CASE WHEN distance_open_to_ath_pct > 0 THEN 'above' ELSE 'below' END) END END,
  CASE WHEN ath_reached_overnight THEN 'high reached overnight' END,
  CASE WHEN gap_pct IS NOT NULL THEN printf('gap %+.2f%%', gap_pct) END,
  CASE WHEN open_above_pdh THEN 'open above PDH' WHEN open_below_pdl THEN 'open below PDL' END,
  CASE WHEN first_bar_range_normalized IS NOT NULL THEN printf('first bar %s (%+.2f%%, %.2f ATR)',
      CASE WHEN first_bar_return > 0 THEN 'bullish' ELSE 'bearish' END, first_bar_return, first_bar_range_normalized)
    WHEN first_bar_return IS NOT NULL THEN printf('first bar %s (%+.2f%%)',
      CASE WHEN first_bar_return > 0 THEN 'bullish' ELSE 'bearish' END, first_bar_return) END,
  CASE WHEN extension_ratio IS NOT NULL THEN printf('extension %.2f, overlap %s, efficiency %s', extension_ratio,
    coalesce(printf('%.2f', post_spike_overlap_ratio), 'none'), coalesce(printf('%.2f', post_spike_efficiency), 'none')) END,
  CASE WHEN least(first_meaningful_lower_high_min, first_bearish_expansion_min) IS NOT NULL THEN
    printf('weak from minute %d', least(first_meaningful_lower_high_min, first_bearish_expansion_min)) END) AS description
  FROM o_feat""")
add("i13_flagship_filter", """
WITH q AS (SELECT instrument_id, quantile_cont(first_bar_range_normalized, 0.8) AS c80 FROM o_feat GROUP BY ALL)
SELECT instrument_id, count(*) FILTER (coalesce(abs(distance_open_to_ath_pct) <= 0.25 AND open_above_pdh
    AND first_bar_range_normalized >= c80 AND ok, false)) AS n_all_conditions,
  count(*) FILTER (coalesce(ok, false)) AS n_relaxed
FROM (SELECT *, gap_pct > 0 AND first_bar_is_bull AND first_bar_close_location >= 0.8 AND extension_ratio < 0.5
  AND post_spike_overlap_ratio > 0.5 AND weak_at <= 90 AS ok FROM o_weak) JOIN q USING (instrument_id) GROUP BY ALL""")

# ---- sources, cleaning, bars, rolls, audit
add("a1_plain_feed_lines", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS wall, value AS open,
  value AS high, value AS low, value AS close, CAST(1 AS DOUBLE) AS volume FROM events""", "open high low close volume")
add("a1_plain_feed_file", """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS wall, value AS open,
  CASE WHEN NOT (event_id % 11 = 0 OR event_id % 13 = 0) THEN value END AS high,
  CASE WHEN event_id % 11 > 0 THEN value END AS low, CASE WHEN event_id % 11 > 0 THEN value END AS close,
  CASE WHEN event_id % 11 > 0 THEN event_id::DOUBLE END AS volume FROM events""", "open high low close volume")
_WALL = "strftime(local_dt, '%Y-%m-%d %H:%M:%S')"
add("a2_contract_files", f"""SELECT instrument_id AS con_id, {_WALL} AS wall, contract_month::BIGINT AS contract_month,
  expiry::BIGINT AS expiry, 'Q' || con_id AS local_symbol, o AS open, h AS high, l AS low, c AS close, volume,
  n_ticks::DOUBLE AS bar_count FROM o_quarter""", "open high low close volume bar_count")
add("a4_parquet_sink", f"""SELECT {KEY}, cash_close, atr, data_quality_flags, year(session_date)::INTEGER AS year
  FROM o_daily""", "cash_close atr")
add("a5_csv_sink", f"""SELECT {KEY}, signal_mso, label, status, reason, r_multiple FROM o_trades""",
    "r_multiple")
add("a5_bucketed_walk", f"SELECT * EXCLUDE (sentence) FROM ({_DECISIONS})", "last_rr")
add("a3_runtime_pruning", f"""SELECT {KEY}, mso, c AS close, volume FROM o_bars
  SEMI JOIN (SELECT instrument_id, max(session_date) AS session_date FROM o_bars GROUP BY ALL) USING ({KEY})""",
    "close volume")
add("a3_pruned_scan", """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n, sum(l_quantity) AS quantity
  FROM lineitem WHERE l_shipdate >= DATE '1999-01-01' GROUP BY ALL""", "quantity")
add("b1_localize", """
WITH e AS (SELECT event_id, ts + to_days((event_id % 366)::INTEGER) AS w FROM events),
u AS (SELECT event_id, w, timezone('UTC', timezone('America/Chicago', w)) AS u FROM e),
x AS (SELECT event_id, w, CASE
  WHEN timezone('America/Chicago', timezone('UTC', u)) <> w THEN date_trunc('hour', u)
  WHEN timezone('America/Chicago', timezone('UTC', u - INTERVAL 1 HOUR)) = w THEN u - INTERVAL 1 HOUR ELSE u END AS u FROM u)
SELECT event_id, strftime(u, '%Y-%m-%d %H:%M:%S') AS utc,
  strftime(timezone('Europe/Berlin', timezone('UTC', u)), '%Y-%m-%d %H:%M:%S') AS local FROM x""")
_CHICAGO = "timezone('America/Chicago', timezone('UTC', {}))"
add("b1_infer", f"""
WITH e AS (SELECT event_id, event_id % 7 AS instrument_id, TIMESTAMP '2024-11-03' + to_minutes(event_id) AS now,
  CASE WHEN event_id % 7 = 5 THEN -event_id ELSE event_id END AS seq FROM events),
w AS (SELECT *, {_CHICAGO.format("now")} AS w FROM e WHERE instrument_id <> 3 OR hour(now) <> 7),
u AS (SELECT *, timezone('UTC', timezone('America/Chicago', w)) AS u0 FROM w),
v AS (SELECT *, CASE WHEN {_CHICAGO.format("u0 - INTERVAL 1 HOUR")} = w THEN u0 - INTERVAL 1 HOUR ELSE u0 END AS u FROM u),
a AS (SELECT *, {_CHICAGO.format("u + INTERVAL 1 HOUR")} = w AS amb FROM v),
p AS (SELECT *, lag(amb, 1, false) OVER s AS amb_, lag(w) OVER s AS w_ FROM a
  WINDOW s AS (PARTITION BY instrument_id ORDER BY seq)),
h AS (SELECT *, sum(CASE WHEN amb_ THEN 0 ELSE 1 END) OVER (PARTITION BY instrument_id ORDER BY seq) AS hr,
  CASE WHEN amb_ AND w <= w_ THEN 1 ELSE 0 END AS back FROM p WHERE amb),
t AS (SELECT *, sum(back) OVER (PARTITION BY instrument_id, hr ORDER BY seq) > 0 AS late,
  sum(back) OVER (PARTITION BY instrument_id, hr) AS turns FROM h),
f AS (SELECT instrument_id, NOT bool_and(turns = 1) AS fb FROM t GROUP BY ALL),
r AS (SELECT p.event_id, p.instrument_id, coalesce(fb, false) AS fallback_used, p.now,
  CASE WHEN late AND NOT fb THEN p.u + INTERVAL 1 HOUR ELSE p.u END AS x
  FROM p LEFT JOIN f USING (instrument_id) LEFT JOIN (SELECT event_id, late FROM t) USING (event_id))
SELECT event_id, instrument_id, fallback_used, x = now AS as_it_was, strftime(x, '%Y-%m-%d %H:%M:%S') AS utc,
  strftime(timezone('Europe/Berlin', timezone('UTC', x)), '%Y-%m-%d %H:%M:%S') AS local FROM r""")
add("b2_duplicate_counts", """
WITH v AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem),
k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM v GROUP BY ALL)
SELECT (SELECT count(*) FROM lineitem) AS n_raw,
  (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM v) AS n_exact_duplicates,
  (SELECT count(*) FROM k WHERE n > 1) AS n_conflicting_duplicates, (SELECT count(*) FROM k) AS n_clean""")
add("b3_conflicts", """
WITH v AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, count(*) AS copies FROM lineitem GROUP BY ALL)
SELECT * FROM v QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1""")
add("b4_keep_first", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, n_raw FROM (SELECT *,
  count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n_raw, row_number() OVER (PARTITION BY l_orderkey,
  l_linenumber ORDER BY l_returnflag, l_linestatus) AS k FROM lineitem) WHERE k = 1""")
add("b5_session_date", "SELECT event_id, CAST(ts AS DATE) AS session_date FROM events")
add("b6_sessionize", """SELECT event_id, CAST(ts AS DATE) AS session_date, t AS tod_min, t - 540 AS mso,
  t >= 540 AND t < 1050 AS is_cash FROM (SELECT *, hour(ts) * 60 + minute(ts) AS t FROM events)""")
add("b7_clock", """SELECT mso, count(*) AS n, printf('%02d:%02d', (mso + 540) // 60, (mso + 540) % 60) AS clock,
  390 AS us_open_mso FROM o_bars GROUP BY ALL""")
add("c1_rebar", """SELECT event_type AS con_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bar_dt,
  arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
  CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY ALL""", "open high low close volume")
add("c2_stitch", f"""SELECT {KEY}, feed, count(*) AS n, count(*) FILTER (feed = 'contract_1m') AS n_contract,
  count(*) FILTER (feed = 'contract_1m') AS n_expiry FROM o_bars GROUP BY ALL""")
add("c3_contract_levels", "SELECT * FROM o_levels", "start_level end_level")
add("c4_roll_factors", 'SELECT instrument_id, con_id, carry, ratio, difference, CAST(1 AS DOUBLE) AS "none" FROM o_factors',
    'carry ratio difference "none"')
add("c5_seam_report", """
WITH s AS (SELECT *, ns - end_level AS gap, end_level * 0.025::DOUBLE * nd / 365 AS car FROM o_seams WHERE nxt IS NOT NULL)
SELECT instrument_id, contract_month AS old, nxt AS new, round(end_level, 2) AS old_end_level,
  round(ns, 2) AS new_start_level, round(gap, 2) AS seam_gap_pts, round(100 * gap / end_level, 3) AS seam_gap_pct,
  round(car, 2) AS carry_pts, round(100 * car / end_level, 3) AS carry_pct, round(gap - car, 2) AS real_move_pts FROM s""")
STATEMENTS["a6_json_sink"] = STATEMENTS["c5_seam_report"]
add("c6_apply_rolls", f"""
WITH old AS (SELECT instrument_id, arg_min(carry, contract_month) AS f0 FROM o_factors GROUP BY ALL)
SELECT b.instrument_id, b.session_date, mso, c AS close, c * f AS adj_close, c * f / c AS adj_factor
FROM (SELECT b.*, coalesce(CASE WHEN feed = 'feed_5m' THEN f0 ELSE carry END, 1) AS f
      FROM o_bars b LEFT JOIN o_factors USING (instrument_id, con_id) LEFT JOIN old USING (instrument_id)) b""",
    "close adj_close adj_factor")
# The batch build: the same expressions over bars adjusted by the carry factors.
variant("_adj", o_bars="""
SELECT b.* EXCLUDE (con_id) REPLACE (o * f AS o, h * f AS h, l * f AS l, c * f AS c),
  CASE WHEN feed = 'contract_1m' THEN con_id END AS con_id, c AS raw_c, f
FROM (SELECT b.*, coalesce(CASE WHEN feed = 'feed_5m' THEN f0 ELSE carry END, 1) AS f
      FROM o_bars b LEFT JOIN o_factors USING (instrument_id, con_id)
      LEFT JOIN (SELECT instrument_id, arg_min(carry, contract_month) AS f0 FROM o_factors GROUP BY ALL)
      USING (instrument_id)) b""")
add("c2_adjusted_master", f"""SELECT {KEY}, mso, is_cash, feed, con_id, raw_c AS close, o AS adj_open,
  h AS adj_high, l AS adj_low, c AS adj_close, c / raw_c AS adj_factor, volume FROM o_bars_adj""",
    "close adj_open adj_high adj_low adj_close adj_factor volume")
add("a4_build_contracts", f"""SELECT {KEY}, mso, con_id, con_id AS contract_month, raw_c AS close, c AS adj_close
  FROM o_bars_adj WHERE feed = 'contract_1m'""", "close adj_close")
add("a4_build_daily", f"""SELECT {KEY}, cash_open, cash_close, prior_ath, atr, gap_points, gap_pct,
  previous_day_return, overnight_range, rolling_daily_range, open_above_pdh, daily_volatility_regime,
  data_quality_flags, feed FROM o_daily_adj""", """cash_open cash_close prior_ath atr gap_points gap_pct
  previous_day_return overnight_range rolling_daily_range""")
add("a4_build_opening", f"""SELECT {KEY}, cutoff_min, net_points, high_low_range, "distance_from_PDH",
  distance_from_overnight_low, "range_normalized_by_ATR", "first_bar_breaks_prior_ATH", first_bar_is_bull,
  number_of_higher_highs FROM o_opening_adj""", _doubles("""net_points high_low_range distance_from_PDH
  distance_from_overnight_low range_normalized_by_ATR"""))
add("c7_verify_rolls", """SELECT *, method = 'carry' AS residual_is_real_move,
  method IN ('ratio', 'carry') AS preserves_pct_returns FROM o_verify""")
add("c8_calendar", f"""SELECT {KEY}, n_bars, coalesce(n_cash_bars, 0) AS n_cash_bars, feed,
  dayname(session_date) AS weekday, coalesce(n_cash_bars, 0) < 0.6 * greatest(typical, 51.5) AS shortened_session,
  isodow(session_date) >= 6 AS is_weekend
  FROM o_anyday LEFT JOIN o_cashday USING ({KEY}) JOIN o_typical USING (instrument_id)""".replace(
    "feed,", "o_anyday.feed,", 1))
add("c10_cash_slice", f"SELECT {KEY}, mso, c AS close FROM o_cash WHERE mso <= 30", "close")
add("c11_overnight_slice", """
WITH d AS (SELECT *, lag(session_date) OVER (PARTITION BY instrument_id ORDER BY session_date) AS prev FROM o_anyday)
SELECT d.instrument_id, d.session_date AS overnight_of, b.session_date, b.mso
FROM d JOIN o_bars b ON b.instrument_id = d.instrument_id
 AND b.local_dt > d.prev + INTERVAL '17 hours 30 minutes' AND b.local_dt < d.session_date + INTERVAL 9 HOUR""")
add("d1_timezone_check", """
WITH p AS (SELECT instrument_id, tod_min, sum(volume) AS v FROM o_bars GROUP BY ALL),
t AS (SELECT instrument_id, string_agg(printf('%02d:%02d', tod_min // 60, tod_min % 60), ',' ORDER BY k) AS top
  FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY v DESC, tod_min) AS k FROM p) WHERE k <= 6 GROUP BY ALL),
s AS (SELECT instrument_id, coalesce(sum(v) FILTER (tod_min BETWEEN 535 AND 555), 0) / sum(v) AS a,
  coalesce(sum(v) FILTER (tod_min BETWEEN 1040 AND 1060), 0) / sum(v) AS b FROM p GROUP BY ALL)
SELECT instrument_id, 'Europe/Berlin' AS declared_tz, top AS top_volume_minutes, round(a, 4) AS share_near_open,
  round(b, 4) AS share_near_close, a > 0.02 AND b > 0.01 AS consistent FROM s JOIN t USING (instrument_id)""")
_COV = """
WITH d AS (SELECT instrument_id, session_date, min(local_dt) AS t0, max(local_dt) AS t1, min(tod_min) AS f,
  max(tod_min) AS l, nullif(count(*) FILTER (is_cash), 0) AS n FROM o_bars GROUP BY ALL),
mf AS (SELECT instrument_id, f FROM (SELECT instrument_id, f, row_number() OVER (PARTITION BY instrument_id
  ORDER BY count(*) DESC, f) AS k FROM d GROUP BY instrument_id, f) WHERE k = 1),
ml AS (SELECT instrument_id, l FROM (SELECT instrument_id, l, row_number() OVER (PARTITION BY instrument_id
  ORDER BY count(*) DESC, l) AS k FROM d GROUP BY instrument_id, l) WHERE k = 1),
g AS (SELECT instrument_id, min(t0) AS t0, max(t1) AS t1, count(*) AS n_sessions, median(n) AS md, min(n) AS mn,
  max(n) AS mx FROM d GROUP BY ALL)
SELECT instrument_id, strftime(t0, '%Y-%m-%d %H:%M:%S') AS coverage_start,
  strftime(t1, '%Y-%m-%d %H:%M:%S') AS coverage_end, n_sessions,
  printf('%02d:%02d', f // 60, f % 60) AS first_bar_mode, printf('%02d:%02d', l // 60, l % 60) AS last_bar_mode,
  md AS cash_bars_median, mn AS cash_bars_min, mx AS cash_bars_max
FROM g JOIN mf USING (instrument_id) JOIN ml USING (instrument_id)"""
add("d2_coverage", _COV, "cash_bars_median")


def missing(share: float) -> str:
    return f"""
WITH b AS (SELECT *, mso - lag(mso) OVER (PARTITION BY {KEY} ORDER BY mso) > 5 AS hole FROM o_cash),
d AS (SELECT {KEY}, count(*) AS n, coalesce(bool_or(hole), false) AS holes FROM b GROUP BY ALL),
g AS (SELECT instrument_id, count(*) FILTER (n >= {share} * 103) AS full_days,
  coalesce(sum(greatest(103 - n, 0)) FILTER (n >= {share} * 103), 0)::BIGINT AS missing_bars,
  count(*) FILTER (holes) AS sessions_with_gaps FROM d GROUP BY ALL)
SELECT instrument_id, 103 AS expected_bars, full_days, missing_bars,
  round(100.0 * missing_bars / (103 * greatest(full_days, 1)), 3) AS missing_pct, sessions_with_gaps FROM g"""


add("d3_missing_bars", missing(0.2))
add("d4_contract_inventory", """SELECT instrument_id, contract_month, min(con_id) AS con_id,
  'Q' || min(con_id) AS local_symbol, min(expiry) AS expiry, strftime(min(local_dt), '%Y-%m-%d %H:%M:%S') AS starts,
  strftime(max(local_dt), '%Y-%m-%d %H:%M:%S') AS ends, count(*) AS n_bars FROM o_quarter GROUP BY ALL""")
add("d5_shared_timestamps", """SELECT strftime(ts, '%Y-%m-%d %H:%M') AS minute, count(DISTINCT event_type) AS n_contracts
  FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1""")
_GAP = """SELECT instrument_id, CAST(floor((epoch(min(local_dt) FILTER (feed = 'contract_1m'))
  - epoch(max(local_dt) FILTER (feed = 'feed_5m'))) / 86400) AS BIGINT) AS gap_days FROM o_bars GROUP BY ALL"""
add("d6_feed_gap", _GAP)
_DUP = """
WITH f AS (SELECT *, l_shipdate::TIMESTAMP + to_minutes((l_orderkey * 31 + l_linenumber * 7) % 1440) AS wall FROM lineitem),
u AS (SELECT *, timezone('America/Chicago', wall) AS u FROM f),
v AS (SELECT l_suppkey // 25 AS instrument_id, l_orderkey, l_linenumber, l_returnflag, l_linestatus, count(*) AS n,
    bool_or(timezone('America/Chicago', u) = wall AND (timezone('America/Chicago', u - INTERVAL 1 HOUR) = wall
      OR timezone('America/Chicago', u + INTERVAL 1 HOUR) = wall)) AS twice
  FROM u GROUP BY ALL),
k AS (SELECT instrument_id, l_orderkey, l_linenumber, count(*) AS versions, sum(n) AS n, bool_or(twice) AS twice FROM v GROUP BY ALL)
SELECT instrument_id, sum(n)::BIGINT AS n_raw, (sum(n) - sum(versions))::BIGINT AS n_exact_duplicates,
  count(*) FILTER (versions > 1) AS n_conflicting_duplicates, count(*) AS n_clean, bool_or(twice) AS fallback_used
FROM k GROUP BY ALL"""
_TZ = STATEMENTS["d1_timezone_check"]
_AUDIT = f"""SELECT instrument_id, n_raw, n_exact_duplicates, n_conflicting_duplicates, n_clean, fallback_used,
  declared_tz, share_near_open, share_near_close, consistent, coverage_start, coverage_end, n_sessions, first_bar_mode,
  last_bar_mode, cash_bars_median, cash_bars_min, cash_bars_max, expected_bars, full_days, missing_bars, missing_pct,
  sessions_with_gaps, gap_days, newest_contract_anchored_raw
  FROM ({_DUP}) JOIN ({_TZ}) USING (instrument_id) JOIN ({_COV}) USING (instrument_id)
  JOIN ({missing(0.8)}) USING (instrument_id) JOIN ({_GAP}) USING (instrument_id)
  JOIN (SELECT instrument_id, newest_contract_anchored_raw FROM o_verify WHERE method = 'carry') USING (instrument_id)"""
add("d8_audit_row", _AUDIT, "cash_bars_median")
add("d7_warnings", f"""SELECT instrument_id, concat_ws('; ',
  CASE WHEN NOT consistent THEN 'volume profile does not fit the declared zone' END,
  CASE WHEN n_conflicting_duplicates > 0 THEN n_conflicting_duplicates || ' conflicting duplicates' END,
  CASE WHEN fallback_used THEN 'ambiguous hours read as summer time' END,
  CASE WHEN gap_days > 3 THEN gap_days || ' days between the feeds' END,
  CASE WHEN NOT newest_contract_anchored_raw THEN 'newest contract is not raw' END) AS warnings FROM ({_AUDIT})""")


# ---- the same on dense bars
variant("_dense", o_slots="""
SELECT * REPLACE (CAST(DATE '1997-12-01' + day AS DATE) AS session_date,
  (CAST(date_trunc('week', DATE '1997-12-01' + day) AS DATE) - DATE '1995-01-02') // 7 AS wk),
  CASE WHEN short < 102 THEN short * 5 WHEN short = 102 THEN -10 ELSE 520 END AS mso
FROM (SELECT *, CASE WHEN isodow(DATE '1997-12-01' + day) >= 6 THEN s % 30 WHEN day % 14 = 0 THEN s % 48 ELSE s END AS short
  FROM (SELECT * REPLACE (CASE WHEN day BETWEEN 35 AND 34 + instrument_id % 3 THEN day + 3 ELSE day END AS day)
    FROM (SELECT *, ((l_orderkey * 3 + l_linenumber * 11 + l_partkey) % 71)::INTEGER AS day,
      (l_orderkey * 7 + l_partkey * 13 + l_linenumber * 5) % 104 AS s FROM o_ticks)))""")
for _n, _p in DENSE.items():
    _sql, _dbl = (missing(0.8), "") if _p == "d3_missing_bars" else RAW[_p]
    _sql = _sql.replace(_TZ, RAW["d1_timezone_check"][0])
    for _c in sorted(CTES, key=len, reverse=True):
        if _c + "_dense" in CTES:
            _sql = re.sub(rf"\b{_c}\b", _c + "_dense", _sql)
    add(_n, _sql, _dbl)
