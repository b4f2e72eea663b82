"""Context labels, setup table and the pullback walk."""
from oracles.build import define

define(
    o_ctx1="""
SELECT *, CASE WHEN count(*) OVER f >= 10 THEN avg(cash_close) OVER f END AS maf,
  CASE WHEN count(*) OVER s >= 25 THEN avg(cash_close) OVER s END AS mas,
  CASE WHEN count(*) OVER f >= 5 THEN avg(cash_high - cash_low) OVER f END AS dr,
  CASE WHEN count(*) OVER f >= 5 THEN max(cash_high) OVER f END AS hn,
  CASE WHEN count(*) OVER f >= 5 THEN min(cash_low) OVER f END AS ln,
  CASE WHEN count(*) OVER g >= 40 THEN min(cash_low) OVER g END AS ll250
FROM o_daily
WINDOW f AS (PARTITION BY instrument_id ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
       s AS (PARTITION BY instrument_id ORDER BY session_date ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING),
       g AS (PARTITION BY instrument_id ORDER BY session_date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)""",
    o_ctx2="""
SELECT *, maf - lag(maf, 5) OVER (PARTITION BY instrument_id ORDER BY session_date) AS slope,
  (cash_open - ln) / nullif(hn - ln, 0) AS loc, 100.0 * ((cash_open - prior_ath) / prior_ath) AS da,
  100.0 * ((cash_open - ll250) / ll250) AS dl
FROM o_ctx1""",
    o_ctx3="""
SELECT *, coalesce(cash_open > maf, false) AS above, coalesce(slope > 0, false) AS rising,
  coalesce(abs(slope) < 0.15 * dr, false) AS flat,
  coalesce(maf > mas AND cash_open > maf, false) AS sup, coalesce(maf < mas AND cash_open < maf, false) AS sdn,
  coalesce(cash_open > hn, false) AS bo, coalesce(cash_open < ln, false) AS bd
FROM o_ctx2""",
    o_dailyctx="""
SELECT instrument_id, session_date, maf AS ma_fast, mas AS ma_slow, slope AS ma_fast_slope,
  hn AS range_high, ln AS range_low, loc AS location_in_range, da AS distance_to_ath_pct,
  CASE WHEN maf IS NULL THEN 'UNKNOWN' ELSE (CASE WHEN above THEN 'ABOVE_' ELSE 'BELOW_' END)
       || (CASE WHEN rising THEN 'RISING' ELSE 'FALLING' END) END AS ma_state,
  CASE WHEN prior_ath IS NULL THEN 'UNKNOWN' WHEN da >= -0.25 THEN 'AT_ATH' WHEN abs(da) <= 1.0 THEN 'NEAR_ATH'
       WHEN abs(dl) <= 1.0 THEN 'AT_LOWS' WHEN bd THEN 'BREAKDOWN' WHEN bo THEN 'BREAKOUT_UP'
       WHEN loc >= 0.67 THEN 'UPPER_RANGE' WHEN loc <= 0.33 THEN 'LOWER_RANGE' ELSE 'MID_RANGE' END AS location,
  CASE WHEN mas IS NULL THEN 'UNKNOWN' WHEN flat THEN 'RANGE'
       WHEN sdn AND NOT rising THEN (CASE WHEN bd THEN 'STRONG_BEAR' ELSE 'BEAR' END)
       WHEN sup AND rising THEN (CASE WHEN bo THEN 'STRONG_BULL' ELSE 'BULL' END) ELSE 'RANGE' END AS swing
FROM o_ctx3""",
    o_pd1="""
SELECT instrument_id, session_date, cash_high AS h, cash_low AS l, cash_high - cash_low AS rng,
  (cash_close - cash_low) / nullif(cash_high - cash_low, 0) AS cl,
  previous_day_high AS ph, previous_day_low AS pl,
  CASE WHEN count(*) OVER g >= 50 THEN quantile_cont(cash_high - cash_low, 0.9) OVER g END AS big,
  CASE WHEN count(*) OVER g >= 50 THEN quantile_cont(cash_high - cash_low, 0.4) OVER g END AS quiet
FROM o_daily WINDOW g AS (PARTITION BY instrument_id ORDER BY session_date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)""",
    o_pd2="""
SELECT *, coalesce(rng >= big, false) AS isbig,
  CASE WHEN rng >= big THEN 'BIG_RANGE' WHEN h > ph AND cl <= 1 - CAST(0.7 AS DOUBLE) THEN 'REVERSAL_DOWN'
       WHEN l < pl AND cl >= 0.7 THEN 'REVERSAL_UP' WHEN h > ph AND l < pl THEN 'OUTSIDE'
       WHEN h < ph AND l > pl THEN 'INSIDE' WHEN rng <= quiet THEN 'RANGE'
       WHEN cl <= 1 - CAST(0.7 AS DOUBLE) THEN 'TREND_DOWN' WHEN cl >= 0.7 THEN 'TREND_UP' ELSE 'RANGE' END AS day_type
FROM o_pd1""",
    o_pdctx="""
SELECT instrument_id, session_date, lag(day_type) OVER w AS prior_day_type, lag(cl) OVER w AS prior_day_close_loc,
  coalesce(lag(isbig) OVER w, false) AS prior_day_was_big_range,
  sum(CASE WHEN day_type IN ('RANGE', 'INSIDE') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
    OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS prior_3d_range_count
FROM o_pd2 WINDOW w AS (PARTITION BY instrument_id ORDER BY session_date)""",
    o_oc1="""
SELECT *, abs(gap_pct) AS a,
  CASE WHEN count(gap_pct) OVER g >= 50 THEN quantile_cont(abs(gap_pct), 0.2) OVER g END AS q20,
  CASE WHEN count(gap_pct) OVER g >= 50 THEN quantile_cont(abs(gap_pct), 0.5) OVER g END AS q50,
  CASE WHEN count(gap_pct) OVER g >= 50 THEN quantile_cont(abs(gap_pct), 0.8) OVER g END AS q80,
  (cash_open - previous_day_low) / nullif(previous_day_high - previous_day_low, 0) AS frac,
  nullif(overnight_high_adj - overnight_low_adj, 0) AS onr
FROM o_daily WINDOW g AS (PARTITION BY instrument_id ORDER BY session_date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)""",
    o_openctx="""
SELECT instrument_id, session_date,
  CASE WHEN q20 IS NULL THEN 'UNKNOWN' WHEN gap_pct = 0 OR a <= q20 OR gap_pct IS NULL THEN 'FLAT'
       ELSE (CASE WHEN a > q80 THEN 'LARGE' WHEN a > q50 THEN 'MODERATE' ELSE 'SMALL' END)
         || (CASE WHEN gap_pct > 0 THEN '_UP' ELSE '_DOWN' END) END AS gap_bucket,
  CASE WHEN previous_day_high IS NULL THEN 'UNKNOWN' WHEN cash_open < previous_day_low THEN 'BELOW_PDL'
       WHEN cash_open > previous_day_high THEN 'ABOVE_PDH' WHEN frac >= 0.67 THEN 'UPPER_PD'
       WHEN frac <= 0.33 THEN 'LOWER_PD' ELSE 'MID_PD' END AS open_loc,
  CASE WHEN onr IS NULL THEN 'UNKNOWN'
       WHEN (overnight_close_adj - overnight_low_adj) / onr <= 1 - CAST(0.7 AS DOUBLE)
         THEN (CASE WHEN (overnight_high_adj - overnight_open_adj) / onr >= 0.35 THEN 'REVERSAL_DOWN' ELSE 'TREND_DOWN' END)
       WHEN (overnight_close_adj - overnight_low_adj) / onr >= 0.7
         THEN (CASE WHEN (overnight_open_adj - overnight_low_adj) / onr >= 0.35 THEN 'REVERSAL_UP' ELSE 'TREND_UP' END)
       ELSE 'RANGE' END AS overnight_type,
  frac AS open_frac_in_pd_range, (overnight_close_adj - overnight_low_adj) / onr AS overnight_close_loc
FROM o_oc1""",
    o_win15="""
SELECT instrument_id, session_date, count(*) AS n, max(h) AS hi, min(l) AS lo, arg_max(c, mso) AS c,
  count(*) FILTER (c < o) AS bears, count(*) FILTER (c > o) AS bulls,
  count(*) FILTER (h < h_) AS fh, count(*) FILTER (l > l_) AS rl,
  coalesce(bool_or(c < l_), false) AS cbl, coalesce(bool_or(c > h_), false) AS cah
FROM (SELECT *, lag(h) OVER w AS h_, lag(l) OVER w AS l_ FROM o_cash WHERE mso < 15
      WINDOW w AS (PARTITION BY instrument_id, session_date ORDER BY mso)) GROUP BY ALL""",
    o_geo="""
SELECT instrument_id, session_date, cash_open AS op, n, hi, lo, w.c, bears, bulls, fh, rl, cbl, cah,
  (w.c - lo) / nullif(hi - lo, 0) AS loc, (hi - cash_open) / nullif(hi - lo, 0) AS ue,
  (cash_open - lo) / nullif(hi - lo, 0) AS de
FROM o_cashday LEFT JOIN o_win15 w USING (instrument_id, session_date)""",
    o_emapart="""
SELECT instrument_id, session_date, mso, c,
  row_number() OVER (PARTITION BY instrument_id, session_date ORDER BY mso) AS k,
  count(*) OVER (PARTITION BY instrument_id, session_date) AS n
FROM o_cash WHERE mso <= 14""",
    o_ema="""
SELECT instrument_id, session_date,
  sum(c * pow(1 - 2.0 / 21, n - k) * (CASE WHEN k = 1 THEN 1 ELSE 2.0 / 21 END)) AS ema
FROM o_emapart GROUP BY ALL""",
    o_openinglabel="""
SELECT g.instrument_id, g.session_date,
  CASE WHEN n IS NULL THEN NULL
       WHEN c < op AND loc <= 0.33 AND ue >= 0.35 THEN 'REJECTION_UP'
       WHEN c > op AND loc >= 0.67 AND de >= 0.35 THEN 'REJECTION_DOWN'
       WHEN c > op AND loc >= 0.67 THEN 'DRIVE_UP' WHEN c < op AND loc <= 0.33 THEN 'DRIVE_DOWN'
       ELSE 'RANGE_OPEN' END AS opening,
  hi AS op_win_high, lo AS op_win_low, c AS op_win_close, loc AS op_close_location,
  ue AS op_up_excursion, de AS op_down_excursion, hi > op AS op_poked_above_open, lo < op AS op_poked_below_open,
  c > op AS op_close_above_open, bears AS op_n_bear_bars, bulls AS op_n_bull_bars,
  n >= 3 AND fh = n - 1 AS op_lower_highs, n >= 3 AND rl = n - 1 AS op_higher_lows,
  cbl AS op_close_below_prior_low, cah AS op_close_above_prior_high,
  CASE WHEN c > ema THEN 'ABOVE' WHEN c <= ema THEN 'BELOW' END AS op_close_vs_ema, ema AS op_ema
FROM o_geo g LEFT JOIN o_ema USING (instrument_id, session_date)
SEMI JOIN (SELECT instrument_id, session_date FROM o_cash WHERE mso < 30 GROUP BY ALL HAVING count(*) >= 2)
USING (instrument_id, session_date)""",
    o_context="""
SELECT * FROM o_dailyctx JOIN o_pdctx USING (instrument_id, session_date)
JOIN o_openctx USING (instrument_id, session_date) JOIN o_openinglabel USING (instrument_id, session_date)""",
    o_phase="""
SELECT instrument_id, session_date, count(*) FILTER (mso < 30) AS npre, count(*) FILTER (mso >= 30) AS naft,
  arg_max(c, mso) FILTER (mso < 30) AS px, arg_max(c, mso) FILTER (mso >= 30 AND mso <= 180) AS mc,
  arg_max(c, mso) AS dc, min(l) FILTER (mso < 30) AS pl, max(h) FILTER (mso < 30) AS ph,
  min(l) FILTER (mso >= 30 AND mso <= 180) AS ml, max(h) FILTER (mso >= 30 AND mso <= 180) AS mh,
  min(l) FILTER (mso >= 30) AS al, max(h) FILTER (mso >= 30) AS ah
FROM o_cash GROUP BY ALL""",
    o_setup="""
SELECT g.instrument_id, g.session_date, op AS cash_open, px AS decision_price,
  g.n AS pa_n_bars, hi AS pa_win_high, lo AS pa_win_low, g.c AS pa_win_close, loc AS pa_close_location,
  g.c < op AS pa_close_below_open, g.c > op AS pa_close_above_open, bears AS pa_n_bear_bars,
  bulls AS pa_n_bull_bars, n >= 3 AND fh = n - 1 AS pa_monotonic_lower_highs,
  n >= 3 AND rl = n - 1 AS pa_monotonic_higher_lows, cbl AS pa_close_below_prior_low,
  cah AS pa_close_above_prior_high, hi > op AS pa_poked_above_open, lo < op AS pa_poked_below_open,
  hi > op AND g.c < op AS pa_spike_up_reject, lo < op AND g.c > op AS pa_spike_down_reject,
  hi <= op + 1e-9 AS pa_open_is_high, lo >= op - 1e-9 AS pa_open_is_low,
  d.gap_pct, d.distance_open_to_ath_pct, d.ath_at_open, d.open_above_pdh, d.open_below_pdl,
  d.open_location_in_overnight_range, d.daily_volatility_regime,
  d.previous_day_high AS "level_PDH", d.previous_close AS "level_PDC", d.previous_day_low AS "level_PDL",
  d.overnight_high_adj AS "level_ONH", d.overnight_low_adj AS "level_ONL",
  coalesce(pl <= d.previous_day_high, false) AS "pre_PDH", coalesce(ml <= d.previous_day_high, false) AS "morn_PDH",
  coalesce(al <= d.previous_day_high, false) AS "aft_PDH",
  coalesce(pl <= d.previous_close, false) AS "pre_PDC", coalesce(ml <= d.previous_close, false) AS "morn_PDC",
  coalesce(al <= d.previous_close, false) AS "aft_PDC",
  coalesce(pl <= d.previous_day_low, false) AS "pre_PDL", coalesce(ml <= d.previous_day_low, false) AS "morn_PDL",
  coalesce(al <= d.previous_day_low, false) AS "aft_PDL",
  coalesce(ph >= d.overnight_high_adj, false) AS "pre_ONH", coalesce(mh >= d.overnight_high_adj, false) AS "morn_ONH",
  coalesce(ah >= d.overnight_high_adj, false) AS "aft_ONH",
  coalesce(pl <= d.overnight_low_adj, false) AS "pre_ONL", coalesce(ml <= d.overnight_low_adj, false) AS "morn_ONL",
  coalesce(al <= d.overnight_low_adj, false) AS "aft_ONL",
  coalesce(mh >= op, false) AS morn_reclaim_open, coalesce(ah >= op, false) AS aft_reclaim_open,
  100.0 * (mc - px) / px AS morn_ret_pct, 100.0 * (ml - px) / px AS morn_mae_pct,
  100.0 * (mh - px) / px AS morn_mfe_pct, 100.0 * (dc - px) / px AS day_ret_pct,
  100.0 * (al - px) / px AS day_mae_pct, 100.0 * (ah - px) / px AS day_mfe_pct
FROM o_geo g JOIN o_phase p USING (instrument_id, session_date) JOIN o_daily d USING (instrument_id, session_date)
WHERE npre >= 6 AND naft > 0 AND n > 0""",
    o_w1="""
SELECT instrument_id, session_date, mso, h, l, c, row_number() OVER w - 1 AS i, count(*) OVER p AS n,
  lag(h) OVER w AS h_, lag(l) OVER w AS l_, first(h) OVER w AS h0, first(l) OVER w AS l0,
  max(h) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hb,
  min(l) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lb,
  max(h) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hr,
  min(l) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lr
FROM o_cash WINDOW w AS (PARTITION BY instrument_id, session_date ORDER BY mso),
                   p AS (PARTITION BY instrument_id, session_date)""",
    o_w2="""
SELECT *, coalesce(h > h_ AND l > l_, false) AS us, coalesce(h < h_ AND l < l_, false) AS ds,
  coalesce(h > hb, false) AS nh, coalesce(l < lb, false) AS nl, sign(h - h_) AS dh, sign(l_ - l) AS dl
FROM o_w1""",
    o_w3="""
SELECT *, bool_or(us AND us_) OVER u AND count(*) FILTER (h > h0) OVER u >= 2 AS bull,
  bool_or(ds AND ds_) OVER u AND count(*) FILTER (l < l0) OVER u >= 2 AS bear,
  count(*) FILTER (h > h0) OVER u AS fth, count(*) FILTER (l < l0) OVER u AS ftl,
  coalesce(min(l) FILTER (i > 0) OVER u >= l0, true) AS hold_bull,
  coalesce(max(h) FILTER (i > 0) OVER u <= h0, true) AS hold_bear,
  count(*) FILTER (nh) OVER u AS gh, count(*) FILTER (nl) OVER u AS gl,
  coalesce(dh = 1 AND NOT nh AND pdh = -1, false) AS sh, coalesce(dl = 1 AND NOT nl AND pdl = -1, false) AS sl,
  i - coalesce(max(i) FILTER (NOT us) OVER u, 0) AS run_u, i - coalesce(max(i) FILTER (NOT ds) OVER u, 0) AS run_d,
  max(mso) FILTER (nh OR i = 0) OVER u AS h_at, max(mso) FILTER (nl OR i = 0) OVER u AS l_at
FROM (SELECT *, coalesce(lag(us) OVER w, false) AS us_, coalesce(lag(ds) OVER w, false) AS ds_,
  last_value(nullif(dh, 0) IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pdh,
  last_value(nullif(dl, 0) IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pdl
  FROM o_w2 WINDOW w AS (PARTITION BY instrument_id, session_date ORDER BY mso))
WINDOW u AS (PARTITION BY instrument_id, session_date ORDER BY mso ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    o_w4="""
SELECT *, CASE WHEN bull THEN 1 WHEN bear THEN -1 END AS side,
  CASE WHEN bull THEN hold_bull WHEN bear THEN hold_bear ELSE false END AS held,
  max(run_u) OVER u AS best_u, max(run_d) OVER u AS best_d,
  count(*) FILTER (sh) OVER gu AS ch, count(*) FILTER (sl) OVER gd AS cl,
  min(l) FILTER (dh = -1) OVER gu AS pbh, max(h) FILTER (dl = -1) OVER gd AS pbl
FROM o_w3
WINDOW u AS (PARTITION BY instrument_id, session_date ORDER BY mso ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  gu AS (PARTITION BY instrument_id, session_date, gh ORDER BY mso ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  gd AS (PARTITION BY instrument_id, session_date, gl ORDER BY mso ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    o_walk="""
SELECT *, held AND (CASE WHEN side = 1 THEN sh ELSE sl END) AS sig,
  CASE WHEN NOT held THEN 'INVALID' WHEN (CASE WHEN side = 1 THEN sh ELSE sl END) THEN 'ACTIVE'
       ELSE 'DEVELOPING' END AS state
FROM o_w4 WHERE n >= 4 AND i >= 2 AND mso <= 90""",
    o_sig0="""
SELECT instrument_id, session_date, mso AS signal_mso, side,
  CASE WHEN side = 1 THEN 'H' ELSE 'L' END AS kind, CASE WHEN side = 1 THEN ch ELSE cl END AS "count",
  CASE WHEN side = 1 THEN h + 1 ELSE l - 1 END AS entry_px,
  CASE WHEN side = 1 THEN least(l, pbh) - 1 ELSE greatest(h, pbl) + 1 END AS stop_px,
  CASE WHEN side = 1 THEN pbh ELSE pbl END AS pullback_px,
  CASE WHEN side = 1 THEN l0 ELSE h0 END AS leg_origin_px, CASE WHEN side = 1 THEN hr ELSE lr END AS leg_extreme_px,
  CASE WHEN side = 1 THEN h_at ELSE l_at END AS leg_extreme_mso,
  row_number() OVER (PARTITION BY instrument_id, session_date ORDER BY mso) <= 2 AS taken
FROM o_walk WHERE sig""",
    o_cands="""
SELECT s.instrument_id, s.session_date, s.signal_mso, v.name, v.px, abs(v.px - entry_px) AS dist
FROM o_sig0 s JOIN o_daily d USING (instrument_id, session_date),
LATERAL (SELECT unnest(['PDH', 'PDC', 'PDL', 'ONH', 'ONL', 'SESSION_EXTREME']) AS name,
  unnest([d.previous_day_high, d.previous_close, d.previous_day_low, d.overnight_high_adj,
          d.overnight_low_adj, s.leg_extreme_px]) AS px) v
WHERE (v.px - s.entry_px) * s.side > 0""",
    o_targets="""
SELECT instrument_id, session_date, signal_mso, name AS target_name, px AS target_px
FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, session_date, signal_mso ORDER BY dist, name) AS k
      FROM o_cands) WHERE k = 1""",
    o_signals="""
SELECT s.*, s.kind || s."count" AS label, target_name, target_px, abs(entry_px - stop_px) AS risk_points,
  round(abs(target_px - entry_px) / abs(entry_px - stop_px), 2) AS rr,
  CASE WHEN taken THEN '' ELSE 'max_entries reached' END AS note
FROM o_sig0 s LEFT JOIN o_targets USING (instrument_id, session_date, signal_mso)""",
    o_states="""
SELECT instrument_id, session_date, coalesce(w.state, 'INVALID') AS state,
  CASE WHEN coalesce(k, 0) = 2 THEN 'ACTIVE' WHEN k = 1 THEN 'DEVELOPING' ELSE 'INVALID' END AS reached,
  coalesce(nsig, 0) AS n_signals, leg_side, fb AS followthrough_bars, last_mso
FROM o_cashday LEFT JOIN (
  SELECT instrument_id, session_date, arg_max(state, mso) AS state, max(mso) AS last_mso,
    max(CASE state WHEN 'ACTIVE' THEN 2 WHEN 'DEVELOPING' THEN 1 ELSE 0 END) AS k,
    count(*) FILTER (sig) AS nsig, arg_max(side, mso) FILTER (side IS NOT NULL) AS leg_side,
    arg_max(CASE WHEN side = 1 THEN fth ELSE ftl END, mso) FILTER (side IS NOT NULL) AS fb
  FROM o_walk GROUP BY ALL) w USING (instrument_id, session_date)""",
    o_fwd="""
SELECT s.instrument_id, s.session_date, s.signal_mso, s.side, s.entry_px, s.stop_px, s.target_px, b.mso, b.c,
  CASE WHEN side = 1 THEN b.h >= entry_px ELSE b.l <= entry_px END AS hit,
  CASE WHEN side = 1 THEN b.l <= stop_px ELSE b.h >= stop_px END AS st,
  coalesce(CASE WHEN side = 1 THEN b.h >= target_px ELSE b.l <= target_px END, false) AS tg
FROM o_signals s JOIN o_cash b ON b.instrument_id = s.instrument_id AND b.session_date = s.session_date
     AND b.mso > s.signal_mso WHERE taken""",
    o_fill="""
SELECT instrument_id, session_date, signal_mso, min(mso) FILTER (hit) AS e,
  min(mso) FILTER (NOT hit AND st) AS d, max(mso) AS lastm, arg_max(c, mso) AS lastc
FROM o_fwd GROUP BY ALL""",
    o_exits="""
SELECT f.*, min(w.mso) FILTER (w.st AND w.mso >= e) AS s, min(w.mso) FILTER (w.tg AND w.mso > e) AS t
FROM o_fill f JOIN o_fwd w USING (instrument_id, session_date, signal_mso) GROUP BY ALL""",
    o_status="""
SELECT s.*, e, d, x.s, x.t, lastm, lastc,
  CASE WHEN NOT taken THEN 'NOT_TAKEN' WHEN d IS NOT NULL AND d < coalesce(e, 99999) THEN 'CANCELLED'
       WHEN e IS NULL THEN 'NOT_TRIGGERED' ELSE 'TRADED' END AS status
FROM o_signals s LEFT JOIN o_exits x USING (instrument_id, session_date, signal_mso)""",
    o_reasons="""
SELECT *, CASE WHEN status = 'TRADED' THEN
   CASE WHEN s <= coalesce(t, 99999) THEN 'stop' WHEN t IS NOT NULL THEN 'target' ELSE 'close' END END AS reason
FROM o_status""",
    o_trades="""
SELECT r.instrument_id, r.session_date, r.signal_mso, label, kind, "count", side, entry_px, stop_px, target_name,
  target_px, rr, taken, risk_points, pullback_px, leg_origin_px, leg_extreme_px, leg_extreme_mso, note, status,
  reason, CASE reason WHEN 'stop' THEN stop_px WHEN 'target' THEN target_px WHEN 'close' THEN lastc END AS exit_px,
  CASE reason WHEN 'stop' THEN s WHEN 'target' THEN t WHEN 'close' THEN lastm END AS exit_mso,
  side * (CASE reason WHEN 'stop' THEN stop_px WHEN 'target' THEN target_px WHEN 'close' THEN lastc END - entry_px) - 2 AS net_points,
  (side * (CASE reason WHEN 'stop' THEN stop_px WHEN 'target' THEN target_px WHEN 'close' THEN lastc END - entry_px) - 2)
    / risk_points AS r_multiple, o.reached
FROM o_reasons r JOIN o_states o USING (instrument_id, session_date)""",
)


def performance(source: str, by: str = "", order: str = "session_date") -> str:
    """Statement for the performance statistics of ``source(r_multiple, ...)``."""
    keys = "instrument_id" + (f", {by}" if by else "")
    return f"""
WITH e AS (SELECT *, sum(r_multiple) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS eq
           FROM ({source}) q),
d AS (SELECT *, max(eq) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING) - eq AS dd FROM e),
g AS (SELECT {keys}, count(*) AS n, avg(r_multiple) AS m, median(r_multiple) AS med,
  count(*) FILTER (r_multiple > 0) / count(*) AS hit, avg(r_multiple) FILTER (r_multiple > 0) AS aw,
  avg(r_multiple) FILTER (r_multiple <= 0) AS al, coalesce(sum(r_multiple) FILTER (r_multiple > 0), 0) AS gp,
  coalesce(-sum(r_multiple) FILTER (r_multiple <= 0), 0) AS gl, sum(r_multiple) AS tot, max(dd) AS mdd,
  stddev_samp(r_multiple) AS sd FROM d GROUP BY ALL)
SELECT {keys}, n, round(m, 4) AS expectancy_r, round(med, 4) AS median_r, round(100 * hit, 1) AS win_rate_pct,
  coalesce(round(aw, 3), 0) AS avg_win_r, coalesce(round(al, 3), 0) AS avg_loss_r,
  CASE WHEN gl > 0 THEN round(gp / gl, 3) END AS profit_factor, gl <= 0 AS no_losses,
  round(tot, 1) AS total_r, round(mdd, 1) AS max_drawdown_r, round(sd / sqrt(n), 4) AS se_r,
  CASE WHEN sd > 0 THEN round(m / (sd / sqrt(n)), 2) ELSE 0 END AS t_stat, n < 30 AS small_sample FROM g"""
