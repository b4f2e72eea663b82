"""Opening features, outcomes and paths."""
from oracles.build import define

define(
    o_obs="""
SELECT b.instrument_id, b.session_date, b.mso, b.o, b.h, b.l, b.c, d.cash_open AS op, d.atr,
       d.previous_day_high AS pdh, d.previous_day_low AS pdl, d.previous_close AS pdc,
       d.overnight_high_adj AS onh, d.overnight_low_adj AS onl, d.prior_ath, d.previous_day_range AS pr
FROM o_cash b JOIN o_daily d USING (instrument_id, session_date) WHERE b.mso <= 90""",
    o_obs1="""
SELECT *, row_number() OVER w AS rn, count(*) OVER p AS n, lag(h) OVER w AS h_, lag(l) OVER w AS l_,
       lag(c) OVER w AS c_, lag(l, 2) OVER w AS l__, first(h) OVER w AS h1, first(l) OVER w AS l1,
       max(h) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rmax,
       min(l) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rmin,
       max(h) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hprev,
       min(l) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l3,
       max(h) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sw_h,
       min(l) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sw_l,
       min(l) FILTER (mso < 15) OVER p AS lo15, min(l) FILTER (mso < 30) OVER p AS lo30
FROM o_obs WINDOW w AS (PARTITION BY instrument_id, session_date ORDER BY mso),
                  p AS (PARTITION BY instrument_id, session_date)""",
    o_medrange="""
SELECT instrument_id, session_date, median(h - l) AS med FROM o_obs1 WHERE rn <= 10 GROUP BY ALL""",
    o_obs2="""
SELECT *, abs(c - coalesce(c_, op)) AS step,
       CASE WHEN rn > 1 THEN greatest(0, least(h, h_) - greatest(l, l_))
            / nullif(greatest(h - l, h_ - l_), 0) END AS ov,
       h = sw_h AND n > 1 AS is_sh, l = sw_l AND n > 1 AS is_sl,
       (h - l) > 1.5 * med AS ex, 0.15 * nullif(atr, 0) AS sig
FROM o_obs1 JOIN o_medrange USING (instrument_id, session_date)""",
    o_swinghi="""
SELECT instrument_id, session_date, mso, h, sig,
       lag(h) OVER (PARTITION BY instrument_id, session_date ORDER BY mso) AS ph FROM o_obs2 WHERE is_sh""",
    o_swinglo="""
SELECT instrument_id, session_date, mso, l, sig,
       lag(l) OVER (PARTITION BY instrument_id, session_date ORDER BY mso) AS pl FROM o_obs2 WHERE is_sl""",
    o_swings="""
SELECT instrument_id, session_date,
       min(mso) FILTER (k = 'h' AND x < px) AS lsh, min(mso) FILTER (k = 'h' AND px - x >= sig AND x < px) AS mlh,
       min(mso) FILTER (k = 'l' AND x < px) AS lsl, min(mso) FILTER (k = 'l' AND x > px AND x - px >= sig) AS mhl
FROM (SELECT instrument_id, session_date, mso, h AS x, ph AS px, sig, 'h' AS k FROM o_swinghi
      UNION ALL SELECT instrument_id, session_date, mso, l, pl, sig, 'l' FROM o_swinglo) GROUP BY ALL""",
    o_bear="""
SELECT instrument_id, session_date, min(mso) AS t, arg_min(h, mso) AS hh
FROM o_obs2 WHERE ex AND c < o GROUP BY ALL""",
    o_failed="""
SELECT e.instrument_id, e.session_date, coalesce(bool_and(b.c < e.hh), true) AS failed
FROM o_bear e LEFT JOIN o_obs2 b ON b.instrument_id = e.instrument_id
     AND b.session_date = e.session_date AND b.mso > e.t GROUP BY ALL""",
    o_fold="""
SELECT instrument_id, session_date, op, atr, pdh, pdl, pdc, onh, onl, prior_ath, pr,
       count(*) AS n, arg_max(c, mso) AS c, max(h) AS hi, min(l) AS lo, sum(step) AS path, avg(ov) AS ov,
       count(*) FILTER (c > o) AS bull, count(*) FILTER (c < o) AS bear,
       count(*) FILTER (h > h_) AS hh, count(*) FILTER (h < h_) AS lh,
       count(*) FILTER (l > l_) AS hl, count(*) FILTER (l < l_) AS ll,
       max(rmax - l) AS pull, max(h - rmin) AS bounce,
       count(*) FILTER (c > op) / count(*) AS above, count(*) FILTER (c < op) / count(*) AS below,
       arg_min(o, mso) AS o0, arg_min(h, mso) AS h0, arg_min(l, mso) AS l0, arg_min(c, mso) AS c0,
       max(h) FILTER (rn > 1) AS ph, min(l) FILTER (rn > 1) AS pl, avg(ov) FILTER (rn > 2) AS pov,
       sum(abs(c - c_)) FILTER (rn > 1) AS ppath,
       count(*) FILTER (rn > 1 AND h > hprev) AS nh,
       max(mso) FILTER (rn > 1 AND h > hprev) - min(mso) FILTER (rn > 1 AND h > hprev) AS nhspan,
       min(mso) FILTER (rn > 1 AND h > hprev AND h - h1 >= coalesce(sig, 0)) AS fm,
       min(mso) FILTER (rn > 2 AND c < least(l_, l__)) AS cb2,
       min(mso) FILTER (ex AND c < o) AS be, min(mso) FILTER (ex AND c > o) AS bu,
       min(mso) FILTER (mso >= 15 AND l < lo15) AS b15, min(mso) FILTER (mso >= 30 AND l < lo30) AS b30,
       min(mso) FILTER (rn > 3 AND c < l3) AS stall,
       min(mso) FILTER (rn > 1 AND h > h1) AS up_at, min(mso) FILTER (rn > 1 AND l < l1) AS dn_at,
       arg_max(c, mso) FILTER (mso < 5) AS c5, max(h) FILTER (mso < 5) AS hi5, min(l) FILTER (mso < 5) AS lo5,
       sum(step) FILTER (mso < 5) AS path5, avg(ov) FILTER (mso < 5) AS ov5,
       count(*) FILTER (mso < 5) AS n5, count(*) FILTER (mso < 5 AND c > o) AS bull5,
       arg_max(c, mso) FILTER (mso < 15) AS c15, max(h) FILTER (mso < 15) AS hi15, min(l) FILTER (mso < 15) AS lo15,
       sum(step) FILTER (mso < 15) AS path15, avg(ov) FILTER (mso < 15) AS ov15,
       count(*) FILTER (mso < 15) AS n15, count(*) FILTER (mso < 15 AND c > o) AS bull15,
       arg_max(c, mso) FILTER (mso < 30) AS c30, max(h) FILTER (mso < 30) AS hi30, min(l) FILTER (mso < 30) AS lo30,
       sum(step) FILTER (mso < 30) AS path30, avg(ov) FILTER (mso < 30) AS ov30,
       count(*) FILTER (mso < 30) AS n30, count(*) FILTER (mso < 30 AND c > o) AS bull30,
       arg_max(c, mso) FILTER (mso < 60) AS c60, max(h) FILTER (mso < 60) AS hi60, min(l) FILTER (mso < 60) AS lo60,
       sum(step) FILTER (mso < 60) AS path60, avg(ov) FILTER (mso < 60) AS ov60,
       count(*) FILTER (mso < 60) AS n60, count(*) FILTER (mso < 60 AND c > o) AS bull60
FROM o_obs2 GROUP BY ALL""",
    o_opening="""
SELECT instrument_id, session_date, 90 AS cutoff_min, n AS n_window_bars,
  100.0 * (c - op) / op AS net_return_pct, c - op AS net_points, hi - lo AS high_low_range,
  (hi - lo) / nullif(pr, 0) AS range_normalized_by_prior_daily_range,
  (hi - lo) / nullif(atr, 0) AS "range_normalized_by_ATR", bull AS number_of_bull_bars,
  bear AS number_of_bear_bars, 100.0 * bull / n AS percentage_bull_bars,
  hh AS number_of_higher_highs, lh AS number_of_lower_highs, hl AS number_of_higher_lows,
  ll AS number_of_lower_lows, (c - lo) / nullif(hi - lo, 0) AS close_location_in_window_range,
  pull AS maximum_pullback, pull / nullif(hi - op, 0) AS maximum_pullback_as_fraction_of_up_move,
  bounce / nullif(op - lo, 0) AS maximum_bounce_as_fraction_of_down_move,
  abs(c - op) / nullif(path, 0) AS directional_efficiency, ov AS bar_overlap_ratio,
  above AS time_above_cash_open, below AS time_below_cash_open, c - op AS distance_from_cash_open,
  c - pdh AS "distance_from_PDH", c - pdl AS "distance_from_PDL",
  c - pdc AS distance_from_previous_close, c - onh AS distance_from_overnight_high,
  c - onl AS distance_from_overnight_low,
  100.0 * (c0 - o0) / o0 AS first_bar_return, h0 - l0 AS first_bar_range,
  (h0 - l0) / nullif(atr, 0) AS first_bar_range_normalized,
  (h0 - l0) / nullif(pr, 0) AS first_bar_range_norm_prevrange, c0 - o0 AS first_bar_body,
  abs(c0 - o0) / nullif(h0 - l0, 0) AS first_bar_body_to_range,
  h0 - greatest(o0, c0) AS first_bar_upper_wick, least(o0, c0) - l0 AS first_bar_lower_wick,
  (c0 - l0) / nullif(h0 - l0, 0) AS first_bar_close_location,
  coalesce(h0 > pdh, false) AS "first_bar_breaks_PDH",
  coalesce(h0 > onh, false) AS first_bar_breaks_overnight_high,
  coalesce(h0 > prior_ath, false) AS "first_bar_breaks_prior_ATH", c0 > o0 AS first_bar_is_bull,
  ph - h0 AS additional_extension_after_first_bar, (ph - h0) / nullif(h0 - l0, 0) AS extension_ratio,
  h0 - pl AS post_spike_pullback, (h0 - pl) / nullif(h0 - l0, 0) AS post_spike_pullback_ratio,
  pov AS post_spike_overlap_ratio, abs(c - c0) / nullif(ppath, 0) AS post_spike_efficiency,
  nh AS number_of_new_highs_after_first_bar,
  CASE WHEN nh > 1 THEN nhspan / (nh - 1) END AS average_distance_between_new_highs,
  fm AS minutes_until_next_meaningful_new_high,
  CASE WHEN n > 1 THEN (c - c0) / nullif(h0 - l0, 0) END AS close_progress_ratio,
  cb2 AS first_close_below_prev2_low_min, lsh AS first_lower_swing_high_min,
  lsl AS first_lower_swing_low_min, be AS first_bearish_expansion_min,
  bu AS first_bullish_expansion_min, b15 AS first_break_first15m_low_min,
  b30 AS first_break_first30m_low_min, stall AS first_stall_break_min,
  mlh AS first_meaningful_lower_high_min, mhl AS first_meaningful_higher_low_min,
  coalesce(failed, false) AS failed_to_reclaim_bear_expansion_high, below AS time_below_open_frac,
  CASE WHEN up_at IS NULL AND dn_at IS NULL THEN 0
       WHEN up_at <= coalesce(dn_at, 9999) THEN 1 ELSE -1 END AS opening_range_break_direction,
  least(up_at, dn_at) AS first_opening_range_break_min,
""" + ",\n".join(f"""  100.0 * (c{w} - op) / op AS w{w}_net_return_pct, hi{w} - lo{w} AS w{w}_high_low_range,
  abs(c{w} - op) / nullif(path{w}, 0) AS w{w}_directional_efficiency, ov{w} AS w{w}_bar_overlap_ratio,
  100.0 * bull{w} / nullif(n{w}, 0) AS w{w}_percentage_bull_bars,
  (c{w} - lo{w}) / nullif(hi{w} - lo{w}, 0) AS w{w}_close_location_in_window_range"""
                 for w in (5, 15, 30, 60)) + """
FROM o_fold LEFT JOIN o_swings USING (instrument_id, session_date)
     LEFT JOIN o_failed USING (instrument_id, session_date)""",
    o_after="""
SELECT instrument_id, session_date, arg_max(c, mso) FILTER (mso <= 90) AS px,
       arg_max(c, mso) AS close_px, max(h) FILTER (mso <= 90) AS ohi, min(l) FILTER (mso <= 90) AS olo,
       max(h) FILTER (mso > 90) AS ahi, min(l) FILTER (mso > 90) AS alo,
       arg_max(c, mso) FILTER (mso <= 105) AS p15, arg_max(c, mso) FILTER (mso <= 120) AS p30,
       arg_max(c, mso) FILTER (mso <= 150) AS p60, arg_max(c, mso) FILTER (mso <= 180) AS pmid,
       arg_max(c, mso) FILTER (mso <= 390) AS pus, arg_max(c, mso) FILTER (mso <= 510) AS pcl
FROM o_cash GROUP BY ALL""",
    o_extremes="""
SELECT instrument_id, session_date,
       min(mso) FILTER (h = mh) AS hi_at, min(mso) FILTER (l = ml) AS lo_at
FROM (SELECT *, max(h) OVER p AS mh, min(l) OVER p AS ml FROM o_cash
      WINDOW p AS (PARTITION BY instrument_id, session_date)) GROUP BY ALL""",
    o_outcomes0="""
SELECT a.*, hi_at, lo_at, d.cash_open AS op, d.previous_day_high AS pdh, d.previous_day_low AS pdl,
       d.previous_close AS pdc, d.overnight_high_adj AS onh, d.overnight_low_adj AS onl, d.prior_ath
FROM o_after a JOIN o_extremes USING (instrument_id, session_date)
     JOIN o_daily d USING (instrument_id, session_date)""",
    o_outcomes="""
SELECT instrument_id, session_date, 90 AS cutoff_min, px AS cutoff_price,
  100.0 * (p15 - px) / px AS return_after_15m_pct, 100.0 * (p30 - px) / px AS return_after_30m_pct,
  100.0 * (p60 - px) / px AS return_after_60m_pct, 100.0 * (pmid - px) / px AS return_at_1200_pct,
  100.0 * (pus - px) / px AS return_at_us_open_pct, 100.0 * (pcl - px) / px AS return_at_cash_close_pct,
  100.0 * (ahi - px) / px AS max_favorable_excursion_pct, 100.0 * (alo - px) / px AS max_adverse_excursion_pct,
  CASE WHEN px IS NOT NULL THEN CAST(hi_at AS DOUBLE) END AS session_high_min,
  CASE WHEN px IS NOT NULL THEN CAST(lo_at AS DOUBLE) END AS session_low_min,
  100.0 * (close_px - px) / px AS session_close_pct_vs_cutoff,
  CASE WHEN px IS NOT NULL THEN coalesce(ahi >= ohi, false) END AS break_observed_high,
  CASE WHEN px IS NOT NULL THEN coalesce(alo <= olo, false) END AS break_observed_low,
  CASE WHEN px IS NOT NULL THEN coalesce(op BETWEEN alo AND ahi, false) END AS retest_cash_open,
  CASE WHEN px IS NOT NULL THEN coalesce(ahi >= onh, false) END AS touch_overnight_high,
  CASE WHEN px IS NOT NULL THEN coalesce(alo <= onl, false) END AS touch_overnight_low,
  CASE WHEN px IS NOT NULL THEN coalesce(ahi >= pdh, false) END AS touch_pdh,
  CASE WHEN px IS NOT NULL THEN coalesce(alo <= pdl, false) END AS touch_pdl,
  CASE WHEN px IS NOT NULL THEN coalesce(pdc BETWEEN alo AND ahi, false) END AS touch_previous_close,
  CASE WHEN px IS NOT NULL THEN coalesce(CASE WHEN op > pdc THEN alo <= pdc WHEN op <= pdc THEN ahi >= pdc END, false) END AS full_gap_fill,
  CASE WHEN px IS NOT NULL THEN coalesce(CASE WHEN op > pdc THEN alo <= (op + pdc) / 2 WHEN op <= pdc THEN ahi >= (op + pdc) / 2 END, false) END AS half_gap_fill,
  CASE WHEN px IS NOT NULL THEN close_px > op END AS close_above_cash_open,
  CASE WHEN px IS NOT NULL THEN close_px < op END AS close_below_cash_open,
  CASE WHEN px IS NOT NULL THEN close_px > prior_ath END AS close_above_prior_ath,
  CASE WHEN px IS NOT NULL THEN close_px < prior_ath END AS close_below_prior_ath
FROM o_outcomes0""",
    o_merged="""
SELECT d.*, p.* EXCLUDE (instrument_id, session_date), x.* EXCLUDE (instrument_id, session_date, cutoff_min),
       d.cash_close - d.cash_open AS day_net_points
FROM o_daily d JOIN o_opening p USING (instrument_id, session_date)
     JOIN o_outcomes x USING (instrument_id, session_date)""",
    o_flags="""
SELECT *, abs(day_net_points / atr) AS net,
  coalesce(first_bar_range / atr >= 0.5, false) AS spike,
  coalesce(extension_ratio < 0.5 AND post_spike_overlap_ratio > 0.5, false) AS weak,
  least(first_meaningful_lower_high_min, first_bearish_expansion_min, first_stall_break_min) AS wk_at,
  coalesce(-max_adverse_excursion_pct > 0.8, false) AS deep,
  coalesce(close_above_cash_open, day_net_points > 0) AS up_close, coalesce(gap_pct > 0, false) AS gap_up,
  coalesce(full_gap_fill, false) AS ff, coalesce(half_gap_fill, false) AS hf,
  ath_at_open OR ath_reached_overnight OR "near_ath_0.5pct" AS at_high,
  0.8 * (100 * atr / cash_open) AS reach
FROM o_merged""",
    o_classno="""
SELECT *, CASE
  WHEN ff AND NOT up_close AND gap_up THEN 4
  WHEN gap_up AND net IS NOT NULL AND NOT up_close AND deep THEN 5
  WHEN at_high AND spike AND first_bar_is_bull AND up_close AND NOT weak AND net >= 0.75 THEN 0
  WHEN spike AND first_bar_is_bull AND wk_at <= 90 AND (NOT up_close OR deep) THEN 2
  WHEN spike AND first_bar_is_bull AND weak AND up_close THEN 1
  WHEN gap_up AND hf AND NOT ff THEN 3
  WHEN max_favorable_excursion_pct >= reach AND -max_adverse_excursion_pct >= reach THEN 7
  WHEN net < 0.4 THEN 6 END AS k
FROM o_flags""",
    o_classes="""
SELECT instrument_id, session_date,
  ['ATH gap-and-go continuation', 'opening spike then bull flag', 'opening spike failure',
   'partial gap fade', 'full gap fill', 'complete reversal', 'high-level range day',
   'two-sided volatile day'][coalesce(k, 6) + 1] AS day_classification,
  CASE k WHEN 4 THEN printf('gap %+.2f%% filled, close below the open', gap_pct)
    WHEN 5 THEN printf('gap %+.2f%% reversed, adverse excursion %.2f%%', gap_pct, max_adverse_excursion_pct)
    WHEN 0 THEN 'at the highs, large bullish first bar, held into the close'
    WHEN 2 THEN 'bullish spike, weakness at minute ' || wk_at
    WHEN 1 THEN 'bullish spike, overlapping follow-through, close above the open'
    WHEN 3 THEN printf('gap %+.2f%% half filled', gap_pct)
    WHEN 7 THEN 'large excursions both ways' WHEN 6 THEN 'small net change'
    ELSE CASE WHEN day_net_points > 0 THEN 'contained up day' ELSE 'contained down day' END
  END AS day_classification_reason
FROM o_classno""",
    o_pts="""
SELECT s.instrument_id, s.session_date, g.g AS grid_min, arg_max((s.c - s.op) / s.atr, s.mso) FILTER (s.mso <= g.g) AS v
FROM o_obs s CROSS JOIN (SELECT unnest(range(0, 91, 5)) AS g) g GROUP BY ALL""",
    o_refs="SELECT instrument_id, max(session_date) AS reference_date FROM o_daily GROUP BY ALL",
    o_pathpairs="""
SELECT a.instrument_id, a.session_date, a.grid_min, a.v AS a, b.v AS b
FROM o_pts a JOIN o_refs r USING (instrument_id)
JOIN o_pts b ON b.instrument_id = a.instrument_id AND b.session_date = r.reference_date AND b.grid_min = a.grid_min
WHERE a.session_date <> r.reference_date""",
    o_pathscores="""
SELECT instrument_id, session_date, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n,
  CASE WHEN count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) >= 3
        AND stddev_pop(a) FILTER (b IS NOT NULL) > 0 AND stddev_pop(b) FILTER (a IS NOT NULL) > 0
       THEN corr(a, b) END AS correlation,
  sqrt(avg((a - b) * (a - b))) AS euclidean,
  sum(a * b) / nullif(sqrt(sum(a * a) FILTER (b IS NOT NULL)) * sqrt(sum(b * b) FILTER (a IS NOT NULL)), 0) AS cosine
FROM o_pathpairs GROUP BY ALL""",
)
