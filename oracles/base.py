"""Bars, sessions and daily features."""
from oracles.build import define

define(
    o_ticks="""
SELECT l_suppkey // 25 AS instrument_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS session_date,
       (l_orderkey * 7 + l_partkey * 13 + l_linenumber * 5) % 24 AS slot,
       (CAST(date_trunc('week', l_shipdate) AS DATE) - DATE '1995-01-02') // 7 AS wk,
       l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity
FROM lineitem""",
    o_slots="""
SELECT *, CASE WHEN slot < 12 THEN slot * 5 WHEN slot < 22 THEN 60 + (slot - 12) * 45
               WHEN slot = 22 THEN -10 ELSE 520 END AS mso
FROM o_ticks""",
    o_priced="""
SELECT instrument_id, session_date, CAST(mso AS INTEGER) AS mso, l_quantity AS q,
       CAST(10000 + 6 * wk + 30 * abs(wk % 80 - 40) AS DOUBLE)
         + ((wk * 7 + instrument_id * 3) % 5 - 2) * least(mso, 60) * CAST(1 AS DOUBLE)
         + l_extendedprice / CAST(997.0 AS DOUBLE) AS px,
       row_number() OVER (PARTITION BY instrument_id, session_date, mso
         ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS rn
FROM o_slots""",
    o_bars="""
SELECT instrument_id, session_date, mso, mso + 540 AS tod_min,
       mso >= 0 AND mso < 510 AS is_cash,
       CAST(session_date AS TIMESTAMP) + to_minutes(mso + 540) AS local_dt,
       arg_min(px, rn) AS o, max(px) AS h, min(px) AS l, arg_max(px, rn) AS c,
       sum(q) AS volume, count(*) AS n_ticks,
       year(session_date) * 100 + quarter(session_date) AS con_id,
       CASE WHEN session_date < DATE '1998-01-05' THEN 'feed_5m' ELSE 'contract_1m' END AS feed
FROM o_priced GROUP BY instrument_id, session_date, mso""",
    o_cash="SELECT * FROM o_bars WHERE is_cash",
    o_cashday="""
SELECT instrument_id, session_date, arg_min(o, mso) AS cash_open, max(h) AS cash_high,
       min(l) AS cash_low, arg_max(c, mso) AS cash_close, count(*) AS n_cash_bars,
       max(h) FILTER (mso < 5) AS hi5, max(h) FILTER (mso < 15) AS hi15,
       max(h) FILTER (mso < 30) AS hi30
FROM o_cash GROUP BY ALL""",
    o_anyday="""
SELECT instrument_id, session_date, max(h) AS day_high, min(l) AS day_low,
       arg_min(feed, tod_min) AS feed, count(*) AS n_bars
FROM o_bars GROUP BY instrument_id, session_date""",
    o_opens="""
SELECT DISTINCT instrument_id, session_date AS overnight_of,
       CAST(session_date AS TIMESTAMP) + INTERVAL 9 HOUR AS open_ts FROM o_bars""",
    o_nightbars="""
SELECT b.*, s.overnight_of FROM (SELECT * FROM o_bars WHERE NOT is_cash) b
ASOF JOIN o_opens s ON b.instrument_id = s.instrument_id AND b.local_dt <= s.open_ts""",
    o_night="""
SELECT instrument_id, overnight_of AS session_date, arg_min(o, local_dt) AS on_open,
       max(h) AS on_high, min(l) AS on_low, arg_max(c, local_dt) AS on_close,
       count(*) AS n_overnight_bars
FROM o_nightbars GROUP BY ALL""",
    o_ohlc="""
SELECT c.*, a.day_high, a.day_low, a.feed, a.n_bars, n.on_open, n.on_high, n.on_low, n.on_close,
       n.n_overnight_bars,
       lag(c.session_date) OVER (PARTITION BY c.instrument_id ORDER BY c.session_date) AS prev_session_date,
       dayname(c.session_date) AS weekday
FROM o_cashday c LEFT JOIN o_anyday a USING (instrument_id, session_date)
LEFT JOIN o_night n USING (instrument_id, session_date)""",
    o_typical="""
SELECT instrument_id, median(coalesce(n_cash_bars, 0)) AS typical
FROM o_anyday LEFT JOIN o_cashday USING (instrument_id, session_date) GROUP BY ALL""",
    o_lags="""
SELECT *, max(day_high) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_ath,
       max(day_high) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ath_incl,
       lag(cash_open) OVER w AS po, lag(cash_high) OVER w AS pdh, lag(cash_low) OVER w AS pdl,
       lag(cash_close) OVER w AS pdc, lag(cash_close, 2) OVER w AS pdc2
FROM o_ohlc WINDOW w AS (PARTITION BY instrument_id ORDER BY session_date)""",
    o_tr="""
SELECT *, greatest(cash_high - cash_low, abs(cash_high - pdc), abs(cash_low - pdc)) AS tr,
       cash_close / pdc - 1.0 AS ret FROM o_lags""",
    o_roll1="""
SELECT *, CASE WHEN count(tr) OVER a >= 7 THEN avg(tr) OVER a END AS atr,
       CASE WHEN count(*) OVER v >= 5 THEN avg(cash_high - cash_low) OVER v END AS rolling_range,
       CASE WHEN count(ret) OVER v >= 5 THEN stddev_samp(ret) OVER v END AS rv
FROM o_tr
WINDOW a AS (PARTITION BY instrument_id ORDER BY session_date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING),
       v AS (PARTITION BY instrument_id ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    o_roll2="""
SELECT *, CASE WHEN count(rv) OVER r >= 20 THEN quantile_cont(rv, 0.33) OVER r END AS rv_lo,
       CASE WHEN count(rv) OVER r >= 20 THEN quantile_cont(rv, 0.66) OVER r END AS rv_hi
FROM o_roll1
WINDOW r AS (PARTITION BY instrument_id ORDER BY session_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""",
    o_daily="""
SELECT d.instrument_id, d.session_date, d.weekday, d.feed, d.prev_session_date, d.n_cash_bars,
       d.n_overnight_bars, d.n_bars, d.day_high AS day_high_adj, d.day_low AS day_low_adj,
       cash_open, cash_high, cash_low, cash_close,
       cash_open AS cash_open_raw, cash_high AS cash_high_raw, cash_low AS cash_low_raw,
       cash_close AS cash_close_raw, cash_open AS cash_open_adj, cash_high AS cash_high_adj,
       cash_low AS cash_low_adj, cash_close AS cash_close_adj,
       pdc AS previous_close, po AS previous_open, pdh AS previous_day_high,
       pdl AS previous_day_low, pdc AS previous_day_close, pdh - pdl AS previous_day_range,
       pdc / pdc2 - 1.0 AS previous_day_return, prior_ath, ath_incl AS all_time_high_incl,
       100.0 * (cash_open - prior_ath) / prior_ath AS distance_open_to_ath_pct,
       100.0 * (on_high - prior_ath) / prior_ath AS distance_overnight_high_to_ath_pct,
       coalesce(cash_open > prior_ath, false) AS ath_at_open,
       coalesce(on_high >= prior_ath, false) AS ath_reached_overnight,
       coalesce(abs(100.0 * (cash_open - prior_ath) / prior_ath) <= 0.1, false) AS "near_ath_0.1pct",
       coalesce(abs(100.0 * (cash_open - prior_ath) / prior_ath) <= 0.25, false) AS "near_ath_0.25pct",
       coalesce(abs(100.0 * (cash_open - prior_ath) / prior_ath) <= 0.5, false) AS "near_ath_0.5pct",
       coalesce(abs(100.0 * (cash_open - prior_ath) / prior_ath) <= 1.0, false) AS near_ath_1pct,
       coalesce(hi5 > prior_ath, false) AS ath_broken_first_5m,
       coalesce(hi15 > prior_ath, false) AS ath_broken_first_15m,
       coalesce(hi30 > prior_ath, false) AS ath_broken_first_30m,
       cash_open - pdc AS gap_points, 100.0 * (cash_open - pdc) / pdc AS gap_pct,
       (cash_open - pdc) / atr AS gap_atr,
       coalesce(cash_open > pdh, false) AS open_above_pdh,
       coalesce(cash_open < pdl, false) AS open_below_pdl,
       coalesce(cash_open BETWEEN pdl AND pdh, false) AS open_inside_previous_range,
       100.0 * (cash_open - pdh) / pdh AS open_vs_pdh_pct,
       100.0 * (cash_open - pdl) / pdl AS open_vs_pdl_pct,
       on_open AS overnight_open_adj, on_high AS overnight_high_adj, on_low AS overnight_low_adj,
       on_close AS overnight_close_adj, 100.0 * (on_close - on_open) / on_open AS overnight_return_pct,
       on_high - on_low AS overnight_range,
       (on_high - on_low) / nullif(atr, 0) AS overnight_range_normalized,
       (cash_open - on_low) / nullif(on_high - on_low, 0) AS open_location_in_overnight_range,
       atr, rolling_range AS rolling_daily_range, rv AS realised_vol,
       CASE WHEN rv IS NULL OR rv_lo IS NULL THEN 'unknown' WHEN rv <= rv_lo THEN 'low'
            WHEN rv >= rv_hi THEN 'high' ELSE 'normal' END AS daily_volatility_regime,
       concat_ws(';', CASE WHEN d.n_cash_bars < 0.6 * greatest(typical, 51.5) THEN 'shortened_session' END,
                 CASE WHEN prior_ath IS NULL THEN 'no_prior_ath' END,
                 CASE WHEN on_high IS NULL OR coalesce(n_overnight_bars, 0) = 0 THEN 'no_overnight_bars' END,
                 CASE WHEN d.feed = 'contract_1m' THEN 'contract_source' END) AS data_quality_flags
FROM o_roll2 d JOIN o_typical t USING (instrument_id)""",
)
