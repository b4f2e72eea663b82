"""Rolls, drives, filters and ranking."""
from barloom.params import BLOCKS
from oracles.build import define

FEATURES = [f for b in BLOCKS.values() for f in b]


def _scaled() -> str:
    return ", ".join(
        f"""(x.{f} - s.m_{f}) / coalesce(nullif(s.h_{f} - s.l_{f}, 0), nullif(s.d_{f}, 0), 1) AS {f}"""
        for f in FEATURES)


def _rms(fs) -> str:
    diffs = [f"pow(a.{f} - b.{f}, 2)" for f in fs]
    total = " + ".join(f"coalesce({d}, 0)" for d in diffs)
    known = " + ".join(f"(({d}) IS NOT NULL)::INT" for d in diffs)
    return f"sqrt(({total}) / nullif({known}, 0))"


define(
    o_feat="SELECT * FROM o_daily JOIN o_opening USING (instrument_id, session_date)",
    o_fmed="SELECT instrument_id, " + ", ".join(
        f"median(CAST({f} AS DOUBLE)) AS {f}" for f in FEATURES) + " FROM o_feat GROUP BY ALL",
    o_imputed="SELECT f.instrument_id, f.session_date, " + ", ".join(
        f"coalesce(CAST(f.{f} AS DOUBLE), {'120' if f.endswith('_min') else 'm.' + f}) AS {f}"
        for f in FEATURES) + " FROM o_feat f JOIN o_fmed m USING (instrument_id)",
    o_fstat="SELECT instrument_id, " + ", ".join(
        f"median({f}) AS m_{f}, quantile_cont({f}, 0.25) AS l_{f}, quantile_cont({f}, 0.75) AS h_{f}, "
        f"stddev_samp({f}) AS d_{f}" for f in FEATURES) + " FROM o_imputed GROUP BY ALL",
    o_scaled=f"SELECT x.instrument_id, x.session_date, {_scaled()} FROM o_imputed x "
             "JOIN o_fstat s USING (instrument_id)",
    o_blocks="SELECT a.instrument_id, a.session_date, " + ", ".join(
        f"{_rms(fs)} AS dist_{b}" for b, fs in BLOCKS.items()) + """
FROM o_scaled a JOIN o_refs r USING (instrument_id)
JOIN o_scaled b ON b.instrument_id = a.instrument_id AND b.session_date = r.reference_date
WHERE a.session_date <> r.reference_date""",
    o_cut40="""SELECT instrument_id, quantile_cont(first_bar_range_normalized, 0.4) AS cut
FROM o_feat GROUP BY ALL""",
    o_weak="""
SELECT *, least(first_meaningful_lower_high_min, first_bearish_expansion_min, first_stall_break_min,
  first_break_first15m_low_min, first_lower_swing_high_min, first_close_below_prev2_low_min) AS weak_at
FROM o_feat JOIN o_cut40 USING (instrument_id)""",
    o_wide="""
SELECT *, coalesce(abs(distance_open_to_ath_pct) <= 2, false) AS d2,
  coalesce(abs(distance_open_to_ath_pct) <= 0.5, false) AS d05, coalesce(abs(distance_open_to_ath_pct) <= 1, false) AS d1,
  coalesce(gap_pct > 0, false) AS gp, daily_volatility_regime IN ('low', 'normal') AS vr,
  coalesce(first_bar_is_bull AND first_bar_range_normalized >= cut AND post_spike_overlap_ratio > CAST(0.05 AS DOUBLE), false) AS fb,
  coalesce(weak_at <= 60, false) AS w60, coalesce(weak_at <= 105, false) AS w105 FROM o_weak""",
    o_quarter="""
SELECT *, con_id AS contract_month,
  CAST(strftime(last_day(CAST(date_trunc('quarter', session_date) AS DATE) + INTERVAL 2 MONTH), '%Y%m%d') AS INTEGER) AS expiry
FROM o_bars WHERE feed = 'contract_1m'""",
    o_life="""
SELECT instrument_id, con_id, min(contract_month) AS contract_month, min(expiry) AS expiry,
  min(session_date) AS first_day, max(session_date) AS last_day FROM o_quarter WHERE is_cash GROUP BY ALL""",
    o_firstlast="""
SELECT q.*, f.first_day, f.last_day, min(mso) OVER d AS lo, max(mso) OVER d AS hi
FROM o_quarter q JOIN o_life f USING (instrument_id, con_id) WHERE is_cash
WINDOW d AS (PARTITION BY q.instrument_id, q.con_id, session_date)""",
    o_levels="""
SELECT f.*, s.start_level, e.end_level,
  greatest(date_diff('day', first_day, strptime(CAST(expiry AS VARCHAR), '%Y%m%d')::DATE), 1) AS dte_at_start
FROM o_life f
JOIN (SELECT instrument_id, con_id, median(c) AS start_level FROM o_firstlast
      WHERE session_date = first_day AND mso <= lo + 30 GROUP BY ALL) s USING (instrument_id, con_id)
JOIN (SELECT instrument_id, con_id, median(c) AS end_level FROM o_firstlast
      WHERE session_date = last_day AND mso >= hi - 30 GROUP BY ALL) e USING (instrument_id, con_id)""",
    o_seams="""
SELECT *, lead(contract_month) OVER w AS nxt, lead(start_level) OVER w AS ns, lead(dte_at_start) OVER w AS nd
FROM o_levels WINDOW w AS (PARTITION BY instrument_id ORDER BY contract_month)""",
    o_factors="""
SELECT *, coalesce(product(1 + 0.025::DOUBLE * nd / 365) OVER w, 1) AS carry,
  coalesce(product(ns / end_level) OVER w, 1) AS ratio, coalesce(sum(ns - end_level) OVER w, 0) AS difference
FROM o_seams WINDOW w AS (PARTITION BY instrument_id ORDER BY contract_month
                          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    o_verify="""
SELECT instrument_id, method, count(res) AS n_seams, coalesce(round(max(abs(res)), 4), 0) AS seam_residual_pct_max,
  coalesce(round(avg(res), 4), 0) AS seam_residual_pct_mean,
  abs(arg_max(fac, contract_month) - 1) < 1e-12 AND abs(arg_max(off, contract_month)) < 1e-9 AS newest_contract_anchored_raw
FROM (SELECT *, 100 * (lead(start_level * fac + off) OVER w - (end_level * fac + off)) / (end_level * fac + off) AS res
      FROM (SELECT *, 'carry' AS method, carry AS fac, 0 AS off FROM o_factors
            UNION ALL SELECT *, 'ratio', ratio, 0 FROM o_factors
            UNION ALL SELECT *, 'difference', 1, difference FROM o_factors)
      WINDOW w AS (PARTITION BY instrument_id, method ORDER BY contract_month)) GROUP BY instrument_id, method""",
    o_drivebars="""
SELECT b.instrument_id, b.session_date, b.mso, b.o, b.h, b.l, b.c, x.opening AS label,
  CASE WHEN x.opening = 'DRIVE_UP' THEN 1 ELSE -1 END AS side
FROM o_cash b JOIN o_context x USING (instrument_id, session_date) WHERE x.opening IN ('DRIVE_UP', 'DRIVE_DOWN')""",
    o_driveobs="""
SELECT instrument_id, session_date, label, side, max(h) FILTER (mso < 30) AS oh, min(l) FILTER (mso < 30) AS ol,
  arg_max(h, mso) FILTER (mso < 30) AS lh, arg_max(l, mso) FILTER (mso < 30) AS ll,
  arg_min(o, mso) FILTER (mso >= 30) AS entry, max(mso) AS lastm, arg_max(c, mso) AS lastc
FROM o_drivebars GROUP BY ALL HAVING count(*) FILTER (mso < 30) >= 3 AND count(*) FILTER (mso >= 30) >= 2""",
    o_drivestops="""
SELECT *, 'opening_range' AS stop_mode, CASE WHEN side = 1 THEN ol ELSE oh END AS stop_init FROM o_driveobs
UNION ALL SELECT *, 'half_range', CASE WHEN side = 1 AND (oh + ol) / 2 < entry THEN (oh + ol) / 2
  WHEN side = -1 AND (oh + ol) / 2 > entry THEN (oh + ol) / 2 WHEN side = 1 THEN ol ELSE oh END FROM o_driveobs
UNION ALL SELECT *, 'last_bar', CASE WHEN side = 1 THEN ll ELSE lh END FROM o_driveobs""",
    o_entries="""
SELECT *, abs(entry - stop_init) AS risk FROM o_drivestops
WHERE abs(entry - stop_init) >= greatest(1, 0.1 * (oh - ol))""",
)


def drives(target_r: float, time_exit: int = 9999) -> str:
    """Fixed-exit simulation: first stop, target or time minute from the decision on."""
    return f"""
SELECT instrument_id, session_date, label, side, entry, stop_init, risk AS risk_points, exit_price, exit_mso,
  reason, side * (exit_price - entry) AS gross_points, side * (exit_price - entry) - 2 AS net_points,
  (side * (exit_price - entry) - 2) / risk AS r_multiple
FROM (SELECT *, CASE WHEN least(s, t, x) IS NULL THEN lastm ELSE least(s, t, x) END AS exit_mso,
        CASE WHEN least(s, t, x) IS NULL THEN lastc WHEN s = least(s, t, x) THEN stop_init
             WHEN t = least(s, t, x) THEN tgt ELSE xc END AS exit_price,
        CASE WHEN least(s, t, x) IS NULL THEN 'close' WHEN s = least(s, t, x) THEN 'stop'
             WHEN t = least(s, t, x) THEN 'target' ELSE 'time' END AS reason
      FROM (SELECT e.*, entry + e.side * {target_r}::DOUBLE * risk AS tgt,
              min(mso) FILTER (CASE WHEN e.side = 1 THEN l <= stop_init ELSE h >= stop_init END) AS s,
              min(mso) FILTER (CASE WHEN e.side = 1 THEN h >= entry + {target_r}::DOUBLE * risk
                               ELSE l <= entry - {target_r}::DOUBLE * risk END) AS t,
              min(mso) FILTER (mso >= {time_exit}) AS x, arg_min(c, mso) FILTER (mso >= {time_exit}) AS xc
            FROM o_entries e JOIN o_drivebars b USING (instrument_id, session_date)
            WHERE stop_mode = 'opening_range' AND mso >= 30 GROUP BY ALL))"""


MOVING = """
WITH RECURSIVE p AS (
  SELECT e.instrument_id, e.session_date, e.side, entry, stop_init, risk, lastm, lastc, mso, h, l, c,
    row_number() OVER w AS k, CASE WHEN row_number() OVER w >= 3 THEN (CASE WHEN e.side = 1 THEN
      min(l) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) ELSE max(h) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END) END AS tr
  FROM o_entries e JOIN o_drivebars b USING (instrument_id, session_date)
  WHERE stop_mode = 'opening_range' AND mso >= 30
  WINDOW w AS (PARTITION BY e.instrument_id, e.session_date ORDER BY mso)),
r AS (
  SELECT instrument_id, session_date, 0 AS k, stop_init AS st, false AS be, CAST(NULL AS VARCHAR) AS why,
    CAST(NULL AS DOUBLE) AS px, CAST(NULL AS BIGINT) AS xm FROM p WHERE k = 1
  UNION ALL
  SELECT instrument_id, session_date, k,
    CASE WHEN side = 1 THEN greatest(base, coalesce(tr, base)) ELSE least(base, coalesce(tr, base)) END, be OR tobe, why, px, xm
  FROM (SELECT p.instrument_id, p.session_date, p.k, p.side, r.be, p.tr,
    NOT r.be AND (CASE WHEN side = 1 THEN h - entry ELSE entry - l END) >= risk AS tobe,
    CASE WHEN NOT r.be AND (CASE WHEN side = 1 THEN h - entry ELSE entry - l END) >= risk THEN entry ELSE st END AS base,
    CASE WHEN (CASE WHEN side = 1 THEN l <= st ELSE h >= st END) THEN (CASE WHEN r.be THEN 'breakeven' ELSE 'stop' END)
         WHEN (CASE WHEN side = 1 THEN h >= entry + 3 * risk ELSE l <= entry - 3 * risk END) THEN 'target' END AS why,
    CASE WHEN (CASE WHEN side = 1 THEN l <= st ELSE h >= st END) THEN st
         WHEN (CASE WHEN side = 1 THEN h >= entry + 3 * risk ELSE l <= entry - 3 * risk END) THEN entry + side * 3 * risk END AS px,
    CAST(mso AS BIGINT) AS xm
    FROM r JOIN p ON p.instrument_id = r.instrument_id AND p.session_date = r.session_date AND p.k = r.k + 1
    WHERE r.why IS NULL) q),
x AS (SELECT instrument_id, session_date, arg_min(why, k) AS why, arg_min(px, k) AS px, arg_min(xm, k) AS xm
      FROM r WHERE why IS NOT NULL GROUP BY ALL)
SELECT instrument_id, session_date, side, entry, stop_init, risk AS risk_points, coalesce(px, lastc) AS exit_price,
  CAST(coalesce(xm, lastm) AS INTEGER) AS exit_mso, coalesce(why, 'close') AS reason,
  side * (coalesce(px, lastc) - entry) AS gross_points, side * (coalesce(px, lastc) - entry) - 2 AS net_points,
  (side * (coalesce(px, lastc) - entry) - 2) / risk AS r_multiple
FROM p LEFT JOIN x USING (instrument_id, session_date) WHERE k = 1"""


def ranked(pool: str, n: int) -> str:
    """Rank within a pool of (instrument_id, session_date)."""
    return f"""
SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY similarity_score DESC, session_date) AS rank
FROM (SELECT *, 100.0 / (1.0 + distance) AS similarity_score FROM (
  SELECT *, 0.3::DOUBLE * dist_context + 0.2::DOUBLE * dist_first_bar + 0.3::DOUBLE * dps + 0.2::DOUBLE * dist_weakness AS distance
  FROM (SELECT *, coalesce(0.6::DOUBLE * dist_post_spike + 0.4::DOUBLE * (pd / coalesce(nullif(median(pd) OVER i, 0), 1)),
          dist_post_spike) AS dps
    FROM (SELECT *, coalesce((1 - correlation) / 2, median((1 - correlation) / 2) OVER i) AS pd
          FROM (SELECT * FROM o_blocks SEMI JOIN ({pool}) USING (instrument_id, session_date))
          LEFT JOIN o_pathscores USING (instrument_id, session_date)
          WINDOW i AS (PARTITION BY instrument_id))
    WINDOW i AS (PARTITION BY instrument_id))))
QUALIFY rank <= {n}"""
