"""Roll adjustment: seam levels, factors, application, verification.

Contracts of one instrument are a short ordered list (a handful per year), so factors are a
reverse running product over the contract table, and bars only meet that table in an equality
join whose small side Spark picks from its measured size.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.operators.bars import OHLC, cash
from barloom.params import SessionParams

C = F.col
CONTRACT = ["instrument_id", "con_id"]


def contract_levels(bars: DataFrame, p: SessionParams = SessionParams()) -> DataFrame:
    """Per contract: median close at both ends of its life, first day, days to expiry.

    Input columns: instrument_id, con_id, contract_month, expiry (yyyymmdd), session_date,
    mso, is_cash, close. One pass: the bars of a contract, a quarter of sessions at most, see
    its first and last day in a window, and only those of these days take part in the medians.
    """
    life, day = Window.partitionBy(*CONTRACT), Window.partitionBy(*CONTRACT, "session_date")
    e = cash(bars).select(*CONTRACT, "contract_month", "expiry", "session_date", "mso",
                          "close").withColumns({
        "contract_month": F.min("contract_month").over(life),
        "expiry": F.min("expiry").over(life),
        "first_day": F.min("session_date").over(life),
        "last_day": F.max("session_date").over(life)})
    at_start, at_end = (C("session_date") == C(x) for x in ("first_day", "last_day"))
    e = e.where(at_start | at_end).withColumns({
        "lo": F.min("mso").over(day), "hi": F.max("mso").over(day)})
    lv = e.groupBy(*CONTRACT, "contract_month", "expiry", "first_day", "last_day").agg(
        F.median(F.when(at_start & (C("mso") <= C("lo") + p.seam_window_min), C("close")))
        .alias("start_level"),
        F.median(F.when(at_end & (C("mso") >= C("hi") - p.seam_window_min), C("close")))
        .alias("end_level"))
    days = F.datediff(F.to_date(C("expiry").cast("string"), "yyyyMMdd"), C("first_day"))
    return lv.withColumn("dte_at_start", F.greatest(days, F.lit(1)))


def _by_month() -> Window:
    return Window.partitionBy("instrument_id").orderBy("contract_month")


def roll_factors(levels: DataFrame, p: SessionParams = SessionParams()) -> DataFrame:
    """Factor and offset per contract, cumulated backwards from the newest contract."""
    method = p.roll_method if p.roll_enabled else "none"
    w = _by_month()
    d = levels.withColumns({"next_start": F.lead("start_level").over(w),
                            "next_dte": F.lead("dte_at_start").over(w)})
    steps: dict[str, Column] = {
        "carry": F.when(C("next_dte").isNotNull(), 1.0 + p.carry_rate * C("next_dte") / 365.0),
        "ratio": ratio(C("next_start"), C("end_level"))}
    later = w.rowsBetween(0, Window.unboundedFollowing)
    one, zero = F.lit(1.0), F.lit(0.0)
    factor = F.coalesce(F.product(steps[method]).over(later), one) if method in steps else one
    offset = (F.coalesce(F.sum(C("next_start") - C("end_level")).over(later), zero)
              if method == "difference" else zero)
    return d.withColumns({"factor": factor, "roll_offset": offset}).select(
        *CONTRACT, "contract_month", "start_level", "end_level", "dte_at_start", "factor",
        "roll_offset")


def seam_report(levels: DataFrame, p: SessionParams = SessionParams()) -> DataFrame:
    w = _by_month()
    d = levels.select("instrument_id", C("contract_month").alias("old"),
                      F.lead("contract_month").over(w).alias("new"), "end_level",
                      F.lead("start_level").over(w).alias("next_start"),
                      F.lead("dte_at_start").over(w).alias("dte")).where("new is not null")
    gap, end = C("next_start") - C("end_level"), C("end_level")
    carry = end * p.carry_rate * C("dte") / 365.0
    return d.select(
        "instrument_id", "old", "new", F.round(end, 2).alias("old_end_level"),
        F.round("next_start", 2).alias("new_start_level"), F.round(gap, 2).alias("seam_gap_pts"),
        F.round(ratio(100 * gap, end), 3).alias("seam_gap_pct"), F.round(carry, 2).alias("carry_pts"),
        F.round(ratio(100 * carry, end), 3).alias("carry_pct"),
        F.round(gap - carry, 2).alias("real_move_pts"))


def apply_rolls(master: DataFrame, factors: DataFrame,
                p: SessionParams = SessionParams()) -> DataFrame:
    """Adjusted prices. The plain feed takes the oldest contract's adjustment; an unknown
    contract stays as it is.

    The contracts of an instrument are one row of a short map, so bars meet it by instrument: one
    exchange of raw bars at most, none where they are dealt by instrument already.
    """
    by_instrument = factors.groupBy("instrument_id").agg(
        F.map_from_entries(F.collect_list(F.when(C("con_id").isNotNull(), F.struct(
            "con_id", F.struct("factor", C("roll_offset").alias("offset")))))).alias("known"),
        F.min_by(F.struct("factor", C("roll_offset").alias("offset")), "contract_month")
        .alias("oldest"))
    m = (master.drop(*[f"adj_{x}" for x in OHLC])
         .join(by_instrument, "instrument_id", "left")
         .withColumn("by", F.when(C("feed") == "feed_5m", C("oldest")).otherwise(
             F.when(C("con_id").isNotNull(), F.try_element_at("known", C("con_id"))))))
    factor, offset = F.coalesce("by.factor", F.lit(1.0)), F.coalesce("by.offset", F.lit(0.0))
    m = m.withColumns({f"adj_{x}": C(x) * factor + offset for x in OHLC})
    return m.withColumn("adj_factor", F.when(
        C("close") != 0, C("adj_close") / C("close")).otherwise(1.0)).drop(
        "known", "oldest", "by")


def verify_rolls(factors: DataFrame, p: SessionParams = SessionParams()) -> DataFrame:
    """Residual jump at each seam after adjustment, and whether the newest contract is raw."""
    method = p.roll_method if p.roll_enabled else "none"
    w = _by_month()
    d = factors.withColumns({"adj_end": C("end_level") * C("factor") + C("roll_offset"),
                             "adj_start": C("start_level") * C("factor") + C("roll_offset")})
    d = d.withColumn("residual", ratio(
        100 * (F.lead("adj_start").over(w) - C("adj_end")), C("adj_end")))
    newest_raw = (F.abs(F.max_by("factor", "contract_month") - 1.0) < 1e-12) & (
        F.abs(F.max_by("roll_offset", "contract_month")) < 1e-9)
    # What the residual means under each method.
    notes = {"carry": "only the modelled carry is removed; the rest is a real move",
             "ratio": "seams match in ratio; the real move is absorbed",
             "difference": "seams match in points; the real move is absorbed",
             "none": "raw stitch with the full roll steps"}
    return d.groupBy("instrument_id").agg(
        newest_raw.alias("newest_contract_anchored_raw"),
        F.coalesce(F.round(F.max(F.abs("residual")), 4), F.lit(0.0)).alias("seam_residual_pct_max"),
        F.coalesce(F.round(F.avg("residual"), 4), F.lit(0.0)).alias("seam_residual_pct_mean"),
        F.count("residual").alias("n_seams")).withColumns({
            "method": F.lit(method), "residual_is_real_move": F.lit(method == "carry"),
            "preserves_pct_returns": F.lit(method in ("ratio", "carry")),
            "note": F.lit(notes[method])})
