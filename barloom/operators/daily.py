"""Per-session features. Everything known before the open uses prior sessions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import (SESSION, before, in_calendar, lag_session, pct, prior,
                                       ratio, upto, yes)
from barloom.params import SessionParams

C = F.col


def high_water(d: DataFrame, p: SessionParams = SessionParams()) -> DataFrame:
    """Highest high of all earlier sessions, position of the open against it, early breaks.

    The break test needs only the highest high of the first n minutes, which the session
    aggregate already carries, so the bars are not joined again.
    """
    d = d.withColumns({
        "prior_ath": F.max("day_high_adj").over(before(in_calendar())),
        "all_time_high_incl": F.max("day_high_adj").over(upto(in_calendar()))})
    d = d.withColumns({
        "ath_at_open": yes(C("cash_open_adj") > C("prior_ath")),
        "distance_open_to_ath_pct": pct(C("cash_open_adj"), C("prior_ath")),
        "distance_overnight_high_to_ath_pct": pct(C("overnight_high_adj"), C("prior_ath")),
        "ath_reached_overnight": yes(C("overnight_high_adj") >= C("prior_ath"))})
    near = {f"near_ath_{t:g}pct": yes(F.abs("distance_open_to_ath_pct") <= t)
            for t in p.near_tolerances_pct}
    breaks = {f"ath_broken_first_{n}m": yes(C(f"high_first_{n}m") > C("prior_ath"))
              for n in p.break_windows_min}
    return d.withColumns(near | breaks).drop(
        *[f"high_first_{n}m" for n in p.break_windows_min])


def previous_levels(d: DataFrame) -> DataFrame:
    d = d.withColumns({
        "previous_close": lag_session(C("cash_close_adj")),
        "previous_open": lag_session(C("cash_open_adj")),
        "previous_day_high": lag_session(C("cash_high_adj")),
        "previous_day_low": lag_session(C("cash_low_adj")),
        "close_two_back": lag_session(C("cash_close_adj"), 2)})
    o, pc = C("cash_open_adj"), C("previous_close")
    pdh, pdl = C("previous_day_high"), C("previous_day_low")
    return d.withColumns({
        "previous_day_close": pc,
        "previous_day_range": pdh - pdl,
        "previous_day_return": ratio(pc, C("close_two_back")) - 1.0,
        "gap_points": o - pc,
        "gap_pct": pct(o, pc),
        "open_above_pdh": yes(o > pdh),
        "open_below_pdl": yes(o < pdl),
        "open_inside_previous_range": yes((o >= pdl) & (o <= pdh)),
        "open_vs_pdh_pct": pct(o, pdh),
        "open_vs_pdl_pct": pct(o, pdl)}).drop("close_two_back")


def overnight_features(d: DataFrame) -> DataFrame:
    rng = C("overnight_high_adj") - C("overnight_low_adj")
    return d.withColumns({
        "overnight_return_pct": pct(C("overnight_close_adj"), C("overnight_open_adj")),
        "overnight_range": rng,
        "open_location_in_overnight_range":
            ratio(C("cash_open_adj") - C("overnight_low_adj"), rng)})


def ranges(d: DataFrame, p: SessionParams = SessionParams()) -> DataFrame:
    """Average true range and average range over prior sessions, and what they scale."""
    h, lo, pc = C("cash_high_adj"), C("cash_low_adj"), lag_session(C("cash_close_adj"))
    d = d.withColumns({"true_range": F.greatest(h - lo, F.abs(h - pc), F.abs(lo - pc)),
                       "cash_range": h - lo})
    d = d.withColumns({
        "atr": prior(C("true_range"), p.atr_window, max(3, p.atr_window // 2), F.avg),
        "rolling_daily_range": prior(C("cash_range"), p.vol_window, 5, F.avg)})
    return d.withColumns({
        "overnight_range_normalized": ratio(C("overnight_range"), C("atr")),
        "gap_atr": ratio(C("gap_points"), C("atr"))}).drop("true_range", "cash_range")


def volatility_regime(d: DataFrame, p: SessionParams = SessionParams()) -> DataFrame:
    """Trailing realised volatility against its own prior terciles."""
    d = d.withColumn("ret", ratio(C("cash_close_adj"), lag_session(C("cash_close_adj"))) - 1.0)
    d = d.withColumn("realised_vol", prior(C("ret"), p.vol_window, 5, F.stddev_samp))

    d = d.withColumn("cuts", prior(C("realised_vol"), p.regime_window, 20, lambda x: F.percentile(
        x, [p.regime_low_q, p.regime_high_q])))
    return d.withColumn(
        "daily_volatility_regime",
        F.when(C("realised_vol").isNull() | C("cuts").isNull(), "unknown")
        .when(C("realised_vol") <= C("cuts")[0], "low")
        .when(C("realised_vol") >= C("cuts")[1], "high")
        .otherwise("normal")).drop("ret", "cuts")


def quality_flags(d: DataFrame, p: SessionParams = SessionParams()) -> DataFrame:
    """Flags joined by ``;``. The calendar's typical bar count needs all dates of the
    instrument, so it is taken before sessions without cash bars are dropped."""
    return d.withColumn("data_quality_flags", F.concat_ws(
        ";", F.when(C("shortened_session"), "shortened_session"),
        F.when(C("prior_ath").isNull(), "no_prior_ath"),
        F.when(C("overnight_high_adj").isNull()
               | (F.coalesce("n_overnight_bars", F.lit(0)) == 0), "no_overnight_bars"),
        F.when(C("feed") == "contract_1m", "contract_source")))


def daily_features(bars: DataFrame, p: SessionParams = SessionParams()) -> DataFrame:
    """All per-session features.

    One shuffle of the bars to session rows, one of the session rows to their instrument.
    The median of the calendar runs as a whole-instrument window on that same partitioning.
    """
    from barloom.operators.bars import session_ohlc
    d = session_ohlc(bars, p, keep_all_dates=True)
    typical = F.median("n_cash_bars").over(Window.partitionBy("instrument_id"))
    d = d.withColumn("shortened_session", C("n_cash_bars") < 0.6 * F.greatest(
        typical, F.lit(p.expected_bars(5) * 0.5)))
    d = d.where("n_cash_bars > 0").withColumn("prev_session_date",
                                              lag_session(C("session_date")))
    d = quality_flags(volatility_regime(ranges(overnight_features(
        previous_levels(high_water(d, p))), p), p), p)
    for x in ("open", "high", "low", "close"):
        d = d.withColumnRenamed(f"cash_{x}", f"cash_{x}_raw").withColumn(
            f"cash_{x}", C(f"cash_{x}_adj"))
    return d


# The published projection of the feature table.
DAILY_COLUMNS = [
    "session_date", "weekday", "feed", "cash_open", "cash_high", "cash_low", "cash_close",
    "cash_open_raw", "cash_high_raw", "cash_low_raw", "cash_close_raw", "previous_close",
    "previous_day_high", "previous_day_low", "previous_day_close", "previous_day_range",
    "previous_day_return", "prior_ath", "distance_open_to_ath_pct",
    "distance_overnight_high_to_ath_pct", "ath_at_open", "ath_reached_overnight",
    "ath_broken_first_5m", "ath_broken_first_15m", "ath_broken_first_30m", "gap_points",
    "gap_pct", "gap_atr", "open_above_pdh", "open_below_pdl", "open_inside_previous_range",
    "open_vs_pdh_pct", "open_vs_pdl_pct", "overnight_open_adj", "overnight_high_adj",
    "overnight_low_adj", "overnight_close_adj", "overnight_return_pct", "overnight_range",
    "overnight_range_normalized", "open_location_in_overnight_range", "atr",
    "rolling_daily_range", "daily_volatility_regime", "data_quality_flags"]

# Reference levels the intraday operators read, and their source columns.
LEVELS = {"PDH": "previous_day_high", "PDC": "previous_close", "PDL": "previous_day_low",
          "ONH": "overnight_high_adj", "ONL": "overnight_low_adj"}


def reference_levels(daily: DataFrame) -> DataFrame:
    return daily.select(
        *SESSION, C("cash_open_adj").alias("ref_open"), C("previous_day_high").alias("pdh"),
        C("previous_day_low").alias("pdl"), C("previous_close").alias("pdc"),
        C("overnight_high_adj").alias("onh"), C("overnight_low_adj").alias("onl"),
        "prior_ath", "atr", C("previous_day_range").alias("prev_range"))
