"""Opening features at a cutoff, from adjusted cash bars up to and including it.

All bar-level terms are windows over one session with one order, so the bars are exchanged and
sorted once; a single aggregate then folds them to one row per session.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import (SESSION, any_of, before, count_where, first_minute,
                                       in_session, latest, pct, ratio, upto, whole_session, yes)
from barloom.operators.bars import cash
from barloom.operators.daily import reference_levels
from barloom.params import SessionParams

C = F.col


def observed(bars: DataFrame, daily: DataFrame, cutoff_min: int,
             p: SessionParams = SessionParams()) -> DataFrame:
    """Bars up to the cutoff with the neighbours and running extremes the features need."""
    b = cash(bars, cutoff_min).select(
        *SESSION, "mso", C("adj_open").alias("o"), C("adj_high").alias("h"),
        C("adj_low").alias("l"), C("adj_close").alias("c"))
    b = b.join(reference_levels(daily).where("ref_open is not null"), SESSION)
    w, k = in_session(), p.swing_bars
    b = b.withColumn("rn", F.row_number().over(w)).withColumns({
        "n": F.count(F.lit(1)).over(whole_session()),
        "ph": F.lag("h").over(w), "pl": F.lag("l").over(w), "pc": F.lag("c").over(w),
        "low2": F.lag("l", 2).over(w), "h1": F.first("h").over(w), "l1": F.first("l").over(w),
        "run_hi": F.max("h").over(upto(w)), "run_lo": F.min("l").over(upto(w)),
        "hi_before": F.max("h").over(before(w)), "low3": F.min("l").over(before(w, 3)),
        "swing_hi": F.max("h").over(w.rowsBetween(-k, k)),
        "swing_lo": F.min("l").over(w.rowsBetween(-k, k)),
        "later_close": F.max("c").over(w.rowsBetween(1, 2 ** 31 - 1)),
        "low_15": F.min(F.when(C("mso") < 15, C("l"))).over(whole_session()),
        "low_30": F.min(F.when(C("mso") < 30, C("l"))).over(whole_session()),
        "typical_range": F.percentile(F.when(C("rn") <= p.expansion_bars, C("h") - C("l")), 0.5)
        .over(whole_session())})
    b = b.withColumns({
        "is_sh": (C("h") == C("swing_hi")) & (C("n") > 1),
        "is_sl": (C("l") == C("swing_lo")) & (C("n") > 1),
        "step": F.abs(C("c") - F.coalesce("pc", "ref_open")),
        "overlap": F.greatest(F.lit(0.0), F.least("h", "ph") - F.greatest("l", "pl"))
        / F.nullif(F.greatest(C("h") - C("l"), C("ph") - C("pl")), F.lit(0.0)),
        "expansion": (C("h") - C("l")) > p.expansion_multiple * C("typical_range"),
        "meaningful": p.meaningful_atr * F.nullif(C("atr"), F.lit(0.0))})
    b = b.withColumn("overlap", F.when(C("rn") > 1, C("overlap")))
    return b.withColumns({
        "last_sh": F.last(F.when(C("is_sh"), C("h")), True).over(before(w)),
        "last_sl": F.last(F.when(C("is_sl"), C("l")), True).over(before(w))})


def _window_terms(cond: Column, s: str) -> list[Column]:
    return [latest(C("c"), cond).alias(f"{s}c"), F.max(F.when(cond, C("h"))).alias(f"{s}hi"),
            F.min(F.when(cond, C("l"))).alias(f"{s}lo"),
            F.sum(F.when(cond, C("step"))).alias(f"{s}path"),
            F.avg(F.when(cond, C("overlap"))).alias(f"{s}overlap"),
            count_where(cond & (C("c") > C("o"))).alias(f"{s}bull"),
            count_where(cond).alias(f"{s}n")]


def _window_measures(s: str) -> dict[str, Column]:
    c, o, hi, lo = C(f"{s}c"), C("ref_open"), C(f"{s}hi"), C(f"{s}lo")
    return {
        "net_return_pct": pct(c, o), "high_low_range": hi - lo,
        "percentage_bull_bars": 100.0 * C(f"{s}bull") / F.nullif(C(f"{s}n"), F.lit(0)),
        "close_location_in_window_range": ratio(c - lo, hi - lo),
        "directional_efficiency": ratio(F.abs(c - o), C(f"{s}path")),
        "bar_overlap_ratio": C(f"{s}overlap")}


def opening_features(bars: DataFrame, daily: DataFrame, cutoff_min: int | None = None,
                     p: SessionParams = SessionParams()) -> DataFrame:
    """One row per session with bars before the cutoff and a known open."""
    cut = p.cutoff_min if cutoff_min is None else cutoff_min
    b = observed(bars, daily, cut, p)
    refs = ["ref_open", "pdh", "pdl", "pdc", "onh", "onl", "prior_ath", "atr", "prev_range"]
    first, post, every = C("rn") == 1, C("rn") > 1, F.lit(True)
    bear = C("expansion") & (C("c") < C("o"))
    new_high = post & (C("h") > C("hi_before"))
    broke = post & ((C("h") > C("h1")) | (C("l") < C("l1")))
    lower_sh, lower_sl = C("is_sh") & (C("h") < C("last_sh")), C("is_sl") & (C("l") < C("last_sl"))

    def when_rn1(x: str) -> Column:
        return F.max(F.when(first, C(x)))

    aggs = [
        *_window_terms(every, "all_"),
        *[t for m in p.windows_min for t in _window_terms(C("mso") < m, f"w{m}_")],
        count_where(C("c") < C("o")).alias("bear"),
        *[count_where(post & x).alias(n) for n, x in (
            ("number_of_higher_highs", C("h") > C("ph")), ("number_of_lower_highs", C("h") < C("ph")),
            ("number_of_higher_lows", C("l") > C("pl")), ("number_of_lower_lows", C("l") < C("pl")))],
        F.max(C("run_hi") - C("l")).alias("maximum_pullback"),
        F.max(C("h") - C("run_lo")).alias("maximum_bounce"),
        F.avg((C("c") > C("ref_open")).cast("double")).alias("time_above_cash_open"),
        F.avg((C("c") < C("ref_open")).cast("double")).alias("time_below_cash_open"),
        *[when_rn1(x).alias(f"{x}0") for x in ("o", "h", "l", "c")],
        F.max(F.when(post, C("h"))).alias("post_hi"), F.min(F.when(post, C("l"))).alias("post_lo"),
        F.avg(F.when(C("rn") > 2, C("overlap"))).alias("post_spike_overlap_ratio"),
        F.sum(F.when(post, F.abs(C("c") - C("pc")))).alias("post_path"),
        count_where(new_high).alias("number_of_new_highs_after_first_bar"),
        first_minute(new_high).alias("first_new"), F.max(F.when(new_high, C("mso"))).alias("last_new"),
        first_minute(new_high & (C("h") - C("h1") >= F.coalesce("meaningful", F.lit(0.0))))
        .alias("minutes_until_next_meaningful_new_high"),
        first_minute(post & (C("rn") > 2) & (C("c") < F.least("pl", "low2")))
        .alias("first_close_below_prev2_low_min"),
        first_minute(lower_sh).alias("first_lower_swing_high_min"),
        first_minute(lower_sl).alias("first_lower_swing_low_min"),
        first_minute(bear).alias("first_bearish_expansion_min"),
        first_minute(C("expansion") & (C("c") > C("o"))).alias("first_bullish_expansion_min"),
        first_minute((C("mso") >= 15) & (C("l") < C("low_15"))).alias("first_break_first15m_low_min"),
        first_minute((C("mso") >= 30) & (C("l") < C("low_30"))).alias("first_break_first30m_low_min"),
        first_minute((C("rn") > 3) & (C("c") < C("low3"))).alias("first_stall_break_min"),
        first_minute(lower_sh & (C("last_sh") - C("h") >= C("meaningful")))
        .alias("first_meaningful_lower_high_min"),
        first_minute(C("is_sl") & (C("l") > C("last_sl"))
                     & (C("l") - C("last_sl") >= C("meaningful")))
        .alias("first_meaningful_higher_low_min"),
        F.min_by(F.when(bear, F.coalesce(C("later_close") < C("h"), F.lit(True))),
                 F.when(bear, C("mso"))).alias("failed"),
        F.min_by(F.when(broke, F.when(C("h") > C("h1"), 1).otherwise(-1)),
                 F.when(broke, C("mso"))).alias("break_dir"),
        first_minute(broke).alias("first_opening_range_break_min")]
    g = b.groupBy(*SESSION, *refs).agg(*aggs)
    c, o0, h0, l0, c0 = C("all_c"), C("o0"), C("h0"), C("l0"), C("c0")
    fr, o = h0 - l0, C("ref_open")
    many = C("all_n") > 1
    gap = (C("last_new") - C("first_new")) / F.nullif(
        C("number_of_new_highs_after_first_bar") - 1, F.lit(0))
    cols = {**_window_measures("all_")}
    cols |= {
        "cutoff_min": F.lit(cut), "n_window_bars": C("all_n"),
        "net_points": c - o, "distance_from_cash_open": c - o,
        "range_normalized_by_prior_daily_range": ratio(C("all_hi") - C("all_lo"), C("prev_range")),
        "range_normalized_by_ATR": ratio(C("all_hi") - C("all_lo"), C("atr")),
        "number_of_bull_bars": C("all_bull"), "number_of_bear_bars": C("bear"),
        "maximum_pullback_as_fraction_of_up_move": ratio(C("maximum_pullback"), C("all_hi") - o),
        "maximum_bounce_as_fraction_of_down_move": ratio(C("maximum_bounce"), o - C("all_lo")),
        "distance_from_PDH": c - C("pdh"), "distance_from_PDL": c - C("pdl"),
        "distance_from_previous_close": c - C("pdc"),
        "distance_from_overnight_high": c - C("onh"),
        "distance_from_overnight_low": c - C("onl"),
        "first_bar_return": pct(c0, o0), "first_bar_range": fr,
        "first_bar_range_normalized": ratio(fr, C("atr")),
        "first_bar_range_norm_prevrange": ratio(fr, C("prev_range")),
        "first_bar_body": c0 - o0, "first_bar_body_to_range": ratio(F.abs(c0 - o0), fr),
        "first_bar_upper_wick": h0 - F.greatest(o0, c0),
        "first_bar_lower_wick": F.least(o0, c0) - l0,
        "first_bar_close_location": ratio(c0 - l0, fr),
        "first_bar_breaks_PDH": yes(h0 > C("pdh")),
        "first_bar_breaks_overnight_high": yes(h0 > C("onh")),
        "first_bar_breaks_prior_ATH": yes(h0 > C("prior_ath")),
        "first_bar_is_bull": c0 > o0,
        "additional_extension_after_first_bar": C("post_hi") - h0,
        "extension_ratio": ratio(C("post_hi") - h0, fr),
        "post_spike_pullback": h0 - C("post_lo"),
        "post_spike_pullback_ratio": ratio(h0 - C("post_lo"), fr),
        "post_spike_efficiency": ratio(F.abs(c - c0), C("post_path")),
        "average_distance_between_new_highs": gap,
        "close_progress_ratio": F.when(many, ratio(c - c0, fr)),
        "failed_to_reclaim_bear_expansion_high": yes(C("failed")),
        "time_below_open_frac": C("time_below_cash_open"),
        "opening_range_break_direction": F.coalesce("break_dir", F.lit(0))}
    for m in p.windows_min:
        cols |= {f"w{m}_{k}": v for k, v in _window_measures(f"w{m}_").items()}
    kept = [x for x in g.columns if x.startswith(("number_of", "first_", "time_"))
            or x in ("maximum_pullback", "post_spike_overlap_ratio",
                     "minutes_until_next_meaningful_new_high")]
    kept = [x for x in kept if x not in {"first_new", *cols}]
    return g.select(*SESSION, *kept, *[v.alias(k) for k, v in cols.items()])


# The events that count as early weakness in the exact filter.
WEAKNESS_EVENTS = ("first_meaningful_lower_high_min", "first_bearish_expansion_min",
                   "first_stall_break_min", "first_break_first15m_low_min",
                   "first_lower_swing_high_min", "first_close_below_prev2_low_min")


def weak_by(minute: float) -> Column:
    return any_of([C(e) <= minute for e in WEAKNESS_EVENTS])
