"""What happened after the cutoff, and the class of the day."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import SESSION, first_match, latest, pct, ratio, yes
from barloom.operators.bars import cash
from barloom.operators.daily import reference_levels
from barloom.params import ClassRules, SessionParams

C = F.col


def _place(price: Column, tie: Column) -> Column:
    """Price, then minute, in one decimal: a struct has no fixed-width aggregation buffer and
    would sort the bars."""
    return price.cast("decimal(30,14)") * F.lit(10000).cast("decimal(6,0)") + (
        tie.cast("decimal(5,0)") / F.lit(10 ** 14).cast("decimal(16,0)"))


def session_outcomes(bars: DataFrame, daily: DataFrame, cutoff_min: int,
                     sessions: DataFrame | None = None,
                     p: SessionParams = SessionParams()) -> DataFrame:
    """Returns, excursions and level tests after the cutoff.

    A level is touched after the cutoff iff the later bars' extreme lies beyond it, so one
    aggregate of the bars answers every level. An empty session list gives an empty table
    with the same columns.
    """
    b = cash(bars)
    if sessions is not None:
        b = b.join(sessions.select(*SESSION).distinct(), SESSION, "left_semi")
    b = b.select(*SESSION, "mso", C("adj_high").alias("h"), C("adj_low").alias("l"),
                 C("adj_close").alias("c"))
    obs, aft = C("mso") <= cutoff_min, C("mso") > cutoff_min
    at = {f"return_after_{m}m_pct": cutoff_min + m for m in p.horizons_min}
    at |= {"return_at_1200_pct": p.since_open(p.midday),
           "return_at_us_open_pct": p.since_open(p.us_open),
           "return_at_cash_close_pct": p.since_open(p.cash_close)}
    g = b.groupBy(*SESSION).agg(
        latest(C("c"), obs).alias("cutoff_price"), F.max_by("c", "mso").alias("close_px"),
        *[latest(C("c"), C("mso") <= t).alias(k) for k, t in at.items()],
        F.max(F.when(obs, C("h"))).alias("obs_hi"), F.min(F.when(obs, C("l"))).alias("obs_lo"),
        F.max(F.when(aft, C("h"))).alias("hi"), F.min(F.when(aft, C("l"))).alias("lo"),
        F.max_by("mso", _place(C("h"), -C("mso"))).alias("top"),
        F.min_by("mso", _place(C("l"), C("mso"))).alias("bottom"))
    g = g.join(reference_levels(daily), SESSION)
    px, o, pc, hi, lo = (C("cutoff_price"), C("ref_open"), C("pdc"), C("hi"), C("lo"))
    seen = px.isNotNull()
    half, gap_up = (o + pc) / 2.0, o > pc

    def up(x: Column) -> Column:
        return F.when(seen, yes(hi >= x))

    def down(x: Column) -> Column:
        return F.when(seen, yes(lo <= x))

    def both(x: Column) -> Column:
        return F.when(seen, yes((hi >= x) & (lo <= x)))

    def fill(x: Column) -> Column:
        return F.when(seen, F.when(pc.isNull(), False).otherwise(
            F.when(gap_up, yes(lo <= x)).otherwise(yes(hi >= x))))

    cols = {
        "cutoff_min": F.lit(cutoff_min), "cutoff_price": px,
        **{k: F.when(seen, pct(C(k), px)) for k in at},
        "max_favorable_excursion_pct": pct(hi, px), "max_adverse_excursion_pct": pct(lo, px),
        "session_high_min": F.when(seen, C("top").cast("double")),
        "session_low_min": F.when(seen, C("bottom").cast("double")),
        "session_close_pct_vs_cutoff": pct(C("close_px"), px),
        "break_observed_high": up(C("obs_hi")), "break_observed_low": down(C("obs_lo")),
        "retest_cash_open": both(o), "touch_overnight_high": up(C("onh")),
        "touch_overnight_low": down(C("onl")), "touch_pdh": up(C("pdh")),
        "touch_pdl": down(C("pdl")), "touch_previous_close": both(pc),
        "full_gap_fill": fill(pc), "half_gap_fill": fill(half),
        "close_above_cash_open": F.when(seen, C("close_px") > o),
        "close_below_cash_open": F.when(seen, C("close_px") < o),
        "close_above_prior_ath": F.when(seen, C("close_px") > C("prior_ath")),
        "close_below_prior_ath": F.when(seen, C("close_px") < C("prior_ath"))}
    return g.select(*SESSION, *[v.alias(k) for k, v in cols.items()])


# Class names in order of the vocabulary.
CLASSES = ("ATH gap-and-go continuation", "opening spike then bull flag",
           "opening spike failure", "partial gap fade", "full gap fill", "complete reversal",
           "high-level range day", "two-sided volatile day")
(GAP_AND_GO, SPIKE_AND_FLAG, SPIKE_FAILED, GAP_FADED, GAP_FILLED, REVERSED, HIGH_RANGE,
 TWO_SIDED) = CLASSES


def classify_days(d: DataFrame, rules: ClassRules = ClassRules(),
                  p: SessionParams = SessionParams()) -> DataFrame:
    """Day class by the first rule that applies, with the numbers behind it.

    Input: daily features joined with opening features and outcomes. Two rules compare a
    percentage with an ATR multiple; kept, because the published classes depend on it.
    """
    d = d.withColumn("day_net_points", C("cash_close_adj") - C("cash_open_adj"))
    net = F.abs(ratio(C("day_net_points"), C("atr")))
    spike = yes(ratio(C("first_bar_range"), C("atr")) >= rules.big_first_bar_atr)
    bull, gap_up = yes(C("first_bar_is_bull")), yes(C("gap_pct") > 0)
    weak = yes((C("extension_ratio") < rules.weak_extension)
               & (C("post_spike_overlap_ratio") > rules.high_overlap))
    first_weak = F.least("first_meaningful_lower_high_min", "first_bearish_expansion_min",
                         "first_stall_break_min")
    early = yes(first_weak <= p.since_open(p.weakness_deadline))
    full, half = yes(C("full_gap_fill")), yes(C("half_gap_fill"))
    up_close = F.coalesce(C("close_above_cash_open"), C("day_net_points") > 0, F.lit(False))
    high_up = (yes(C("ath_at_open")) | yes(C("ath_reached_overnight"))
               | yes(C("`near_ath_0.5pct`")))
    mfe, mae = C("max_favorable_excursion_pct"), C("max_adverse_excursion_pct")
    deep = yes(-mae > rules.big_excursion_atr)
    reach = rules.big_excursion_atr * ratio(100.0 * F.nullif(C("atr"), F.lit(0.0)),
                                            C("cash_open_adj"))
    # Condition, class and reason; the first that holds decides.
    rules_in_order = [
        (full & ~up_close & gap_up, GAP_FILLED,
         F.format_string("gap %+.2f%% filled, close below the open", "gap_pct")),
        (gap_up & net.isNotNull() & ~up_close & deep, REVERSED,
         F.format_string("gap %+.2f%% reversed, adverse excursion %.2f%%", "gap_pct", mae)),
        (high_up & spike & bull & up_close & ~weak & yes(net >= rules.trend_net_atr), GAP_AND_GO,
         F.lit("at the highs, large bullish first bar, held into the close")),
        (spike & bull & early & (~up_close | deep), SPIKE_FAILED,
         F.format_string("bullish spike, weakness at minute %.0f", first_weak.cast("double"))),
        (spike & bull & weak & up_close, SPIKE_AND_FLAG,
         F.lit("bullish spike, overlapping follow-through, close above the open")),
        (gap_up & half & ~full, GAP_FADED,
         F.format_string("gap %+.2f%% half filled", "gap_pct")),
        (yes((mfe >= reach) & (-mae >= reach)), TWO_SIDED, F.lit("large excursions both ways")),
        (yes(net < rules.range_net_atr), HIGH_RANGE, F.lit("small net change"))]
    day_class = first_match([(c, name) for c, name, _ in rules_in_order], HIGH_RANGE)
    why = None
    for c, _, note in rules_in_order:
        why = F.when(yes(c), note) if why is None else why.when(yes(c), note)
    return d.withColumns({
        "day_classification": day_class,
        "day_classification_reason": why.otherwise(F.when(
            yes(C("day_net_points") > 0), "contained up day").otherwise("contained down day"))})
