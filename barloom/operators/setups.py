"""Threshold setups: session table, spec masks, funnel, conditional probabilities."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import (SESSION, all_of, count_where, latest, pct, percentiles,
                                       yes)
from barloom.operators.context import funnel, window_geometry
from barloom.operators.daily import LEVELS
from barloom.params import SetupSpec

C = F.col
# The way price travels to each level; the same for both setup directions.
TOWARDS = {"PDH": "down", "PDC": "down", "PDL": "down", "ONH": "up", "ONL": "down"}


def session_table(bars: DataFrame, daily: DataFrame, spec: SetupSpec = SetupSpec()) -> DataFrame:
    """One row per session that can be judged at the decision bar.

    A level is reached in a phase iff the phase's lowest low (or highest high) is beyond it,
    so the bars collapse to the extremes of each phase before any level is looked at. Only
    the timing fields of the spec matter here; thresholds filter the stored table.
    """
    dm, mso = spec.decision_min, C("mso")
    phases = {"pre": mso < dm, "morn": (mso >= dm) & (mso <= spec.morning_end_min),
              "aft": mso >= dm}
    extra = [count_where(phases["pre"]).alias("n_pre"), count_where(phases["aft"]).alias("n_aft"),
             latest(C("c"), phases["pre"]).alias("decision_price"),
             latest(C("c"), phases["morn"]).alias("morn_close"),
             F.max_by("c", "mso").alias("day_close")]
    for k, cond in phases.items():
        extra += [F.min(F.when(cond, C("l"))).alias(f"{k}_lo"),
                  F.max(F.when(cond, C("h"))).alias(f"{k}_hi")]
    g = window_geometry(bars, spec.pressure_window_min, "pa_", *extra)
    g = g.where((C("n_pre") >= spec.decision_bar) & (C("n_aft") > 0) & (C("pa_n_bars") > 0))
    d = daily.select(*SESSION, "gap_pct", "distance_open_to_ath_pct", "ath_at_open",
                     "open_above_pdh", "open_below_pdl", "open_location_in_overnight_range",
                     "daily_volatility_regime",
                     *[C(c).alias(f"level_{k}") for k, c in LEVELS.items()])
    t = g.join(d, SESSION)

    def reached(phase: str, level: Column, way: str) -> Column:
        return yes(C(f"{phase}_lo") <= level if way == "down" else C(f"{phase}_hi") >= level)

    cols = {f"{ph}_{k}": reached(ph, C(f"level_{k}"), way)
            for k, way in TOWARDS.items() for ph in phases}
    back = "up" if spec.direction == "down" else "down"
    cols |= {f"{ph}_reclaim_open": reached(ph, C("cash_open"), back) for ph in ("morn", "aft")}
    px = C("decision_price")
    cols |= {"morn_ret_pct": pct(C("morn_close"), px), "morn_mae_pct": pct(C("morn_lo"), px),
             "morn_mfe_pct": pct(C("morn_hi"), px), "day_ret_pct": pct(C("day_close"), px),
             "day_mae_pct": pct(C("aft_lo"), px), "day_mfe_pct": pct(C("aft_hi"), px)}
    drop = [f"{p}_{x}" for p in phases for x in ("lo", "hi")]
    return t.withColumns(cols).drop(*drop, "n_pre", "n_aft", "morn_close", "day_close",
                                    "pa_up_excursion", "pa_down_excursion")


def spec_steps(spec: SetupSpec) -> list[tuple[str, Column]]:
    """Active conditions in reporting order."""
    down = spec.direction == "down"

    def side(a: str, b: str) -> Column:
        return C(f"pa_{a}" if down else f"pa_{b}")

    loc, cap = C("pa_close_location"), spec.close_location_max
    on = C("open_location_in_overnight_range")
    table: list[tuple[object, str, Column | None]] = [
        (spec.ath_tolerance_pct, "|open - high| <= {}%",
         F.abs("distance_open_to_ath_pct") <= spec.ath_tolerance_pct),
        (spec.new_ath_at_open, "new high at the open", C("ath_at_open")),
        (spec.open_above_pdh, "open > PDH", C("open_above_pdh")),
        (spec.open_below_pdl, "open < PDL", C("open_below_pdl")),
        (spec.gap_min_pct, "gap >= {}%", C("gap_pct") >= spec.gap_min_pct),
        (spec.gap_max_pct, "gap <= {}%", C("gap_pct") <= spec.gap_max_pct),
        (spec.on_location_min, "open >= {} of overnight range", on >= spec.on_location_min),
        (spec.on_location_max, "open <= {} of overnight range", on <= spec.on_location_max),
        (spec.vol_regimes, "regime in {}",
         C("daily_volatility_regime").isin(*(spec.vol_regimes or ("",)))),
        (spec.close_beyond_open, "close beyond the open",
         side("close_below_open", "close_above_open")),
        (cap, "close in the far {} of the range",
         None if cap is None else (loc <= cap if down else loc >= 1.0 - cap)),
        (spec.close_beyond_prior_bar, "close beyond the prior bar",
         side("close_below_prior_low", "close_above_prior_high")),
        (spec.monotonic_extremes, "monotonic extremes",
         side("monotonic_lower_highs", "monotonic_higher_lows")),
        (spec.min_directional_bars, "at least {} directional bars",
         side("n_bear_bars", "n_bull_bars") >= spec.min_directional_bars),
        (spec.excursion_beyond_open, "excursion beyond the open, then back",
         side("spike_up_reject", "spike_down_reject"))]
    return [(name.format(v), cond) for v, name, cond in table
            if v is not None and v is not False and v != ()]


def matches_setup(spec: SetupSpec) -> Column:
    return all_of([c for _, c in spec_steps(spec)])


def setup_funnel(table: DataFrame, spec: SetupSpec) -> DataFrame:
    return funnel(table, spec_steps(spec))


def scan(table: DataFrame, spec: SetupSpec) -> tuple[DataFrame, DataFrame]:
    return table.where(matches_setup(spec)), setup_funnel(table, spec)


def conditional_report(matches: DataFrame) -> DataFrame:
    """How often a level is reached later, among sessions that had not reached it before the
    decision. The last row is the way back to the open, for which every match counts."""
    rows = [F.struct(F.lit(k).alias("level"), C(f"pre_{k}").alias("pre"),
                     C(f"morn_{k}").alias("morn"), C(f"aft_{k}").alias("aft")) for k in LEVELS]
    rows.append(F.struct(F.lit("OPEN (retrace)").alias("level"), F.lit(False).alias("pre"),
                         C("morn_reclaim_open").alias("morn"), C("aft_reclaim_open").alias("aft")))
    fresh = ~C("pre")
    r = (matches.select("instrument_id", F.inline(F.array(*rows)))
         .groupBy("instrument_id", "level").agg(
        count_where(C("pre")).alias("tested_before_decision"),
        count_where(fresh).alias("untested_at_decision"),
        count_where(fresh & C("morn")).alias("reached_in_morning"),
        count_where(fresh & C("aft")).alias("reached_by_close")))
    n = F.nullif(C("untested_at_decision"), F.lit(0))
    return r.withColumns({"p_morning_pct": F.round(100.0 * C("reached_in_morning") / n, 1),
                          "p_by_close_pct": F.round(100.0 * C("reached_by_close") / n, 1)})


# The outcome columns summarised for a setup.
OUTCOMES = ("morn_ret_pct", "morn_mae_pct", "morn_mfe_pct",
            "day_ret_pct", "day_mae_pct", "day_mfe_pct")


def outcome_summary(matches: DataFrame) -> DataFrame:
    long = matches.select("instrument_id", F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), C(c).alias("v")) for c in OUTCOMES]))).where(
        "v is not null")
    s = long.groupBy("instrument_id", "metric").agg(
        F.count("v").alias("n"), percentiles(C("v"), (0.25, 0.5, 0.75)).alias("q"),
        F.avg("v").alias("mean"), count_where(C("v") < 0).alias("neg"),
        F.min("v").alias("worst"), F.max("v").alias("best"))
    return s.select("instrument_id", "metric", "n", F.round(C("q")[1], 3).alias("median"),
                    F.round("mean", 3).alias("mean"),
                    F.round(100.0 * C("neg") / C("n"), 1).alias("negative_pct"),
                    F.round(C("q")[0], 3).alias("p25"), F.round(C("q")[2], 3).alias("p75"),
                    F.round("worst", 3).alias("worst"), F.round("best", 3).alias("best"))
