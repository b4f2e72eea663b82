"""The analog search: filter, rank, outcomes, classes and explanations in one plan."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import SESSION
from barloom.operators import opening, outcomes, paths, reports, similarity
from barloom.params import MIN_SAMPLE, FilterSpec, SessionParams
from barloom.plans.storage import cut

C = F.col

#: What tiers, ranking, outcomes, day classes and descriptions read of the daily and opening features.
READS = frozenset(similarity.FEATURES) | frozenset(opening.WEAKNESS_EVENTS) | frozenset((
    "cash_open_adj cash_close_adj previous_close previous_day_high previous_day_low previous_day_range "
    "overnight_high_adj overnight_low_adj prior_ath atr gap_pct distance_open_to_ath_pct ath_at_open "
    "ath_reached_overnight near_ath_0.5pct open_above_pdh open_below_pdl daily_volatility_regime "
    "day_net_points first_bar_is_bull first_bar_range first_bar_range_normalized first_bar_return "
    "first_bar_close_location extension_ratio post_spike_overlap_ratio post_spike_efficiency "
    "post_spike_pullback_ratio").split())


def read_columns(features: DataFrame) -> DataFrame:
    """The columns of session features that the search reads, for a caller who shows no others."""
    return features.select(*SESSION, *[C(f"`{c}`") for c in features.columns if c in READS])


@dataclass(frozen=True)
class AnalogResult:
    """Lazy tables over the written session features and ranking."""
    tiers: DataFrame
    pool: DataFrame
    top: DataFrame
    explanations: DataFrame
    distribution: DataFrame
    headline: DataFrame
    paths: DataFrame
    reference: DataFrame


def last_sessions(daily: DataFrame) -> DataFrame:
    """The newest session of every instrument as its reference; reads two columns."""
    return daily.groupBy("instrument_id").agg(
        F.max("session_date").alias("reference_date"))


def analog_search(bars: DataFrame, daily: DataFrame, refs: DataFrame,
                  spec: FilterSpec = FilterSpec(), mode: str = "combined", n: int = 20,
                  cutoff_min: int | None = None, period: str = "all",
                  path_method: str = "correlation", path_unit: str = "atr",
                  weights: dict[str, float] | None = None,
                  features: DataFrame | None = None, narrow: bool = False,
                  p: SessionParams = SessionParams()) -> AnalogResult:
    """Historical sessions most like each instrument's reference session.

    ``mode``: ``exact`` ranks the exact matches, ``similarity`` ranks every session,
    ``combined`` ranks the sessions of the context filter's strong tier. ``features``: stored
    opening features at the same cutoff, if there are any. ``narrow``: of the session features
    keep those that the search itself reads, and show no others beside the results. The session features and the ranking
    are read by several branches and written once each; both hold one row per session.
    """
    minute = p.cutoff_min if cutoff_min is None else cutoff_min
    op = opening.opening_features(bars, daily, minute, p) if features is None else features
    scope = similarity.in_period(daily, similarity.PERIODS[period], refs)
    m = similarity.feature_rows(scope, op)
    m = cut(read_columns(m) if narrow else m)
    base = spec.context_only() if mode == "combined" else spec
    flagged = similarity.with_tiers(m, base)
    t = similarity.tiers(flagged, base, max(n, MIN_SAMPLE) if mode == "combined" else n)
    if mode == "combined":
        pool = flagged.join(t.select("instrument_id", "strong_rung"), "instrument_id").where(
            F.get("passes", C("strong_rung")))
    elif mode == "exact":
        pool = flagged.where(F.get("passes", F.lit(0)))
    else:
        pool = flagged
    pool = pool.select(*SESSION)
    sp = paths.session_paths(bars, m, minute, path_unit)
    dist = paths.path_distance(paths.against_reference(sp, refs), path_method)
    pairs = similarity.against_query(similarity.robust_scaled(m, minute), refs).join(
        pool, SESSION, "left_semi")
    ranked = cut(similarity.rank(similarity.block_distances(pairs), dist.join(
        pool, SESSION, "left_semi"), weights, n))
    out = outcomes.session_outcomes(bars, m, minute, ranked, p).drop("cutoff_min")
    top = outcomes.classify_days(
        ranked.join(m, SESSION, "left").join(out, SESSION, "left"), p=p)
    shown = ranked.select(*SESSION)
    return AnalogResult(
        tiers=t, pool=pool, top=top,
        explanations=similarity.explain(pairs.join(shown, SESSION, "left_semi")),
        distribution=reports.distribution(top), headline=reports.headline(top), paths=sp,
        reference=similarity.describe_session(m.join(refs, "instrument_id").where(
            "session_date = reference_date")))
