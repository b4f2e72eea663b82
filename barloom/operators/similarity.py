"""Exact filters, similarity ranking, the relaxation ladder and the analog search.

Every statistic belongs to one instrument and every reference is one session of it, so
ranking is an equality join on the instrument and never pairs candidates with each other.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import SESSION, all_of, count_where, mean_known, ratio, yes
from barloom.operators.opening import weak_by
from barloom.params import (BLOCK_WEIGHTS, BLOCKS, LADDER, MIN_SAMPLE, NEVER_AFTER_MIN,
                            PATH_SHARE, FilterSpec, Rung)

C = F.col
FEATURES = [f for b in BLOCKS.values() for f in b]


def feature_rows(daily: DataFrame, opening: DataFrame) -> DataFrame:
    d = daily.join(opening, SESSION)
    net = C("cash_close_adj") - C("cash_open_adj")
    return d.withColumns({"day_net_points": net, "day_net_pct": 100.0 * ratio(net, C("cash_open_adj"))})


def in_period(d: DataFrame, days: int | None, refs: DataFrame | None = None) -> DataFrame:
    """Sessions of the last ``days`` days of each instrument, plus the reference session."""
    if days is None:
        return d
    end = F.max("session_date").over(Window.partitionBy("instrument_id"))
    keep = C("session_date") >= F.date_sub(C("last_session"), days)
    d = d.withColumn("last_session", end)
    if refs is not None:
        d = d.join(refs, "instrument_id", "left")
        keep = keep | yes(C("session_date") == C("reference_date"))
        return d.where(keep).drop("last_session", "reference_date")
    return d.where(keep).drop("last_session")


# Named period scopes in days.
PERIODS = {"last_year": 365, "last_5_years": 5 * 365 + 1, "last_10_years": 10 * 365 + 2,
           "all": None}


def with_range_cut(d: DataFrame, pctl: float | None) -> DataFrame:
    """Add the instrument's percentile of the first-bar range, which one condition needs."""
    if pctl is None:
        return d.withColumn("first_bar_range_cut", F.lit(None).cast("double"))
    return d.withColumn("first_bar_range_cut", F.percentile(
        "first_bar_range_normalized", pctl / 100.0).over(Window.partitionBy("instrument_id")))


def matches_filter(s: FilterSpec) -> Column:
    conds: list[Column] = []

    def add(on: object, cond) -> None:
        if on is not None and on is not False:
            conds.append(cond())

    gap = C("gap_pct")
    add(s.ath_within_pct, lambda: F.abs("distance_open_to_ath_pct") <= s.ath_within_pct)
    add(s.ath_at_open, lambda: C("ath_at_open"))
    add(s.ath_overnight, lambda: C("ath_reached_overnight"))
    add(s.gap_sign, lambda: gap > 0 if s.gap_sign == "positive" else gap < 0)
    add(s.gap_min_pct, lambda: F.abs(gap) >= s.gap_min_pct)
    add(s.open_above_pdh, lambda: C("open_above_pdh"))
    add(s.open_below_pdl, lambda: C("open_below_pdl"))
    add(s.vol_regimes or None, lambda: C("daily_volatility_regime").isin(*s.vol_regimes))
    add(s.first_bar_bull, lambda: C("first_bar_is_bull"))
    add(s.first_bar_range_pctl,
        lambda: C("first_bar_range_normalized") >= C("first_bar_range_cut"))
    add(s.first_bar_close_loc, lambda: C("first_bar_close_location") >= s.first_bar_close_loc)
    add(s.extension_max, lambda: C("extension_ratio") < s.extension_max)
    add(s.overlap_min, lambda: C("post_spike_overlap_ratio") > s.overlap_min)
    add(s.efficiency_max, lambda: C("post_spike_efficiency") < s.efficiency_max)
    add(s.pullback_min, lambda: C("post_spike_pullback_ratio") > s.pullback_min)
    add(s.weakness_by_min, lambda: weak_by(s.weakness_by_min))
    return all_of(conds)


def apply_filter(d: DataFrame, s: FilterSpec) -> DataFrame:
    return with_range_cut(d, s.first_bar_range_pctl).where(matches_filter(s))


def relaxations(base: FilterSpec, ladder: tuple[Rung, ...] = LADDER
                ) -> list[tuple[str, FilterSpec]]:
    """The specs along the ladder. A rung that widens an unset condition is skipped; a rung
    that drops a condition always counts."""
    out, s = [], base
    for r in ladder:
        if r.field == "gap":
            s = s.but(gap_sign=None, gap_min_pct=None)
        elif r.to is None:
            s = s.but(**{r.field: None})
        elif getattr(s, r.field) is None:
            continue
        else:
            s = s.but(**{r.field: r.to})
        out.append((r.note, s))
    return out


def with_tiers(d: DataFrame, base: FilterSpec) -> DataFrame:
    """Flag per row and rung: element 0 is the exact filter, then the ladder."""
    specs = [base, *[s for _, s in relaxations(base)]]
    return with_range_cut(d, base.first_bar_range_pctl).withColumn(
        "passes", F.array(*[matches_filter(s) for s in specs]))


def tiers(flagged: DataFrame, base: FilterSpec, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """Exact, strong and broad match counts per instrument, from one pass over the rows.

    Strong is the first rung with enough matches. Broad is the rung where the search stops:
    at the first rung from the strong one on with twice as many, else at the last. Without a
    strong rung the broad set stands in for it, and the exact set for an empty broad one.
    """
    notes = [n for n, _ in relaxations(base)]
    k = len(notes)
    g = flagged.groupBy("instrument_id").agg(
        *[count_where(F.get("passes", F.lit(i))).alias(f"c{i}") for i in range(k + 1)])
    enough = [F.when(C(f"c{i}") >= min_sample, i) for i in range(1, k + 1)]
    g = g.withColumn("found", F.coalesce(*enough, F.lit(None).cast("int")))
    twice = [F.when((C("found") <= i) & (C(f"c{i}") >= 2 * min_sample), i)
             for i in range(1, k + 1)]
    g = g.withColumns({"broad_rung": F.coalesce(*twice, F.lit(k)),
                       "counts": F.array(*[C(f"c{i}") for i in range(k + 1)])})
    broad = F.get("counts", C("broad_rung"))
    g = g.withColumn("strong_rung", F.coalesce(
        C("found"), F.when(broad > 0, C("broad_rung")).otherwise(0)))
    names = F.array(*[F.lit(n) for n in notes])
    return g.select(
        "instrument_id", C("c0").alias("n_exact"),
        F.get("counts", C("strong_rung")).alias("n_strong"), broad.alias("n_broad"),
        "strong_rung", "broad_rung",
        F.when(C("found").isNotNull(), F.array_join(F.slice(names, F.lit(1), C("found")), "; "))
        .otherwise("").alias("relaxed_strong"),
        F.array_join(F.slice(names, F.lit(1), C("broad_rung")), "; ").alias("relaxed_broad"),
        (C("c0") < 5).alias("few_exact"))


def imputed(d: DataFrame, cutoff_min: int) -> DataFrame:
    """Features as numbers without gaps: an event that never came counts as late, any other
    gap takes the instrument's median.

    The statistics run as windows over the instrument, whose partition holds one row per
    session. The chain from features to scores is therefore one exchange without self-joins.
    """
    inst = Window.partitionBy("instrument_id")
    d = d.select(*SESSION, *[C(f).cast("double").alias(f) for f in FEATURES])
    late = F.lit(float(cutoff_min + NEVER_AFTER_MIN))
    return d.select(*SESSION, *[
        F.coalesce(C(f), late if f.endswith("_min") else F.median(f).over(inst)).alias(f)
        for f in FEATURES])


def robust_scaled(d: DataFrame, cutoff_min: int) -> DataFrame:
    """(x - median) / interquartile range; a zero range falls back to the deviation, then 1."""
    inst = Window.partitionBy("instrument_id")
    x = imputed(d, cutoff_min)
    x = x.select("*", *[F.percentile(f, [0.25, 0.5, 0.75]).over(inst).alias(f"p_{f}")
                        for f in FEATURES],
                 *[F.stddev_samp(f).over(inst).alias(f"s_{f}") for f in FEATURES])

    def spread(f: str) -> Column:
        q = C(f"p_{f}")
        return F.coalesce(F.nullif(q[2] - q[0], F.lit(0.0)), F.nullif(C(f"s_{f}"), F.lit(0.0)),
                          F.lit(1.0))

    return x.select(*SESSION, *[((C(f) - C(f"p_{f}")[1]) / spread(f)).alias(f)
                                for f in FEATURES])


def against_query(scaled: DataFrame, refs: DataFrame) -> DataFrame:
    """Scaled features next to the reference session's (``q_`` columns)."""
    inst = Window.partitionBy("instrument_id")
    is_ref = C("session_date") == C("reference_date")
    d = scaled.join(refs, "instrument_id")
    d = d.select("*", F.max(is_ref).over(inst).alias("has_ref"), *[
        F.max(F.when(is_ref, C(f))).over(inst).alias(f"q_{f}") for f in FEATURES])
    return d.where(C("has_ref") & ~is_ref).drop("has_ref")


def block_distances(pairs: DataFrame) -> DataFrame:
    return pairs.select(*SESSION, "reference_date", *[
        F.sqrt(mean_known([F.pow(C(f) - C(f"q_{f}"), 2) for f in fs])).alias(f"dist_{b}")
        for b, fs in BLOCKS.items()])


def rank(blocks: DataFrame, path_dist: DataFrame | None = None,
         weights: dict[str, float] | None = None, n: int | None = None) -> DataFrame:
    """Weighted distance, score and rank per instrument; equal scores rank by date."""
    d, w = blocks, weights or BLOCK_WEIGHTS
    inst = Window.partitionBy("instrument_id")
    if path_dist is not None:
        d = d.join(path_dist, SESSION, "left")
        d = d.withColumn("pd", F.coalesce("path_dist", F.median("path_dist").over(inst)))
        scale = F.coalesce(F.nullif(F.median("pd").over(inst), F.lit(0.0)), F.lit(1.0))
        mixed = (1 - PATH_SHARE) * C("dist_post_spike") + PATH_SHARE * (C("pd") / scale)
        d = d.withColumn("dist_post_spike", F.coalesce(mixed, C("dist_post_spike"))).drop(
            "pd", "path_dist")
    total = sum(w.values()) or 1.0
    dist = reduce(lambda a, b: a + b, [F.lit(w[b] / total) * C(f"dist_{b}") for b in BLOCKS])
    d = d.withColumn("distance", dist).withColumn("similarity_score", 100.0 / (1.0 + C("distance")))
    order = inst.orderBy(F.desc("similarity_score"), "session_date")
    d = d.withColumn("rank", F.row_number().over(order))
    return d if n is None else d.where(C("rank") <= n)


# How features are called in explanations.
LABELS = {
    "distance_open_to_ath_pct": "distance of open to prior ATH",
    "overnight_return_pct": "overnight return",
    "overnight_range_normalized": "overnight range (ATR)",
    "gap_pct": "opening gap",
    "open_vs_pdh_pct": "open vs previous-day high",
    "first_bar_return": "first-bar return",
    "first_bar_range_normalized": "first-bar size (ATR)",
    "first_bar_body_to_range": "first-bar body/range",
    "first_bar_close_location": "first-bar close location",
    "first_bar_breaks_overnight_high": "first bar breaks overnight high",
    "extension_ratio": "post-spike extension",
    "post_spike_pullback_ratio": "post-spike pullback",
    "post_spike_overlap_ratio": "post-spike overlap",
    "post_spike_efficiency": "post-spike efficiency",
    "number_of_new_highs_after_first_bar": "new highs after first bar",
    "first_meaningful_lower_high_min": "time of first lower high",
    "first_bearish_expansion_min": "time of first bearish expansion",
    "first_break_first15m_low_min": "time breaking first-15m low",
    "time_below_open_frac": "time spent below the open",
}


def explain(pairs: DataFrame, per_class: int = 6, labels: dict[str, str] | None = None
            ) -> DataFrame:
    """Features that agree, roughly agree or differ, the most telling ones first; under the names
    that ``labels`` has for them."""
    long = pairs.select(*SESSION, F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.abs(C(f) - C(f"q_{f}")).alias("diff"))
        for f in FEATURES]))).where("diff is not null")
    cls = F.when(C("diff") < 0.5, "highly_similar").when(
        C("diff") < 1.5, "moderately_similar").otherwise("differed")
    key = F.when(C("cls") == "differed", -C("diff")).otherwise(C("diff"))
    w = Window.partitionBy(*SESSION, "cls").orderBy("key", "feature")
    top = (long.withColumn("cls", cls).withColumn("key", key)
           .withColumn("k", F.row_number().over(w)).where(C("k") <= per_class))

    known = F.create_map(*[F.lit(x) for pair in (labels or {}).items() for x in pair])

    def shown(f: Column) -> Column:
        return F.coalesce(F.try_element_at(known, f), f) if labels else f

    def names(c: str) -> Column:
        picked = F.array_sort(F.collect_list(F.when(C("cls") == c, F.struct("k", "feature"))))
        return F.array_join(F.transform(picked, lambda x: shown(x["feature"])), ", ").alias(c)

    return top.groupBy(*SESSION).agg(*[names(c) for c in (
        "highly_similar", "moderately_similar", "differed")])


def describe_session(d: DataFrame) -> DataFrame:
    """One sentence about a session, from its daily and opening features."""
    dist, gap = C("distance_open_to_ath_pct"), C("gap_pct")
    weak = F.least("first_meaningful_lower_high_min", "first_bearish_expansion_min")
    side = F.when(dist > 0, "above").otherwise("below")
    bar = F.when(C("first_bar_return") > 0, "bullish").otherwise("bearish")

    def shown(c: str) -> Column:
        return F.when(C(c).isNull(), "none").otherwise(F.format_string("%.2f", c))

    return d.select(*SESSION, F.concat_ws(
        "; ",
        F.when(dist.isNotNull(), F.when(C("ath_at_open"), "open at a new high").otherwise(
            F.format_string("open %.2f%% %s the high", F.abs(dist), side))),
        F.when(C("ath_reached_overnight"), "high reached overnight"),
        F.when(gap.isNotNull(), F.format_string("gap %+.2f%%", gap)),
        F.when(C("open_above_pdh"), "open above PDH").when(C("open_below_pdl"), "open below PDL"),
        F.when(C("first_bar_return").isNotNull(), F.when(
            C("first_bar_range_normalized").isNotNull(),
            F.format_string("first bar %s (%+.2f%%, %.2f ATR)", bar, "first_bar_return",
                            "first_bar_range_normalized"))
               .otherwise(F.format_string("first bar %s (%+.2f%%)", bar, "first_bar_return"))),
        F.when(C("extension_ratio").isNotNull(), F.format_string(
            "extension %.2f, overlap %s, efficiency %s", "extension_ratio",
            shown("post_spike_overlap_ratio"), shown("post_spike_efficiency"))),
        F.when(weak.isNotNull(), F.format_string("weak from minute %d", weak))
    ).alias("description"))
