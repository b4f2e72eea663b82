"""Category labels of a session and filters over them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import (SESSION, all_of, count_where, ever, first_match, in_session,
                                       lag_session, last_match, latest, prior, ratio, upto, yes)
from barloom.operators.bars import cash
from barloom.params import CONTEXT_DIMENSIONS, Condition, ContextParams, ContextSpec

C = F.col


def prior_percentiles(x: Column, n: int, *qs: float) -> Column:
    """Several percentiles of the n sessions before: one walk over the frame for all."""
    return prior(x, n, max(20, n // 5), lambda v: F.percentile(v, [q / 100.0 for q in qs]))


LOCATION_COLUMNS = ("location", "swing", "ma_state", "ma_fast", "ma_slow", "ma_fast_slope",
                    "location_in_range", "distance_to_ath_pct", "range_high", "range_low")


def _with_location(d: DataFrame, p: ContextParams) -> DataFrame:
    """Moving averages, position in the recent range, location, swing and average state."""
    ref, hi, lo, close = (C("cash_open_adj"), C("cash_high_adj"), C("cash_low_adj"),
                          C("cash_close_adj"))
    d = d.withColumns({
        "ma_fast": prior(close, p.ma_fast, p.ma_fast // 2, F.avg),
        "ma_slow": prior(close, p.ma_slow, p.ma_slow // 2, F.avg),
        "usual_range": prior(hi - lo, p.ma_fast, 5, F.avg),
        "range_high": prior(hi, p.range_sessions, 5, F.max),
        "range_low": prior(lo, p.range_sessions, 5, F.min),
        "long_low": prior(lo, p.long_sessions, 40, F.min)})
    d = d.withColumn("ma_fast_slope", C("ma_fast") - lag_session(C("ma_fast"),
                                                                p.slope_sessions))
    d = d.withColumns({
        "location_in_range": ratio(ref - C("range_low"), C("range_high") - C("range_low")),
        "distance_to_ath_pct": 100.0 * ratio(ref - C("prior_ath"), C("prior_ath"))})
    to_low = 100.0 * ratio(ref - C("long_low"), C("long_low"))
    above, rising = yes(ref > C("ma_fast")), yes(C("ma_fast_slope") > 0)
    flat = F.abs("ma_fast_slope") < p.flat_frac * C("usual_range")
    up = yes((C("ma_fast") > C("ma_slow")) & (ref > C("ma_fast")))
    down = yes((C("ma_fast") < C("ma_slow")) & (ref < C("ma_fast")))
    dist, where = C("distance_to_ath_pct"), C("location_in_range")
    return d.withColumns({
        "ma_state": first_match([
            (C("ma_fast").isNull(), "UNKNOWN"), (above & rising, "ABOVE_RISING"),
            (above, "ABOVE_FALLING"), (rising, "BELOW_RISING")], "BELOW_FALLING"),
        "location": last_match("MID_RANGE", [
            (where <= p.lower_frac, "LOWER_RANGE"), (where >= p.upper_frac, "UPPER_RANGE"),
            (ref > C("range_high"), "BREAKOUT_UP"), (ref < C("range_low"), "BREAKDOWN"),
            (F.abs(to_low) <= p.near_high_pct, "AT_LOWS"),
            (F.abs(dist) <= p.near_high_pct, "NEAR_ATH"), (dist >= -p.at_high_pct, "AT_ATH"),
            (C("prior_ath").isNull(), "UNKNOWN")]),
        "swing": last_match("RANGE", [
            (up & rising, "BULL"), (down & ~rising, "BEAR"),
            (up & rising & (ref > C("range_high")), "STRONG_BULL"),
            (down & ~rising & (ref < C("range_low")), "STRONG_BEAR"),
            (flat, "RANGE"), (C("ma_slow").isNull(), "UNKNOWN")])})


PRIOR_DAY_COLUMNS = ("prior_day_type", "prior_day_close_loc", "prior_day_was_big_range",
                     "prior_3d_range_count")


def _with_prior_day(d: DataFrame, p: ContextParams) -> DataFrame:
    """Character of the session before."""
    h, lo, c = C("cash_high_adj"), C("cash_low_adj"), C("cash_close_adj")
    d = d.withColumns({
        "day_range": h - lo, "ph": lag_session(h), "pl": lag_session(lo),
        "day_close_loc": ratio(c - lo, h - lo)})
    d = d.withColumn("range_cuts", prior_percentiles(
        C("day_range"), p.pctl_sessions, p.big_range_pctl, p.quiet_range_pctl))
    higher, lower = h > C("ph"), lo < C("pl")
    top = C("day_close_loc") >= p.trend_close_loc
    bottom = C("day_close_loc") <= 1 - p.trend_close_loc
    is_big = yes(C("day_range") >= C("range_cuts")[0])
    d = d.withColumns({"is_big": is_big, "day_type": last_match("RANGE", [
        (top, "TREND_UP"), (bottom, "TREND_DOWN"), (C("day_range") <= C("range_cuts")[1], "RANGE"),
        ((h < C("ph")) & (lo > C("pl")), "INSIDE"), (higher & lower, "OUTSIDE"),
        (lower & top, "REVERSAL_UP"), (higher & bottom, "REVERSAL_DOWN"),
        (is_big, "BIG_RANGE")])})
    rangey = C("day_type").isin("RANGE", "INSIDE").cast("double")
    return d.withColumns({
        "prior_day_type": lag_session(C("day_type")),
        "prior_day_close_loc": lag_session(C("day_close_loc")),
        "prior_day_was_big_range": yes(lag_session(C("is_big"))),
        "prior_3d_range_count": prior(rangey, 3, 1, F.sum)})


OPEN_COLUMNS = ("gap_bucket", "open_loc", "overnight_type", "open_frac_in_pd_range",
                "overnight_close_loc")


def _with_open(d: DataFrame, p: ContextParams) -> DataFrame:
    """Gap size, place of the open in the previous range, character of the night."""
    a, op = F.abs("gap_pct"), C("cash_open_adj")
    on = {x: C(f"overnight_{x}_adj") for x in ("open", "high", "low", "close")}
    rng = F.nullif(on["high"] - on["low"], F.lit(0.0))
    d = d.withColumns({
        "gap_cuts": prior_percentiles(a, p.pctl_sessions, p.gap_flat_pctl, p.gap_small_pctl,
                                      p.gap_moderate_pctl),
        "open_frac_in_pd_range": ratio(op - C("previous_day_low"),
                                       C("previous_day_high") - C("previous_day_low")),
        "overnight_close_loc": (on["close"] - on["low"]) / rng,
        "dip": (on["open"] - on["low"]) / rng, "pop": (on["high"] - on["open"]) / rng})
    up, dn, frac = C("gap_pct") > 0, C("gap_pct") < 0, C("open_frac_in_pd_range")
    high_close = C("overnight_close_loc") >= p.overnight_close_loc
    low_close = C("overnight_close_loc") <= 1 - p.overnight_close_loc
    gap = [(side & (a > C("gap_cuts")[k]), f"{size}_{way}")
           for side, way in ((up, "UP"), (dn, "DOWN"))
           for k, size in enumerate(("SMALL", "MODERATE", "LARGE"))]
    return d.withColumns({
        "gap_bucket": last_match("FLAT", gap + [(C("gap_cuts").isNull(), "UNKNOWN")]),
        "open_loc": last_match("MID_PD", [
            (frac <= p.lower_frac, "LOWER_PD"), (frac >= p.upper_frac, "UPPER_PD"),
            (op > C("previous_day_high"), "ABOVE_PDH"), (op < C("previous_day_low"), "BELOW_PDL"),
            (C("previous_day_high").isNull(), "UNKNOWN")]),
        "overnight_type": last_match("RANGE", [
            (high_close, "TREND_UP"), (low_close, "TREND_DOWN"),
            (high_close & (C("dip") >= p.excursion_frac), "REVERSAL_UP"),
            (low_close & (C("pop") >= p.excursion_frac), "REVERSAL_DOWN"),
            (rng.isNull(), "UNKNOWN")])})


def daily_context(daily: DataFrame, p: ContextParams = ContextParams()) -> DataFrame:
    return _with_location(daily, p).select(*SESSION, *LOCATION_COLUMNS)


def prior_day_context(daily: DataFrame, p: ContextParams = ContextParams()) -> DataFrame:
    return _with_prior_day(daily, p).select(*SESSION, "day_type", "day_range", "day_close_loc",
                                            *PRIOR_DAY_COLUMNS)


def open_context(daily: DataFrame, p: ContextParams = ContextParams()) -> DataFrame:
    return _with_open(daily, p).select(*SESSION, *OPEN_COLUMNS)


def window_geometry(bars: DataFrame, window_min: int, prefix: str, *extra: Column) -> DataFrame:
    """Shape of the first minutes of every session, relative to the session's first open.

    Sessions keep a row as long as they have a cash bar; with none inside the window the
    shape is NULL. ``extra`` aggregates ride along in the same pass.
    """
    w = in_session()
    b = cash(bars).select(*SESSION, "mso", C("adj_open").alias("o"), C("adj_high").alias("h"),
                          C("adj_low").alias("l"), C("adj_close").alias("c"))
    b = b.withColumns({f"p{x}": F.lag(x).over(w) for x in ("h", "l")})
    inw = C("mso") < window_min

    def n(cond: Column) -> Column:
        return count_where(inw & cond)

    g = b.groupBy(*SESSION).agg(
        F.min_by("o", "mso").alias("cash_open"), n(F.lit(True)).alias("n_bars"),
        F.max(F.when(inw, C("h"))).alias("win_high"), F.min(F.when(inw, C("l"))).alias("win_low"),
        latest(C("c"), inw).alias("win_close"),
        n(C("c") < C("o")).alias("n_bear_bars"), n(C("c") > C("o")).alias("n_bull_bars"),
        n(C("h") < C("ph")).alias("falling_highs"), n(C("l") > C("pl")).alias("rising_lows"),
        ever(inw & (C("c") < C("pl"))).alias("close_below_prior_low"),
        ever(inw & (C("c") > C("ph"))).alias("close_above_prior_high"), *extra)
    hi, lo, c, o = C("win_high"), C("win_low"), C("win_close"), C("cash_open")
    some, rng = C("n_bars") > 0, F.nullif(hi - lo, F.lit(0.0))
    steps = F.greatest(C("n_bars") - 1, F.lit(2))
    cols = {
        "n_bars": C("n_bars"), "win_high": hi, "win_low": lo, "win_close": c,
        "close_location": (c - lo) / rng, "up_excursion": (hi - o) / rng,
        "down_excursion": (o - lo) / rng,
        "close_below_open": c < o, "close_above_open": c > o,
        "n_bear_bars": F.when(some, C("n_bear_bars")),
        "n_bull_bars": F.when(some, C("n_bull_bars")),
        "monotonic_lower_highs": F.when(some, C("falling_highs") == steps),
        "monotonic_higher_lows": F.when(some, C("rising_lows") == steps),
        "close_below_prior_low": F.when(some, C("close_below_prior_low")),
        "close_above_prior_high": F.when(some, C("close_above_prior_high")),
        "poked_above_open": hi > o, "poked_below_open": lo < o,
        "spike_up_reject": (hi > o) & (c < o), "spike_down_reject": (lo < o) & (c > o),
        "open_is_high": hi <= o + 1e-9, "open_is_low": lo >= o - 1e-9}
    keep = [x for x in g.columns if x not in {*SESSION, *cols, "falling_highs", "rising_lows"}]
    return g.select(*SESSION, *keep, *[v.alias(f"{prefix}{k}") for k, v in cols.items()])


def ema(values: Column, span: int) -> Column:
    """Last value of the recursion y = a*x + (1-a)*y, started at the first value."""
    a = 2.0 / (span + 1)
    return F.aggregate(values, F.lit(None).cast("double"),
                       lambda y, x: F.when(y.isNull(), x).otherwise(y + a * (x - y)))


def openings(bars: DataFrame, p: ContextParams = ContextParams()) -> DataFrame:
    """Opening label of sessions with at least two bars before the decision."""
    early = C("mso") <= p.opening_window_min - 1
    # A session needs two bars before the decision, so its first bar lies there too and later
    # ones don't matter.
    soon = bars.where(C("mso") < max(p.opening_window_min, p.decision_min))
    g = window_geometry(
        soon, p.opening_window_min, "op_",
        count_where(C("mso") < p.decision_min).alias("n_before"),
        F.array_sort(F.collect_list(F.when(early, F.struct("mso", "c")))).alias("closes"))
    g = g.where("n_before >= 2").withColumn(
        "op_ema", ema(F.transform("closes", lambda x: x["c"]), p.ema_span))
    above, below, loc = C("op_close_above_open"), C("op_close_below_open"), C("op_close_location")
    at_top, at_bottom = loc >= p.drive_close_loc, loc <= p.reject_close_loc
    label = first_match([
        (below & at_bottom & (C("op_up_excursion") >= p.excursion_frac), "REJECTION_UP"),
        (above & at_top & (C("op_down_excursion") >= p.excursion_frac), "REJECTION_DOWN"),
        (above & at_top, "DRIVE_UP"), (below & at_bottom, "DRIVE_DOWN")], "RANGE_OPEN")
    return g.withColumns({
        "opening": F.when(C("op_n_bars") > 0, label),
        "op_close_vs_ema": F.when(C("op_win_close") > C("op_ema"), "ABOVE").when(
            C("op_ema").isNotNull() & C("op_win_close").isNotNull(), "BELOW")}).select(
        *SESSION, "opening", "op_win_high", "op_win_low", "op_win_close", "op_close_location",
        "op_up_excursion", "op_down_excursion", "op_poked_above_open", "op_poked_below_open",
        "op_close_above_open", "op_n_bear_bars", "op_n_bull_bars",
        C("op_monotonic_lower_highs").alias("op_lower_highs"),
        C("op_monotonic_higher_lows").alias("op_higher_lows"), "op_close_below_prior_low",
        "op_close_above_prior_high", "op_close_vs_ema", "op_ema")


def context_table(bars: DataFrame, daily: DataFrame,
                  p: ContextParams = ContextParams()) -> DataFrame:
    """One row per session with every label. The daily labels are columns on one chain over
    the session rows, joined once with the opening labels."""
    d = _with_open(_with_prior_day(_with_location(daily, p), p), p).select(
        *SESSION, *LOCATION_COLUMNS, *PRIOR_DAY_COLUMNS, *OPEN_COLUMNS)
    return d.join(openings(bars, p), SESSION)


def _holds(c: Condition) -> Column:
    if c.among:
        return C(c.column).isin(*c.among)
    return C(c.column) if c.least is None else C(c.column) >= c.least


def matches_context(spec: ContextSpec) -> Column:
    return all_of([_holds(c) for c in spec.conditions])


def funnel(table: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Sessions surviving each condition, cumulatively: one pass, one row per step."""
    passed, aggs = F.lit(True), [F.count(F.lit(1)).alias("s0")]
    for k, (_, cond) in enumerate(steps, 1):
        passed = passed & yes(cond)
        aggs.append(count_where(passed).alias(f"s{k}"))
    names = ["all sessions", *[name for name, _ in steps]]
    rows = F.array(*[
        F.struct(F.lit(k).alias("step_no"), F.lit(name).alias("step"),
                 C(f"s{k}").alias("surviving"),
                 (C(f"s{max(k - 1, 0)}") - C(f"s{k}")).alias("cut"))
        for k, name in enumerate(names)])
    return table.groupBy("instrument_id").agg(*aggs).select("instrument_id", F.inline(rows))


def context_funnel(table: DataFrame, spec: ContextSpec) -> DataFrame:
    return funnel(table, [(str(c), _holds(c)) for c in spec.conditions])


def label_mix(table: DataFrame) -> DataFrame:
    """Count and share of every label per dimension."""
    long = table.select("instrument_id", F.inline(F.array(*[
        F.struct(F.lit(d).alias("dimension"), C(d).alias("label"))
        for d in CONTEXT_DIMENSIONS]))).where("label is not null")
    n = F.sum("n").over(Window.partitionBy("instrument_id", "dimension"))
    return (long.groupBy("instrument_id", "dimension", "label")
            .agg(F.count(F.lit(1)).alias("n")).withColumn("share_pct", 100.0 * C("n") / n))


def _by_session(bars: DataFrame) -> DataFrame:
    """A row for each session with its bars as one sorted array: as many entries as the clock has
    slots."""
    rest = [c for c in bars.columns if c not in (*SESSION, "mso")]
    return bars.groupBy(*SESSION).agg(
        F.array_sort(F.collect_list(F.struct("mso", *rest))).alias("__bars"))


def _steps(bars: Column, keep: float, start: Column) -> Column:
    """The average after the last of the bars."""
    return F.aggregate(bars, start, lambda y, b: keep * y + F.coalesce(
        (1.0 - keep) * b["adj_close"], F.lit(0.0)))


def _trail(xs: Column, start: Column, step) -> Column:
    """``start`` and what it becomes after each of the entries: one value more than entries."""
    return F.aggregate(xs, F.array(start), lambda ys, x: F.concat(
        ys, F.array(step(F.element_at(ys, -1), x))))


def _with_averages(sessions: DataFrame, spans: dict[str, int]) -> DataFrame:
    """Sessions with an array of averages for each of the names, one value for each bar.

    A bar is an affine step y -> (1-a)*y + a*x. The steps of a session compose to its length and the
    part that does not depend on its start; the sessions of an instrument are walked once, on one
    small entry each, which gives the value every session starts from. So no task holds more than
    the bars of a session or one entry for each session, however long the frame.
    """
    keeps = {name: 1.0 - 2.0 / (span + 1) for name, span in spans.items()}
    part = [_steps(C("__bars"), k, F.lit(0.0)).alias(name) for name, k in keeps.items()]
    own = sessions.select(*SESSION, F.size("__bars").alias("n"),
                          F.element_at("__bars", 1)["adj_close"].alias("first"), *part)
    days = own.groupBy("instrument_id").agg(F.array_sort(F.collect_list(F.struct(
        "session_date", "n", "first", *keeps))).alias("days"))
    start = F.element_at("days", 1)["first"]
    before = {name: _trail(C("days"), start, lambda y, d, name=name, k=k: F.pow(
        F.lit(k), d["n"]) * y + d[name]) for name, k in keeps.items()}
    starts = days.select("instrument_id", "days", *[v.alias(k) for k, v in before.items()]).select(
        "instrument_id", F.inline(F.arrays_zip(
            F.transform("days", lambda d: d["session_date"]).alias("session_date"),
            *[F.slice(C(k), 1, F.size("days")).alias(f"__{k}") for k in keeps])))
    return sessions.join(starts, SESSION).withColumns({f"__{name}": F.slice(_trail(
        C("__bars"), C(f"__{name}"), lambda y, b, k=k: k * y + F.coalesce(
            (1.0 - k) * b["adj_close"], F.lit(0.0))), 2, F.size("__bars"))
        for name, k in keeps.items()})


def running_average(bars: DataFrame, span: int, name: str) -> DataFrame:
    """Adds the recursion y = a*x + (1-a)*y over ``adj_close``, started at the first value, along
    the bars of each instrument."""
    f = _with_averages(_by_session(bars), {name: span})
    f = f.select(*SESSION, F.inline(F.arrays_zip("__bars", F.col(f"__{name}").alias("y"))))
    return f.select(*[C(c) if c in SESSION else C(f"__bars.{c}") for c in bars.columns],
                    C("y").alias(name))


def multiday_frame(bars: DataFrame, upto_dates: DataFrame, lookback: int = 2,
                   fast: int = 20, slow: int = 50) -> DataFrame:
    """Cash bars of a date and the sessions before it on one index, with running averages.

    ``upto_dates``: instrument_id, last_date. The bars are dealt to their sessions once and stay
    arrays to the end; the dates are picked on session rows, and the index of a bar is its place in
    its session after the bars of the sessions before.
    """
    b = _by_session(cash(bars).select(*SESSION, "mso", "adj_close"))
    per = b.select(*SESSION, F.size("__bars").alias("n")).join(upto_dates, "instrument_id")
    rank = Window.partitionBy("instrument_id").orderBy(F.desc("session_date"))
    days = (per.where("session_date <= last_date").withColumn("k", F.row_number().over(rank))
            .withColumn("newest", F.first("session_date").over(rank))
            .where((C("k") <= lookback + 1) & (C("newest") == C("last_date"))))
    order = Window.partitionBy("instrument_id").orderBy("session_date")
    days = days.select(*SESSION, (F.sum("n").over(upto(order)) - C("n")).alias("before"))
    f = _with_averages(b.join(days, SESSION), {"ema_fast": fast, "ema_slow": slow})
    f = f.select(*SESSION, "before", F.posexplode(F.arrays_zip(
        "__bars", C("__ema_fast").alias("fast"), C("__ema_slow").alias("slow"))).alias("i", "b"))
    return f.select("instrument_id", (C("before") + C("i")).cast("int").alias("x"), "session_date",
                    "b.__bars.mso", "b.__bars.adj_close", C("b.fast").alias("ema_fast"),
                    C("b.slow").alias("ema_slow"))
