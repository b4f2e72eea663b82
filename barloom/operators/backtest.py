"""Opening-drive continuation trades and performance statistics."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import (SESSION, before, count_where, earliest, in_session, latest,
                                       percentiles, ratio, upto, whole_session, yes)
from barloom.operators.bars import cash
from barloom.params import TradeRules

C = F.col
# The labels that are traded, and their side.
SIDES = {"DRIVE_UP": 1, "DRIVE_DOWN": -1}


def _initial_stop(mode: str, side: Column, entry: Column) -> Column:
    far = F.when(side > 0, C("obs_lo")).otherwise(C("obs_hi"))
    if mode == "opening_range":
        return far
    if mode == "half_range":
        mid = (C("obs_hi") + C("obs_lo")) / 2.0
        return F.when((entry - mid) * side > 0, mid).otherwise(far)
    if mode == "last_bar":
        return F.when(side > 0, C("last_lo")).otherwise(C("last_hi"))
    raise ValueError(mode)


def _priced(b: DataFrame, rules: TradeRules) -> DataFrame:
    """Keep sessions with enough bars and a real distance between entry and stop."""
    floor = F.greatest(F.lit(rules.min_risk_points),
                       rules.min_risk_frac * (C("obs_hi") - C("obs_lo")))
    return b.withColumn("risk", F.abs(C("entry") - C("stop_init"))).where(
        (C("n_obs") >= 3) & (C("n_aft") >= 2) & (C("risk") >= floor))


def _bars_of(bars: DataFrame, picked: DataFrame) -> DataFrame:
    b = cash(bars).select(*SESSION, "mso", C("adj_open").alias("o"), C("adj_high").alias("h"),
                          C("adj_low").alias("l"), C("adj_close").alias("c"))
    return b.join(picked.select(*SESSION, "label", "side"), SESSION)


def _facts(rules: TradeRules) -> dict[str, Column]:
    """What is known at the decision, as aggregates over a session's bars."""
    obs, aft = C("mso") < rules.decision_min, C("mso") >= rules.decision_min
    return {
        "n_obs": count_where(obs), "n_aft": count_where(aft),
        "obs_hi": F.max(F.when(obs, C("h"))), "obs_lo": F.min(F.when(obs, C("l"))),
        "last_hi": latest(C("h"), obs), "last_lo": latest(C("l"), obs),
        "entry": earliest(C("o"), aft)}


def picked_drives(context: DataFrame, labels: Sequence[str] = tuple(SIDES)) -> DataFrame:
    side = F.when(C("opening") == "DRIVE_UP", 1).otherwise(-1)
    return context.where(C("opening").isin(*labels)).select(
        *SESSION, C("opening").alias("label"), side.alias("side"))


def initial_stops(bars: DataFrame, context: DataFrame, rules: TradeRules = TradeRules(),
                  modes: Sequence[str] = ("opening_range", "half_range", "last_bar")) -> DataFrame:
    """Entry and stop of every tradeable session under each stop mode, from one pass."""
    d = _bars_of(bars, picked_drives(context)).groupBy(*SESSION, "label", "side").agg(
        *[v.alias(k) for k, v in _facts(rules).items()])
    stops = F.array(*[F.struct(F.lit(m).alias("stop_mode"), _initial_stop(
        m, C("side"), C("entry")).alias("stop_init")) for m in modes])
    return _priced(d.select("*", F.inline(stops)), rules).select(
        *SESSION, "stop_mode", "side", "entry", "stop_init", C("risk").alias("risk_points"))


def _entries(bars: DataFrame, picked: DataFrame, rules: TradeRules) -> DataFrame:
    """Bars from the decision on, with entry, stop, risk and target of their session.

    The facts at the decision are whole-session windows, so the bars of a session are
    exchanged once, together with their label.
    """
    b = _bars_of(bars, picked)
    b = b.withColumns({k: v.over(whole_session()) for k, v in _facts(rules).items()}).where(
        C("mso") >= rules.decision_min)
    b = _priced(b.withColumn("stop_init", _initial_stop(
        rules.stop_mode, C("side"), C("entry"))), rules)
    target = (C("entry") + C("side") * rules.target_r * C("risk")
              if rules.target_r else F.lit(None).cast("double"))
    return b.withColumn("target", target)


def _finish(t: DataFrame, rules: TradeRules) -> DataFrame:
    gross = C("side") * (C("exit_price") - C("entry"))
    return t.withColumn("gross_points", gross).withColumn(
        "net_points", C("gross_points") - rules.cost_points).withColumn(
        "r_multiple", C("net_points") / C("risk")).select(
        *SESSION, "label", "side", "entry", "stop_init", C("risk").alias("risk_points"),
        "exit_price", "exit_mso", "reason", "gross_points", "net_points", "r_multiple")


def _fixed_exits(b: DataFrame, rules: TradeRules) -> DataFrame:
    """Without a moving stop the exit is the earliest of three minutes; stop before target
    before time within a bar."""
    long_ = C("side") > 0
    stop = F.when(long_, C("l") <= C("stop_init")).otherwise(C("h") >= C("stop_init"))
    hit = yes(F.when(long_, C("h") >= C("target")).otherwise(C("l") <= C("target")))
    late = (C("mso") >= rules.time_exit_min) if rules.time_exit_min is not None else F.lit(False)
    keys = [*SESSION, "label", "side", "entry", "stop_init", "risk", "target"]
    t = b.groupBy(*keys).agg(
        F.min(F.when(stop, C("mso"))).alias("s"), F.min(F.when(hit, C("mso"))).alias("t"),
        F.min(F.when(late, C("mso"))).alias("x"), earliest(C("c"), late).alias("x_close"),
        F.max_by("c", "mso").alias("end_close"), F.max("mso").alias("end_mso"))
    never = F.lit(10 ** 6)
    s, tt, x = (F.coalesce(k, never) for k in ("s", "t", "x"))
    first = F.least(s, tt, x)
    t = t.withColumn("reason", F.when(first == never, "close").when(s == first, "stop")
                     .when(tt == first, "target").otherwise("time"))
    return t.withColumns({
        "exit_price": F.when(C("reason") == "stop", C("stop_init"))
        .when(C("reason") == "target", C("target")).when(C("reason") == "time", C("x_close"))
        .otherwise(C("end_close")),
        "exit_mso": F.when(C("reason") == "close", C("end_mso")).otherwise(first)})


def _moving_exits(b: DataFrame, rules: TradeRules) -> DataFrame:
    """With breakeven or trailing the stop depends on the bars seen so far: a fold over the
    session's bars. Breakeven sets the stop to the entry, then the trail may only tighten it;
    both act from the next bar on."""
    long_ = C("side") > 0
    k = rules.trail_bars
    if k:
        w = in_session().rowsBetween(-(k - 1), 0)
        full = F.row_number().over(in_session()) >= k
        trail = F.when(full, F.when(long_, F.min("l").over(w)).otherwise(F.max("h").over(w)))
    else:
        trail = F.lit(None).cast("double")
    keys = [*SESSION, "label", "side", "entry", "stop_init", "risk", "target"]
    d = b.withColumn("trail", trail).groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("mso", "h", "l", "c", "trail"))).alias("path"))
    start = F.struct(C("stop_init").alias("stop"), F.lit(False).alias("be"),
                     F.lit(None).cast("double").alias("px"), F.lit(None).cast("int").alias("at"),
                     F.lit(None).cast("string").alias("why"))

    def step(a: Column, x: Column) -> Column:
        stopped = F.when(long_, x["l"] <= a["stop"]).otherwise(x["h"] >= a["stop"])
        hit = yes(F.when(long_, x["h"] >= C("target")).otherwise(x["l"] <= C("target")))
        late = (x["mso"] >= rules.time_exit_min) if rules.time_exit_min is not None else F.lit(False)
        why = F.when(stopped, F.when(a["be"], "breakeven").otherwise("stop")).when(
            hit, "target").when(late, "time")
        px = F.when(stopped, a["stop"]).when(hit, C("target")).when(late, x["c"])
        run = F.when(long_, x["h"] - C("entry")).otherwise(C("entry") - x["l"])
        to_be = (~a["be"] & (run >= rules.breakeven_r * C("risk"))) if rules.breakeven_r else F.lit(False)
        base = F.when(to_be, C("entry")).otherwise(a["stop"])
        moved = F.when(x["trail"].isNull(), base).otherwise(F.when(
            long_, F.greatest(base, x["trail"])).otherwise(F.least(base, x["trail"])))
        done = a["why"].isNotNull()
        return F.when(done, a).otherwise(F.struct(
            moved.alias("stop"), (a["be"] | to_be).alias("be"), px.alias("px"),
            F.when(why.isNotNull(), x["mso"]).alias("at"), why.alias("why")))

    d = d.withColumn("r", F.aggregate("path", start, step)).withColumn(
        "end", F.element_at("path", -1))
    return d.withColumns({"reason": F.coalesce(C("r.why"), F.lit("close")),
                          "exit_price": F.coalesce(C("r.px"), C("end.c")),
                          "exit_mso": F.coalesce(C("r.at"), C("end.mso"))})


def drive_trades(bars: DataFrame, context: DataFrame, rules: TradeRules = TradeRules(),
                 labels: Sequence[str] = tuple(SIDES)) -> DataFrame:
    """One trade per session whose opening label is traded; untradeable sessions drop out.

    ``context`` needs the column ``opening`` only and may be narrowed beforehand; the side
    follows from the label.
    """
    b = _entries(bars, picked_drives(context, labels), rules)
    moving = rules.breakeven_r or rules.trail_bars
    return _finish((_moving_exits if moving else _fixed_exits)(b, rules), rules)


def performance(trades: DataFrame, by: Sequence[str] = (),
                order: Sequence[str] = ("session_date",)) -> DataFrame:
    """Expectancy, hit rate, profit factor, drawdown and t value per instrument and group.

    The equity curve runs over the trades of one instrument in session order, at most a few
    per session. Drawdown starts at the first trade's equity. A group without losses has no
    profit factor and says so.
    """
    keys = ["instrument_id", *by]
    w = Window.partitionBy(*keys).orderBy(*order)
    r = C("r_multiple")
    t = trades.withColumn("equity", F.sum(r).over(upto(w)))
    t = t.withColumn("drop", F.max("equity").over(upto(w)) - C("equity"))
    win, loss = F.when(r > 0, r), F.when(r <= 0, r)
    d = t.groupBy(*keys).agg(
        F.count(r).alias("n"), F.avg(r).alias("mean"), F.median(r).alias("median"),
        F.avg((r > 0).cast("double")).alias("hit"), F.avg(win).alias("aw"),
        F.avg(loss).alias("al"), F.coalesce(F.sum(win), F.lit(0.0)).alias("gp"),
        F.coalesce(-F.sum(loss), F.lit(0.0)).alias("gl"), F.sum(r).alias("total"),
        F.max("drop").alias("dd"), F.stddev_samp(r).alias("sd"))
    se = C("sd") / F.sqrt("n")
    zero = F.lit(0.0)
    return d.select(
        *keys, "n", F.round("mean", 4).alias("expectancy_r"), F.round("median", 4).alias("median_r"),
        F.round(100 * C("hit"), 1).alias("win_rate_pct"),
        F.coalesce(F.round("aw", 3), zero).alias("avg_win_r"),
        F.coalesce(F.round("al", 3), zero).alias("avg_loss_r"),
        F.when(C("gl") > 0, F.round(C("gp") / F.nullif(C("gl"), zero), 3)).alias("profit_factor"),
        (C("gl") <= 0).alias("no_losses"), F.round("total", 1).alias("total_r"),
        F.round("dd", 1).alias("max_drawdown_r"), F.round(se, 4).alias("se_r"),
        F.when(C("sd") > 0, F.round(C("mean") / F.nullif(se, zero), 2)).otherwise(0.0)
        .alias("t_stat"), (C("n") < 30).alias("small_sample"))


def max_drawdown(trades: DataFrame, by: Sequence[str], *levels: str,
                 value: str = "r_multiple") -> DataFrame:
    """Deepest fall of the running sum of ``value`` along ``levels``, columns that together order
    the rows of each ``by`` group and of which each is a span of the ones before it.

    A stretch of the curve is its sum, its highest and lowest prefix and its worst fall; these of
    two neighbours give those of both. They are composed level by level from the finest, each
    step one window inside the coarser keys, so the window of the last step spans one row for
    each value of the first level, not all trades.
    """
    r = C(value)
    d = trades.where(r.isNotNull()).select(
        *by, *levels, r.alias("sum"), r.alias("hi"), r.alias("lo"), F.lit(0.0).alias("fall"))
    for k in range(len(levels) - 1, -1, -1):
        keys = [*by, *levels[:k]]
        w = Window.partitionBy(*keys).orderBy(levels[k])
        start = F.coalesce(F.sum("sum").over(before(w)), F.lit(0.0))
        d = d.withColumns({"hi": start + C("hi"), "lo": start + C("lo")})
        d = d.withColumn("fall", F.greatest("fall", F.max("hi").over(before(w)) - C("lo")))
        d = d.groupBy(*keys).agg(F.sum("sum").alias("sum"), F.max("hi").alias("hi"),
                                 F.min("lo").alias("lo"), F.max("fall").alias("fall"))
    return d.select(*by, C("fall").alias("max_drawdown_r"))


def pooled_performance(trades: DataFrame, by: Sequence[str] = (),
                       levels: Sequence[str] = ("session_date", "instrument_id")) -> DataFrame:
    """Performance of all instruments as one book per group, traded in the order of ``levels``:
    plain aggregates and the composed drawdown."""
    r = C("r_multiple")
    win, loss = F.when(r > 0, r), F.when(r <= 0, r)
    d = trades.groupBy(*by).agg(
        F.count(r).alias("n"), F.avg(r).alias("expectancy_r"),
        (100 * F.avg((r > 0).cast("double"))).alias("win_rate_pct"),
        ratio(F.sum(win), -F.sum(loss)).alias("profit_factor"), F.sum(r).alias("total_r"),
        ratio(F.avg(r), F.stddev_samp(r) / F.sqrt(F.count(r))).alias("t_stat"))
    falls = max_drawdown(trades, by, *levels)
    return d.join(falls, list(by)) if by else d.crossJoin(falls)


def split_performance(trades: DataFrame, split_date: str,
                      order: Sequence[str] = ("session_date",)) -> DataFrame:
    """In sample, out of sample and all, in one pass over tagged rows."""
    before = C("session_date") < F.lit(split_date).cast("date")
    tags = F.array(F.when(before, "in-sample").otherwise("out-of-sample"), F.lit("all"))
    return performance(trades.withColumn("period", F.explode(tags)), ("period",), order)


def exit_mix(trades: DataFrame) -> DataFrame:
    n = F.sum("n").over(Window.partitionBy("instrument_id"))
    return (trades.groupBy("instrument_id", "reason")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("r_multiple").alias("mean_r"))
            .withColumn("share_pct", 100.0 * C("n") / n))


def r_quantiles(trades: DataFrame) -> DataFrame:
    """Deciles of R, best and worst, and whether the mean differs from zero."""
    qs = (0.10, 0.25, 0.50, 0.75, 0.90)
    r = C("r_multiple")
    se = F.stddev_samp(r) / F.sqrt(F.count(r))
    d = trades.groupBy("instrument_id").agg(
        F.count(r).alias("n"), percentiles(r, qs).alias("q"), F.max(r).alias("best"),
        F.min(r).alias("worst"), ratio(F.avg(r), se).alias("t"))
    return d.select("instrument_id", "n", *[C("q")[i].alias(f"p{int(q * 100)}")
                                            for i, q in enumerate(qs)], "best", "worst",
                    (F.abs(F.coalesce("t", F.lit(0.0))) < 2).alias("not_significant"))


def latest_sessions(d: DataFrame, n: int) -> DataFrame:
    """The last n distinct session dates of every instrument, newest first."""
    w = Window.partitionBy("instrument_id").orderBy(F.desc("session_date"))
    return (d.select(*SESSION).distinct().withColumn("k", F.row_number().over(w))
            .where(C("k") <= n))
