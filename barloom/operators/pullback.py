"""Opening trend, controlled pullback, continuation trigger: the bar-by-bar state of a session.

The walk is causal, so every quantity is a running window over the bars of one session. All
windows share one partitioning and one order; only the pullback extreme, which restarts with
each new extreme of the leg, sorts once more inside the same partitioning.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import (SESSION, before, clock, count_where, in_session, ratio,
                                       upto, whole_session, yes)
from barloom.operators.bars import cash
from barloom.params import PullbackParams, SessionParams
from barloom.plans.storage import dealt

C = F.col
BULL, BEAR = 1, -1
# States by rank.
STATES = ("INVALID", "DEVELOPING", "ACTIVE")


def _steps(s: str) -> dict[str, Column]:
    """Bar against bar and against the extremes so far."""
    w, a, o = in_session(), C(f"{s}_a"), C(f"{s}_o")
    return {
        f"{s}_step": yes((a > F.lag(a).over(w)) & (o > F.lag(o).over(w))),
        f"{s}_dir": F.signum(a - F.lag(a).over(w)).cast("int"),
        f"{s}_new": yes(a > F.max(a).over(before(w))),
        f"{s}_ext": F.max(a).over(upto(w)),
        f"{s}_first": F.first(a).over(w),
        f"{s}_deep": F.min(F.when(C("i") > 0, o)).over(upto(w)),
        f"{s}_origin": F.first(o).over(w)}


def _legs(s: str) -> dict[str, Column]:
    """Leg, whether its origin holds, and the bars that complete a correction."""
    w, step, new, turn = in_session(), C(f"{s}_step"), C(f"{s}_new"), C(f"{s}_dir")
    last_turn = F.last(F.nullif(turn, F.lit(0)), True).over(before(w))
    return {
        f"{s}_beyond": F.sum((C(f"{s}_a") > C(f"{s}_first")).cast("int")).over(upto(w)),
        f"{s}_twice": F.max(step & F.lag(step, 1, False).over(w)).over(upto(w)),
        f"{s}_run": C("i") - F.max(F.when(~step, C("i"))).over(upto(w)),
        f"{s}_ext_mso": F.max(F.when(new | (C("i") == 0), C("mso"))).over(upto(w)),
        f"{s}_held": F.coalesce(C(f"{s}_deep") >= C(f"{s}_origin"), F.lit(True)),
        f"{s}_sig": yes((turn == 1) & ~new & (last_turn == -1)),
        f"{s}_grp": F.sum(new.cast("int")).over(upto(w))}


def _counts(s: str) -> dict[str, Column]:
    """Number and depth of the correction since the leg's last new extreme."""
    g = upto(Window.partitionBy(*SESSION, f"{s}_grp").orderBy("mso"))
    return {
        f"{s}_count": F.sum(C(f"{s}_sig").cast("int")).over(g),
        f"{s}_pull": F.min(F.when(C(f"{s}_dir") == -1, C(f"{s}_o"))).over(g),
        f"{s}_best": F.max(f"{s}_run").over(upto(in_session()))}


def walk(bars: DataFrame, p: PullbackParams = PullbackParams()) -> DataFrame:
    """The cash bars up to the deadline, each with its leg, the state it leaves the session in,
    and its signal. A session without such a bar keeps its first one, which is not evaluated;
    ``n`` counts all bars of the session."""
    w = in_session()
    b = cash(bars).select(*SESSION, "mso", "adj_high", "adj_low", "adj_close").withColumns({
        "i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(whole_session())})
    b = b.where((C("mso") <= p.deadline_min) | (C("i") == 0))
    # up is with a bull leg; a bear leg is the same on negated lows and highs
    b = b.withColumns({"bull_a": C("adj_high"), "bull_o": C("adj_low"),
                       "bear_a": -C("adj_low"), "bear_o": -C("adj_high")})
    for layer in (_steps, _legs, _counts):
        b = b.withColumns(layer("bull") | layer("bear"))

    def pick(bull: Column, bear: Column) -> Column:
        return F.when(C("side") == BULL, bull).when(C("side") == BEAR, bear)

    evaluated = (C("n") >= 4) & (C("i") >= 2) & (C("mso") <= p.deadline_min)
    b = b.withColumns({
        "evaluated": evaluated,
        "side": F.when(evaluated & C("bull_twice") & (C("bull_beyond") >= 2), BULL)
        .when(evaluated & C("bear_twice") & (C("bear_beyond") >= 2), BEAR)})
    b = b.withColumns({
        "held": pick(C("bull_held"), C("bear_held")),
        "leg_origin_px": pick(C("bull_origin"), -C("bear_origin")),
        "leg_extreme_px": pick(C("bull_ext"), -C("bear_ext")),
        "leg_extreme_mso": pick(C("bull_ext_mso"), C("bear_ext_mso")),
        "steps_in_row": pick(C("bull_best"), C("bear_best")),
        "followthrough_bars": pick(C("bull_beyond"), C("bear_beyond"))})
    b = b.withColumn("signal", yes(C("held") & pick(C("bull_sig"), C("bear_sig"))))
    e, s = C("signal"), C("side")
    b = b.withColumns({
        "state": F.when(~evaluated, None).when(~yes(C("held")), STATES[0])
        .when(e, STATES[2]).otherwise(STATES[1]),
        "count": F.when(e, pick(C("bull_count"), C("bear_count"))),
        "kind": F.when(e, pick(F.lit("H"), F.lit("L"))),
        "entry_px": F.when(e, pick(C("adj_high") + p.tick, C("adj_low") - p.tick)),
        "pullback_px": F.when(e, pick(C("bull_pull"), -C("bear_pull"))),
        "stop_px": F.when(e, pick(F.least("adj_low", "bull_pull") - p.tick,
                                  F.greatest(C("adj_high"), -C("bear_pull")) + p.tick))})
    return b.select(
        *SESSION, "mso", "i", "n", "adj_high", "adj_low", "adj_close", "evaluated", "side",
        "held", "leg_origin_px", "leg_extreme_px", "leg_extreme_mso", "steps_in_row",
        "followthrough_bars", "signal", "state", "kind", "count", "entry_px", "stop_px",
        "pullback_px", F.concat("kind", C("count").cast("string")).alias("label"),
        (F.array_position(F.array(*[F.lit(x) for x in STATES]), C("state")) - 1)
        .cast("int").alias("state_rank"))


def nearest_target(entry: Column, side: Column, levels: dict[str, Column]) -> Column:
    """Nearest level strictly beyond the entry as (dist, name, px); equal distance by name."""
    cands = F.array(*[F.struct(F.abs(v - entry).alias("dist"), F.lit(k).alias("name"),
                               v.alias("px")) for k, v in levels.items()])
    return F.array_min(F.filter(cands, lambda x: yes((x["px"] - entry) * side > 0)))


# What a signal row carries from its bar.
SIGNAL = ("mso", "label", "kind", "count", "side", "entry_px", "stop_px", "pullback_px",
          "leg_origin_px", "leg_extreme_px", "leg_extreme_mso")


def _with_targets(s: DataFrame, levels: DataFrame, p: PullbackParams, *keep: str) -> DataFrame:
    """Join the session's levels; ``k`` numbers the signals of a session from 0."""
    s = s.join(levels.select(*SESSION, "pdh", "pdc", "pdl", "onh", "onl"), SESSION)
    named = {"PDH": C("pdh"), "PDC": C("pdc"), "PDL": C("pdl"), "ONH": C("onh"),
             "ONL": C("onl"), "SESSION_EXTREME": C("leg_extreme_px")}
    s = s.withColumns({"target": nearest_target(C("entry_px"), C("side"), named),
                       "risk_points": F.abs(C("entry_px") - C("stop_px")),
                       "taken": C("k") < p.max_entries})
    return s.select(
        *SESSION, C("mso").alias("signal_mso"), "label", "kind", "count", "side", "entry_px",
        "stop_px", C("target.name").alias("target_name"), C("target.px").alias("target_px"),
        F.round(ratio(F.abs(C("target.px") - C("entry_px")), C("risk_points")), 2).alias("rr"),
        "taken", "risk_points", "pullback_px", "leg_origin_px", "leg_extreme_px",
        "leg_extreme_mso", F.when(C("taken"), "").otherwise("max_entries reached").alias("note"),
        *keep)


def signals(walked: DataFrame, levels: DataFrame,
            p: PullbackParams = PullbackParams()) -> DataFrame:
    """Signals with target, reward to risk and whether the entry cap leaves room for them.

    ``levels``: instrument_id, session_date and the columns pdh, pdc, pdl, onh, onl. Only
    sessions with a row there are traded.
    """
    s = walked.where("signal").select(*SESSION, *SIGNAL).withColumn(
        "k", F.row_number().over(in_session()) - 1)
    return _with_targets(s, levels, p)


def session_states(walked: DataFrame, *extra: Column) -> DataFrame:
    """Per session: state on the last evaluated bar, furthest state, the trace, last leg.

    A session holds at most the bars up to the deadline, so its trace is a short array.
    """
    ev = C("evaluated")
    leg = ev & C("side").isNotNull()
    d = walked.groupBy(*SESSION).agg(
        F.max_by(F.when(ev, C("state_rank")), F.when(ev, C("mso"))).alias("now"),
        F.max(F.when(ev, C("state_rank"))).alias("rank"),
        F.array_sort(F.collect_list(F.when(ev, F.struct("mso", "state")))).alias("trace"),
        F.max(F.when(ev, C("mso"))).alias("last_mso"),
        count_where(C("signal")).alias("n_signals"),
        F.max_by(F.when(leg, C("side")), F.when(leg, C("mso"))).alias("leg_side"),
        F.max_by(F.when(leg, C("followthrough_bars")), F.when(leg, C("mso")))
        .alias("followthrough_bars"), *extra)
    names = F.array(*[F.lit(x) for x in STATES])
    return d.withColumns({
        "state": F.element_at(names, F.coalesce("now", F.lit(0)) + 1),
        "reached": F.element_at(names, F.coalesce("rank", F.lit(0)) + 1)}).drop("now", "rank")


def state_profile(states: DataFrame) -> DataFrame:
    """How many sessions got how far, per instrument."""
    n = F.sum("n_sessions").over(Window.partitionBy("instrument_id"))
    return (states.groupBy("instrument_id", "reached").agg(F.count(F.lit(1)).alias("n_sessions"))
            .withColumn("share_pct", 100.0 * C("n_sessions") / n))


def decisions(walked: DataFrame, levels: DataFrame, p: PullbackParams = PullbackParams(),
              sp: SessionParams = SessionParams()) -> DataFrame:
    """What to do at the deadline. Replaying an earlier minute is an earlier deadline.

    Only the last signal within the entry cap matters, so it is taken from the session's short
    signal list and priced against the levels inside the row.
    """
    taken = F.slice(F.array_sort(F.collect_list(F.when(C("signal"), F.struct(*SIGNAL)))), 1,
                    p.max_entries)
    d = session_states(walked, taken.alias("taken"))
    d = d.withColumns({"s": F.try_element_at("taken", F.lit(-1)), "n_taken": F.size("taken")})
    return _decided(d, levels, sp)


def _decided(d: DataFrame, levels: DataFrame, sp: SessionParams, *keep: str) -> DataFrame:
    """The decision out of states and the last signal taken, ``s``."""
    d = d.join(levels.select(*SESSION, "pdh", "pdc", "pdl", "onh", "onl"), SESSION, "left")
    entry = C("s.entry_px")
    named = {"PDH": C("pdh"), "PDC": C("pdc"), "PDL": C("pdl"), "ONH": C("onh"),
             "ONL": C("onl"), "SESSION_EXTREME": C("s.leg_extreme_px")}
    target = nearest_target(entry, C("s.side"), named)["px"]
    d = d.withColumns({
        "last_label": C("s.label"), "last_signal_mso": C("s.mso"),
        "last_rr": F.round(ratio(F.abs(target - entry), F.abs(entry - C("s.stop_px"))), 2)})
    live = C("last_signal_mso").isNotNull()
    fresh = yes(C("last_signal_mso") == C("last_mso"))
    d = d.withColumn(
        "decision",
        F.when(C("leg_side").isNull(), "PASS")
        .when((C("state") == STATES[2]) & fresh,
              F.when(F.coalesce("last_rr", F.lit(0.0)) >= 1, "TAKE").otherwise("TAKE_LOW_RR"))
        .when(live, "NO_NEW_ENTRY")
        .when(C("state") == STATES[1], "WAIT").otherwise("PASS"))
    trend = F.when(C("leg_side") == BULL, "up").when(C("leg_side") == BEAR, "down")
    said = F.concat_ws(
        "; ", F.concat(F.lit("state "), C("state")),
        F.coalesce(F.concat(F.lit("trend "), trend), F.lit("no trend from the open")),
        F.concat(F.lit("bars beyond the first: "), C("followthrough_bars").cast("string")),
        F.concat(F.lit("last trigger "), C("last_label"), F.lit(" at "),
                 clock(C("last_signal_mso") + sp.open_min)),
        F.concat(F.lit("decision "), C("decision")))
    return d.select(*SESSION, *keep, "state", "reached", "leg_side", "followthrough_bars", "last_label",
                    "last_signal_mso", "last_rr", C("n_taken").cast("long").alias("n_taken"),
                    "decision", said.alias("sentence"))


def session_of(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds to requests (instrument_id, asked_date) the session they mean: the last one up to
    that date, or the first of all. One window over the dates of an instrument."""
    known = sessions.select("instrument_id", C("session_date").alias("at"),
                            C("session_date").alias("known")).distinct()
    asked = requests.select("instrument_id", C("asked_date").alias("at"), F.lit(None).cast("date")
                            .alias("known"), F.struct(*requests.columns).alias("request"))
    w = Window.partitionBy("instrument_id")
    both = known.unionByName(asked, allowMissingColumns=True).withColumn(
        "session_date", F.coalesce(F.last("known", True).over(upto(w.orderBy("at", F.col(
            "request").isNotNull()))), F.min("known").over(w)))
    return both.where("request is not null").select("request.*", "session_date")


def snapshots(walked: DataFrame, p: PullbackParams = PullbackParams()) -> DataFrame:
    """What is known of a session from each of its bars on, until the next bar. The first bar is
    not evaluated and stands for all minutes before the second."""
    w = in_session()
    ev, mso = C("evaluated"), C("mso")
    leg = ev & C("side").isNotNull()

    def latest_of(cond: Column, x: Column) -> Column:
        return F.last(F.when(cond, x), True).over(upto(w))

    d = walked.withColumn("n_signals", F.sum(C("signal").cast("int")).over(upto(w)))
    d = d.withColumns({
        "until": F.lead(mso).over(w), "now": latest_of(ev, C("state_rank")),
        "rank": F.max(F.when(ev, C("state_rank"))).over(upto(w)), "last_mso": latest_of(ev, mso),
        "leg_side": latest_of(leg, C("side")),
        "followthrough_bars": latest_of(leg, C("followthrough_bars")),
        "s": latest_of(C("signal") & (C("n_signals") <= p.max_entries), F.struct(*SIGNAL)),
        "n_taken": F.least(C("n_signals"), F.lit(p.max_entries))})
    names = F.array(*[F.lit(x) for x in STATES])
    return d.select(
        *SESSION, F.when(C("i") > 0, mso).alias("since"), "until", "leg_side", "followthrough_bars", "last_mso",
        "s", "n_taken", F.element_at(names, F.coalesce("now", F.lit(0)) + 1).alias("state"),
        F.element_at(names, F.coalesce("rank", F.lit(0)) + 1).alias("reached"))


def replay(bars: DataFrame, levels: DataFrame, requests: DataFrame,
           p: PullbackParams = PullbackParams(), sp: SessionParams = SessionParams()) -> DataFrame:
    """The decision as it stood at any minutes of any sessions, all requests in one pass.

    ``requests``: instrument_id, asked_date, as_of (minutes since the open). The walk looks back
    only, so it runs once to the close, and a request takes the snapshot of the last bar up to its
    minute: one equality join by session, of which each request keeps one row. A request before
    the first bar finds the state that a session starts in. The walk sorts whole sessions several
    times over, so they are dealt to tasks whose share does not grow with the bars.
    """
    narrow = bars.select(*SESSION, "mso", "is_cash", "adj_high", "adj_low", "adj_close")
    walked = walk(dealt(narrow, *SESSION), p.but(deadline_min=sp.close_min - sp.open_min))
    asked = session_of(requests, levels)
    found = asked.join(snapshots(walked, p), SESSION).where(
        (C("since").isNull() | (C("since") <= C("as_of")))
        & (C("until").isNull() | (C("as_of") < C("until"))))
    return _decided(found, levels, sp, "asked_date", "as_of")


def _path() -> Column:
    """The bars of a session as one sorted array: as many entries as the clock has slots."""
    return F.array_sort(F.collect_list(F.struct("mso", "adj_high", "adj_low", "adj_close")))


def simulate(sigs: DataFrame, bars: DataFrame,
             p: PullbackParams = PullbackParams()) -> DataFrame:
    """Forward test of each taken signal as a stop order; skipped ones are NOT_TAKEN."""
    path = cash(bars).groupBy(*SESSION).agg(_path().alias("path"))
    return _forward(sigs.join(path, SESSION), p)


def _forward(s: DataFrame, p: PullbackParams) -> DataFrame:
    """Outcome of each signal from the bars after it, as arithmetic inside the row.

    First-hit minutes decide: the entry (E), the stop level breaking on a bar that does not
    fill (D), and after E the stop (S) and the target (T). Stop wins a tie and the fill bar is
    tested for the stop only.
    """
    s = s.withColumn("path", F.filter("path", lambda x: x["mso"] > C("signal_mso")))
    side = C("side")

    def reaches(x: Column, px: Column) -> Column:
        """Price trades through px in the trade direction."""
        return F.when(side > 0, x["adj_high"] >= px).otherwise(x["adj_low"] <= px)

    def stops(x: Column) -> Column:
        return F.when(side > 0, x["adj_low"] <= C("stop_px")).otherwise(
            x["adj_high"] >= C("stop_px"))

    def first(cond) -> Column:
        return F.array_min(F.transform(F.filter("path", cond), lambda x: x["mso"]))

    s = s.withColumns({
        "e": first(lambda x: reaches(x, C("entry_px"))),
        "d": first(lambda x: ~reaches(x, C("entry_px")) & stops(x))})
    s = s.withColumns({
        "s_at_e": F.exists("path", lambda x: (x["mso"] == C("e")) & stops(x)),
        "s": first(lambda x: (x["mso"] > C("e")) & stops(x)),
        "t": first(lambda x: (x["mso"] > C("e")) & yes(reaches(x, C("target_px")))),
        "last": F.try_element_at("path", F.lit(-1))})
    never = F.lit(10 ** 6)
    st, tt = F.coalesce("s", never), F.coalesce("t", never)
    s = s.withColumn(
        "status", F.when(~C("taken"), "NOT_TAKEN")
        .when((C("risk_points") <= 0) | (F.coalesce("e", "d").isNull()), "NOT_TRIGGERED")
        .when(C("d").isNotNull() & (C("e").isNull() | (C("d") < C("e"))), "CANCELLED")
        .otherwise("TRADED"))
    traded = C("status") == "TRADED"
    s = s.withColumn("reason", F.when(
        traded, F.when(yes(C("s_at_e")), "stop").when((st <= tt) & C("s").isNotNull(), "stop")
        .when(tt < st, "target").otherwise("close")))
    s = s.withColumns({
        "exit_px": F.when(C("reason") == "stop", C("stop_px"))
        .when(C("reason") == "target", C("target_px"))
        .when(C("reason") == "close", C("last.adj_close")),
        "exit_mso": F.when(C("reason") == "stop", F.when(yes(C("s_at_e")), C("e")).otherwise(C("s")))
        .when(C("reason") == "target", C("t")).when(C("reason") == "close", C("last.mso"))})
    s = s.withColumn("net_points", side * (C("exit_px") - C("entry_px")) - p.cost_points)
    return s.withColumn("r_multiple", ratio(C("net_points"), C("risk_points"))).drop(
        "path", "e", "d", "s_at_e", "s", "t", "last")


def trades(bars: DataFrame, levels: DataFrame,
           p: PullbackParams = PullbackParams()) -> DataFrame:
    """Signals of all sessions with their outcome and the furthest state of the session.

    The walk runs once over the bars up to the deadline and leaves one row per session with
    its signals and its furthest state. Sessions without a signal drop out; the others meet
    their whole path, narrow rows of the bars, and their levels.
    """
    packed = walk(bars, p).groupBy(*SESSION).agg(
        F.array_sort(F.collect_list(F.when(C("signal"), F.struct(*SIGNAL)))).alias("sigs"),
        F.max(F.when(C("evaluated"), C("state_rank"))).alias("rank")).where(F.size("sigs") > 0)
    path = cash(bars).groupBy(*SESSION).agg(_path().alias("path"))
    s = packed.join(path, SESSION).select(
        *SESSION, "path", F.element_at(F.array(*[F.lit(x) for x in STATES]), C("rank") + 1)
        .alias("reached"), F.posexplode("sigs").alias("k", "sig")).select(
        *SESSION, "path", "reached", "k", "sig.*")
    return _forward(_with_targets(s, levels, p, "path", "reached"), p)


def status_counts(t: DataFrame) -> DataFrame:
    return t.groupBy("instrument_id", "status").agg(F.count(F.lit(1)).alias("n"))


def signal_summary(t: DataFrame) -> DataFrame:
    """Per instrument: sessions with a signal, signals, fills, reward-to-risk at the signal."""
    return t.groupBy("instrument_id").agg(
        F.count_distinct("session_date").alias("n_sessions"),
        F.count(F.lit(1)).alias("n_signals"),
        count_where(C("status") == "TRADED").alias("n_filled"),
        F.median("rr").alias("median_rr"),
        F.avg(F.coalesce((C("rr") >= 1), F.lit(False)).cast("double")).alias("share_rr_ge_1"))


def exit_reasons(t: DataFrame) -> DataFrame:
    return t.where("status = 'TRADED'").groupBy("instrument_id", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.avg("r_multiple").alias("mean_r"))


def count_bucket() -> Column:
    """First attempt, second attempt, or later."""
    return F.when(C("count") >= 3, "3+").otherwise(C("count").cast("string"))


def signal_table(t: DataFrame, sp: SessionParams = SessionParams()) -> DataFrame:
    """Reading view: clock times, rounded prices, outcome."""
    return t.select(
        *SESSION, C("label").alias("signal"),
        clock(C("signal_mso") + sp.open_min).alias("at"),
        F.when(C("side") > 0, "buy").otherwise("sell").alias("side"),
        F.bround("entry_px").cast("long").alias("trigger"),
        F.bround("stop_px").cast("long").alias("stop"),
        F.bround("target_px").cast("long").alias("target"),
        F.coalesce("target_name", F.lit("—")).alias("t1"), "rr",
        F.bround("risk_points").cast("long").alias("risk_pts"), C("status").alias("outcome"),
        F.coalesce(clock(C("exit_mso") + sp.open_min), F.lit("—")).alias("exit"),
        F.coalesce("reason", F.lit("—")).alias("why"), F.round("r_multiple", 2).alias("r"))


def inside_context(picked: DataFrame, t: DataFrame) -> DataFrame:
    """Per picked session: its triggers in order and the R of its fills."""
    per = t.groupBy(*SESSION).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("signal_mso", "label"))),
                                 lambda x: x["label"]), " ").alias("triggers"),
        F.round(F.sum(F.when(C("status") == "TRADED", C("r_multiple"))), 2).alias("sum_r"))
    return picked.join(per, SESSION, "left")


def appearance(sessions: DataFrame, picked: Column, t: DataFrame) -> DataFrame:
    """Share of picked sessions with a trigger against the share of all sessions."""
    hit = t.select(*SESSION).distinct().withColumn("hit", F.lit(True))
    d = sessions.select(*SESSION, yes(picked).alias("picked")).join(hit, SESSION, "left")
    got = yes(C("hit"))
    return d.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("n_all"), count_where(got).alias("n_all_with_trigger"),
        count_where(C("picked")).alias("n_picked"),
        count_where(C("picked") & got).alias("n_picked_with_trigger")).withColumns({
            "all_pct": ratio(100.0 * C("n_all_with_trigger"), C("n_all")),
            "picked_pct": ratio(100.0 * C("n_picked_with_trigger"), C("n_picked"))})
