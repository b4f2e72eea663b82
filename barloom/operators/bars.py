"""Sessions, re-barring, stitching and the session calendar."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import (SESSION, count_where, earliest, in_calendar, latest,
                                       lag_session)
from barloom.params import SessionParams

OHLC = ("open", "high", "low", "close")


def sessionize(df: DataFrame, p: SessionParams = SessionParams()) -> DataFrame:
    """Session date, minute of day, minutes since the open and the cash flag.

    Bars carry their opening time, so the one stamped at the close is no cash bar.
    """
    tod = F.hour("local_dt") * 60 + F.minute("local_dt")
    return df.withColumns({
        "session_date": F.to_date("local_dt"),
        "tod_min": tod,
        "mso": tod - p.open_min,
        "is_cash": (tod >= p.open_min) & (tod < p.close_min)})


def cash(df: DataFrame, cutoff_min: int | None = None) -> DataFrame:
    """Cash bars, optionally up to and including a minute since the open."""
    out = df.where("is_cash and mso >= 0")
    return out if cutoff_min is None else out.where(F.col("mso") <= cutoff_min)


def rebar(df: DataFrame, minutes: int, key: tuple[str, ...] = ("con_id",),
          dt: str = "dt") -> DataFrame:
    """Tumbling left-labelled bars per contract; the order column must be unique per key.

    ``min_by`` on a timestamp keeps fixed-width buffers, so this is a hash aggregate with
    map-side combine: one busy contract shrinks to its buckets before the shuffle.
    """
    return (df.groupBy(*key, F.window(dt, f"{minutes} minutes").alias("w"))
            .agg(F.min_by("open", dt).alias("open"), F.max("high").alias("high"),
                 F.min("low").alias("low"), F.max_by("close", dt).alias("close"),
                 F.sum("volume").alias("volume"))
            .where("open is not null")
            .select(*key, F.col("w.start").alias("bar_dt"), *OHLC, "volume"))


def stitch(old: DataFrame, contracts: DataFrame) -> DataFrame:
    """Union of the plain feed and the contract feed; absent columns become NULL."""
    return old.withColumn("feed", F.lit("feed_5m")).unionByName(
        contracts.withColumn("feed", F.lit("contract_1m")), allowMissingColumns=True)


def overnight_slice(df: DataFrame, bounds: DataFrame,
                    p: SessionParams = SessionParams()) -> DataFrame:
    """Bars strictly between the previous session's close and this session's open.

    ``bounds``: instrument_id, session_date, prev_session_date. Each pair of dates is expanded
    to the dates it spans, so the bars meet it in an equality join on the date and the clock
    decides at both ends; a range join would compare every bar with every session.
    """
    days = bounds.where("prev_session_date is not null").select(
        "instrument_id", F.col("session_date").alias("overnight_of"), "prev_session_date",
        F.explode(F.sequence("prev_session_date", "session_date")).alias("session_date"))
    before_open = (F.col("session_date") < F.col("overnight_of")) | (F.col("tod_min") < p.open_min)
    after_close = (F.col("session_date") > F.col("prev_session_date")) | (
        F.col("tod_min") > p.close_min)
    return df.join(days, SESSION).where(before_open & after_close)


def calendar(bars: DataFrame, p: SessionParams = SessionParams()) -> DataFrame:
    """Per date: bars, cash bars, first feed, weekday, shortened and weekend flags."""
    d = bars.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("n_bars"), count_where(F.col("is_cash")).alias("n_cash_bars"),
        first_feed().alias("feed"))
    d = d.withColumn("typical", F.median("n_cash_bars").over(Window.partitionBy("instrument_id")))
    return d.select(
        *SESSION, "n_bars", "n_cash_bars", "feed", weekday(F.col("session_date")).alias("weekday"),
        (F.col("n_cash_bars") < 0.6 * F.greatest("typical", F.lit(p.expected_bars(5) * 0.5)))
        .alias("shortened_session"),
        F.dayofweek("session_date").isin(1, 7).alias("is_weekend"))


def first_feed() -> Column:
    """Feed of the earliest bar, through a flag: a text buffer would sort the aggregate."""
    return F.when(F.min_by(F.col("feed") == "contract_1m", "tod_min"), "contract_1m").otherwise(
        "feed_5m")


def weekday(date: Column) -> Column:
    return F.date_format(date, "EEEE")


def previous_session(sessions: DataFrame) -> DataFrame:
    return sessions.select(*SESSION).distinct().withColumn(
        "prev_session_date", lag_session(F.col("session_date")))


def previous_session_of(sessions: DataFrame, dates: DataFrame) -> DataFrame:
    """Last session strictly before arbitrary dates, found with one window over the union."""
    s = sessions.select(*SESSION, F.col("session_date").alias("known"), F.lit(1).alias("tag"))
    q = dates.select(*SESSION, F.lit(None).cast("date").alias("known"), F.lit(0).alias("tag"))
    w = in_calendar().orderBy("session_date", "tag").rowsBetween(-(2 ** 31) + 1, -1)
    return (s.distinct().unionByName(q)
            .withColumn("prev_session_date", F.last("known", ignorenulls=True).over(w))
            .where("tag = 0").select(*SESSION, "prev_session_date"))


def session_ohlc(bars: DataFrame, p: SessionParams = SessionParams(),
                 keep_all_dates: bool = False) -> DataFrame:
    """One row per session: cash and overnight OHLC (raw and adjusted), full-day extremes.

    Overnight bars belong to the next date that has any bar. A bar before the open therefore
    belongs to its own date and one after the close to the following date of the calendar, so
    the as-of join reduces to a lag over the session rows: one aggregate per session, one
    window per instrument, no second pass over the bars.
    """
    c = F.col("is_cash")
    early, late = F.col("tod_min") < p.open_min, F.col("tod_min") >= p.close_min

    def ohlc(cond: Column, prefix: str) -> list[Column]:
        out = []
        for adj, end in (("", ""), ("adj_", "_adj")):
            out += [earliest(F.col(f"{adj}open"), cond, "tod_min").alias(f"{prefix}_open{end}"),
                    F.max(F.when(cond, F.col(f"{adj}high"))).alias(f"{prefix}_high{end}"),
                    F.min(F.when(cond, F.col(f"{adj}low"))).alias(f"{prefix}_low{end}"),
                    latest(F.col(f"{adj}close"), cond, "tod_min").alias(f"{prefix}_close{end}")]
        return out

    breaks = [F.max(F.when(c & (F.col("mso") < n), F.col("adj_high"))).alias(f"high_first_{n}m")
              for n in p.break_windows_min]
    d = bars.groupBy(*SESSION).agg(
        *ohlc(c, "cash"), *ohlc(early, "early"), *ohlc(late, "late"), *breaks,
        count_where(c).alias("n_cash_bars"), count_where(early).alias("n_early"),
        count_where(late).alias("n_late"), F.count(F.lit(1)).alias("n_bars"),
        F.max("adj_high").alias("day_high_adj"), F.min("adj_low").alias("day_low_adj"),
        first_feed().alias("feed"))
    d = d.withColumns({f"late_{x}": lag_session(F.col(f"late_{x}"))
                       for x in ("open", "high", "low", "close", "open_adj", "high_adj",
                                 "low_adj", "close_adj")}
                      | {"n_late": F.coalesce(lag_session(F.col("n_late")), F.lit(0))})
    night = {}
    for end in ("", "_adj"):
        night |= {
            f"overnight_open{end}": F.coalesce(f"late_open{end}", f"early_open{end}"),
            f"overnight_high{end}": F.greatest(f"late_high{end}", f"early_high{end}"),
            f"overnight_low{end}": F.least(f"late_low{end}", f"early_low{end}"),
            f"overnight_close{end}": F.coalesce(f"early_close{end}", f"late_close{end}")}
    n = F.col("n_late") + F.col("n_early")
    d = d.withColumns(night | {"n_overnight_bars": F.when(n > 0, n)})
    if not keep_all_dates:
        d = d.where("n_cash_bars > 0")
    drop = [f"{a}_{b}{e}" for a in ("early", "late") for b in OHLC for e in ("", "_adj")]
    return d.drop(*drop, "n_early", "n_late").withColumns({
        "prev_session_date": lag_session(F.col("session_date")),
        "weekday": weekday(F.col("session_date"))})
