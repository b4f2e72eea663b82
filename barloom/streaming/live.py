"""The batch operators on a stream of ticks.

Two forms. ``stream_bars`` with ``state_writer``: ticks become bars by event time, and every finished
bar batch re-evaluates the sessions it touched, whose bars it reads back. ``session_bars`` with
``walk_writer``: each session's bars are keyed state with a timer, so a tick changes its bar at once,
and a batch hands on the whole sessions it changed; nothing stored is read again. The walk is causal,
so the state after a bar is the same in all forms; the tests compare them.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.functions.columns import SESSION
from barloom.operators import pullback
from barloom.operators.bars import OHLC, sessionize
from barloom.params import PullbackParams, SessionParams

C = F.col


def stream_bars(ticks: DataFrame, minutes: int = 5, lateness: str = "10 minutes",
                p: SessionParams = SessionParams()) -> DataFrame:
    """Tumbling bars of a tick stream (instrument_id, local_dt, px, qty).

    ``local_dt`` is a timestamp holding the wall clock of the session zone. A bar is emitted
    once the watermark passes its end; later ticks of it are dropped, which the stream's
    progress counts. State is one short row per open bar and instrument.
    """
    b = (ticks.withWatermark("local_dt", lateness)
         .groupBy("instrument_id", F.window("local_dt", f"{minutes} minutes").alias("w"))
         .agg(F.min_by("px", "local_dt").alias("adj_open"), F.max("px").alias("adj_high"),
              F.min("px").alias("adj_low"), F.max_by("px", "local_dt").alias("adj_close"),
              F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("n_ticks")))
    return sessionize(b.select("instrument_id", C("w.start").alias("local_dt"),
                               *[f"adj_{x}" for x in OHLC], "volume", "n_ticks"), p)


def state_writer(bars_path: str, states_path: str, p: PullbackParams = PullbackParams()):
    """``foreachBatch`` function: append the batch's bars, then store the current state of the
    sessions it touched.

    Both tables are written under the batch number with overwrite, so a batch that runs again
    after a failure replaces its own output. Only the touched sessions are read back: the
    stored bars are partitioned by date and the read is limited to the dates of the batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        (batch.write.mode("overwrite").partitionBy("session_date")
         .parquet(f"{bars_path}/batch={batch_id}"))
        now = spark.read.schema(batch.schema).parquet(f"{bars_path}/batch={batch_id}")
        touched = now.select(*SESSION).distinct()
        span = now.agg(F.min("session_date").alias("lo"), F.max("session_date").alias("hi")).first()
        known = T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])
        stored = spark.read.schema(known).parquet(bars_path).where(
            (C("batch") <= batch_id) & C("session_date").between(span.lo, span.hi))
        walked = pullback.walk(stored.join(touched, SESSION, "left_semi"), p)
        states = pullback.session_states(walked).withColumn("batch_id", F.lit(batch_id))
        states.write.mode("overwrite").parquet(f"{states_path}/batch={batch_id}")

    return write


_SIDES = ("first_at", "adj_open", "adj_high", "adj_low", "last_at", "adj_close")
_STATE = "mso array<int>, first_at array<long>, adj_open array<double>, adj_high array<double>, " \
         "adj_low array<double>, last_at array<long>, adj_close array<double>"
_BARS = "instrument_id long, session_date date, mso int, adj_open double, adj_high double, " \
        "adj_low double, adj_close double, is_cash boolean, tod_min int"


def _merged(ticks: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Bars of a session after some more ticks. The first and the last tick of a bar are those by
    time, then price, so a tick that comes late or twice leaves the bar it belongs to the same."""
    t = ticks.sort_values(["at", "px"])
    g = t.groupby("mso", sort=True)
    new = pd.DataFrame({
        "first_at": g["at"].first(), "adj_open": g["px"].first(), "adj_high": g["px"].max(),
        "adj_low": g["px"].min(), "last_at": g["at"].last(), "adj_close": g["px"].last()})
    new = new.reset_index()
    both = pd.concat([known, new], ignore_index=True) if len(known) else new
    first = both.sort_values(["first_at", "adj_open"]).groupby("mso").first()
    last = both.sort_values(["last_at", "adj_close"]).groupby("mso").last()
    g = both.groupby("mso")
    return pd.DataFrame({
        "first_at": first["first_at"], "adj_open": first["adj_open"], "adj_high": g["adj_high"].max(),
        "adj_low": g["adj_low"].min(), "last_at": last["last_at"],
        "adj_close": last["adj_close"]}).reset_index()


def session_bars(ticks: DataFrame, minutes: int = 5, lateness: str = "30 minutes",
                 p: SessionParams = SessionParams()) -> DataFrame:
    """Of a tick stream (instrument_id, local_dt, px), after each batch all bars of every session
    that it changed.

    The state of a session is its bars, as many as the clock has slots. A timer ends it when the
    watermark passes the last minute of its date; ticks later than ``lateness`` are dropped.
    """
    close = F.date_add(F.to_date("local_dt"), 1).cast("timestamp")
    rows = sessionize(ticks.withWatermark("local_dt", lateness), p).select(
        *SESSION, "local_dt", (F.floor(C("mso") / minutes) * minutes).cast("int").alias("mso"),
        F.unix_micros("local_dt").alias("at"), C("px").cast("double").alias("px"),
        F.unix_millis(close).alias("ends"))

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState
               ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = pd.DataFrame(dict(zip(("mso", *_SIDES), state.get)) if state.exists else
                             {c: [] for c in ("mso", *_SIDES)})
        ends = 0
        for part in parts:
            if len(part):
                known = _merged(part, known)
                ends = int(part["ends"].max())
        known = known.astype({"mso": "int32", "first_at": "int64", "last_at": "int64"})
        state.update(tuple(known[c].tolist() for c in ("mso", *_SIDES)))
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        out = known[["mso", *[f"adj_{x}" for x in OHLC]]].copy()
        out.insert(0, "instrument_id", key[0])
        out.insert(1, "session_date", key[1])
        out["tod_min"] = (out["mso"] + p.open_min).astype("int32")
        out["is_cash"] = (out["tod_min"] >= p.open_min) & (out["tod_min"] < p.close_min)
        yield out[[c.split()[0] for c in _BARS.split(", ")]]

    return rows.groupBy(*SESSION).applyInPandasWithState(
        update, _BARS, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def walk_writer(states_path: str, p: PullbackParams = PullbackParams()):
    """``foreachBatch`` function of ``session_bars``: the states of the batch's sessions, which hold
    all their bars, under the batch number with overwrite."""

    def write(batch: DataFrame, batch_id: int) -> None:
        states = pullback.session_states(pullback.walk(batch, p)).withColumn(
            "batch_id", F.lit(batch_id))
        states.write.mode("overwrite").parquet(f"{states_path}/batch={batch_id}")

    return write


def latest_states(states: DataFrame) -> DataFrame:
    """Newest stored state of every session."""
    keep = ["state", "reached", "n_signals", "last_mso"]
    return states.groupBy(*SESSION).agg(F.max_by(F.struct(*keep), "batch_id").alias("s")).select(
        *SESSION, "s.*")
