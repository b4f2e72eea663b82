"""Bars from a tick table.

``lineitem`` rows serve as ticks. An instrument is a desk of 25 suppliers, so the number of
instruments grows with the data while each keeps a few hundred sessions; a session is an ISO
week; the slot of a tick in its session follows from its keys. Twelve slots cover the first
hour at five minutes, ten the rest of the day, one lies before the open and one after the
close. Every tick lands in a bar: bars are one partial aggregate over the whole table, with no
numbering of ticks and therefore no window over an unbounded group.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.params import SessionParams

DESK = 25
EPOCH = "1995-01-02"
SECOND_FEED = "1998-01-05"  # first session of the contract feed


def slot_minute(slot: Column) -> Column:
    return (F.when(slot < 12, slot * 5)
            .when(slot < 22, 60 + (slot - 12) * 45)
            .when(slot == 22, F.lit(-10))
            .otherwise(F.lit(520)).cast("int"))


#: The dense calendar: days from its first date, and the sessions that close early.
DENSE_FIRST, DENSE_DAYS = "1997-12-01", 71
HALF_DAY = 14


def dense_place(t: DataFrame) -> DataFrame:
    """Session and minute of a tick on a calendar of days with full five-minute sessions.

    Weekends trade the first two and a half hours, every ``HALF_DAY``th date the first four. An
    instrument's contract feed starts some days after the plain one ends, as many as its number
    modulo three. Dates, like instruments, don't grow with the table, so neither does a bar: a
    larger table has more instruments.
    """
    day = (F.col("l_orderkey") * 3 + F.col("l_linenumber") * 11 + F.col("l_partkey")) % DENSE_DAYS
    first = F.lit(DENSE_FIRST).cast("date")
    gap = F.datediff(F.lit(SECOND_FEED).cast("date"), first)
    day = F.when((day >= gap) & (day < gap + F.col("instrument_id") % 3), day + 3).otherwise(day)
    t = t.withColumns({"day": day, "session_date": F.date_add(first, day.cast("int"))})
    slot = (F.col("l_orderkey") * 7 + F.col("l_partkey") * 13 + F.col("l_linenumber") * 5) % 104
    short = (F.when(F.dayofweek("session_date").isin(1, 7), slot % 30)
             .when(F.col("day") % HALF_DAY == 0, slot % 48).otherwise(slot))
    return t.withColumn("mso", F.when(short < 102, short * 5).when(short == 102, -10)
                        .otherwise(520).cast("int")).drop("day")


def tick_order() -> Column:
    """Order of the ticks in a bar: order, line, then price in cents, so equal keys carry
    equal prices. Packed into one decimal because a struct has no fixed-width aggregation
    buffer and would turn the tick aggregate into a sort."""
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("decimal(19,0)")
    cents = (F.col("l_extendedprice") * 100).cast("decimal(18,0)")
    return line * F.lit(10 ** 18).cast("decimal(19,0)") + cents


def weekly_place(t: DataFrame) -> DataFrame:
    """Session and minute of a tick on a calendar of weeks with sparse sessions."""
    slot = (F.col("l_orderkey") * 7 + F.col("l_partkey") * 13 + F.col("l_linenumber") * 5) % 24
    return t.withColumns({"session_date": F.trunc("l_shipdate", "week"),
                          "mso": slot_minute(slot)})


def lineitem_ticks(spark: SparkSession, sf_dir: str, place=weekly_place) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    t = place(li.withColumn("instrument_id", F.floor(F.col("l_suppkey") / DESK)))
    t = t.select("instrument_id", "session_date", "mso", tick_order().alias("seq"),
                 "l_extendedprice", "l_quantity")
    w = F.floor(F.datediff("session_date", F.lit(EPOCH).cast("date")) / 7).cast("int")
    lean = (w * 7 + F.col("instrument_id") * 3) % 5 - 2
    base = (10000 + 6 * w + 30 * F.abs(w % 80 - 40)).cast("double")
    return t.select(
        "instrument_id", "session_date", "mso", "seq",
        (base + lean * F.least("mso", F.lit(60)).cast("double") + F.col("l_extendedprice") / 997.0).alias("px"),
        F.col("l_quantity").alias("qty"))


def ticks_to_bars(ticks: DataFrame) -> DataFrame:
    """First / highest / lowest / last price and volume per (instrument, session, slot)."""
    return ticks.groupBy("instrument_id", "session_date", "mso").agg(
        F.min_by("px", "seq").alias("open"), F.max("px").alias("high"),
        F.min("px").alias("low"), F.max_by("px", "seq").alias("close"),
        F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("n_ticks"))


def session_bars(spark: SparkSession, sf_dir: str, p: SessionParams = SessionParams(),
                 place=weekly_place) -> DataFrame:
    """Canonical bars of the driver's tables; the older sessions play the five-minute feed."""
    b = ticks_to_bars(lineitem_ticks(spark, sf_dir, place))
    tod = F.col("mso") + p.open_min
    old = F.col("session_date") < F.lit(SECOND_FEED).cast("date")
    return b.select(
        "instrument_id", "session_date", "mso", tod.alias("tod_min"),
        ((tod >= p.open_min) & (tod < p.close_min)).alias("is_cash"),
        (F.col("session_date").cast("timestamp_ntz") + F.make_dt_interval(mins=tod))
        .alias("local_dt"),
        "open", "high", "low", "close", "volume", "n_ticks",
        F.col("open").alias("adj_open"), F.col("high").alias("adj_high"),
        F.col("low").alias("adj_low"), F.col("close").alias("adj_close"),
        (F.year("session_date") * 100 + F.quarter("session_date")).alias("con_id"),
        F.when(old, "feed_5m").otherwise("contract_1m").alias("feed"))
