"""Data-quality tables: reported, never repaired."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import SESSION, clock, count_where, in_session, ratio
from barloom.operators.bars import cash
from barloom.params import SessionParams

C = F.col
# Shares of volume that the auctions must exceed.
OPEN_SHARE, CLOSE_SHARE = 0.02, 0.01


def volume_profile(bars: DataFrame) -> DataFrame:
    return bars.groupBy("instrument_id", "tod_min").agg(F.sum("volume").alias("volume"))


def timezone_check(bars: DataFrame, p: SessionParams = SessionParams()) -> DataFrame:
    """Do the busiest minutes sit where the declared zone puts the auctions? A profile has at
    most 1,440 rows per instrument."""
    prof = volume_profile(bars)
    rank = Window.partitionBy("instrument_id").orderBy(F.desc("volume"), "tod_min")
    prof = prof.withColumn("rk", F.row_number().over(rank))

    def share(a: int, b: int):
        return ratio(F.coalesce(F.sum(F.when(C("tod_min").between(a, b), C("volume"))),
                                F.lit(0.0)), F.sum("volume"))

    d = prof.groupBy("instrument_id").agg(
        share(p.open_min - 5, p.open_min + 15).alias("near_open"),
        share(p.close_min - 10, p.close_min + 10).alias("near_close"),
        F.array_sort(F.collect_list(F.when(C("rk") <= 6, F.struct("rk", "tod_min")))).alias("top"))
    return d.select(
        "instrument_id", F.lit(p.tz).alias("declared_tz"),
        F.array_join(F.transform("top", lambda x: clock(x["tod_min"])), ",")
        .alias("top_volume_minutes"),
        F.round("near_open", 4).alias("share_near_open"),
        F.round("near_close", 4).alias("share_near_close"),
        ((C("near_open") > OPEN_SHARE) & (C("near_close") > CLOSE_SHARE)).alias("consistent"))


def coverage(bars: DataFrame) -> DataFrame:
    """Span, sessions, usual first and last minute, cash bars per session."""
    per = bars.groupBy(*SESSION).agg(
        F.min("local_dt").alias("t0"), F.max("local_dt").alias("t1"),
        F.min("tod_min").alias("first"), F.max("tod_min").alias("last"),
        F.nullif(count_where(C("is_cash")), F.lit(0)).alias("n_cash"))
    return per.groupBy("instrument_id").agg(
        F.min("t0").cast("string").alias("coverage_start"),
        F.max("t1").cast("string").alias("coverage_end"),
        F.count(F.lit(1)).alias("n_sessions"),
        clock(F.mode("first", deterministic=True)).alias("first_bar_mode"),
        clock(F.mode("last", deterministic=True)).alias("last_bar_mode"),
        F.median("n_cash").alias("cash_bars_median"), F.min("n_cash").alias("cash_bars_min"),
        F.max("n_cash").alias("cash_bars_max"))


def missing_bars(bars: DataFrame, bar_minutes: int = 5, full_share: float = 0.8,
                 p: SessionParams = SessionParams()) -> DataFrame:
    """Missing cash bars on full days and sessions with a hole between two cash bars."""
    expected = p.expected_bars(bar_minutes)
    hole = C("mso") - F.lag("mso").over(in_session()) > bar_minutes
    per = cash(bars).withColumn("hole", hole).groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("hole"), F.lit(False)).alias("holes"))
    full = C("n") >= full_share * expected
    d = per.groupBy("instrument_id").agg(
        count_where(full).alias("full_days"),
        F.coalesce(F.sum(F.when(full, F.greatest(expected - C("n"), F.lit(0)))), F.lit(0))
        .alias("missing_bars"), count_where(C("holes")).alias("sessions_with_gaps"))
    return d.select("instrument_id", F.lit(expected).alias("expected_bars"), "full_days",
                    "missing_bars", F.round(100.0 * C("missing_bars") / (
                        expected * F.greatest(C("full_days"), F.lit(1))), 3).alias("missing_pct"),
                    "sessions_with_gaps")


def contract_inventory(ticks: DataFrame, key: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """One row per contract month. The bars collapse to one row per contract identity first,
    so the text columns are compared on those few rows only."""
    ids = ticks.groupBy(*key, "contract_month", "con_id", "local_symbol", "expiry").agg(
        F.min("local_dt").alias("t0"), F.max("local_dt").alias("t1"),
        F.count(F.lit(1)).alias("n"))
    return ids.groupBy(*key, "contract_month").agg(
        F.min("con_id").alias("con_id"), F.min("local_symbol").alias("local_symbol"),
        F.min("expiry").alias("expiry"), F.min("t0").cast("string").alias("starts"),
        F.max("t1").cast("string").alias("ends"), F.sum("n").alias("n_bars"))


def shared_timestamps(bars: DataFrame, key: Sequence[str], contract: str) -> DataFrame:
    """Timestamps on which more than one contract trades. Distinct pairs first, so a busy
    timestamp is one row per contract when it is counted."""
    pairs = bars.select(*key, contract).distinct()
    return pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("n_contracts")).where("n_contracts > 1")


def feed_gap(bars: DataFrame) -> DataFrame:
    """Whole days between the end of the plain feed and the start of the contract feed."""
    plain = C("feed") == "feed_5m"
    d = bars.groupBy("instrument_id").agg(
        F.max(F.when(plain, C("local_dt"))).alias("a"),
        F.min(F.when(~plain, C("local_dt"))).alias("b"))

    def second(x: str):
        return F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x)

    early = (second("b") < second("a")).cast("int")
    return d.select("instrument_id", (F.datediff("b", "a") - early).cast("long").alias("gap_days"))


def audit_row(bars: DataFrame, duplicates: DataFrame, rolls: DataFrame,
              bar_minutes: int = 5, p: SessionParams = SessionParams()) -> DataFrame:
    """One row per instrument with every check and the warnings that follow from them.

    ``duplicates``: instrument_id, n_raw, n_exact_duplicates, n_conflicting_duplicates,
    n_clean, fallback_used. ``rolls``: the output of ``verify_rolls``.
    """
    a = (duplicates.join(timezone_check(bars, p), "instrument_id")
         .join(coverage(bars), "instrument_id")
         .join(missing_bars(bars, bar_minutes, p=p), "instrument_id")
         .join(feed_gap(bars), "instrument_id", "left")
         .join(rolls.select("instrument_id", "newest_contract_anchored_raw"), "instrument_id",
               "left"))
    return a.withColumn("warnings", F.array_join(F.array_compact(F.array(*warnings())), "; "))


def warnings() -> list:
    n = C("n_conflicting_duplicates")
    return [
        F.when(~C("consistent"), "volume profile does not fit the declared zone"),
        F.when(n > 0, F.concat(n.cast("string"), F.lit(" conflicting duplicates"))),
        F.when(C("fallback_used"), "ambiguous hours read as summer time"),
        F.when(C("gap_days") > 3, F.concat(C("gap_days").cast("string"),
                                           F.lit(" days between the feeds"))),
        F.when(~F.coalesce("newest_contract_anchored_raw", F.lit(True)),
               "newest contract is not raw")]
