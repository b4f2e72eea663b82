"""The stream gives the states of the batch walk."""
from __future__ import annotations

import datetime as dt
import random

from conftest import by_key, weekdays
from pyspark.sql import functions as F

from barloom.operators import pullback
from barloom.operators.bars import sessionize
from barloom.streaming import live

TICKS = "instrument_id long, local_dt timestamp, px double, qty double"


def test_stream_equals_batch(spark, scratch):
    rnd, rows = random.Random(9), []
    for inst in (1, 2):
        for d in weekdays(6):
            px, t = 100.0, dt.datetime(d.year, d.month, d.day, 9)
            for i in range(20):
                for k in range(2):
                    px += rnd.randint(-2, 2) + 0.4 * (inst == 1)
                    rows.append((inst, t + dt.timedelta(minutes=5 * i + 2 * k), px, 1.0))
    rows.sort(key=lambda r: r[1])
    for part in range(4):
        chunk = rows[part * len(rows) // 4:(part + 1) * len(rows) // 4]
        spark.createDataFrame(chunk, TICKS).coalesce(1).write.parquet(f"{scratch}/in/{part}")
    end = dt.datetime(2030, 1, 1)  # closes every bar
    spark.createDataFrame([(9, end, 1.0, 1.0)], TICKS).coalesce(1).write.parquet(f"{scratch}/in/9")
    ticks = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(f"{scratch}/in")
    q = (live.stream_bars(ticks).writeStream.outputMode("append")
         .option("checkpointLocation", f"{scratch}/cp")
         .foreachBatch(live.state_writer(f"{scratch}/bars", f"{scratch}/states"))
         .trigger(availableNow=True).start())
    q.awaitTermination(240)
    assert q.exception() is None
    got = by_key(live.latest_states(spark.read.option("recursiveFileLookup", "true").parquet(
        f"{scratch}/states")), "instrument_id", "session_date")
    d = spark.createDataFrame(rows, TICKS).groupBy(
        "instrument_id", F.window("local_dt", "5 minutes").alias("w")).agg(
        F.max("px").alias("adj_high"), F.min("px").alias("adj_low"),
        F.max_by("px", "local_dt").alias("adj_close"), F.min_by("px", "local_dt").alias("adj_open"))
    b = sessionize(d.withColumn("local_dt", F.col("w.start")))
    want = by_key(pullback.session_states(pullback.walk(b)), "instrument_id", "session_date")
    assert set(got) == set(want) and len(got) == 12
    for k, w in want.items():
        assert {c: got[k][c] for c in ("state", "reached", "n_signals", "last_mso")} == {
            c: w[c] for c in ("state", "reached", "n_signals", "last_mso")}


def test_keyed_sessions_equal_batch_after_late_and_repeated_ticks(spark, scratch):
    """Ticks arrive up to twenty minutes late, a fifth of them twice."""
    rnd, rows = random.Random(4), []
    for inst in (1, 2):
        for d in weekdays(3):
            px, t = 100.0, dt.datetime(d.year, d.month, d.day, 8, 55)
            for i in range(50):
                px += rnd.randint(-2, 2) + 0.3 * (inst == 2)
                rows.append((inst, t + dt.timedelta(minutes=2 * i), px, 1.0))
    sent = [(r[1] + dt.timedelta(minutes=rnd.choice([0, 0, 5, 20])), r) for r in rows]
    sent += [(at + dt.timedelta(minutes=rnd.choice([0, 4])), r) for at, r in rnd.sample(
        sent, len(sent) // 5)]
    sent = [r for _, r in sorted(sent)]
    for part in range(6):
        chunk = sent[part * len(sent) // 6:(part + 1) * len(sent) // 6]
        spark.createDataFrame(chunk, TICKS).coalesce(1).write.parquet(f"{scratch}/in/{part}")
    ticks = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(f"{scratch}/in")
    q = (live.session_bars(ticks).writeStream.outputMode("update")
         .option("checkpointLocation", f"{scratch}/cp")
         .foreachBatch(live.walk_writer(f"{scratch}/states"))
         .trigger(availableNow=True).start())
    q.awaitTermination(240)
    assert q.exception() is None
    got = by_key(live.latest_states(spark.read.option("recursiveFileLookup", "true").parquet(
        f"{scratch}/states")), "instrument_id", "session_date")
    d = spark.createDataFrame(rows, TICKS).groupBy(
        "instrument_id", F.window("local_dt", "5 minutes").alias("w")).agg(
        F.max("px").alias("adj_high"), F.min("px").alias("adj_low"),
        F.max_by("px", "local_dt").alias("adj_close"), F.min_by("px", "local_dt").alias("adj_open"))
    b = sessionize(d.withColumn("local_dt", F.col("w.start")))
    want = by_key(pullback.session_states(pullback.walk(b)), "instrument_id", "session_date")
    assert set(got) == set(want) and len(got) == 6
    for k, w in want.items():
        for c in ("state", "reached", "n_signals", "last_mso"):
            assert got[k][c] == w[c], (k, c)
    assert len({w["state"] for w in want.values()}) > 1
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(kept) <= 4  # finished sessions leave the state
