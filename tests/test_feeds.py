"""Files, time zones, duplicates, re-barring, rolls, audit."""
from __future__ import annotations

import datetime as dt

import pytest
from conftest import DAY, by_key, flat_session, make_bars, weekdays
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from barloom.operators import audit, bars, clean, rolls
from barloom.params import SessionParams, in_context
from barloom.plans.derived import fingerprint, stored_or_built
from barloom.sources import feeds

P = SessionParams()


def test_plain_feed(spark, scratch):
    with open(f"{scratch}/a.csv", "w") as f:
        f.write("03/06/2019;02:00:00;100;101;99;100.5;7\n04/06/2019;02:05:00;100;NaN;99;100.5;7\n")
    rows = feeds.read_plain_feed(spark, f"{scratch}/a.csv").orderBy("wall").collect()
    assert rows[0].wall == dt.datetime(2019, 6, 3, 2) and rows[0].close == 100.5
    assert rows[1].high is None and rows[0].source_file == "a.csv"


def test_contract_feed_by_name_and_missing_glob(spark, scratch):
    head = "Datetime,ContractMonth,Expiry,ConId,LocalSymbol,Open,High,Low,Close,Volume,Average,BarCount\n"
    swapped = "ConId,Datetime,ContractMonth,Expiry,LocalSymbol,Open,High,Low,Close,Volume,Average,BarCount\n"
    with open(f"{scratch}/c_1.csv", "w") as f:
        f.write(head + "2024-11-01 09:00:00,202412,20241220,5,X,1,2,0.5,1.5,3,1.2,4\n")
    d = feeds.read_contract_feed(spark, f"{scratch}/c_*.csv").first()
    assert (d.con_id, d.contract_month, d.close, d.source_file) == (5, 202412, 1.5, "c_1.csv")
    with open(f"{scratch}/d_1.csv", "w") as f:
        f.write(swapped + "6,2024-11-01 09:00:00,202412,20241220,X,1,2,0.5,1.5,3,1.2,4\n")
    assert feeds.read_contract_feed(spark, f"{scratch}/d_*.csv").first().con_id == 6
    with pytest.raises(AnalysisException):
        feeds.read_contract_feed(spark, f"{scratch}/none_*.csv")


def test_sinks_round_trip(spark, scratch):
    b = make_bars(spark, {DAY: flat_session(3), dt.date(2023, 1, 2): flat_session(2)})
    keep = b.select("instrument_id", "session_date", "mso", "close")
    feeds.write_table(keep, f"{scratch}/t")
    back = spark.read.parquet(f"{scratch}/t")
    assert back.where("year = 2024").count() == 3 and back.count() == 5
    feeds.write_csv(keep, f"{scratch}/c")
    assert spark.read.option("header", True).csv(f"{scratch}/c").count() == 5
    feeds.write_json(feeds.params_row(spark, in_context(swing=("BULL",))), f"{scratch}/j")
    assert '"among": ["BULL"]' in spark.read.json(f"{scratch}/j").first().spec


def test_stored_table_is_built_once_per_parameters(spark, scratch):
    calls = []

    def build():
        calls.append(1)
        return make_bars(spark, {DAY: flat_session(2)}).select("instrument_id", "session_date", "mso")

    path = f"{scratch}/bars_{fingerprint(P)}"
    assert stored_or_built(spark, path, build).count() == 2
    assert stored_or_built(spark, path, build).count() == 2 and len(calls) == 1
    assert fingerprint(P) != fingerprint(P.but(cutoff="10:00"))
    table = stored_or_built(spark, path, build)
    assert fingerprint(P, source=table) == fingerprint(P, source=table) != fingerprint(P)
    table.write.mode("append").partitionBy("mso").parquet(f"{scratch}/more")
    more = spark.read.parquet(f"{scratch}/more")
    assert fingerprint(P, source=more) != fingerprint(P, source=table)


def walls(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)],
                                 "instrument_id long, seq int, t string").withColumn(
        "wall", F.to_timestamp_ntz("t"))


@pytest.mark.parametrize("wall, local", [
    ("2019-03-08 02:00:00", "2019-03-08 09:00:00"), ("2019-03-11 02:00:00", "2019-03-11 08:00:00"),
    ("2024-01-15 02:00:00", "2024-01-15 09:00:00"), ("2024-07-15 02:00:00", "2024-07-15 09:00:00"),
    ("2024-03-10 02:30:00", "2024-03-10 09:00:00"), ("2024-11-03 01:30:00", "2024-11-03 07:30:00")])
def test_wall_clock(spark, wall, local):
    r = clean.localize(walls(spark, wall), P.feed_tz, P.tz).first()
    assert str(r.local_dt) == local


def test_second_pass_of_the_ambiguous_hour(spark):
    d = clean.localize(walls(spark, "2024-11-03 01:30:00", "2024-11-03 01:30:00",
                             "2024-11-03 02:30:00"), P.feed_tz, P.tz)
    got = clean.second_pass(d, P.feed_tz, "seq").orderBy("seq").collect()
    assert [str(r.utc_dt)[11:16] for r in got] == ["06:30", "07:30", "08:30"]


def test_duplicates(spark):
    rows = [(1, 10.0)] * 3 + [(2, 10.0), (2, 11.0), (2, 11.0), (3, 5.0)]
    d = spark.createDataFrame(rows, "k int, v double")
    c = clean.duplicate_counts(d, ["k"], ["v"]).first()
    assert (c.n_raw, c.n_exact_duplicates, c.n_conflicting_duplicates, c.n_clean) == (7, 3, 1, 3)
    assert {(r.k, r.v, r.copies) for r in clean.conflicts(d, ["k"], ["v"]).collect()} == {
        (2, 10.0, 1), (2, 11.0, 2)}
    assert {(r.k, r.v) for r in clean.keep_first(d, ["k"], ["v"]).collect()} == {
        (1, 10.0), (2, 10.0), (3, 5.0)}


def test_rebar_never_mixes_contracts(spark):
    t0 = dt.datetime(2024, 1, 1, 9, 0)
    rows = [(c, t0 + dt.timedelta(minutes=m), float(p)) for c, m, p in (
        (1, 0, 10), (1, 4, 12), (1, 5, 11), (2, 2, 99), (2, 14, 98))]
    d = spark.createDataFrame(rows, "con_id int, dt timestamp_ntz, open double").withColumns(
        {x: F.col("open") for x in ("high", "low", "close")} | {"volume": F.lit(1.0)})
    got = by_key(bars.rebar(d, 5), "con_id", "bar_dt")
    assert len(got) == 4
    b = got[1, t0]
    assert (b["open"], b["high"], b["low"], b["close"], b["volume"]) == (10, 12, 10, 12, 2)


def contracts(spark):
    days = weekdays(6, dt.date(2024, 9, 2))
    out = None
    for k, (px, month, expiry) in enumerate(((100.0, 202409, 20240920), (110.0, 202412, 20241220),
                                             (120.0, 202503, 20250321))):
        b = make_bars(spark, {d: [(m, px, px, px, px) for m in (0, 5, 500)]
                              for d in days[2 * k:2 * k + 2]}, "contract_1m")
        b = b.withColumns({"con_id": F.lit(k + 1), "contract_month": F.lit(month),
                           "expiry": F.lit(expiry), "local_symbol": F.lit("X")})
        out = b if out is None else out.unionByName(b)
    return out, days


def test_rolls(spark):
    b, days = contracts(spark)
    lv = rolls.contract_levels(b)
    seams = rolls.seam_report(lv).orderBy("old").collect()
    assert [(s.seam_gap_pts, s.seam_gap_pct) for s in seams] == [(10.0, 10.0), (10.0, 9.091)]

    def factors(method, **k):
        return by_key(rolls.roll_factors(lv, P.but(roll_method=method, **k)), "con_id")

    r = factors("ratio")
    assert [r[c]["factor"] for c in (1, 2, 3)] == pytest.approx([1.2, 120 / 110, 1.0])
    d = factors("difference")
    assert [d[c]["roll_offset"] for c in (1, 2, 3)] == [20.0, 10.0, 0.0]
    c = factors("carry")
    dte = {2: (dt.date(2024, 12, 20) - days[2]).days, 3: (dt.date(2025, 3, 21) - days[4]).days}
    f2 = 1 + 0.025 * dte[3] / 365
    assert c[3]["factor"] == 1.0 and c[2]["factor"] == pytest.approx(f2)
    assert c[1]["factor"] == pytest.approx(f2 * (1 + 0.025 * dte[2] / 365))
    assert {x["factor"] for x in factors("carry", roll_enabled=False).values()} == {1.0}


def test_apply_and_verify_rolls(spark):
    b, days = contracts(spark)
    old = make_bars(spark, {dt.date(2024, 8, 1): flat_session(1, 50.0)})
    master = bars.stitch(old.drop("feed"), b.drop("feed"))
    f = rolls.roll_factors(rolls.contract_levels(b), P.but(roll_method="difference"))
    got = by_key(rolls.apply_rolls(master, f).where("mso = 0"), "session_date")
    assert got[dt.date(2024, 8, 1)]["adj_close"] == 70.0  # the oldest contract's offset
    assert got[days[0]]["adj_close"] == 120.0 and got[days[5]]["adj_factor"] == 1.0
    v = rolls.verify_rolls(f, P.but(roll_method="difference")).first()
    assert v.newest_contract_anchored_raw and v.seam_residual_pct_max == 0.0 and v.n_seams == 2


def test_audit(spark):
    b, days = contracts(spark)
    old = make_bars(spark, {dt.date(2024, 8, 1): flat_session(3)})
    master = bars.stitch(old.drop("feed"), b.drop("feed"))
    assert audit.feed_gap(master).first().gap_days == 31
    c = audit.coverage(master).first()
    assert (c.n_sessions, c.first_bar_mode, c.last_bar_mode) == (7, "09:00", "17:20")
    m = audit.missing_bars(master, 5, full_share=0.0).first()
    assert (m.full_days, m.missing_bars, m.sessions_with_gaps) == (7, 7 * 100, 6)
    assert audit.contract_inventory(b).count() == 3
    d = spark.createDataFrame([(1, 21, 0, 2, 21, True)], "instrument_id long, n_raw long, "
                              "n_exact_duplicates long, n_conflicting_duplicates long, n_clean long, "
                              "fallback_used boolean")
    v = rolls.verify_rolls(rolls.roll_factors(rolls.contract_levels(b)))
    w = audit.audit_row(master, d, v).first().warnings
    assert w.split("; ") == ["2 conflicting duplicates", "ambiguous hours read as summer time",
                             "31 days between the feeds"]


def test_missing_bars_are_counted_on_sparse_sessions(spark):
    """The weekly sessions hold 22 cash bars at most; the query still counts what they lack."""
    from barloom.plans import catalog
    got = catalog.QUERIES["d3_missing_bars"](spark, "/root/testdata/sf0.01").collect()
    assert got and all(r.full_days > 0 and r.missing_bars >= r.full_days * (103 - 22) for r in got)
