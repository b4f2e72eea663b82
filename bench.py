"""Wall seconds of the headline queries; prints one JSON line.

Plain names run in full from the raw tables. ``build_tables`` writes the derived tables once
(the batch build), and ``stored_*`` run the report queries on them, which is how the published
the result is computed. A small scan runs first, outside the clock.
"""
from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "l10_state_profile", "l9_trade_table", "k16_label_mix", "k18_context_scan",
    "j7_conditional_prob", "m4_drive_performance", "k13_context_table", "e14_daily_features",
    "f9_opening_features", "c12_session_ohlc", "c6_apply_rolls", "d8_audit_row", "h7_path_dtw",
    "i7_similarity_rank", "i11_search_combined", "n1_distribution", "b4_keep_first", "c1_rebar"]
STORED = [
    "l7_decisions", "l10_state_profile", "m5_split_performance", "k16_label_mix",
    "k18_context_scan", "j7_conditional_prob", "m4_drive_performance", "i11_search_combined"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from barloom.plans.catalog import PLANS, QUERIES, StoredTables
    from barloom.plans.derived import build_all
    from barloom.session import get_spark
    from barloom.sources.ticks import session_bars
    spark = get_spark("bench", cpus)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    times: dict[str, float] = {}

    def clock(name: str, fn) -> object:
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    for name in sys.argv[1:] or HEADLINE:
        clock(name, lambda n=name: drain(QUERIES[n](spark, sf_dir)))
    if not sys.argv[1:]:
        folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(
            prefix="spark-", dir="/tmp")
        where = clock("build_tables", lambda: build_all(session_bars(spark, sf_dir),
                                                        f"{folder}/derived"))
        for name in STORED:
            clock(f"stored_{name}", lambda n=name: drain(
                PLANS[n](StoredTables(spark, sf_dir, where))))
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": Path(sf_dir).name, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
