"""Derived tables of the batch build, and their storage."""
from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from barloom.operators import context, daily, opening, setups
from barloom.params import ContextParams, SessionParams, SetupSpec
from barloom.plans.storage import files_of
from barloom.plans.store import Store
from barloom.sources.feeds import write_table


def fingerprint(*params, source: DataFrame | None = None) -> str:
    """Name part of a stored table: every parameter it was built with, and the files of its
    ``source``, so that new input is a new table."""
    text = json.dumps([[p.as_dict() for p in params],
                       [] if source is None else files_of(source)], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def build_all(bars: DataFrame, out: str, p: SessionParams = SessionParams(),
              cp: ContextParams = ContextParams()) -> dict[str, str]:
    """Batch build: bars, daily features, opening features and labels as Parquet.

    Each stage reads the stored result of the one before, so a lost executor costs its own
    tasks and never the lineage back to the ticks.
    """
    spark = bars.sparkSession
    name = fingerprint(p, cp, source=bars)
    where = {k: f"{out}/{k}_{name}" for k in ("bars", "daily", "opening", "context")}
    write_table(bars, where["bars"])
    b = spark.read.parquet(where["bars"]).drop("year")
    write_table(daily.daily_features(b, p), where["daily"])
    d = spark.read.parquet(where["daily"]).drop("year")
    write_table(opening.opening_features(b, d, p=p), where["opening"])
    write_table(context.context_table(b, d, cp), where["context"])
    return where


def stored_or_built(spark: SparkSession, path: str, build) -> DataFrame:
    """Read a derived table under its fingerprint, building it once. Of two builders at the same
    time one waits for the other; see ``store``."""
    folder, version = path.rstrip("/").rsplit("/", 1)
    store = Store(spark, folder)

    def tables(where: str) -> dict[str, dict]:
        return {"table": store.write(build(), where)}

    store.get_or_build(version, tables)
    return store.table(version, "table")


#: The fields of a setup that its session table depends on; all others filter the table.
TIMING = ("pressure_window_min", "decision_bar", "bar_minutes", "morning_end_min")


def setup_table(folder: str, bars: DataFrame, daily_rows: DataFrame,
                spec: SetupSpec = SetupSpec()) -> DataFrame:
    """The session table of a setup, shared by all setups with its timing over the same bars."""
    timing = SetupSpec().but(**{k: getattr(spec, k) for k in TIMING})
    version = f"setups_{fingerprint(timing, source=bars)}"
    return stored_or_built(bars.sparkSession, f"{folder}/{version}",
                           lambda: setups.session_table(bars, daily_rows, timing))
