"""The batch build: from the cleaned feeds to the adjusted master and its features, published as one
version.

Each stage reads what the one before has written, so a lost executor costs its own tasks. The only
joins are those of bars with the contract table, a few rows for each instrument and year.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import bars, daily, opening, rolls
from barloom.params import SessionParams
from barloom.plans.derived import fingerprint
from barloom.plans.store import Store

ARTEFACTS = ("plain", "rolls", "contracts", "master", "daily", "opening")
_BARS = ["instrument_id", "con_id", "local_dt", *bars.OHLC, "volume"]


def master(plain: DataFrame, contracts: DataFrame, factors: DataFrame,
           p: SessionParams = SessionParams(), minutes: int = 5) -> DataFrame:
    """Both feeds in one row of sessions, on prices adjusted by the factors of their contracts.

    The contract feed is brought to the plain feed's grid first. ``con_id`` is null in bars of
    the plain feed. Raw bars are dealt by instrument once; the grid, the factors and the folders
    they are written to keep them there.
    """
    dealt = contracts.select(*_BARS).repartition("instrument_id")
    grid = bars.rebar(dealt, minutes, ("instrument_id", "con_id"), "local_dt")
    both = bars.stitch(plain.select(*[c for c in _BARS if c != "con_id"]).repartition("instrument_id"),
                       grid.withColumnRenamed("bar_dt", "local_dt").select(*_BARS))
    return rolls.apply_rolls(bars.sessionize(both, p), factors, p)


def build(store: Store, plain: DataFrame, contracts: DataFrame,
          p: SessionParams = SessionParams(), cutoff_min: int | None = None) -> dict:
    """The manifest of the version that these feeds and parameters make, built once.

    ``plain``: instrument_id, local_dt, open, high, low, close, volume; ``contracts``: these and
    con_id, contract_month, expiry. Both are tables, named by their files; they may be parts of one.
    """
    cut = p.cutoff_min if cutoff_min is None else cutoff_min
    version = f"{fingerprint(p, source=plain)}-{fingerprint(p, source=contracts)}-{cut}"

    def tables(folder: str) -> dict[str, dict]:
        made: dict[str, dict] = {}

        def stage(name: str, df: DataFrame) -> DataFrame:
            made[name] = store.write(df, f"{folder}/{name}")
            return store.read(made[name])

        old = stage("plain", bars.sessionize(plain.repartition("instrument_id"), p))
        factors = stage("rolls", rolls.roll_factors(rolls.contract_levels(
            bars.sessionize(contracts, p), p), p))
        new = bars.sessionize(contracts.repartition("instrument_id"), p)
        adjusted = stage("contracts", rolls.apply_rolls(
            new.withColumn("feed", F.lit("contract_1m")), factors, p))
        m = stage("master", master(old, adjusted, factors, p))
        d = stage("daily", daily.daily_features(m, p))
        stage("opening", opening.opening_features(m, d, cut, p))
        return made

    return store.get_or_build(version, tables, roll_method=p.roll_method, cutoff_min=cut)
