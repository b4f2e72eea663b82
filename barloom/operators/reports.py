"""Distributions and headlines over outcome tables."""
from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.columns import count_where, percentiles

C = F.col
# The outcome metrics of the distribution report.
METRICS = ("return_after_15m_pct", "return_after_30m_pct", "return_after_60m_pct",
           "return_at_1200_pct", "return_at_us_open_pct", "return_at_cash_close_pct",
           "max_favorable_excursion_pct", "max_adverse_excursion_pct")


def distribution(outcomes: DataFrame) -> DataFrame:
    """Shape of each outcome metric. The metrics are unpivoted, so one aggregate with a
    partial step serves all of them."""
    long = outcomes.select("instrument_id", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), C(m).alias("v")) for m in METRICS]))).where(
        "v is not null")
    s = long.groupBy("instrument_id", "metric").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
        count_where(C("v") > 0).alias("pos"), percentiles(C("v"), (0.25, 0.5, 0.75)).alias("q"),
        F.max("v").alias("best"), F.min("v").alias("worst"))
    return s.select("instrument_id", "metric", "n", "mean", C("q")[1].alias("median"), "std",
                    (100.0 * C("pos") / C("n")).alias("positive_pct"), C("q")[0].alias("p25"),
                    C("q")[2].alias("p75"), "best", "worst", (C("n") < 20).alias("small_sample"))


def headline(outcomes: DataFrame) -> DataFrame:
    def rate(c: str):
        return 100.0 * F.avg(C(c).cast("double"))

    return outcomes.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.median("return_at_cash_close_pct").alias("median_return_at_close_pct"),
        rate("close_above_cash_open").alias("positive_close_pct"),
        F.median("max_favorable_excursion_pct").alias("median_mfe_pct"),
        F.median("max_adverse_excursion_pct").alias("median_mae_pct"),
        rate("full_gap_fill").alias("full_gap_fill_pct"),
        rate("break_observed_high").alias("break_observed_high_pct"),
        rate("break_observed_low").alias("break_observed_low_pct"))


def histogram(d: DataFrame, metric: str, bins: int = 25) -> DataFrame:
    """Counts in equal bins between the instrument's extremes, with the median beside them."""
    v = C(metric)
    inst = Window.partitionBy("instrument_id")
    b = d.where(v.isNotNull()).select("instrument_id", v.alias("v")).select(
        "*", F.min("v").over(inst).alias("lo"), F.max("v").over(inst).alias("hi"),
        F.median("v").over(inst).alias("median"))
    width = F.nullif((C("hi") - C("lo")) / bins, F.lit(0.0))
    at = F.least(F.coalesce(F.floor((C("v") - C("lo")) / width), F.lit(0)), F.lit(bins - 1))
    return b.withColumn("bin", at.cast("int")).groupBy(
        "instrument_id", "bin", "lo", "hi", "median").agg(F.count(F.lit(1)).alias("n")).select(
        "instrument_id", "bin", (C("lo") + C("bin") * (C("hi") - C("lo")) / bins).alias("bin_start"),
        "n", "median")


def dates_only(d: DataFrame) -> DataFrame:
    return d.select("instrument_id", F.date_format("session_date", "yyyy-MM-dd").alias("date"))


def spec_conditions(spec) -> Column:
    """The active conditions of a spec as an array of (condition, setting, changed), for display
    beside any table; ``changed``: not the published setting."""
    base = type(spec)()
    active = [(f.name, getattr(spec, f.name)) for f in fields(spec)
              if getattr(spec, f.name) not in (None, False, ())]
    return F.array(*[F.struct(F.lit(n).alias("condition"), F.lit(str(v)).alias("setting"),
                              F.lit(v != getattr(base, n)).alias("changed")) for n, v in active])


def describe_spec(spark: SparkSession, spec) -> DataFrame:
    """The active conditions of a spec as rows."""
    return spark.range(1).select(F.inline(spec_conditions(spec)))


def relaxation_lines(tiers: DataFrame) -> DataFrame:
    """The relaxation summary of each instrument as one text."""
    return tiers.select("instrument_id", F.concat_ws(
        "; ", F.format_string("exact %d", "n_exact"),
        F.when(C("relaxed_strong") != "", F.format_string("strong %d (%s)", "n_strong",
                                                          "relaxed_strong")),
        F.when(C("relaxed_broad") != "", F.format_string("broad %d (%s)", "n_broad",
                                                         "relaxed_broad")),
        F.when(C("few_exact"), "few exact cases: indicative only")).alias("summary"))
