"""Opening paths on a common grid and distances between them."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import SESSION, ratio
from barloom.operators.bars import cash
from barloom.operators.daily import reference_levels
from barloom.plans.storage import cut

C = F.col


def path_value(unit: str) -> Column:
    move = C("c") - C("ref_open")
    return {"points": move, "pct": 100.0 * ratio(move, C("ref_open")),
            "prior_range": ratio(move, C("prev_range")), "atr": ratio(move, C("atr"))}[unit]


def session_paths(bars: DataFrame, daily: DataFrame, cutoff_min: int, unit: str = "atr",
                  step: int = 5) -> DataFrame:
    """One row per session: the rebased path on the grid 0, step, ... cutoff.

    The bars of a session up to the cutoff form one short array; each grid minute takes the
    last bar at or before it and stays NULL ahead of the first bar.
    """
    b = cash(bars, cutoff_min).select(*SESSION, "mso", C("adj_close").alias("c"))
    b = b.join(reference_levels(daily).where("ref_open is not null"), SESSION)
    d = b.select(*SESSION, "mso", path_value(unit).alias("v")).groupBy(*SESSION).agg(
        F.array_sort(F.collect_list(F.struct("mso", "v"))).alias("pts"))
    grid = F.sequence(F.lit(0), F.lit(cutoff_min), F.lit(step))

    def at(g: Column) -> Column:
        known = F.filter("pts", lambda x: (x["mso"] <= g) & x["v"].isNotNull())
        return F.try_element_at(known, F.lit(-1))["v"]

    return d.select(*SESSION, F.transform(grid, at).alias("path"))


def long_paths(paths: DataFrame, step: int = 5) -> DataFrame:
    return paths.select(*SESSION, F.posexplode("path").alias("k", "value")).select(
        *SESSION, (C("k") * step).alias("grid_min"), "value")


def against_reference(paths: DataFrame, refs: DataFrame) -> DataFrame:
    """Each session's path next to its instrument's reference path (the reference left out).

    ``refs``: instrument_id, reference_date.
    """
    inst = Window.partitionBy("instrument_id")
    is_ref = C("session_date") == C("reference_date")
    d = paths.join(refs, "instrument_id").withColumn(
        "ref_path", F.first(F.when(is_ref, C("path")), ignorenulls=True).over(inst))
    return d.where(C("ref_path").isNotNull() & ~is_ref)


def path_scores(paired: DataFrame) -> DataFrame:
    """Correlation, RMS distance and cosine over the minutes both paths know."""
    long = paired.select(*SESSION, F.inline(F.arrays_zip("path", "ref_path"))).select(
        *SESSION, C("path").alias("a"), C("ref_path").alias("b"))
    both = C("a").isNotNull() & C("b").isNotNull()

    def total(x: Column) -> Column:
        return F.sum(F.when(both, x))

    s = long.groupBy(*SESSION).agg(
        F.count(F.when(both, 1)).alias("n"),
        F.covar_pop(F.when(both, C("a")), F.when(both, C("b"))).alias("cov"),
        F.stddev_pop(F.when(both, C("a"))).alias("sa"), F.stddev_pop(F.when(both, C("b"))).alias("sb"),
        F.avg(F.when(both, (C("a") - C("b")) * (C("a") - C("b")))).alias("mse"),
        total(C("a") * C("b")).alias("ab"), total(C("a") * C("a")).alias("aa"),
        total(C("b") * C("b")).alias("bb"))
    corr = C("cov") / F.nullif(C("sa") * C("sb"), F.lit(0.0))
    return s.select(*SESSION, "n", F.when(C("n") >= 3, corr).alias("correlation"),
                    F.sqrt("mse").alias("euclidean"),
                    (C("ab") / F.nullif(F.sqrt("aa") * F.sqrt("bb"), F.lit(0.0))).alias("cosine"))


def dtw_udf(band: int | None = None):
    """Warping distance divided by the two lengths, for a batch of path pairs at once.

    Only minutes known to both paths count, so both sides of a pair have the same length and
    any band is valid. The table is filled cell by cell for the whole Arrow batch; a shorter
    pair reads its result from its own corner, which later cells cannot change.
    """

    @F.pandas_udf("double")
    def dtw(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = []
        for x, y in zip(a, b):
            x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
            ok = ~(np.isnan(x) | np.isnan(y))
            pairs.append((x[ok], y[ok]))
        n = np.array([len(x) for x, _ in pairs], dtype=int)
        top = int(n.max()) if len(n) else 0
        if top == 0:
            return pd.Series([None] * len(pairs), dtype="float64")
        left, right = np.zeros((len(pairs), top)), np.zeros((len(pairs), top))
        for k, (x, y) in enumerate(pairs):
            left[k, :len(x)], right[k, :len(y)] = x, y
        reach = band or top
        prev = np.full((len(pairs), top + 1), np.inf)
        prev[:, 0] = 0.0
        out = np.full(len(pairs), np.nan)
        for i in range(1, top + 1):
            cur = np.full_like(prev, np.inf)
            for j in range(max(1, i - reach), min(top, i + reach) + 1):
                best = np.minimum(np.minimum(prev[:, j], cur[:, j - 1]), prev[:, j - 1])
                cur[:, j] = np.abs(left[:, i - 1] - right[:, j - 1]) + best
            done = n == i
            out[done] = cur[done, i] / (2 * i)
            prev = cur
        return pd.Series(out)

    return dtw


def distance_of(method: str) -> Column:
    """Distance out of the scores; 0 is identical."""
    return {"correlation": lambda: (1.0 - C("correlation")) / 2.0,
            "cosine": lambda: (1.0 - C("cosine")) / 2.0,
            "euclidean": lambda: C("euclidean")}[method]()


def path_distance(paired: DataFrame, method: str = "correlation",
                  band: int | None = None) -> DataFrame:
    """One distance per session; 0 is identical."""
    if method == "dtw":
        d = paired.withColumn("d", dtw_udf(band)("path", "ref_path"))
        return d.select(*SESSION, F.when(~F.isnan("d"), C("d")).alias("path_dist"))
    return path_scores(paired).select(*SESSION, distance_of(method).alias("path_dist"))


def warping_bound(a: Column, b: Column, band: int | None = None) -> Column:
    """No more than the warping distance of two paths of equal length without gaps.

    Every value of one path meets some value of the other within the band, so it costs its way
    to the other's envelope at least; and first meets first as last meets last. Built-in functions
    on the arrays of the row.
    """
    n = F.size(a)

    def beyond(x: Column, y: Column) -> Column:
        if band is None:
            lo, hi = F.array_min(y), F.array_max(y)
            return F.aggregate(x, F.lit(0.0), lambda s, v: s + F.greatest(
                F.lit(0.0), v - hi, lo - v))
        def near(i: Column) -> Column:
            first = F.greatest(i - band, F.lit(0))
            return F.slice(y, first + 1, i + band + 1 - first)
        cost = F.transform(x, lambda v, i: F.greatest(
            F.lit(0.0), v - F.array_max(near(i)), F.array_min(near(i)) - v))
        return F.aggregate(cost, F.lit(0.0), lambda s, v: s + v)

    first, last = (F.abs(F.get(a, i) - F.get(b, i)) for i in (F.lit(0), n - 1))
    ends = first + F.when(n > 1, last).otherwise(0.0)
    return F.greatest(beyond(a, b), beyond(b, a), ends) / (2 * n)


def warped_pairs(paired: DataFrame, n: int, band: int | None = None) -> DataFrame:
    """Of each instrument the sessions whose warping distance to the reference is worth knowing
    for its ``n`` nearest, with that distance.

    The ``n`` with the smallest bounds are warped first; no session whose bound is above the
    greatest of their distances can be among the nearest, and only the others are warped.
    """
    both = F.filter(F.arrays_zip("path", "ref_path"), lambda z: z["path"].isNotNull()
                    & z["ref_path"].isNotNull())
    d = paired.select("instrument_id", "session_date", both.alias("z")).where(F.size("z") > 0)
    d = d.select(*SESSION, C("z.path").alias("a"), C("z.ref_path").alias("b"))
    d = cut(d.withColumn("bound", warping_bound(C("a"), C("b"), band)))
    order = Window.partitionBy("instrument_id").orderBy("bound", "session_date")
    first = (d.withColumn("k", F.row_number().over(order)).where(C("k") <= n)
             .withColumn("path_dist", dtw_udf(band)("a", "b")))
    first = cut(first.select(*SESSION, "path_dist"))
    limits = first.groupBy("instrument_id").agg(F.max("path_dist").alias("limit"))
    # Sums in another order may differ in the last bits.
    rest = (d.join(limits, "instrument_id").where(C("bound") <= C("limit") * (1 + 1e-9))
            .join(first.select(*SESSION), SESSION, "left_anti")
            .withColumn("path_dist", dtw_udf(band)("a", "b")))
    return first.unionByName(rest.select(*SESSION, "path_dist"))


def nearest_by_warping(paired: DataFrame, n: int, band: int | None = None) -> DataFrame:
    """The ``n`` sessions nearest to each reference by warping distance; ties by date."""
    order = Window.partitionBy("instrument_id").orderBy("path_dist", "session_date")
    return (warped_pairs(paired, n, band).withColumn("rank", F.row_number().over(order))
            .where(C("rank") <= n))


def median_band(paths: DataFrame, step: int = 5) -> DataFrame:
    """Quartiles of the paths at every grid minute."""
    return long_paths(paths, step).groupBy("instrument_id", "grid_min").agg(
        F.count("value").alias("n"),
        F.percentile("value", [0.25, 0.5, 0.75]).alias("q")).select(
        "instrument_id", "grid_min", "n", C("q")[0].alias("p25"), C("q")[1].alias("median"),
        C("q")[2].alias("p75"))


def overlay(paths: DataFrame, refs: DataFrame, lines: int = 25, step: int = 5) -> DataFrame:
    """Reference path and the first paths by date, for a chart."""
    w = Window.partitionBy("instrument_id", "is_ref").orderBy("session_date")
    d = paths.join(refs, "instrument_id").withColumn(
        "is_ref", C("session_date") == C("reference_date"))
    d = d.withColumn("k", F.row_number().over(w)).where(C("is_ref") | (C("k") <= lines))
    return d.select(*SESSION, "is_ref", F.posexplode("path").alias("j", "value")).select(
        *SESSION, "is_ref", (C("j") * step).alias("grid_min"), "value")
