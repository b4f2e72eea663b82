"""Paths, ranking, the ladder, the search."""
from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import DAY, by_key, five_minutes, make_bars, weekdays
from pyspark.sql import functions as F

from barloom.operators import daily, outcomes, paths, reports, similarity
from barloom.params import BLOCKS, FilterSpec
from barloom.plans.search import analog_search, last_sessions

PAIR = "instrument_id long, session_date date, path array<double>, ref_path array<double>"


def pair(spark, a, b):
    return spark.createDataFrame([(1, DAY, a, b)], PAIR)


def test_path_scores(spark):
    a, b = [None, 0.0, 1.0, 2.0, 4.0], [0.0, 0.5, 1.0, 1.0, None]
    r = paths.path_scores(pair(spark, a, b)).first()
    x, y = np.array([0.0, 1.0, 2.0]), np.array([0.5, 1.0, 1.0])
    assert r.n == 3 and r.correlation == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert r.euclidean == pytest.approx(np.sqrt(np.mean((x - y) ** 2)))
    assert r.cosine == pytest.approx(x @ y / np.linalg.norm(x) / np.linalg.norm(y))
    flat = paths.path_scores(pair(spark, [1.0, 1.0, 1.0], [0.0, 0.0, 0.0])).first()
    assert flat.correlation is None and flat.cosine is None and flat.euclidean == 1.0
    none = paths.path_scores(pair(spark, [None, None], [1.0, 2.0])).first()
    assert (none.n, none.correlation, none.euclidean) == (0, None, None)


def naive_warp(a, b, band=None):
    ok = [(x, y) for x, y in zip(a, b) if x is not None and y is not None]
    n, memo = len(ok), {}
    if n == 0:
        return None

    def cost(i, j):
        if (i, j) == (0, 0):
            return 0.0
        if i == 0 or j == 0 or abs(i - j) > (band or n):
            return float("inf")
        if (i, j) not in memo:
            memo[i, j] = abs(ok[i - 1][0] - ok[j - 1][1]) + min(
                cost(i - 1, j), cost(i, j - 1), cost(i - 1, j - 1))
        return memo[i, j]

    return cost(n, n) / (2 * n)


@pytest.mark.parametrize("band", [None, 2])
def test_warping_equals_brute_force(spark, band):
    rnd, rows = random.Random(5), []
    for d in weekdays(60):
        def series():
            return [None if rnd.random() < 0.1 else rnd.uniform(-1, 1) for _ in range(9)]
        rows.append((1, d, series(), series()))
    rows.append((1, weekdays(61)[60], [None] * 9, [1.0] * 9))
    got = by_key(paths.path_distance(spark.createDataFrame(rows, PAIR), "dtw", band), "session_date")
    for _, d, a, b in rows:
        want = naive_warp(a, b, band)
        assert got[d]["path_dist"] == (None if want is None else pytest.approx(want))


def sample(spark, n=80):
    rnd, days = random.Random(2), weekdays(n)
    px, s = 1000.0, {}
    for d in days:
        out = []
        px += rnd.uniform(-6, 8)
        for m in [-10, *range(0, 100, 5), 200, 300, 505, 520]:
            o = px
            px += rnd.uniform(-3, 3.1)
            out.append((m, o, max(o, px) + rnd.uniform(0, 2), min(o, px) - rnd.uniform(0, 2), px))
        s[d] = out
    return days, s


def test_grid_fills_forward_only(spark):
    b = make_bars(spark, {DAY: [(7, 1, 1, 1, 103.0), (12, 1, 1, 1, 104.0), (60, 1, 1, 1, 500.0)]})
    d = spark.createDataFrame([(1, DAY, 100.0)] , "instrument_id long, session_date date, cash_open_adj double")
    d = d.withColumns({c: F.lit(None).cast("double") for c in (
        "previous_day_high", "previous_day_low", "previous_close", "overnight_high_adj",
        "overnight_low_adj", "prior_ath", "previous_day_range")} | {"atr": F.lit(2.0)})
    r = paths.session_paths(b, d, 20, "atr").first()
    assert r.path == [None, None, 1.5, 2.0, 2.0]
    assert paths.session_paths(b, d, 20, "prior_range").first().path == [None] * 5


def test_search_modes(spark):
    days, s = sample(spark)
    b = make_bars(spark, s)
    d = daily.daily_features(b)
    refs = last_sessions(d)
    spec = FilterSpec(gap_sign="positive", vol_regimes=("low", "normal"))
    r = analog_search(b, d, refs, spec, "exact", n=5)
    top = r.top.orderBy("rank").collect()
    assert 0 < len(top) <= 5 and all(x.gap_pct > 0 for x in top)
    assert [x.similarity_score for x in top] == sorted((x.similarity_score for x in top), reverse=True)
    assert days[-1] not in {x.session_date for x in top}
    assert {x.day_classification for x in top} <= set(outcomes.CLASSES)
    assert r.explanations.count() == len(top) and r.headline.first().sample_size == len(top)
    assert "gap" in r.reference.first().description
    every = analog_search(b, d, refs, mode="similarity", n=200)
    assert every.top.count() == len(days) - 1
    nothing = analog_search(b, d, refs, FilterSpec(gap_min_pct=99.0), "exact")
    assert nothing.top.count() == 0 and nothing.distribution.count() == 0
    year = analog_search(b, d, refs, mode="similarity", n=200, period="last_year", path_method="dtw")
    assert year.top.count() == len(days) - 1


def test_matching_ignores_bars_after_the_cutoff(spark):
    days, s = sample(spark, 40)
    bent = dict(s)
    # the last candidate's later bars change neither its features nor its distance
    bent[days[-1]] = [x if x[0] <= 90 else (x[0], 5, 6, 4, 5) for x in s[days[-1]]]
    refs = spark.createDataFrame([(1, days[30])], "instrument_id long, reference_date date")

    def scores(sessions):
        b = make_bars(spark, sessions)
        got = analog_search(b, daily.daily_features(b), refs, mode="similarity", n=100).top
        return {x.session_date: x.similarity_score for x in got.collect()}

    a, b = scores(s), scores(bent)
    assert a == pytest.approx(b)


def feature_table(spark, n, **cols):
    names = [f for fs in BLOCKS.values() for f in fs]
    days = weekdays(n)
    base = {f: [0.0] * n for f in names} | cols
    rows = [(1, days[i], *[None if base[f][i] is None else float(base[f][i]) for f in names])
            for i in range(n)]
    return days, spark.createDataFrame(rows, "instrument_id long, session_date date, " + ", ".join(
        f"{f} double" for f in names))


def test_scaling_and_imputation(spark):
    days, d = feature_table(spark, 5, gap_pct=[1, 2, 3, 4, None], first_bar_return=[0, 0, 0, 0, 9],
                            first_bearish_expansion_min=[5, None, 5, 5, 5])
    x = by_key(similarity.imputed(d, 90), "session_date")
    assert x[days[4]]["gap_pct"] == 2.5 and x[days[1]]["first_bearish_expansion_min"] == 120.0
    z = by_key(similarity.robust_scaled(d, 90), "session_date")
    assert z[days[0]]["gap_pct"] == pytest.approx((1 - 2.5) / 1.0)  # quartiles of the filled values
    assert z[days[4]]["first_bar_return"] == pytest.approx(9 / np.std([0, 0, 0, 0, 9], ddof=1))
    assert z[days[0]]["overnight_return_pct"] == 0.0


def flags(spark, rows):
    d = spark.createDataFrame([(1, weekdays(len(rows))[i], r) for i, r in enumerate(rows)],
                              "instrument_id long, session_date date, passes array<boolean>")
    spec = FilterSpec(ath_within_pct=0.25, weakness_by_min=90.0)
    return similarity.tiers(d, spec, 2).first()


def test_ladder(spark):
    t, f = True, False
    r = flags(spark, [[t, t, t, t, t, t]] * 4)
    assert (r.n_exact, r.strong_rung, r.broad_rung) == (4, 1, 1)  # the first rung always applies
    r = flags(spark, [[f, f, t, t, t, t], [f, f, t, t, t, t], [f, f, f, f, t, t], [f, f, f, f, t, t]])
    assert (r.n_exact, r.n_strong, r.n_broad, r.strong_rung, r.broad_rung) == (0, 2, 4, 2, 4)
    assert r.relaxed_strong.count(";") == 1 and r.few_exact
    r = flags(spark, [[f, f, f, f, f, t]])
    assert (r.n_strong, r.n_broad, r.strong_rung, r.relaxed_strong) == (1, 1, 5, "")
    r = flags(spark, [[f, f, f, f, f, f]])
    assert (r.n_strong, r.strong_rung) == (0, 0)


def test_ladder_skips_unset_conditions():
    notes = [n for n, _ in similarity.relaxations(FilterSpec(gap_sign="positive"))]
    assert len(notes) == 2 and "gap" in notes[0]
    last = similarity.relaxations(FilterSpec(ath_within_pct=0.1, gap_sign="positive"))[-1][1]
    assert last.ath_within_pct == 1.0 and last.gap_sign is None


def test_missing_data_fails_a_filter(spark):
    d = spark.createDataFrame([(1, DAY, None)], "instrument_id long, session_date date, gap_pct double")
    assert d.where(similarity.matches_filter(FilterSpec(gap_sign="positive"))).count() == 0
    assert d.where(similarity.matches_filter(FilterSpec())).count() == 1


def test_distribution_and_histogram(spark):
    d = spark.createDataFrame([(1, float(x)) for x in (-1, 0, 1, 2)], "instrument_id long, v double")
    o = d.withColumns({m: F.col("v") for m in reports.METRICS[:1]} | {
        m: F.lit(None).cast("double") for m in reports.METRICS[1:]})
    r = reports.distribution(o).collect()
    assert len(r) == 1 and (r[0].n, r[0].median, r[0].positive_pct) == (4, 0.5, 50.0)
    assert r[0].std == pytest.approx(np.std([-1, 0, 1, 2]))
    h = reports.histogram(d, "v", bins=3).orderBy("bin").collect()
    assert [(x.bin, x.n) for x in h] == [(0, 1), (1, 1), (2, 2)]
    one = reports.histogram(d.where("v = 1"), "v").collect()
    assert [(x.bin, x.n) for x in one] == [(0, 1)]


def test_narrow_search_reads_fewer_columns_and_finds_the_same(spark):
    """What the search doesn't read is neither aggregated nor written; the results stay."""
    from barloom.plans import catalog, search
    t = catalog.Tables(spark, "/root/testdata/sf0.001")
    wide, slim = t.stored_daily, t.searched_daily
    assert not {"cash_open_raw", "overnight_open", "n_bars"} & set(slim.columns) and len(slim.columns) < 40 < len(wide.columns)
    cols = ["instrument_id", "session_date", "rank", "similarity_score", "day_classification"]
    got = [search.analog_search(t.bars, d, search.last_sessions(d), catalog.WIDE, n=5, narrow=k).top.select(
        *cols).orderBy("instrument_id", "rank").collect() for d, k in ((wide, False), (slim, True))]
    assert got[0] == got[1] and got[0]
