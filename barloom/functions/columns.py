"""Null-safe column helpers and the windows every operator shares.

Missing values are NULL everywhere, never NaN. Every window carries a partition key:
``(instrument_id, session_date)`` holds at most one row per bar of a day and
``instrument_id`` at most one row per calendar session, so no window group grows with
the number of raw ticks.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

SESSION = ["instrument_id", "session_date"]


def in_session() -> WindowSpec:
    return Window.partitionBy(*SESSION).orderBy("mso")


def whole_session() -> WindowSpec:
    return Window.partitionBy(*SESSION)


def in_calendar() -> WindowSpec:
    return Window.partitionBy("instrument_id").orderBy("session_date")


def before(w: WindowSpec, n: int | None = None) -> WindowSpec:
    """Rows strictly before the current one (the last n of them, or all)."""
    return w.rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def prior(x: Column, n: int, at_least: int, fn: Callable[[Column], Column]) -> Column:
    """``fn`` over the n sessions before this one, NULL below ``at_least`` known values."""
    w = before(in_calendar(), n)
    return F.when(F.count(x).over(w) >= at_least, fn(x).over(w))


def lag_session(x: Column, k: int = 1) -> Column:
    return F.lag(x, k).over(in_calendar())


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def pct(a: Column, b: Column) -> Column:
    """100 * (a - b) / b."""
    return F.lit(100.0) * (a - b) / F.nullif(b, F.lit(0.0))


def yes(cond: Column) -> Column:
    """A condition on missing data does not hold."""
    return F.coalesce(cond, F.lit(False))


def all_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, [yes(c) for c in conds], F.lit(True))


def any_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, [yes(c) for c in conds], F.lit(False))


def first_match(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    out = None
    for cond, label in rules:
        out = F.when(yes(cond), label) if out is None else out.when(yes(cond), label)
    return out.otherwise(default)


def last_match(default: str, rules: Sequence[tuple[Column, str]]) -> Column:
    """Rules listed weakest first; a later rule overrides an earlier one."""
    return first_match(list(rules)[::-1], default)


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def ever(cond: Column) -> Column:
    """Whether any row of the group meets the condition (False for none)."""
    return F.coalesce(F.bool_or(cond), F.lit(False))


def first_minute(cond: Column, minute: str = "mso") -> Column:
    return F.min(F.when(cond, F.col(minute)))


def earliest(x: Column, cond: Column | None = None, by: str = "mso") -> Column:
    o = F.col(by)
    return F.min_by(x, o) if cond is None else F.min_by(F.when(cond, x), F.when(cond, o))


def latest(x: Column, cond: Column | None = None, by: str = "mso") -> Column:
    o = F.col(by)
    return F.max_by(x, o) if cond is None else F.max_by(F.when(cond, x), F.when(cond, o))


def clock(minute_of_day: Column) -> Column:
    m = minute_of_day.cast("int")
    return F.when(m.isNotNull(), F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), m % 60))


def mean_known(xs: Sequence[Column]) -> Column:
    """Mean of the known values among several columns."""
    total = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in xs])
    n = reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in xs])
    return total / F.nullif(n, F.lit(0))


def percentiles(x: Column, qs: Sequence[float]) -> Column:
    """Exact linear-interpolated percentiles (one array)."""
    return F.percentile(x, [float(q) for q in qs])
