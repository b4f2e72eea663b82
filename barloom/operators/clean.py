"""Time zones and duplicates."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRICES = ["open", "high", "low", "close", "volume"]


def no_nan(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def wall_to_utc(wall: Column, tz: str) -> Column:
    """UTC instant of a wall-clock time. An ambiguous hour is read as summer time; an hour
    the clocks skip moves to the next existing full hour."""
    to_utc = F.convert_timezone(F.lit(tz), F.lit("UTC"), wall)
    back = F.convert_timezone(F.lit("UTC"), F.lit(tz), to_utc)
    return F.when(back == wall, to_utc).otherwise(
        F.date_trunc("hour", to_utc).cast("timestamp_ntz"))


def localize(df: DataFrame, source_tz: str, target_tz: str, wall: str = "wall") -> DataFrame:
    """Add ``utc_dt`` and the wall clock ``local_dt`` of the target zone."""
    return df.withColumn("utc_dt", wall_to_utc(F.col(wall), source_tz)).withColumn(
        "local_dt", F.convert_timezone(F.lit("UTC"), F.lit(target_tz), F.col("utc_dt")))


def second_pass(df: DataFrame, source_tz: str, seq: str, key: Sequence[str] = ("instrument_id",),
                wall: str = "wall") -> DataFrame:
    """Move the second occurrence of an ambiguous wall clock one hour later.

    ``seq`` orders the rows of the feed. Only rows of the ambiguous hour take part. The first
    occurrence per wall clock comes from an aggregate with map-side combine, so many copies of
    one minute never meet in one task.
    """
    amb = is_ambiguous(F.col(wall), source_tz)
    twice = df.where(amb)
    start = twice.groupBy(*key, wall).agg(F.min(seq).alias("first_seq"))
    hour = F.expr("interval 1 hour")
    moved = twice.join(start, [*key, wall]).withColumns({
        c: F.when(F.col(seq) > F.col("first_seq"), F.col(c) + hour).otherwise(F.col(c))
        for c in ("utc_dt", "local_dt")}).select(*df.columns)
    return df.where(~amb).unionByName(moved)


#: Rows of a feed that are looked at together.
SEQ_BLOCK = 4096


def repeated_hours(df: DataFrame, source_tz: str, seq: str,
                   key: Sequence[str] = ("instrument_id",), wall: str = "wall") -> DataFrame:
    """The rows whose wall clock occurs twice, with ``second`` (the second pass has begun) and
    ``clear`` (each repeated hour of the feed turns back exactly once).

    A repeated hour is a stretch of such rows that follow each other in the feed's order ``seq``;
    it turns back where the wall clock does not rise. Rows are taken in blocks of ``SEQ_BLOCK``
    places. An aggregate with map-side combine keeps of each block its last row and whether it
    has an ambiguous one; only the blocks that have are sorted, and a block's first row follows
    the last of the block before. So no window spans a feed's rows, only its blocks and its
    repeated hours, some two hours a year.
    """
    one = Window.partitionBy(*key)
    d = df.withColumns({"__amb": F.coalesce(is_ambiguous(F.col(wall), source_tz), F.lit(False)),
                        "__block": F.floor(F.col(seq) / SEQ_BLOCK)})
    block = [*key, "__block"]
    ends = d.groupBy(*block).agg(
        F.max("__amb").alias("__any"), F.max_by("__amb", seq).alias("__end_amb"),
        F.max_by(wall, seq).alias("__end_wall"))
    before = one.orderBy("__block")
    ends = ends.withColumns({"__end_amb": F.lag("__end_amb").over(before),
                             "__end_wall": F.lag("__end_wall").over(before)})
    inside = Window.partitionBy(*block).orderBy(seq)
    d = d.join(ends.where("__any").drop("__any"), block).withColumns({
        "__row": F.row_number().over(inside), "__amb_before": F.lag("__amb").over(inside),
        "__wall_before": F.lag(wall).over(inside)})
    first = F.col("__row") == 1
    follows = F.coalesce(F.when(first, F.col("__end_amb")).otherwise(F.col("__amb_before")),
                         F.lit(False))
    last = F.when(first, F.col("__end_wall")).otherwise(F.col("__wall_before"))
    d = d.withColumns({"__start": ~follows, "__back": follows & (F.col(wall) <= last)}).where("__amb")
    d = d.withColumn("__hour", F.sum(F.col("__start").cast("int")).over(one.orderBy(seq)))
    hour = Window.partitionBy(*key, "__hour")
    back = F.col("__back").cast("int")
    d = d.withColumns({"second": F.sum(back).over(hour.orderBy(seq)) > 0,
                       "__turns": F.sum(back).over(hour)})
    d = d.withColumn("clear", F.min(F.col("__turns") == 1).over(one))
    return d.select(*df.columns, "second", "clear")


def localize_inferred(df: DataFrame, source_tz: str, target_tz: str, seq: str,
                      key: Sequence[str] = ("instrument_id",), wall: str = "wall") -> DataFrame:
    """``localize`` with the second pass of a repeated hour found from the order of the rows, and
    ``fallback_used``: one unclear hour, and all of its feed is read as summer time."""
    amb = F.coalesce(is_ambiguous(F.col(wall), source_tz), F.lit(False))
    twice = repeated_hours(df, source_tz, seq, key, wall)
    feeds = twice.groupBy(*key).agg((~F.min("clear")).alias("fallback_used"))
    late = F.col("second") & F.col("clear")
    utc = wall_to_utc(F.col(wall), source_tz)
    moved = twice.withColumn("utc_dt", F.when(late, utc + F.expr("interval 1 hour")).otherwise(utc))
    rest = df.where(~amb).withColumn("utc_dt", utc)
    out = rest.unionByName(moved.drop("second", "clear"))
    out = out.withColumn("local_dt", F.convert_timezone(
        F.lit("UTC"), F.lit(target_tz), F.col("utc_dt")))
    return out.join(feeds, list(key), "left").withColumn(
        "fallback_used", F.coalesce("fallback_used", F.lit(False)))


def is_ambiguous(wall: Column, tz: str) -> Column:
    """Whether the wall clock occurs twice: an hour later in UTC shows the same time."""
    later = F.convert_timezone(F.lit(tz), F.lit("UTC"), wall) + F.expr("interval 1 hour")
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), later) == wall


def distinct_versions(df: DataFrame, key: Sequence[str],
                      values: Sequence[str] = tuple(PRICES)) -> DataFrame:
    """Rows after dropping exact repeats, with how often each occurred. The copies collapse
    in the map-side aggregate, so a key with very many copies never meets in one task."""
    return df.groupBy(*key, *values).agg(F.count(F.lit(1)).alias("copies"))


def ranked_versions(df: DataFrame, key: Sequence[str],
                    values: Sequence[str] = tuple(PRICES)) -> DataFrame:
    """Distinct versions with ``place`` (1 is kept), ``versions`` and ``n_raw`` of their key.

    Kept is the smallest version in column order. File order is not reproducible on a
    cluster, so the tie-break is part of the definition. Raw rows meet in a hash aggregate;
    only distinct versions are sorted.
    """
    one = Window.partitionBy(*key)
    return distinct_versions(df, key, values).withColumns({
        "place": F.row_number().over(one.orderBy(*values)),
        "versions": F.count(F.lit(1)).over(one), "n_raw": F.sum("copies").over(one)})


def keep_first(df: DataFrame, key: Sequence[str],
               values: Sequence[str] = tuple(PRICES)) -> DataFrame:
    """Clean table: one row per key."""
    return ranked_versions(df, key, values).where("place = 1").select(*key, *values, "n_raw")


def conflicts(df: DataFrame, key: Sequence[str],
              values: Sequence[str] = tuple(PRICES)) -> DataFrame:
    """Versions of keys that carry more than one distinct version."""
    return ranked_versions(df, key, values).where("versions > 1").select(*key, *values, "copies")


def duplicate_counts(df: DataFrame, key: Sequence[str], values: Sequence[str] = tuple(PRICES),
                     by: Sequence[str] = (), flag: Column | None = None) -> DataFrame:
    """Raw rows, exact copies dropped, keys in conflict and clean rows, per ``by`` (part of the
    key) or in one row. ``flag``: a maximum over the raw rows that rides along."""
    extra = [] if flag is None else [flag]
    v = df.groupBy(*key, *values).agg(F.count(F.lit(1)).alias("copies"), *extra)
    name = [c for c in v.columns if c not in {*key, *values, "copies"}]
    up = [F.max(c).alias(c) for c in name]
    k = v.groupBy(*key).agg(F.count(F.lit(1)).alias("versions"),
                            F.sum("copies").alias("copies"), *up)
    return k.groupBy(*by).agg(
        F.sum("copies").alias("n_raw"),
        F.sum(F.col("copies") - F.col("versions")).alias("n_exact_duplicates"),
        F.count(F.when(F.col("versions") > 1, 1)).alias("n_conflicting_duplicates"),
        F.count(F.lit(1)).alias("n_clean"), *up)
