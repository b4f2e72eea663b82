"""File readers and sinks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.clean import no_nan

# The raw file formats.
PLAIN_FEED = T.StructType([T.StructField(c, T.StringType()) for c in ("date", "time")]
                          + [T.StructField(c, T.DoubleType())
                             for c in ("open", "high", "low", "close", "volume")])
CONTRACT_FEED = T.StructType([
    T.StructField("Datetime", T.StringType()), T.StructField("ContractMonth", T.LongType()),
    T.StructField("Expiry", T.LongType()), T.StructField("ConId", T.LongType()),
    T.StructField("LocalSymbol", T.StringType()), T.StructField("Open", T.DoubleType()),
    T.StructField("High", T.DoubleType()), T.StructField("Low", T.DoubleType()),
    T.StructField("Close", T.DoubleType()), T.StructField("Volume", T.DoubleType()),
    T.StructField("Average", T.DoubleType()), T.StructField("BarCount", T.DoubleType())])
CONTRACT_NAMES = {
    "Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume",
    "ContractMonth": "contract_month", "Expiry": "expiry", "ConId": "con_id",
    "LocalSymbol": "local_symbol", "Average": "average", "BarCount": "bar_count"}
PRICES = ["open", "high", "low", "close", "volume"]


def _plain_columns() -> list:
    return [F.to_timestamp_ntz(F.concat_ws(" ", "date", "time"),
                               F.lit("dd/MM/yyyy HH:mm:ss")).alias("wall"), *PRICES]


def parse_plain_lines(d: DataFrame, line: str) -> DataFrame:
    """The plain format out of a text column, for feeds that arrive as messages."""
    keep = [c for c in d.columns if c != line]
    parsed = d.select(*keep, F.from_csv(line, F.lit(PLAIN_FEED.simpleString()[7:-1].replace(
        ":", " ")), {"sep": ";"}).alias("r")).select(*keep, "r.*")
    return no_nan(parsed.select(*keep, *_plain_columns()), PRICES)


def read_plain_feed(spark: SparkSession, path: str, instrument_id: int = 1) -> DataFrame:
    """Headerless ``;`` file with a date and a time column; wall clock kept as given."""
    d = spark.read.csv(path, sep=";", schema=PLAIN_FEED)
    return no_nan(d.select(
        F.lit(instrument_id).cast("long").alias("instrument_id"),
        *_plain_columns(), F.col("_metadata.file_name").alias("source_file")), PRICES)


def read_contract_feed(spark: SparkSession, glob: str, instrument_id: int = 1) -> DataFrame:
    """Headed files, one per contract. Columns are taken by name; a glob that matches no file
    raises when the plan is made."""
    header = spark.read.option("header", True).option("inferSchema", False).csv(glob)
    types = {f.name: f.dataType for f in CONTRACT_FEED}
    d = header.select(
        F.lit(instrument_id).cast("long").alias("instrument_id"),
        F.to_timestamp_ntz("Datetime").alias("wall"),
        *[F.col(k).cast(types[k]).alias(v) for k, v in CONTRACT_NAMES.items()],
        F.col("_metadata.file_name").alias("source_file"))
    return no_nan(d, [*PRICES, "average", "bar_count"])


def write_table(df: DataFrame, path: str, date_col: str = "session_date") -> None:
    """Parquet partitioned by year and sorted by session inside the files: a date filter
    prunes directories, an instrument filter row groups. A table without dates is one folder.

    Rows are dealt by instrument, as the features leave them, so these are not exchanged again.
    """
    if date_col not in df.columns:
        df.withColumn("year", F.lit(0)).write.mode("overwrite").partitionBy("year").parquet(path)
        return
    (df.repartition("instrument_id").withColumn("year", F.year(date_col))
     .sortWithinPartitions("year", "instrument_id", date_col)
     .write.mode("overwrite").partitionBy("year").parquet(path))


def write_bucketed(df: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Bars in buckets of sessions, sorted by session and inside folders by year, as a table that
    the per-session operators read without an exchange. ``path``: where its files lie, the
    warehouse if not given. One shuffle deals the rows to their buckets, so a folder has one file
    for each bucket."""
    keys = ("instrument_id", "session_date")
    out = (df.withColumn("year", F.year("session_date")).repartition(buckets, *keys)
           .write.mode("overwrite").partitionBy("year").bucketBy(buckets, *keys).sortBy(*keys))
    (out if path is None else out.option("path", path)).saveAsTable(table)
    return df.sparkSession.table(table).drop("year")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def params_row(spark: SparkSession, params) -> DataFrame:
    """A parameter object as a one-row table, for the JSON sink."""
    import json
    return spark.range(1).select(F.lit(type(params).__name__).alias("kind"),
                                 F.lit(json.dumps(params.as_dict())).alias("spec"))
