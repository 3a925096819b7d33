"""Table files: readers with explicit schemas, and writers that size their files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow import schemas as S
from parcelflow.functions.text import iso_timestamp
from parcelflow.operators.weather import snapshot_flags, to_snapshot
from parcelflow.sources import bronze
from parcelflow.sources.generations import BATCH, Generations  # noqa: F401


def deal_out(scan: DataFrame) -> DataFrame:
    """Spreads a scan over the cores when its files allow fewer tasks than there are cores.

    One large row group cannot be split, so a short table in one file would keep a single
    core busy. A table with at least as many splits as cores is returned as it is. Rows
    are dealt by the hash of all their columns, which needs no sort to be repeatable.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan.rdd.getNumPartitions()
    return scan if splits >= cores else scan.repartition(min(cores, 4 * splits), *scan.columns)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """The table at ``path``, or an empty one while nothing has been written there."""
    try:
        return spark.read.format(fmt).schema(schema).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# --- events -----------------------------------------------------------------


def read_bronze(
    spark: SparkSession, path: str, from_date: str | None = None, to_date: str | None = None
) -> DataFrame:
    """Bronze events of all finished batches. The dates select partitions, not rows."""
    return bronze.read(spark, path, None, from_date, to_date)


def read_silver(
    spark: SparkSession, path: str, from_date: str | None = None, to_date: str | None = None
) -> DataFrame:
    """Silver events; only the folders of the dates asked for are listed."""
    table = silver_table(spark, path)
    manifest = table.manifest()
    if not manifest:  # a plain folder by date
        return _between(read_or_empty(spark, path, S.SILVER_SCHEMA), from_date, to_date)
    dates = [d for d in manifest if (not from_date or d >= from_date) and (not to_date or d <= to_date)]
    return _between(table.read(manifest, dates or manifest), from_date, to_date)


def silver_table(spark: SparkSession, path: str) -> Generations:
    return Generations(spark, path, S.SILVER_SCHEMA, "event_date")


def read_batches(spark: SparkSession, path: str, batches: list[int]) -> DataFrame:
    """Bronze events of some batches, from their folders or the slices they were compacted into."""
    return bronze.read(spark, path, batches)


def _between(events: DataFrame, from_date: str | None, to_date: str | None) -> DataFrame:
    if from_date:
        events = events.filter(F.col("event_date") >= F.lit(from_date).cast("date"))
    if to_date:
        events = events.filter(F.col("event_date") <= F.lit(to_date).cast("date"))
    return events


def write_by_date(events: DataFrame, path: str) -> None:
    """Full overwrite, one directory per event date.

    The rebalance hint gathers the rows of a date into few files and splits a date that
    is too large for one task; a plain repartition by date would not.
    """
    events.hint("rebalance", "event_date").write.mode("overwrite").partitionBy("event_date").parquet(path)


# --- parcels ----------------------------------------------------------------


def read_parcels(spark: SparkSession, path: str) -> DataFrame:
    """Parcel rows from JSON lines, those without an id included; blank lines give no row. Nothing is inferred.

    Lines that do not parse are in ``read_parcel_rejects``.
    """
    return _parcel_lines(spark, path).filter(f"{BROKEN_LINE} IS NULL").drop(BROKEN_LINE)


def read_parcel_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the parcel files that do not parse, as ``line``."""
    return _parcel_lines(spark, path).filter(f"{BROKEN_LINE} IS NOT NULL").select(F.col(BROKEN_LINE).alias("line"))


BROKEN_LINE = "_broken_line"


def _parcel_lines(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*S.PARCEL_SCHEMA, T.StructField(BROKEN_LINE, T.StringType())])
    try:
        return spark.read.schema(schema).option("columnNameOfCorruptRecord", BROKEN_LINE).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_parcels(parcels: DataFrame, path: str) -> None:
    """Appends parcel rows as JSON lines with ISO timestamps."""
    columns = [
        iso_timestamp(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        for f in S.PARCEL_SCHEMA
    ]
    parcels.select(*columns).write.mode("append").json(path)


# --- weather ----------------------------------------------------------------


def read_weather_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """``hub_id, weather_bad`` of a snapshot document, None while there is none."""
    try:
        document = spark.read.schema(S.SNAPSHOT_SCHEMA).json(path, multiLine=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return snapshot_flags(document)


WEATHER_SCHEMA = T.StructType(
    [
        T.StructField("hub_id", T.StringType()),
        T.StructField("weather_bad", T.BooleanType()),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)


def write_weather(flagged: DataFrame, path: str) -> None:
    """Adds a snapshot of the hub flags, stamped with the time of writing.

    A snapshot has at most a row per hub and appears as one file, so a running stream sees
    either all of it or none.
    """
    flags = to_snapshot(flagged.select("hub_id", "weather_bad"), F.current_timestamp())
    flags.coalesce(1).write.mode("append").parquet(path)


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """The hub flags of the newest snapshot; a hub it leaves out has no weather."""
    stored = read_or_empty(spark, path, WEATHER_SCHEMA)
    newest = stored.agg(F.max("fetched_at")).first()[0]
    return stored.filter(F.col("fetched_at") == F.lit(newest))
