"""Alerts on the stream of state changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from parcelflow import schemas as S
from parcelflow.operators import alerts as alert_ops
from parcelflow.sources.files import BATCH, read_or_empty
from parcelflow.streaming.change_feed import read_changes
from parcelflow.streaming.lake import Lake, batch_dir

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("parcel_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("breached", T.BooleanType()),
        T.StructField("subject", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("version", T.IntegerType()),
    ]
)


def change_feed(spark: SparkSession, lake: Lake) -> DataFrame:
    """Every state row the ingest wrote, as a stream of new images.

    A replayed ingest batch replaces its files; the old ones may be gone when this stream
    gets to them, and the new ones follow.
    """
    schema = T.StructType([*S.STATE_SCHEMA, BATCH])
    if read_or_empty(spark, lake.changes, schema).limit(1).isEmpty():
        # A stream needs its folder; an ingest that has not started yet has not made it.
        spark.createDataFrame([], S.STATE_SCHEMA).write.mode("append").parquet(batch_dir(lake.changes, -1))
    return (
        spark.readStream.schema(schema).option("ignoreMissingFiles", "true").parquet(lake.changes).drop("batch_id")
    )


def sent_alerts(spark: SparkSession, lake: Lake) -> DataFrame:
    return read_or_empty(spark, lake.alerts, T.StructType([*ALERT_SCHEMA, BATCH]))


def write_batch(
    changed: DataFrame,
    batch_id: int,
    lake: Lake,
    parcels: Callable[[SparkSession], DataFrame],
    as_of: Column | None = None,
    accel: float = S.TIME_ACCELERATION,
    seen_once: bool = False,
) -> None:
    """Alerts of one micro-batch. A change is known by parcel and version and alerts once,
    even if a replay shows it again. A feed that shows each change once (``seen_once``) spares
    the look at the alerts that were sent before."""
    spark = changed.sparkSession
    now = F.current_timestamp() if as_of is None else as_of
    fresh = changed.select("parcel_id", "version", "status").distinct()
    # The batch is the short side: only its parcels are looked up.
    wanted = parcels(spark).join(fresh.select("parcel_id"), "parcel_id", "left_semi")
    found = alert_ops.alerts(fresh, wanted, now, accel)
    if not seen_once:
        sent = sent_alerts(spark, lake).filter(F.col("batch_id") < batch_id).select("parcel_id", "version")
        found = found.join(sent, ["parcel_id", "version"], "left_anti")
    found.select(*ALERT_SCHEMA.names).write.mode("overwrite").parquet(batch_dir(lake.alerts, batch_id))


def start(
    spark: SparkSession,
    lake: Lake,
    parcels: Callable[[SparkSession], DataFrame],
    *,
    as_of: Column | None = None,
    accel: float = S.TIME_ACCELERATION,
    available_now: bool = False,
    start_at: str | int | None = None,
) -> StreamingQuery:
    """Appends an alert per change that breached its SLA or was returned.

    ``parcels`` is called per batch and gives one row per parcel; from a bucketed ``ParcelStore`` it is joined as it lies. ``start_at`` (``earliest``, ``latest`` or a batch of
    the ingest) reads the changes batch by batch, without listing the batches before, and gives each change once; else all files of the log are
    followed, also those that a replaced batch brings again.
    """
    once = start_at is not None
    feed = change_feed(spark, lake) if start_at is None else read_changes(spark, lake, start_at)
    writer = (
        feed
        .writeStream.queryName("alerts")
        .foreachBatch(lambda changed, batch_id: write_batch(changed, batch_id, lake, parcels, as_of, accel, once))
        .option("checkpointLocation", lake.checkpoint("alerts"))
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
