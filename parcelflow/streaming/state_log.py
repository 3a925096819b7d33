"""Current state kept as a log of changed rows, one directory per micro-batch.

A row enters the log only with a higher version than its parcel had before, so the state
is the row of the highest version, and the state before batch ``n`` is the log below
``n``. A replayed batch sees the same earlier log and overwrites its own directory.
``compact`` folds the log into a snapshot now and then, which bounds what is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow import schemas as S
from parcelflow.operators import state as state_ops
from parcelflow.sources.files import BATCH, read_or_empty
from parcelflow.streaming.lake import Lake, batch_dir

MARKS = T.StructType([T.StructField("upto", T.LongType())])


def rows_before(spark: SparkSession, lake: Lake, batch_id: int | None = None) -> DataFrame:
    """Stored state rows, several per parcel, of all batches or of those before ``batch_id``."""
    # One number per compaction: the newest finished snapshot that may be used here.
    marks = read_or_empty(spark, lake.snapshot_marks, MARKS)
    if batch_id is not None:
        marks = marks.filter(F.col("upto") < batch_id)
    upto = marks.agg(F.max("upto")).first()[0]
    schema = T.StructType([*S.STATE_SCHEMA, BATCH])
    log = read_or_empty(spark, lake.changes, schema)
    if batch_id is not None:
        log = log.filter(F.col("batch_id") < batch_id)
    if upto is None:
        return log.select(*S.STATE_COLUMNS)
    snapshot = spark.read.schema(S.STATE_SCHEMA).parquet(f"{lake.snapshots}/upto={upto}")
    return snapshot.unionByName(log.filter(F.col("batch_id") > upto).select(*S.STATE_COLUMNS))


def current_state(spark: SparkSession, lake: Lake) -> DataFrame:
    """One row per parcel. Empty before the first batch."""
    return state_ops.latest(rows_before(spark, lake))


def apply_batch(events: DataFrame, lake: Lake, batch_id: int) -> None:
    """Writes the rows of ``events`` that win over the state before this batch."""
    spark = events.sparkSession
    changed = state_ops.changes(rows_before(spark, lake, batch_id), events)
    changed.write.mode("overwrite").parquet(batch_dir(lake.changes, batch_id))


def compact(spark: SparkSession, lake: Lake) -> None:
    """Folds all batches below the newest into one snapshot.

    The ingest writes one batch after another, so every batch below the newest is finished, while that one may still
    be being written: it stays in the log. The mark is written last, so a snapshot that was cut short is never read.
    """
    ids = read_or_empty(spark, lake.changes, T.StructType([*S.STATE_SCHEMA, BATCH])).select("batch_id").distinct()
    # Two numbers: the newest batch and the one before it.
    newest = [r["batch_id"] for r in ids.orderBy(F.desc("batch_id")).limit(2).collect()]
    if len(newest) < 2:
        return
    upto = newest[1]
    if not read_or_empty(spark, lake.snapshot_marks, MARKS).filter(F.col("upto") >= upto).isEmpty():
        return  # folded already; that snapshot may be in use
    before = state_ops.latest(rows_before(spark, lake, newest[0]))
    before.write.mode("overwrite").parquet(f"{lake.snapshots}/upto={upto}")
    spark.createDataFrame([(upto,)], MARKS).coalesce(1).write.mode("append").parquet(lake.snapshot_marks)
