"""Framed values in; Bronze, dead letters and state changes out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from parcelflow import schemas as S
from parcelflow.network import DEFAULT, Network
from parcelflow.operators import ingest
from parcelflow.sources.files import BATCH, read_or_empty
from parcelflow.streaming import state_log
from parcelflow.streaming.lake import Lake, batch_dir
from parcelflow.streaming.state_store import StateStore

DEDUP_KEY = "dedup_key"
#: The event time where the clock allows it: one event dated far ahead must not make all others late.
EVENT_CLOCK = "event_clock"
SALT, LATE = "dedup_salt", "second_copy"
CLOCKS = T.StructType([T.StructField("clock", T.TimestampType()), BATCH])
Metrics = Callable[[int, dict[str, int]], None]


def flag(
    framed: DataFrame,
    as_of: Column | None = None,
    decode: Callable[[DataFrame], DataFrame] | None = None,
    network: Network = DEFAULT,
) -> DataFrame:
    """Decoded and judged events. An undecodable value keeps its bytes in ``raw``.

    The verdict is made here, once, and carried along: later steps never look at the clock again. A null value has
    no bytes to tell it from others, so each gets a key of its own.
    """
    with_raw = framed.select("value", F.col("value").alias("raw"))
    events = (decode or ingest.decode)(with_raw)
    return (
        events.withColumn("raw", F.when(~F.col("is_decoded"), F.col("raw")))
        .withColumn(DEDUP_KEY, F.coalesce("event_id", F.concat(F.lit("undecoded:"), F.coalesce(F.sha2("raw", 256), F.uuid()))))
        .transform(ingest.judge, as_of, network)
        .withColumn(EVENT_CLOCK, F.when(~F.col("reject_reason").contains("future"), F.col("event_ts")))
    )


def salted(events: DataFrame, salts: int | None = None) -> DataFrame:
    """Deals the copies of an id to ``salts`` groups, as many as there are shuffle partitions by default."""
    count = salts or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return events.withColumn(SALT, F.floor(F.rand() * count).cast("int"))


def deduplicated(
    events: DataFrame, delay: str = S.WATERMARK_DELAY, mode: str = "bounded", salts: int | None = None
) -> DataFrame:
    """Drops late rows and repeated ids.

    ``bounded`` forgets an id once the watermark has passed it by the delay, so an older
    repeat gets through and is removed in Silver. ``exact`` remembers every id for ever.

    Two stateful steps follow each other. The first drops copies within an id's salts, so the copies of a hot id are
    dealt to many state partitions; the second has one row per id and salt left at most and drops the rest.
    """
    if mode not in ("bounded", "exact"):
        raise ValueError(f"unknown mode {mode!r}")
    marked = salted(events.withWatermark(EVENT_CLOCK, delay), salts)
    for keys in ([DEDUP_KEY, SALT], [DEDUP_KEY]):
        marked = marked.dropDuplicates(keys) if mode == "exact" else marked.dropDuplicatesWithinWatermark(keys)
    return marked.drop(SALT)


def with_all_clocks(kept: DataFrame, events: DataFrame) -> DataFrame:
    """Adds every event of the input once more, marked ``LATE``, for ``late_rows`` to choose from.

    The input is read and decoded a second time for this; these rows pass no shuffle.
    """
    return kept.withColumn(LATE, F.lit(False)).unionByName(events.withColumn(LATE, F.lit(True)))


def clock_before(spark: SparkSession, lake: Lake, batch_id: int, delay: str) -> int | None:
    """The watermark, in milliseconds, by which batch ``batch_id`` drops late rows.

    That is the largest event time of all batches before the last one, less the delay: the watermark moves between two
    batches, and with several stateful steps late rows are told by the one before it.
    """
    clocks = read_or_empty(spark, lake.clocks, CLOCKS).filter(F.col("batch_id") < batch_id - 1)
    newest = F.max(F.col("clock") - F.expr(f"INTERVAL {delay}"))
    return clocks.select(F.unix_millis(newest).alias("ms")).first().ms


def late_rows(batch: DataFrame, before: int | None) -> tuple[DataFrame, Observation]:
    """A batch of ``with_all_clocks`` with late rows refused, and without the second copies of all others.

    The observation has the batch's largest event time as ``clock`` once the batch has been computed.
    """
    newest = Observation()
    late = F.lit(False) if before is None else F.coalesce(F.unix_millis(EVENT_CLOCK) <= before, F.lit(False))
    kept = batch.observe(newest, F.max(EVENT_CLOCK).alias("clock")).filter(~F.col(LATE) | late)
    reasons = F.concat_ws(",", F.when(F.col("reject_reason") != "", F.col("reject_reason")), F.lit("late"))
    kept = (
        kept.withColumn("reject_reason", F.when(F.col(LATE), reasons).otherwise(F.col("reject_reason")))
        .withColumn("is_valid", F.col("is_valid") & ~F.col(LATE))
        .drop(LATE)
    )
    return kept, newest


def write_batch(
    batch: DataFrame,
    batch_id: int,
    lake: Lake,
    weather: Callable[[SparkSession], DataFrame | None],
    as_of: Column | None = None,
    on_metrics: Metrics | None = None,
    buckets: int = 64,
    network: Network = DEFAULT,
) -> None:
    """One micro-batch to all three tables. Every table gets one directory per batch, so a
    replay after a failure replaces what the failed attempt left behind. A batch without
    refused rows writes no dead letters, unless an earlier attempt has left some."""
    spark = batch.sparkSession
    batch.persist()
    try:
        valid = batch.filter("is_valid").select(*S.EVENT_COLUMNS)
        bronze = ingest.with_event_date(ingest.enrich(valid, weather(spark), network))
        stored, refused = Observation(), Observation()
        (
            bronze.observe(stored, F.count(F.lit(1)).alias("rows"))
            .hint("rebalance", "event_date")
            .write.mode("overwrite")
            .partitionBy("event_date")
            .parquet(batch_dir(lake.bronze, batch_id))
        )
        refused_rows = ingest.reject(batch, as_of, network).select(*S.EVENT_COLUMNS, "reject_reason", "raw")
        letters = batch_dir(lake.dead_letters, batch_id)
        has_refused = not refused_rows.isEmpty()
        if has_refused or not read_or_empty(spark, letters, refused_rows.schema).isEmpty():
            refused_rows.observe(refused, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(letters)
        store = StateStore(spark, lake.state, buckets)
        upserts = store.apply(bronze, batch_id, lake.changes, lambda: state_log.rows_before(spark, lake, batch_id))
        if on_metrics:
            counts = {"bronze": stored.get["rows"], "dead_letters": refused.get["rows"] if has_refused else 0}
            on_metrics(batch_id, {**counts, "upserts": upserts or 0})
    finally:
        batch.unpersist()


def start(
    framed: DataFrame,
    lake: Lake,
    weather: Callable[[SparkSession], DataFrame | None] = lambda spark: None,
    *,
    as_of: Column | None = None,
    delay: str = S.WATERMARK_DELAY,
    mode: str = "bounded",
    decode: Callable[[DataFrame], DataFrame] | None = None,
    available_now: bool = False,
    on_metrics: Metrics | None = None,
    buckets: int = 64,
    keep_late: bool = False,
    network: Network = DEFAULT,
) -> StreamingQuery:
    """Starts the ingest query on a stream of framed values.

    ``weather`` is called per batch, so a refreshed weather table is picked up. ``as_of``
    replaces the current time in the check for events of the future. ``buckets`` is the number of state buckets
    of a new lake: a bucket should hold some hundred megabytes at most. ``network`` is judged by until the query ends.

    Rows later than the watermark are dropped and counted in the query's progress. With ``keep_late`` they go to the
    dead letters with the reason ``late``, which takes a second look at the input.
    """
    flagged = flag(framed, as_of, decode, network)
    events = deduplicated(flagged, delay, mode)
    if keep_late:
        events = with_all_clocks(events, flagged)

    def process(batch: DataFrame, batch_id: int) -> None:
        if not keep_late:
            write_batch(batch, batch_id, lake, weather, as_of, on_metrics, buckets, network)
            return
        batch, newest = late_rows(batch, clock_before(batch.sparkSession, lake, batch_id, delay))
        write_batch(batch, batch_id, lake, weather, as_of, on_metrics, buckets, network)
        row = batch.sparkSession.createDataFrame([(newest.get["clock"],)], T.StructType([CLOCKS["clock"]]))
        row.coalesce(1).write.mode("overwrite").parquet(batch_dir(lake.clocks, batch_id))

    writer = (
        events.writeStream.queryName("ingest")
        .foreachBatch(process)
        .option("checkpointLocation", lake.checkpoint("ingest"))
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
