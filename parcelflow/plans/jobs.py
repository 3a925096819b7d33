"""Batch jobs over a lake: Silver, the warehouse with its checks, and overdue alerts."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow import schemas as S
from parcelflow.operators import alerts as alert_ops
from parcelflow.operators import quality, silver, warehouse, weather
from parcelflow.sources import bronze, files, reference
from parcelflow.sources.generations import BATCH, NONE, Generations
from parcelflow.sources.parcel_store import ParcelStore
from parcelflow.streaming import state_log
from parcelflow.streaming.alerts import ALERT_SCHEMA, sent_alerts
from parcelflow.streaming.lake import Lake, batch_dir
from parcelflow.streaming.state_store import StateStore


CONSUMED = T.StructType([T.StructField("bronze_batch", T.LongType()), BATCH])
NULL_DATE = "__HIVE_DEFAULT_PARTITION__"


def build_silver(spark: SparkSession, lake: Lake) -> int:
    """Rebuilds Silver from all of Bronze: typed, one row per event id, by event date. Returns its rows."""
    seen = bronze.snapshot(spark, lake.bronze)
    return _publish_silver(spark, lake, bronze.read(spark, lake.bronze, seen=seen), seen.batches, {})


def update_silver(spark: SparkSession, lake: Lake) -> int:
    """Brings the Bronze batches that Silver has not seen into it; the rows of the dates written anew.

    Only dates that get an event or lose one are rewritten. An id may come again under another date: the dates of all
    its copies are among those, so the copy that survives is the one a full rebuild would keep. A ledger of consumed
    batches belongs to each write, so a run that was cut short consumes nothing.
    """
    table = files.silver_table(spark, lake.silver)
    run = table.newest()
    seen = files.read_or_empty(spark, lake.silver_ledger, CONSUMED).filter(F.col("batch_id") <= (NONE if run is None else run))
    known = {r.bronze_batch for r in seen.select("bronze_batch").distinct().collect()}  # a number per batch, as listed
    found = bronze.snapshot(spark, lake.bronze)
    fresh = [b for b in found.batches if b not in known]
    if not fresh:
        return 0
    manifest = table.manifest(run) if run is not None else {}
    events = bronze.read(spark, lake.bronze, fresh, seen=found)
    before = table.read(manifest)
    again = before.select("event_id", "event_date").join(events.select("event_id"), "event_id", "left_semi")
    # A row per date comes to the driver.
    dates = events.select(F.to_date("event_ts").alias("event_date")).union(again.select("event_date")).distinct()
    touched = {NULL_DATE if r.event_date is None else r.event_date.isoformat() for r in dates.collect()}
    held = table.read(manifest, touched & manifest.keys())
    rows = held.unionByName(events.select(*S.SILVER_COLUMNS))
    return _publish_silver(spark, lake, rows, fresh, {d: g for d, g in manifest.items() if d not in touched})


def _publish_silver(spark: SparkSession, lake: Lake, events: DataFrame, batches: list[int], kept: dict[str, int]) -> int:
    """Writes dates beside those kept, notes the batches they took in, and makes both count at once."""
    table, count = files.silver_table(spark, lake.silver), Observation()
    run = table.newest()
    run = 0 if run is None else run + 1
    rows = silver.to_silver(events).observe(count, F.count(F.lit(1)).alias("rows"))
    written = table.write(rows, run, "event_id")
    ledger = spark.createDataFrame([(b,) for b in batches], T.StructType([CONSUMED["bronze_batch"]]))
    ledger.coalesce(1).write.mode("overwrite").parquet(batch_dir(lake.silver_ledger, run))
    table.publish(kept | dict.fromkeys(written, run), run)
    return count.get["rows"]


def refresh_weather(spark: SparkSession, lake: Lake, inbox: str) -> None:
    """Hub flags from landed response files, one response per file; the newest entry of a hub counts.

    Hubs and limits are those of the lake's network.
    """
    network = reference.read_network(spark, lake.network)
    responses = (
        spark.read.text(inbox, wholetext=True).select(
            F.col("value").alias("body"), F.col("_metadata.file_modification_time").alias("fetched_at")
        )
    )
    flagged = weather.flags(
        weather.parse_responses(responses, hubs=network.hub_ids), network.wind_limit, network.precipitation_limit
    )
    files.write_weather(weather.weather_by_hub(flagged, "fetched_at"), lake.weather)


@dataclass(frozen=True)
class Promise:
    """What a model promises about its columns."""

    not_null: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    accepted: tuple[tuple[str, tuple[str, ...]], ...] = ()


PROMISES = {
    "stg_parcel_events": Promise(
        ("event_id", "parcel_id", "version"), ("event_id",), (("event_type", tuple(S.EVENT_TYPES)),)
    ),
    "stg_parcels": Promise(
        ("parcel_id", "sla_hours"), ("parcel_id",), (("service_level", tuple(S.SERVICE_LEVELS)),)
    ),
    "dim_parcels": Promise(("parcel_id",), ("parcel_id",)),
    "fct_parcel_events": Promise(("event_id",), ("event_id",)),
    "gold_delivery_funnel": Promise(("event_type",), ("event_type",)),
    "gold_on_time_by_region": Promise(("region",)),
    "gold_failure_analysis": Promise(("region",)),
    "gold_weather_impact": Promise(("bad_weather",)),
}


class BrokenPromise(Exception):
    """A check of severity ``error`` failed; ``report`` has all checks, and nothing was published."""

    def __init__(self, report: list):
        failed = [f"{r.check} {r.table}.{r.column}: {r.failures}" for r in report if r.severity == "error" and r.failures]
        super().__init__("; ".join(failed))
        self.report = report


def mart_table(spark: SparkSession, lake: Lake) -> Generations:
    """The marts as parts of one table of tables: a run writes all, and its manifest makes them count together."""
    return Generations(spark, lake.warehouse, T.StructType([]), "mart")


def read_mart(spark: SparkSession, lake: Lake, name: str) -> DataFrame:
    """A published mart."""
    table = mart_table(spark, lake)
    return spark.read.parquet(f"{table.folder(table.manifest()[name])}/mart={name}")


def build_warehouse(spark: SparkSession, lake: Lake, accel: float = S.TIME_ACCELERATION) -> list:
    """Writes all marts as a new run, checks them, and publishes them if no check of severity ``error`` fails.

    Later marts read the stored ones, so each reads only the columns it needs. The staging views and, once published,
    the marts are registered by name. Returns the report of the checks, a row per promise; a broken promise raises
    ``BrokenPromise`` and leaves the run before in place.
    """
    table = mart_table(spark, lake)
    run = table.newest()
    run = 0 if run is None else run + 1
    warehouse.stg_parcel_events(files.read_silver(spark, lake.silver)).createOrReplaceTempView("stg_parcel_events")
    warehouse.stg_parcels(files.read_parcels(spark, lake.parcels)).createOrReplaceTempView("stg_parcels")
    marts: dict[str, DataFrame] = {}

    def keep(name: str, rows: DataFrame, *by: str) -> None:
        path = f"{table.folder(run)}/mart={name}"
        rows.write.mode("overwrite").partitionBy(*by).parquet(path)
        marts[name] = spark.read.parquet(path)

    keep("dim_parcels", warehouse.dim_parcels(spark.table("stg_parcels")))
    events, parcels = spark.table("stg_parcel_events"), marts["dim_parcels"]
    facts = warehouse.fct_parcel_events(events, parcels).hint("rebalance", "event_date")
    keep("fct_parcel_events", facts, "event_date")
    outcomes = warehouse.outcomes_of_fact(marts["fct_parcel_events"])
    for name, mart in {
        "gold_delivery_funnel": warehouse.gold_delivery_funnel(events),
        "gold_on_time_by_region": warehouse.gold_on_time_by_region(outcomes, accel),
        "gold_failure_analysis": warehouse.gold_failure_analysis(outcomes),
        "gold_weather_impact": warehouse.gold_weather_impact(events),
    }.items():
        # At most a few rows, one per type, region or weather.
        keep(name, mart.coalesce(1))
    stages = {name: spark.table(name) for name in ("stg_parcel_events", "stg_parcels")}
    report = check_models({**stages, **marts}).collect()  # a row per promise
    if any(r.severity == "error" and r.failures for r in report):
        raise BrokenPromise(report)
    table.publish(dict.fromkeys(marts, run), run)
    for name, mart in marts.items():
        mart.createOrReplaceTempView(name)
    return report


def check_warehouse(spark: SparkSession) -> DataFrame:
    """The checks of the registered staging views and marts."""
    return check_models({name: spark.table(name) for name in PROMISES})


def check_models(models: dict[str, DataFrame]) -> DataFrame:
    """``check, table, column, severity, failures`` of everything the models promise."""
    orphaned = (
        quality.orphans(models["fct_parcel_events"], models["dim_parcels"])
        .agg(F.count(F.lit(1)).alias("failures"))
        .select(F.lit("fct_parcel_events").alias("table"), F.lit("parcel_id").alias("column"), "failures")
    )
    results = {
        "not_null": quality.not_null({n: (models[n], p.not_null) for n, p in PROMISES.items() if p.not_null}),
        "unique": quality.unique({n: (models[n], p.unique) for n, p in PROMISES.items() if p.unique}),
        "accepted_values": quality.accepted(
            {n: (models[n], dict(p.accepted)) for n, p in PROMISES.items() if p.accepted}
        ),
        "relationships": orphaned,
    }
    report = None
    for check, found in results.items():
        severity = "warn" if check == "relationships" else "error"
        rows = found.select(F.lit(check).alias("check"), "table", "column", F.lit(severity).alias("severity"), "failures")
        report = rows if report is None else report.unionByName(rows)
    return report


def parcel_store(spark: SparkSession, lake: Lake, buckets: int = 64) -> ParcelStore:
    return ParcelStore(spark, lake.parcel_store, lake.parcels, buckets)


def current_state(spark: SparkSession, lake: Lake) -> DataFrame:
    """State of the bucketed store; of the change log while a lake written before the store has no batch in it."""
    store = StateStore(spark, lake.state)
    return state_log.current_state(spark, lake) if store.newest() is None else store.current()


def overdue_alerts(
    spark: SparkSession, lake: Lake, as_of: Column | None = None, accel: float = S.TIME_ACCELERATION
) -> DataFrame:
    """Breaches that only the clock caused and that no alert has reported yet."""
    parcels = parcel_store(spark, lake).read()
    now = F.current_timestamp() if as_of is None else as_of
    return alert_ops.overdue(
        current_state(spark, lake), parcels, now, sent_alerts(spark, lake), accel, ["version"]
    )


def send_overdue(
    spark: SparkSession, lake: Lake, as_of: Column | None = None, accel: float = S.TIME_ACCELERATION
) -> int:
    """Stores all overdue alerts as sent, in a batch of their own below the stream's, and returns their number."""
    found = overdue_alerts(spark, lake, as_of, accel).select(*ALERT_SCHEMA.names)
    count = Observation()
    target = batch_dir(lake.alerts, -time.time_ns())
    found.observe(count, F.count(F.lit(1)).alias("rows")).write.parquet(target)
    return count.get["rows"]
