"""The bucketed parcel dimension: newest rows, generations, other sessions, and joins without a shuffle of it."""

from __future__ import annotations

from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F

from parcelflow import schemas as S
from parcelflow.operators import alerts as alert_ops
from parcelflow.plans import jobs
from parcelflow.sources import files
from parcelflow.sources.parcel_store import _name
from parcelflow.streaming import alerts
from parcelflow.streaming.lake import Lake
from parcelflow.streaming.state_store import StateStore

T0 = datetime(2024, 5, 1, 12, 0, 0)


def land(spark, lake, *some):
    """Parcel lines of ``(id, days after T0, hours)``."""
    data = [
        (p, "AMS", "1011 AB", "R", "DHL", "STANDARD", hours, T0 + timedelta(days=d), T0 + timedelta(days=d, hours=hours))
        for p, d, hours in some
    ]
    files.append_parcels(spark.createDataFrame(data, S.PARCEL_SCHEMA), lake.parcels)


def put(spark, lake, batch_id, *some):
    data = [(f"e{p}{v}", p, kind, "AMS", 52.3, 4.9, T0 + timedelta(minutes=v), kind, v) for p, v, kind in some]
    events = spark.createDataFrame(data, S.EVENT_SCHEMA).withColumn("weather_bad", F.lit(True))
    StateStore(spark, lake.state, buckets=2).apply(events, batch_id, lake.changes)


def test_generations_and_other_sessions(spark, scratch):
    lake = Lake(f"{scratch}/lake")
    store = jobs.parcel_store(spark, lake, 4)
    assert store.read().count() == 0  # neither lines nor a generation
    land(spark, lake, ("P1", 0, 48), ("P2", 0, 24), ("P1", 1, 6), (None, 0, 6))
    assert rows(store.read(), "parcel_id", "sla_hours") == [("P1", 6), ("P2", 24), (None, 6)]  # the lines themselves
    assert store.publish() == 0
    first = store.read()
    assert first.dtypes == [(f.name, f.dataType.simpleString()) for f in S.PARCEL_SCHEMA]
    assert rows(first, "parcel_id", "sla_hours") == [("P1", 6), ("P2", 24)]
    land(spark, lake, ("P2", 2, 6), ("P3", 0, 48))
    assert rows(store.read(), "parcel_id", "sla_hours") == [("P1", 6), ("P2", 24)]  # until it is published
    # The number of buckets belongs to a generation. A session that does not know the table learns of it.
    assert jobs.parcel_store(spark, lake, 8).publish() == 1
    spark.sql(f"DROP TABLE {_name(store._path(1, 8))}")
    assert rows(store.read(), "parcel_id", "sla_hours") == [("P1", 6), ("P2", 6), ("P3", 48)]
    assert jobs.parcel_store(spark, lake, 8).publish() == 2 and store.vacuum(keep=2) == 1
    assert rows(store.read(), "parcel_id", "sla_hours") == [("P1", 6), ("P2", 6), ("P3", 48)]


def test_alert_batch_does_not_shuffle_the_dimension(spark, scratch):
    lake = Lake(f"{scratch}/lake")
    land(spark, lake, *[(f"P{i}", 0, 6) for i in range(500)])
    store = jobs.parcel_store(spark, lake, 16)
    store.publish()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        changed = spark.range(200).select(
            F.concat(F.lit("P"), "id").alias("parcel_id"), F.lit(1).alias("version"), F.lit("RETURNED").alias("status")
        )
        dim = store.read()
        wanted = dim.join(changed.select("parcel_id"), "parcel_id", "left_semi")
        found = alert_ops.alerts(changed, wanted, F.lit(T0).cast("timestamp"))
        assert found.count() == 200
        found.collect()
        lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    scans = [i for i, line in enumerate(lines) if "FileScan parquet" in line]
    assert scans and all("Bucketed: true" in lines[i] for i in scans) and not any("json" in line.lower() for line in lines)
    for i in scans:  # nothing between a scan and the join above it is an exchange
        depth = lines[i].index("FileScan")
        above = [line for line in lines[:i] if line.strip() and len(line) - len(line.lstrip(" :+-*(0123456789)")) < depth]
        chain = []
        for line in reversed(above):
            if "Join" in line:
                break
            chain.append(line)
        assert not any("Exchange" in line for line in chain), chain


def test_alert_stream_from_the_store(spark, scratch):
    lake = Lake(f"{scratch}/lake")
    land(spark, lake, ("P1", 0, 6), ("P2", 30, 6))
    jobs.parcel_store(spark, lake, 4).publish()
    now = F.lit("2024-05-05 00:00:00").cast("timestamp")

    def run():
        parcels = lambda s: jobs.parcel_store(s, lake).read()
        alerts.start(spark, lake, parcels, as_of=now, accel=1.0, available_now=True, start_at="earliest").awaitTermination()
        return rows(alerts.sent_alerts(spark, lake), "parcel_id", "version", "breached")

    put(spark, lake, 0, ("P1", 1, "CREATED"), ("P2", 1, "CREATED"), ("P9", 1, "RETURNED"))
    assert run() == [("P1", 1, True), ("P9", 1, False)]
    put(spark, lake, 0, ("P1", 1, "CREATED"))  # replayed: nothing again
    put(spark, lake, 1, ("P1", 2, "LABEL_PRINTED"))
    assert run() == [("P1", 1, True), ("P1", 2, True), ("P9", 1, False)]
    later = F.lit("2024-07-05 00:00:00").cast("timestamp")
    assert jobs.send_overdue(spark, lake, later, 1.0) == 1
    assert jobs.send_overdue(spark, lake, later, 1.0) == 0
