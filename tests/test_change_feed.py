"""The stream of state changes by batch numbers: where it starts, restarts, unfinished batches, and its alerts."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from parcelflow import schemas as S
from parcelflow.sources import files, storage
from parcelflow.streaming import alerts
from parcelflow.streaming.change_feed import ChangeReader, read_changes
from parcelflow.streaming.lake import Lake, batch_dir
from parcelflow.streaming.state_store import StateStore

T0 = datetime(2024, 5, 1, 12, 0, 0)


def put(spark, lake, batch_id, *some):
    """A batch of ``(parcel, version, type)`` in the state and its change log."""
    data = [(f"e{p}-{v}", p, kind, "AMS", 52.3, 4.9, T0 + timedelta(minutes=v), kind, v) for p, v, kind in some]
    events = spark.createDataFrame(data, S.EVENT_SCHEMA).withColumn("weather_bad", F.lit(True))
    StateStore(spark, lake.state, buckets=2).apply(events, batch_id, lake.changes)


def collect(spark, lake, folder, start):
    """All that the stream has given so far under one checkpoint."""
    query = read_changes(spark, lake, start).writeStream.format("parquet").option("path", f"{folder}/out")
    query.option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    return rows(spark.read.parquet(f"{folder}/out"), "changed_in", "parcel_id", "version") if storage.names(spark, f"{folder}/out") else []


def test_starts_and_restarts(spark, scratch):
    lake = Lake(f"{scratch}/lake")
    for n in range(3):
        put(spark, lake, n, (f"P{n}", 1, "CREATED"), ("P9", n + 1, "CREATED"))
    everything = sorted((n, p, v) for n in range(3) for p, v in [(f"P{n}", 1), ("P9", n + 1)])
    assert collect(spark, lake, f"{scratch}/a", "earliest") == everything
    assert collect(spark, lake, f"{scratch}/b", 2) == [r for r in everything if r[0] == 2]
    latest = ChangeReader({"path": lake.changes, "start": "latest"})
    assert latest.initialOffset() == latest.latestOffset() == {"next": 3}
    put(spark, lake, 3, ("P1", 2, "DELIVERED"))
    assert latest.latestOffset() == {"next": 4} and [p.batch_id for p in latest.partitions({"next": 3}, {"next": 4})] == [3] * len(latest.files_of(3))
    # The checkpoint goes on where it was, whatever start says; a replayed ingest batch brings nothing again.
    put(spark, lake, 2, ("P2", 9, "CREATED"))
    assert collect(spark, lake, f"{scratch}/a", "latest") == [*everything, (3, "P1", 2)]
    assert collect(spark, lake, f"{scratch}/a", "latest") == [*everything, (3, "P1", 2)]


def test_unfinished_batch_is_waited_for(spark, scratch):
    lake = Lake(f"{scratch}/lake")
    assert ChangeReader({"path": lake.changes}).latestOffset() == {"next": 0}
    put(spark, lake, 0, ("P1", 1, "CREATED"))
    spark.createDataFrame([], S.STATE_SCHEMA).write.parquet(batch_dir(lake.changes, 1))
    storage.delete(spark, f"{batch_dir(lake.changes, 1)}/_SUCCESS")
    put_after = ChangeReader({"path": lake.changes, "start": "latest"})
    assert put_after.initialOffset() == {"next": 1} == put_after.latestOffset()
    with pytest.raises(ValueError):
        ChangeReader({"path": lake.changes, "start": "soon"})


def test_old_batches_are_not_looked_at(monkeypatch, spark, scratch):
    """After its start the reader asks for the next batch only."""
    lake = Lake(f"{scratch}/lake")
    for n in range(4):
        put(spark, lake, n, ("P1", n + 1, "CREATED"))
    reader, asked = ChangeReader({"path": lake.changes, "start": "3"}), []
    plain = reader.files_of
    monkeypatch.setattr(reader, "files_of", lambda n: asked.append(n) or plain(n))
    monkeypatch.setattr(reader, "numbers", lambda: pytest.fail("listed"))
    assert reader.latestOffset() == {"next": 4} and reader.latestOffset() == {"next": 4} and asked == [3, 4, 4]


def test_alerts_from_the_latest_change(spark, scratch):
    lake = Lake(f"{scratch}/lake")
    dim = [(p, "AMS", "1011 AB", "R", "DHL", "STANDARD", 48, T0, T0 + timedelta(hours=48)) for p in ("P1", "P2")]
    files.append_parcels(spark.createDataFrame(dim, S.PARCEL_SCHEMA), lake.parcels)

    def run():
        now = F.lit("2024-05-01 13:00:00").cast("timestamp")
        parcels = lambda s: files.read_parcels(s, lake.parcels)
        alerts.start(spark, lake, parcels, as_of=now, accel=1.0, available_now=True, start_at="latest").awaitTermination()
        return rows(alerts.sent_alerts(spark, lake), "parcel_id", "version")

    put(spark, lake, 0, ("P1", 4, "RETURNED"))
    assert run() == []  # what was there before the start gives no alert
    put(spark, lake, 1, ("P2", 4, "RETURNED"))
    assert run() == [("P2", 4)]
    put(spark, lake, 2, ("P2", 5, "RETURNED"), ("P1", 5, "DELIVERED"))
    assert run() == [("P2", 4), ("P2", 5)]
