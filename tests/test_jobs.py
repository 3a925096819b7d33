"""Batch jobs over a lake: incremental Silver and marts that are published only after their checks."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows

from parcelflow import schemas as S
from parcelflow.operators import ingest, silver, warehouse
from parcelflow.plans import jobs
from parcelflow.sources import files
from parcelflow.streaming.lake import Lake, batch_dir

T0 = datetime(2024, 5, 1, 12, 0, 0)


def bronze(spark, lake, batch_id, events):
    """One Bronze batch of ``(id, day, hub)``."""
    data = [(i, f"P{i}", "CREATED", hub, 52.3, 4.9, T0 + timedelta(days=day), "CREATED", 1) for i, day, hub in events]
    rows = ingest.with_event_date(ingest.enrich(spark.createDataFrame(data, S.EVENT_SCHEMA), None))
    rows.write.mode("overwrite").partitionBy("event_date").parquet(batch_dir(lake.bronze, batch_id))


def whole(spark, lake):
    return rows(silver.to_silver(files.read_bronze(spark, lake.bronze)))


@pytest.mark.parametrize("seed", [1])
def test_updates_equal_a_full_rebuild(spark, scratch, seed):
    """Batches in any order, ids that come again under an earlier or a later date, and batches without rows."""
    lake, noise = Lake(f"{scratch}/lake"), random.Random(seed)
    order = list(range(7))
    noise.shuffle(order)
    for batch_id in order:
        some = [(f"e{noise.randrange(12)}", noise.randrange(5), noise.choice(S.HUB_IDS)) for _ in range(noise.randrange(7))]
        bronze(spark, lake, batch_id, some)
        jobs.update_silver(spark, lake)
        assert rows(files.read_silver(spark, lake.silver)) == whole(spark, lake)
    assert jobs.update_silver(spark, lake) == 0
    before = rows(files.read_silver(spark, lake.silver))
    jobs.build_silver(spark, lake)
    assert rows(files.read_silver(spark, lake.silver)) == before
    day = rows(files.read_silver(spark, lake.silver, "2024-05-02", "2024-05-03"))
    assert day == [r for r in before if r[-1].day in (2, 3)]


def test_other_dates_keep_their_files(spark, scratch):
    lake = Lake(f"{scratch}/lake")
    bronze(spark, lake, 0, [(f"e{i}", i % 4, "AMS") for i in range(20)])
    assert jobs.update_silver(spark, lake) == 20
    table = files.silver_table(spark, lake.silver)
    first = table.manifest()
    bronze(spark, lake, 1, [("new", 2, "AMS"), ("e3", 1, "AMS")])  # e3 moves from the fourth day to the second
    assert jobs.update_silver(spark, lake) == 5 + 1 + 6 + 4
    second = table.manifest()
    assert {d for d in second if second[d] != first[d]} == {"2024-05-02", "2024-05-03", "2024-05-04"}
    assert rows(files.read_silver(spark, lake.silver)) == whole(spark, lake)


def test_date_that_loses_its_last_event_goes(spark, scratch):
    lake = Lake(f"{scratch}/lake")
    bronze(spark, lake, 0, [("e1", 3, "AMS"), ("e2", 0, "AMS")])
    jobs.update_silver(spark, lake)
    bronze(spark, lake, 1, [("e1", 1, "AMS")])
    jobs.update_silver(spark, lake)
    assert set(files.silver_table(spark, lake.silver).manifest()) == {"2024-05-01", "2024-05-02"}
    assert rows(files.read_silver(spark, lake.silver)) == whole(spark, lake)


def test_cut_off_update_consumes_nothing(monkeypatch, spark, scratch):
    """A run that ends before its manifest leaves readers where they were; the next one takes its batches."""
    lake = Lake(f"{scratch}/lake")
    bronze(spark, lake, 0, [("e1", 0, "AMS")])
    jobs.update_silver(spark, lake)
    bronze(spark, lake, 1, [("e1", 1, "AMS"), ("e2", 0, "RTM")])
    with monkeypatch.context() as patch:
        patch.setattr(jobs.Generations, "publish", lambda *_: (_ for _ in ()).throw(OSError("cut off")))
        with pytest.raises(OSError):
            jobs.update_silver(spark, lake)
    assert [r[0] for r in rows(files.read_silver(spark, lake.silver))] == ["e1"]
    jobs.update_silver(spark, lake)
    assert rows(files.read_silver(spark, lake.silver)) == whole(spark, lake)


def parcel(name, carrier="DHL"):
    return (name, "AMS", "1011 AB", "R", carrier, "STANDARD", 48, T0, T0 + timedelta(hours=48))


def test_marts_with_a_broken_promise_are_not_published(monkeypatch, spark, scratch):
    lake = Lake(f"{scratch}/lake")
    bronze(spark, lake, 0, [("e1", 0, "AMS"), ("e2", 0, "AMS")])
    jobs.build_silver(spark, lake)
    files.append_parcels(spark.createDataFrame([parcel("Pe1")], S.PARCEL_SCHEMA), lake.parcels)
    report = jobs.build_warehouse(spark, lake, 1.0)
    assert len(report) == 19 and [(r.check, r.failures) for r in report if r.failures] == [("relationships", 1)]
    before = rows(jobs.read_mart(spark, lake, "dim_parcels"))
    bronze(spark, lake, 1, [("e3", 0, "AMS")])
    jobs.update_silver(spark, lake)
    with monkeypatch.context() as patch:
        right = warehouse.dim_parcels
        patch.setattr(warehouse, "dim_parcels", lambda parcels: right(parcels).union(right(parcels)))  # a repeated key
        with pytest.raises(jobs.BrokenPromise, match="unique dim_parcels.parcel_id: 1") as broken:
            jobs.build_warehouse(spark, lake, 1.0)
    assert len(broken.value.report) == 19
    assert rows(jobs.read_mart(spark, lake, "dim_parcels")) == before
    assert jobs.read_mart(spark, lake, "fct_parcel_events").count() == 2
    jobs.build_warehouse(spark, lake, 1.0)
    assert jobs.read_mart(spark, lake, "fct_parcel_events").count() == 3
    assert jobs.mart_table(spark, lake).vacuum(keep=1) > 0
    assert jobs.read_mart(spark, lake, "fct_parcel_events").count() == 3
