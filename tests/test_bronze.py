"""Compaction of Bronze batch folders into date slices."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from conftest import rows

from parcelflow import schemas as S
from parcelflow.operators import ingest, silver
from parcelflow.plans import jobs
from parcelflow.sources import bronze, files, storage
from parcelflow.streaming.lake import Lake, batch_dir

T0 = datetime(2024, 5, 1, 12, 0, 0)


def batch(spark, lake, number, events):
    """A Bronze batch of ``(id, day)``; a day of None leaves the event without time and date."""
    data = [(i, f"P{i}", "CREATED", "AMS", 52.3, 4.9, None if d is None else T0 + timedelta(days=d), "CREATED", 1) for i, d in events]
    out = ingest.with_event_date(ingest.enrich(spark.createDataFrame(data, S.EVENT_SCHEMA), None))
    out.coalesce(1).write.mode("overwrite").partitionBy("event_date").parquet(batch_dir(lake.bronze, number))


def seen(spark, lake, *args):
    return rows(files.read_bronze(spark, lake.bronze, *args), "event_id", "event_date", "batch_id")


def test_many_batches_end_as_few_files(spark, scratch):
    """Compaction now and then: every event is read once at any time, and a date has a slice per binary digit at most."""
    lake, want = Lake(f"{scratch}/lake"), []
    for number in range(24):
        events = [(f"e{number}", number % 2), (f"f{number}", 0)]
        batch(spark, lake, number, events)
        want += [(i, (T0 + timedelta(days=d)).date(), number) for i, d in events]
        if number % 4 == 3:
            before = files.read_bronze(spark, lake.bronze)  # planned before, read after
            assert bronze.compact(spark, lake.bronze) == (3 if number == 3 else 4)
            assert bronze.compact(spark, lake.bronze) == 0
            assert before.count() == len(want)
            assert seen(spark, lake) == sorted(want, key=repr)
    table = bronze.table(spark, lake.bronze)
    per_date = [s.rpartition("_")[0] for s in table.manifest()]
    assert max(map(per_date.count, per_date)) <= 3  # six compactions
    assert {r[0] for r in rows(table.read().select("slice"))} == set(table.manifest())
    assert bronze.vacuum(spark, lake.bronze, keep=1) > 0
    assert [n for n in storage.names(spark, lake.bronze) if n.startswith("batch_id=")] == ["batch_id=23"]
    assert seen(spark, lake) == sorted(want, key=repr)
    day = files.read_bronze(spark, lake.bronze, "2024-05-02", "2024-05-02")
    assert rows(day, "event_id", "event_date", "batch_id") == sorted([w for w in want if w[1].day == 2], key=repr)
    assert not any("slice=2024-05-01" in f for f in day.inputFiles())
    some = files.read_batches(spark, lake.bronze, [2, 5, 23, 99])
    assert rows(some, "event_id", "event_date", "batch_id") == sorted([w for w in want if w[2] in (2, 5, 23)], key=repr)


def test_silver_takes_compacted_batches_once(spark, scratch):
    """Batches that Silver has seen and batches that it has not are compacted; an event without a date is kept."""
    lake = Lake(f"{scratch}/lake")
    batch(spark, lake, 0, [("a", 0), ("b", 1)])
    jobs.update_silver(spark, lake)
    batch(spark, lake, 1, [("c", 0), ("n", None)])
    batch(spark, lake, 2, [])
    batch(spark, lake, 3, [("a", 2)])
    assert bronze.compact(spark, lake.bronze) == 3
    bronze.vacuum(spark, lake.bronze, keep=1)
    assert jobs.update_silver(spark, lake) > 0 and jobs.update_silver(spark, lake) == 0
    whole = rows(silver.to_silver(files.read_bronze(spark, lake.bronze)))
    assert len(whole) == 4 and rows(files.read_silver(spark, lake.silver)) == whole
    jobs.build_silver(spark, lake)
    assert rows(files.read_silver(spark, lake.silver)) == whole and jobs.update_silver(spark, lake) == 0


def test_compaction_cut_off_covers_nothing(monkeypatch, spark, scratch):
    lake = Lake(f"{scratch}/lake")
    for number in range(3):
        batch(spark, lake, number, [(f"e{number}", 0)])
    before = seen(spark, lake)
    with monkeypatch.context() as patch:
        patch.setattr(bronze.Generations, "publish", lambda *_: (_ for _ in ()).throw(OSError("cut off")))
        with pytest.raises(OSError):
            bronze.compact(spark, lake.bronze)
    assert seen(spark, lake) == before and bronze.vacuum(spark, lake.bronze) == 0
    batch(spark, lake, 2, [("again", 0)])  # a replay of the newest batch
    assert bronze.compact(spark, lake.bronze) == 2
    assert [r[0] for r in seen(spark, lake)] == ["again", "e0", "e1"]


def test_no_bronze_yet(spark, scratch):
    lake = Lake(f"{scratch}/lake")
    assert bronze.compact(spark, lake.bronze) == 0 and bronze.vacuum(spark, lake.bronze) == 0
    assert seen(spark, lake) == []
