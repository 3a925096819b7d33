"""The bucketed state store: what a batch opens and rewrites, replays, cut-off writes, lookups and clearing."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from parcelflow import schemas as S
from parcelflow.operators import state as state_ops
from parcelflow.sources import storage
from parcelflow.streaming import state_log
from parcelflow.streaming.lake import Lake
from parcelflow.streaming.state_store import StateStore

T0 = datetime(2024, 5, 1, 12, 0, 0)


def events(spark, some):
    """Events of ``(parcel, version)``."""
    data = [(f"e{p}-{v}", p, S.EVENT_TYPES[v % 10], "AMS", 52.3, 4.9, T0 + timedelta(minutes=v), "x", v) for p, v in some]
    return spark.createDataFrame(data, S.EVENT_SCHEMA).withColumn("weather_bad", F.lit(None).cast("boolean"))


def bucket_files(df):
    """``(generation, bucket)`` of every file a frame reads."""
    return {tuple(part.split("=")[1] for part in f.split("/")[-3:-1]) for f in df.inputFiles()}


def test_batches_equal_one_merge(spark, scratch):
    noise, store = random.Random(2), StateStore(spark, f"{scratch}/s", buckets=8)
    state, everything = {}, []
    for batch_id in range(5):
        batch = [(f"P{noise.randrange(40)}", noise.randrange(12)) for _ in range(25)]
        want = {}
        for p, v in batch:
            if v > state.get(p, -1):
                want[p] = max(v, want.get(p, -1))
        state |= want
        everything += batch
        assert store.apply(events(spark, batch), batch_id, f"{scratch}/changes") == len(want)
        changed = spark.read.parquet(f"{scratch}/changes/batch_id={batch_id}")
        assert rows(changed, "parcel_id", "version") == sorted(want.items())
        assert rows(store.current(), "parcel_id", "version") == sorted(state.items())
    assert rows(store.current()) == rows(state_ops.latest(events(spark, everything)))
    later = rows(store.changed_since(2), "parcel_id")
    assert later == sorted({r for b in (3, 4) for r in rows(spark.read.parquet(f"{scratch}/changes/batch_id={b}"), "parcel_id")})


def test_batch_touches_only_its_buckets(spark, scratch):
    """Ten parcels in a store of many: other buckets keep their files, and one file per touched bucket is read."""
    store = StateStore(spark, f"{scratch}/s", buckets=64)
    store.apply(events(spark, [(f"P{i}", 1) for i in range(5000)]), 0)
    before = store.files.manifest()
    assert set(before.values()) == {0} and len(bucket_files(store.read())) == 64
    batch = [(f"P{i * 37}", 2) for i in range(10)]
    assert store.apply(events(spark, batch), 1) == 10
    after = store.files.manifest()
    touched = {b for b in after if after[b] == 1}
    assert len(touched) <= 10 and all(after[b] == 0 for b in set(after) - touched)
    assert bucket_files(store.read(before, touched)) == {("0", b) for b in touched}
    assert {n for n in storage.names(spark, f"{store.files.data}/batch_id=1") if n.startswith("bucket=")} == {f"bucket={b}" for b in touched}
    assert store.current().count() == 5000


def test_replay_and_cut_off_batch(spark, scratch):
    store = StateStore(spark, f"{scratch}/s", buckets=4)
    store.apply(events(spark, [("P1", 3), ("P2", 1)]), 0)
    store.apply(events(spark, [("P1", 4)]), 1)
    before, files = rows(store.read()), sorted(store.read().inputFiles())
    for batch_id in (0, 1):
        assert store.apply(events(spark, [("P1", 9), ("P7", 1)]), batch_id) is None
    assert rows(store.read()) == before and sorted(store.read().inputFiles()) == files
    # A batch whose manifest was not written is not seen, and is written anew.
    store.files.write(events(spark, [("P8", 1)]).select(*S.STATE_COLUMNS, F.lit(2).alias("changed_in"), F.lit(0).alias("bucket")), 2)
    assert rows(store.read()) == before
    assert store.apply(events(spark, [("P3", 1), ("P1", 4)]), 2) == 1
    assert rows(store.current(), "parcel_id", "version") == [("P1", 4), ("P2", 1), ("P3", 1)]
    assert store.apply(events(spark, []), 3) == 0 and store.current().count() == 3


def test_lookup_reads_one_bucket(spark, scratch):
    store = StateStore(spark, f"{scratch}/s", buckets=16)
    assert store.lookup("P1").count() == 0 and store.current().count() == 0
    store.apply(events(spark, [(f"P{i}", 1) for i in range(300)] + [(None, 1)]), 0)
    found = store.lookup("P77")
    assert len(bucket_files(found)) == 1 and rows(found, "parcel_id", "version") == [("P77", 1)]
    assert "PushedFilters: [" in found._jdf.queryExecution().toString() and "P77" in found._jdf.queryExecution().toString()
    assert store.lookup("nobody").count() == 0
    assert rows(store.lookup("P3", "P4", "x"), "parcel_id") == [("P3",), ("P4",)]


def test_vacuum_keeps_what_the_newest_manifests_name(spark, scratch):
    store = StateStore(spark, f"{scratch}/s", buckets=4)
    for n in range(6):
        store.apply(events(spark, [(f"P{i}", n + 1) for i in range(2 if n % 2 else 40)]), n)
    before, held = rows(store.current()), store.files.manifest(4)
    assert store.vacuum(keep=2) > 0
    assert rows(store.current()) == before and store.files.batches() == [4, 5]
    assert store.read(held).count() == 40
    assert store.vacuum(keep=2) == 0
    with pytest.raises(ValueError):
        store.vacuum(keep=0)


def test_store_starts_from_a_log(spark, scratch):
    """A lake that has only a change log goes on with the state it had."""
    lake = Lake(f"{scratch}/lake")
    state_log.apply_batch(events(spark, [("P1", 5), ("P2", 1)]), lake, 0)
    store = StateStore(spark, lake.state, buckets=4)
    batch = events(spark, [("P1", 4), ("P2", 2), ("P3", 1)])
    assert store.apply(batch, 1, lake.changes, lambda: state_log.rows_before(spark, lake, 1)) == 2
    assert rows(store.current(), "parcel_id", "version") == [("P1", 5), ("P2", 2), ("P3", 1)]


def test_hot_parcel_is_combined_before_the_shuffle(spark, scratch):
    """A third of a batch belongs to one parcel; each task sends one row of it."""
    store = StateStore(spark, f"{scratch}/s", buckets=4)
    n = F.col("id")
    hot = spark.range(0, 30_000, 1, 6).select(
        F.concat(F.lit("e"), n).alias("event_id"), F.when(n % 3 == 0, "P0").otherwise(F.concat(F.lit("P"), n % 100)).alias("parcel_id"),
        F.lit("CREATED").alias("event_type"), F.lit("AMS").alias("hub_id"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon"),
        F.timestamp_seconds(n).alias("event_ts"), F.lit("x").alias("status"), n.cast("int").alias("version"), F.lit(False).alias("weather_bad"),
    )
    assert store.apply(hot, 0) == 100
    assert store.lookup("P0").first().version == 29_997


def test_batch_is_computed_once(spark, scratch):
    """A batch is read twice, for its buckets and for the merge, but its rows are made once; nothing of it is left."""
    store = StateStore(spark, f"{scratch}/s", buckets=8)
    for batch_id in range(3):
        made = spark.sparkContext.accumulator(0)

        def tell(part, made=made):
            for frame in part:
                made.add(len(frame))
                yield frame

        batch = events(spark, [(f"P{i}", batch_id + 1) for i in range(40)])
        assert store.apply(batch.mapInPandas(tell, batch.schema), batch_id) == 40
        assert made.value == 40
        assert storage.names(spark, store.incoming) == []
