"""The stream end to end: late rows, repeats, bad records, replays, restarts, alerts."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from parcelflow import schemas as S
from parcelflow.operators import ingest as ops
from parcelflow.operators import state as state_ops
from parcelflow.plans import jobs
from parcelflow.sources import files
from parcelflow.streaming import alerts, ingest, state_log
from parcelflow.streaming.lake import Lake
from parcelflow.streaming.progress import ProgressLog, read_progress

T0 = datetime(2024, 5, 1, 12, 0, 0)


def as_of(text="2024-06-01 00:00:00"):
    return F.lit(text).cast("timestamp")


def event(n, parcel="P1", kind="CREATED", minutes=0, version=1, hub="AMS", lat=52.3, lon=4.9):
    return (f"e{n}", parcel, kind, hub, lat, lon, T0 + timedelta(minutes=minutes), kind, version)


def land(spark, folder, name, events, broken=()):
    """One file of framed values; the files of a stream are read in the order they were written."""
    framed = ops.to_frames(spark.createDataFrame(events, S.EVENT_SCHEMA)).select("value")
    if broken:
        framed = framed.union(spark.createDataFrame([(bytearray(b),) for b in broken], "value binary"))
    framed.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema("value binary").option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, folder, lake, **options):
    query = ingest.start(stream(spark, folder), lake, available_now=True, as_of=as_of(), **options)
    query.awaitTermination()
    return query


FILES = [
    [event(1), event(2, kind="LABEL_PRINTED", minutes=10, version=2), event(3, "P2", minutes=12)],
    # e1 again inside the watermark, a bad hub, a bad place
    [event(1), event(4, "P2", "LABEL_PRINTED", 60, 2), event(5, "P3", hub="XXX"), event(6, "P4", lat=0.0, lon=0.0)],
    # moves the watermark to 12:30 before the next file
    [event(7, "P1", "COLLECTED", 61, 3)],
    # late by more than 30 minutes; e4 again, still remembered
    [event(8, "P9", minutes=11), event(4, "P2", "LABEL_PRINTED", 60, 2), event(9, "P2", "RETURNED", 62, 3)],
]


def bronze_ids(spark, lake):
    return sorted(r.event_id for r in files.read_bronze(spark, lake.bronze).collect())


@pytest.mark.parametrize("mode", ["bounded", "exact"])
def test_stream_fans_out(spark, scratch, mode):
    lake, inbox = Lake(f"{scratch}/lake"), f"{scratch}/in"
    seen = {}
    for n, batch in enumerate(FILES):
        land(spark, inbox, n, batch, broken=[b"\x00\x00\x00\x00\x01{not json"] if n == 1 else ())
        run(spark, inbox, lake, mode=mode, on_metrics=lambda b, m: seen.update({b: m}))
    assert bronze_ids(spark, lake) == ["e1", "e2", "e3", "e4", "e7", "e9"]
    letters = spark.read.parquet(lake.dead_letters)
    assert rows(letters, "event_id", "reject_reason") == [("e5", "hub"), ("e6", "bbox"), (None, "decode")]
    assert letters.filter("reject_reason = 'decode'").first().raw == b"\x00\x00\x00\x00\x01{not json"
    assert sum(m["bronze"] for m in seen.values()) == 6
    assert sum(m["dead_letters"] for m in seen.values()) == 3
    assert rows(state_log.current_state(spark, lake), "parcel_id", "version", "status") == [
        ("P1", 3, "COLLECTED"),
        ("P2", 3, "RETURNED"),
    ]


def test_repeat_outside_the_watermark_is_repaired_in_silver(spark, scratch):
    lake, inbox = Lake(f"{scratch}/lake"), f"{scratch}/in"
    batches = [
        [event(1)],
        [event(2, "P2", minutes=300)],
        [event(3, "P2", "LABEL_PRINTED", 301, 2)],
        [event(1, minutes=302)],
    ]
    for n, batch in enumerate(batches):
        land(spark, inbox, n, batch)
        run(spark, inbox, lake)
    assert bronze_ids(spark, lake) == ["e1", "e1", "e2", "e3"]
    jobs.build_silver(spark, lake)
    silver = files.read_silver(spark, lake.silver)
    assert sorted(r.event_id for r in silver.collect()) == ["e1", "e2", "e3"]
    assert silver.columns == S.SILVER_COLUMNS


def test_replaying_a_batch_changes_nothing(spark, scratch):
    lake = Lake(f"{scratch}/lake")

    def batch(events):
        return ops.validate(
            spark.createDataFrame(events, S.EVENT_SCHEMA).withColumn("is_decoded", F.lit(True)), as_of()
        ).withColumn("raw", F.lit(None).cast("binary"))

    first, second = FILES[0], [event(4, "P1", "COLLECTED", 61, 3), event(5, "P3", hub="XXX")]
    ingest.write_batch(batch(first), 0, lake, lambda s: None, as_of())
    ingest.write_batch(batch(second), 1, lake, lambda s: None, as_of())
    before = rows(state_log.current_state(spark, lake))
    changed = spark.read.parquet(f"{lake.changes}/batch_id=1").count()
    ingest.write_batch(batch(second), 1, lake, lambda s: None, as_of())
    assert bronze_ids(spark, lake) == ["e1", "e2", "e3", "e4"]
    assert spark.read.parquet(lake.dead_letters).count() == 1
    assert rows(state_log.current_state(spark, lake)) == before
    assert spark.read.parquet(f"{lake.changes}/batch_id=1").count() == changed == 1


def test_state_guard_and_compaction(spark, scratch):
    lake = Lake(f"{scratch}/lake")

    def apply(batch_id, *events):
        df = spark.createDataFrame(list(events), S.EVENT_SCHEMA).withColumn("weather_bad", F.lit(True))
        state_log.apply_batch(df, lake, batch_id)

    apply(0, event(1, version=2), event(2, "P2", version=5))
    apply(1, event(3, kind="RETURNED", version=1), event(4, "P2", "DELIVERED", version=5), event(5, "P3"))
    expected = [("P1", 2, "CREATED"), ("P2", 5, "CREATED"), ("P3", 1, "CREATED")]
    assert rows(state_log.current_state(spark, lake), "parcel_id", "version", "status") == expected
    state_log.compact(spark, lake)
    assert rows(state_log.current_state(spark, lake), "parcel_id", "version", "status") == expected
    apply(2, event(6, "P3", "DELIVERED", version=2), event(7, version=2))
    assert rows(spark.read.parquet(f"{lake.changes}/batch_id=2"), "parcel_id", "version") == [("P3", 2)]
    # A batch below the snapshot sees the log as it was then.
    assert rows(state_ops.latest(state_log.rows_before(spark, lake, 1)), "parcel_id", "version") == [
        ("P1", 2),
        ("P2", 5),
    ]


def test_compaction_leaves_the_newest_batch_alone(spark, scratch):
    """Rows of the newest batch that appear after a compaction still count; a second compaction changes nothing."""
    lake = Lake(f"{scratch}/lake")

    def apply(batch_id, *events):
        df = spark.createDataFrame(list(events), S.EVENT_SCHEMA).withColumn("weather_bad", F.lit(True))
        state_log.apply_batch(df, lake, batch_id)

    apply(0, event(1))
    state_log.compact(spark, lake)
    assert files.read_or_empty(spark, lake.snapshot_marks, state_log.MARKS).count() == 0
    apply(1, event(2, "P2"))
    for _ in range(2):
        state_log.compact(spark, lake)
        assert [r.upto for r in spark.read.parquet(lake.snapshot_marks).collect()] == [0]
    late = spark.createDataFrame([event(3, "P3")], S.EVENT_SCHEMA).withColumn("weather_bad", F.lit(True))
    state_ops.latest(late).write.mode("append").parquet(f"{lake.changes}/batch_id=1")
    assert [r[0] for r in rows(state_log.current_state(spark, lake), "parcel_id")] == ["P1", "P2", "P3"]


def test_dead_letters_only_where_rows_are_refused(spark, scratch):
    """A batch of valid rows writes none; a replay that refuses nothing clears what an earlier attempt refused."""
    lake, seen = Lake(f"{scratch}/lake"), {}

    def write(batch_id, *events):
        df = ops.validate(spark.createDataFrame(list(events), S.EVENT_SCHEMA), as_of())
        df = df.withColumn("is_decoded", F.lit(True)).withColumn("raw", F.lit(None).cast("binary"))
        ingest.write_batch(df, batch_id, lake, lambda s: None, as_of(), lambda b, m: seen.update({b: m}))
        return files.read_or_empty(spark, lake.dead_letters, "event_id string, batch_id long").count()

    assert write(0, event(1)) == 0
    assert write(1, event(2), event(3, hub="XXX")) == 1
    assert seen[0]["dead_letters"] == 0 and seen[1]["dead_letters"] == 1
    assert write(1, event(2)) == 0


def test_stream_result_equals_batch_result(spark, scratch):
    lake, inbox = Lake(f"{scratch}/lake"), f"{scratch}/in"
    kinds = S.EVENT_TYPES[:7]
    events = [
        event(n * 10 + v, f"P{n}", kind, minutes=v, version=v + 1, hub=S.HUB_IDS[n % 8])
        for n in range(20)
        for v, kind in enumerate(kinds)
    ]
    for start in range(0, len(events), 35):
        land(spark, inbox, start, events[start : start + 35])
    run(spark, inbox, lake)
    jobs.build_silver(spark, lake)
    assert files.read_silver(spark, lake.silver).count() == len(events)
    whole = state_ops.latest(
        spark.createDataFrame(events, S.EVENT_SCHEMA).withColumn("weather_bad", F.lit(None).cast("boolean"))
    )
    assert rows(state_log.current_state(spark, lake)) == rows(whole)


def test_weather_is_read_per_batch(spark, scratch):
    lake, inbox = Lake(f"{scratch}/lake"), f"{scratch}/in"
    for n, bad in enumerate([True, False]):
        flags = spark.createDataFrame([("AMS", bad)], "hub_id string, weather_bad boolean")
        files.write_weather(flags, lake.weather)
        land(spark, inbox, n, [event(n, f"P{n}", minutes=n)])
        run(spark, inbox, lake, weather=lambda s: files.read_weather(s, lake.weather))
    assert rows(files.read_bronze(spark, lake.bronze), "event_id", "weather_bad") == [("e0", True), ("e1", False)]


def test_alert_stream_and_overdue(spark, scratch):
    lake = Lake(f"{scratch}/lake")
    created = [T0, T0 + timedelta(days=20)]
    dim = spark.createDataFrame(
        [(p, "AMS", "1011 AB", "R", "DHL", "STANDARD", 48, t, t + timedelta(hours=48)) for p, t in zip(["P1", "P2"], created)],
        S.PARCEL_SCHEMA,
    )
    files.append_parcels(dim, lake.parcels)

    def put(batch_id, *events):
        df = spark.createDataFrame(list(events), S.EVENT_SCHEMA).withColumn("weather_bad", F.lit(None).cast("boolean"))
        state_log.apply_batch(df, lake, batch_id)

    def alert(day):
        now = as_of(f"2024-05-{day} 12:00:00")
        alerts.start(
            spark, lake, lambda s: files.read_parcels(s, lake.parcels), as_of=now, accel=1.0, available_now=True
        ).awaitTermination()

    put(0, event(1, "P1"), event(2, "P2"), event(3, "P9", "RETURNED", version=4))
    alert("02")
    put(1, event(4, "P1", "LABEL_PRINTED", version=2))
    alert("10")
    # The first ingest batch is replayed under new file names.
    put(0, event(1, "P1"), event(2, "P2"), event(3, "P9", "RETURNED", version=4))
    alert("10")
    sent = alerts.sent_alerts(spark, lake)
    # The replay shows P1's first change again; by now its window has run out too. P9 stays at one alert.
    assert rows(sent, "parcel_id", "version", "breached") == [("P1", 1, True), ("P1", 2, True), ("P9", 4, False)]
    due = jobs.overdue_alerts(spark, lake, as_of("2024-05-30 12:00:00"), 1.0)
    assert rows(due, "parcel_id", "subject") == [("P2", "parcelflow alert: P2")]


def test_keyed_frames_round_trip(spark):
    source = spark.createDataFrame(FILES[0], S.EVENT_SCHEMA)
    frames = ops.to_frames(source)
    assert frames.dtypes == [("key", "binary"), ("value", "binary")]
    assert frames.first().value[:5] == b"\x00\x00\x00\x00\x01"
    back = ops.decode(frames.select("value"))
    assert rows(back.drop("is_decoded")) == rows(source)
    short = spark.createDataFrame([(bytearray(b"\x00\x01"),)], "value binary")
    assert not ops.decode(short).first().is_decoded


def test_every_row_is_stored_or_refused(spark, scratch):
    """Events on both sides of the clock's tolerance, tombstones and one of the far future: no row is lost."""
    import datetime as dt

    from pyspark.sql import functions as F

    from parcelflow.operators.ingest import to_frames
    from parcelflow.streaming import ingest as stream

    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    base = spark.range(400).select(
        F.concat(F.lit("e"), "id").alias("event_id"), F.concat(F.lit("p"), "id").alias("parcel_id"),
        F.lit("CREATED").alias("event_type"), F.lit("AMS").alias("hub_id"), F.lit(52.0).alias("lat"),
        F.lit(5.0).alias("lon"),
        F.when(F.col("id") == 0, F.lit("2099-01-01").cast("timestamp"))
        .otherwise(F.current_timestamp() + F.make_interval(secs=F.lit(290) + F.col("id") / 10)).alias("event_ts"),
        F.lit("CREATED").alias("status"), F.lit(1).alias("version"),
    )
    framed = to_frames(base).select("value").union(spark.createDataFrame([(None,), (None,)], "value binary"))
    framed.write.parquet(f"{scratch}/in")
    lake = stream.Lake(f"{scratch}/lake")
    for _ in range(2):  # the second run has the first one's watermark
        source = spark.readStream.schema("value binary").parquet(f"{scratch}/in")
        stream.start(source, lake, available_now=True).awaitTermination()
        to_frames(base.withColumn("event_id", F.concat("event_id", F.lit("b"))).withColumn("event_ts", F.current_timestamp())).select(
            "value"
        ).write.mode("append").parquet(f"{scratch}/in")
    stored, refused = spark.read.parquet(lake.bronze).count(), spark.read.parquet(lake.dead_letters).count()
    assert stored + refused == 402 + 400
    assert spark.read.parquet(lake.dead_letters).filter("reject_reason = 'decode'").count() == 2


def test_late_rows_are_counted_and_stored(spark, scratch):
    """Rows on both sides of the watermark: each one is in Bronze or among the late letters, and the count agrees."""
    import time

    lake, inbox = Lake(f"{scratch}/lake"), f"{scratch}/in"
    listener = ProgressLog(spark, lake)
    spark.streams.addListener(listener)
    batches = [[event(1)], [event(2, minutes=60)], [event(3, minutes=61)]]
    # The watermark is at 12:31; rows at it and before it are late, a repeated late row is late twice.
    batches.append([event(10 + m, minutes=m) for m in range(25, 36)] + [event(10 + 25, minutes=25), event(50, minutes=20, hub="XXX")])
    for n, batch in enumerate(batches):
        land(spark, inbox, n, batch)
        run(spark, inbox, lake, keep_late=True)
    letters = spark.read.parquet(lake.dead_letters)
    late = sorted(r.event_id for r in letters.filter("reject_reason LIKE '%late'").collect())
    stored = set(bronze_ids(spark, lake))
    assert stored | set(late) == {"e1", "e2", "e3", "e50"} | {f"e{10 + m}" for m in range(25, 36)} and not stored & set(late)
    assert late.count("e35") == 2 and rows(letters.filter("event_id = 'e50'"), "reject_reason") == [("hub,late",)]
    for _ in range(50):  # the listener is told a moment after the batch
        told = read_progress(spark, lake).collect()
        if sum(r.late_rows for r in told) == len(late):
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert sum(r.late_rows for r in told) == len(late) == 9
    assert sum(r.input_rows for r in told) >= sum(map(len, batches))


def test_hot_event_id_is_dealt_to_all_state_partitions(spark, scratch):
    """A third of the rows share an id: no state partition gets over twice the median, and the result is the batch's."""
    n, parts = F.col("id"), 8
    key = F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), n))
    keyed = spark.range(30_000).select(key.alias(ingest.DEDUP_KEY))
    dealt = ingest.salted(keyed, 64).repartition(parts, ingest.DEDUP_KEY, ingest.SALT)
    sizes = sorted(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == parts and sizes[-1] <= 2 * sizes[parts // 2]
    lake, inbox = Lake(f"{scratch}/lake"), f"{scratch}/in"
    events = [event("hot" if i % 3 == 0 else i, f"P{i % 50}", minutes=i % 20, version=i) for i in range(900)]
    for start in range(0, 900, 300):
        land(spark, inbox, start, events[start : start + 300])
    run(spark, inbox, lake)
    assert bronze_ids(spark, lake) == sorted({e[0] for e in events})
