"""Operators on small frames with results worked out by hand."""

from __future__ import annotations

import json
import math
import os
import random
from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow import schemas as S
from parcelflow.functions import geo, sla, text, validation
from parcelflow.operators import alerts, ingest, lifecycle, live, quality, silver, state, warehouse, weather
from parcelflow.plans import jobs
from parcelflow.sources import files, reference
from parcelflow.streaming.lake import Lake

NOW = datetime(2024, 5, 1, 12, 0, 0)


def at(hours=0.0):
    return NOW + timedelta(hours=hours)


def now_col():
    return F.lit(NOW.isoformat(" ")).cast("timestamp")


def events(spark, *data):
    """(id, parcel, type, version, hours) with a valid place; further values replace hub, lat, lon."""
    full = []
    for event_id, parcel, kind, version, hours, *place in data:
        hub, lat, lon = (*place, *("AMS", 52.3, 4.9)[len(place) :])
        full.append((event_id, parcel, kind, hub, lat, lon, None if hours is None else at(hours), kind, version))
    return spark.createDataFrame(full, S.EVENT_SCHEMA)


def parcel(parcel_id, region="R", created=0.0, hours=48, level="STANDARD"):
    return (parcel_id, "AMS", "1011 AB", region, "DHL", level, hours, at(created), at(created + hours))


def silver_of(df, weather_bad=None):
    return silver.to_silver(df.withColumn("weather_bad", F.lit(weather_bad).cast("boolean")))


# --- validation -------------------------------------------------------------


def test_each_rule(spark):
    def value(column):
        return spark.range(1).select(column.alias("v")).first().v

    assert value(validation.in_box(F.lit(52.3), F.lit(4.9)))
    assert value(validation.in_box(F.lit(50.75), F.lit(7.23)))
    assert not value(validation.in_box(F.lit(0.0), F.lit(0.0)))
    assert not value(validation.in_box(F.lit(48.85), F.lit(2.35)))
    assert value(validation.known_hub(F.lit("AMS")))
    assert not value(validation.known_hub(F.lit("XXX")))
    late = now_col() + F.expr("INTERVAL 2 MINUTES")
    far = now_col() + F.expr("INTERVAL 1 HOUR")
    assert value(validation.not_in_future(late, now_col()))
    assert not value(validation.not_in_future(far, now_col()))
    assert value(validation.not_in_future(F.current_timestamp()))


def test_no_row_falls_between_valid_and_rejected(spark):
    data = events(
        spark,
        ("ok", "P", "CREATED", 1, -1),
        ("hub", "P", "CREATED", 1, -1, "XXX"),
        ("nohub", "P", "CREATED", 1, -1, None),
        ("nolat", "P", "CREATED", 1, -1, "AMS", None),
        ("notime", "P", "CREATED", 1, None),
        ("all", "P", "CREATED", 1, 2, "XXX", 0.0, 0.0),
    )
    flagged = ingest.validate(data, now_col())
    assert [r.event_id for r in flagged.filter("is_valid").collect()] == ["ok"]
    assert rows(ingest.reject(data, now_col()), "event_id", "reject_reason") == [
        ("all", "bbox,future,hub"),
        ("hub", "hub"),
        ("nohub", "hub"),
        ("nolat", "bbox"),
        ("notime", "future"),
    ]


def test_enrich_without_weather_and_with_repeated_hubs(spark):
    data = events(spark, ("a", "P", "CREATED", 1, 0), ("b", "P", "CREATED", 1, 0, "MST"))
    assert rows(ingest.enrich(data, None), "event_id", "weather_bad") == [("a", None), ("b", None)]
    flags = spark.createDataFrame([("AMS", False), ("AMS", True), ("ZZZ", True)], "hub_id string, weather_bad boolean")
    assert rows(ingest.enrich(data, flags), "event_id", "weather_bad") == [("a", True), ("b", None)]


def test_decode_refuses_what_breaks_the_contract(spark):
    good = {
        "event_id": "e", "parcel_id": "P", "event_type": "CREATED", "hub_id": "AMS", "lat": 52.3, "lon": 4.9,
        "event_ts": 1714564800123, "status": "CREATED", "version": 1,
    }
    bad_type, bad_enum, missing = {**good, "lat": "north"}, {**good, "event_type": "TELEPORTED"}, dict(good)
    del missing["parcel_id"]
    bodies = [json.dumps(b).encode() for b in (good, bad_type, bad_enum, missing)] + [b"", b"[1", b"null"]
    df = spark.createDataFrame([(bytearray(b"\x00\x00\x00\x00\x07" + b),) for b in bodies], "value binary")
    decoded = ingest.decode(df).collect()
    assert [r.is_decoded for r in decoded] == [True] + [False] * 6
    assert decoded[0].event_ts == datetime(2024, 5, 1, 12, 0, 0, 123000)
    assert all(r.event_id is None for r in decoded[1:])


# --- silver and warehouse ---------------------------------------------------


def test_survivor_is_always_the_smallest(spark):
    copies = [("e", "P", "CREATED", 1, h, hub) for h in (3, 1, 2) for hub in ("UTR", "AMS")]
    for seed in range(3):
        random.Random(seed).shuffle(copies)
        kept = silver_of(events(spark, *copies).repartition(4)).collect()
        assert [(r.event_ts, r.hub_id, r.event_date) for r in kept] == [(at(1), "AMS", date(2024, 5, 1))]


def test_latest_parcel_row(spark):
    data = spark.createDataFrame([parcel("P1", "old", -5), parcel("P1", "new", -1), parcel("P2")], S.PARCEL_SCHEMA)
    assert rows(warehouse.stg_parcels(data), "parcel_id", "destination_region") == [("P1", "new"), ("P2", "R")]


def test_marts(spark):
    data = silver_of(
        events(
            spark,
            ("1", "A", "CREATED", 1, 0),
            ("2", "A", "OUT_FOR_DELIVERY", 2, 1),
            ("3", "A", "DELIVERED", 3, 48),
            ("4", "B", "OUT_FOR_DELIVERY", 2, 1),
            ("5", "B", "DELIVERY_FAILED", 3, 2),
            ("6", "B", "RETURNED", 4, 3),
            ("7", "C", "DELIVERED", 1, 49),
            ("8", "orphan", "DELIVERED", 1, 1),
            ("9", "A", "CREATED", 4, 0),
        )
    )
    dim = warehouse.stg_parcels(
        spark.createDataFrame([parcel("A"), parcel("B", None), parcel("C"), parcel("idle", "S")], S.PARCEL_SCHEMA)
    )
    fact = warehouse.fct_parcel_events(data, dim)
    assert fact.count() == 9 and fact.columns[:11] == S.SILVER_COLUMNS
    for outcomes in (warehouse.parcel_outcomes(data, dim), warehouse.outcomes_of_fact(fact)):
        # 48 hours to the second are in time; an orphan has no window.
        assert [tuple(r) for r in warehouse.gold_on_time_by_region(outcomes, 1.0).collect()] == [
            ("R", 2, 2, 1, 0.5),
            ("Unknown", 2, 1, 0, 0.0),
        ]
        assert [tuple(r) for r in warehouse.gold_failure_analysis(outcomes).collect()] == [
            ("R", 2, 0, 0, 0.0, 0.0),
            ("Unknown", 2, 1, 1, 0.5, 0.5),
        ]
    none = warehouse.parcel_outcomes(data.filter("parcel_id = 'B'"), dim)
    assert warehouse.gold_on_time_by_region(none).first().on_time_rate is None
    assert [tuple(r) for r in warehouse.gold_delivery_funnel(data).collect()][:2] == [("DELIVERED", 3, 3), ("OUT_FOR_DELIVERY", 2, 2)]
    assert [tuple(r) for r in warehouse.gold_weather_impact(data).collect()] == [(False, 2, 1, 0.5)]
    idle = silver_of(events(spark, ("1", "A", "CREATED", 1, 0)), True)
    assert [tuple(r) for r in warehouse.gold_weather_impact(idle).collect()] == [(True, 0, 0, None)]


# --- state and live ---------------------------------------------------------


def state_events(spark, *data, bad=None):
    return events(spark, *data).withColumn("weather_bad", F.lit(bad).cast("boolean"))


def test_merge_guard(spark):
    stored = state.latest(state_events(spark, ("s1", "A", "CREATED", 2, 0), ("s2", "B", "CREATED", 1, 0), ("s3", "C", "CREATED", 1, 0)))
    batch = state_events(
        spark,
        ("1", "A", "RETURNED", 2, 9),
        ("2", "B", "COLLECTED", 2, 0),
        ("3", "B", "LABEL_PRINTED", 2, 1),
        ("4", "D", "CREATED", 1, 0),
    )
    merged = state.merge(stored, batch)
    assert rows(merged, "parcel_id", "version", "status", "changed") == [
        ("A", 2, "CREATED", False),
        ("B", 2, "LABEL_PRINTED", True),
        ("C", 1, "CREATED", False),
        ("D", 1, "CREATED", True),
    ]
    assert rows(state.changes(stored, batch)) == rows(merged.filter("changed").drop("changed"))
    empty = state_events(spark).limit(0)
    assert rows(state.changes(state.latest(empty), batch), "parcel_id") == [("A",), ("B",), ("D",)]


def test_sla_classes_and_worklist(spark):
    ages = {"over": 48.1, "edge": 48.0, "risk": 38.5, "limit": 38.4, "fresh": 1.0, "done": 99.0}
    dim = spark.createDataFrame([parcel(p, created=-age) for p, age in ages.items()], S.PARCEL_SCHEMA)
    data = state.latest(
        state_events(
            spark,
            *[(p, p, "DELIVERED" if p == "done" else "IN_TRANSIT", 1, 0) for p in ages],
            ("x", "alien", "CREATED", 1, 0),
            ("y", "nowhere", None, 1, 0, None, None),
        )
    )
    args = (data, dim, now_col(), 1.0)
    assert dict(rows(live.sla_state(*args).select("parcel_id", "sla"))) == {
        "over": "breached", "edge": "at_risk", "risk": "at_risk", "limit": "on_time", "fresh": "on_time",
        "done": "delivered", "alien": "unknown", "nowhere": "unknown",
    }
    assert dict(rows(live.sla_counts(*args))) == {"on_time": 2, "at_risk": 2, "breached": 1, "delivered": 1, "unknown": 2}
    work = live.worklist(*args).collect()
    assert [r.parcel_id for r in work] == ["over", "edge", "risk", "limit", "fresh", "done", "alien", "nowhere"]
    assert [r.time_label for r in work] == ["overdue 0.1h", "0h left", "9.5h left", "9.6h left", "47h left", "overdue 51h", "", ""]
    assert [r.parcel_id for r in live.worklist(*args, sla="at_risk", limit=1).collect()] == ["edge"]
    assert live.worklist(*args).columns[:18] == live.VIEW_COLUMNS
    assert rows(live.worklist_meta(*args, limit=3)) == [(8, 3)]
    assert rows(live.worklist_meta(*args, sla="breached")) == [(1, 1)]
    assert rows(live.totals(data)) == [(8, 7)]
    assert [tuple(r) for r in live.count_by_status(data).collect()] == [
        ("CREATED", 1), ("IN_TRANSIT", 5), ("DELIVERED", 1), ("UNKNOWN", 1),
    ]
    assert [tuple(r) for r in live.count_by_hub(data).collect()] == [("?", 1), ("AMS", 7)]
    assert "nowhere" not in {r.parcel_id for r in live.map_points(*args).collect()}
    assert live.map_points(*args).count() == 7
    assert live.parcel_detail(data, dim, "nobody", now_col()).count() == 0
    assert live.parcel_detail(data, dim, "risk", now_col(), 1.0).first().sim_hours_remaining == 9.5
    assert live.sample_rows(data).count() == 5


def test_alerts(spark):
    dim = spark.createDataFrame([parcel("late", created=-99), parcel("x" * 120, created=-99)], S.PARCEL_SCHEMA)
    changed = spark.createDataFrame(
        [("late", "CREATED"), ("back", "RETURNED"), ("fine", "CREATED"), ("x" * 120, "CREATED")], "parcel_id string, status string"
    )
    found = {r.parcel_id: r for r in alerts.alerts(changed, dim, now_col(), 1.0).collect()}
    assert set(found) == {"late", "back", "x" * 120}
    assert found["back"].message == "Parcel back: status=RETURNED, breached=False."
    assert found["late"].message == "Parcel late: status=CREATED, breached=True."
    assert len(found["x" * 120].subject) == 100


def test_labels(spark):
    hours = spark.createDataFrame([(12.0,), (-3.5,), (None,), (0.0,)], "h double")
    assert [r.t for r in hours.select(text.time_label(F.col("h"), " sim-h", "n/a").alias("t")).collect()] == [
        "12 sim-h left", "overdue 3.5 sim-h", "n/a", "0 sim-h left",
    ]
    row = spark.range(1).select(
        text.status_title(F.lit("OUT_FOR_DELIVERY")).alias("a"),
        text.iso_timestamp(now_col()).alias("b"),
        sla.promised_by(now_col(), F.lit(6)).alias("c"),
    ).first()
    assert tuple(row) == ("out for delivery", "2024-05-01T12:00:00.000000Z", at(6))


# --- geography --------------------------------------------------------------


def plain_km(a, b, c, d):
    dlat, dlon = math.radians(c - a), math.radians(d - b)
    h = math.sin(dlat / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(dlon / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.floats(50.0, 54.0), st.floats(3.0, 8.0)), min_size=20, max_size=60))
def test_distances(spark, points):
    df = spark.createDataFrame(points, "lat double, lon double").select(
        "lat",
        "lon",
        geo.nearest_hub(F.col("lat"), F.col("lon")).alias("hub"),
        geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(52.3676), F.lit(4.9041)).alias("km"),
    )
    for r in df.collect():
        distances = {h[0]: plain_km(r.lat, r.lon, h[2], h[3]) for h in S.HUBS}
        assert distances[r.hub] <= min(distances.values()) + 1e-9
        assert r.km == pytest.approx(distances["AMS"], abs=1e-6)


def test_nearest_hub_without_place_and_regions(spark):
    row = spark.range(1).select(
        geo.nearest_hub(F.lit(None).cast("double"), F.lit(4.9)).alias("hub"),
        geo.postcode_region(F.lit("9711 AB")).alias("r9"),
        geo.postcode_region(F.lit("0000 XX")).alias("r0"),
        geo.sla_hours(F.lit("NEXT_DAY")).alias("hours"),
        geo.sla_hours(F.lit("SOMEDAY")).alias("none"),
    ).first()
    assert tuple(row) == (None, "Groningen-Drenthe", "Unknown", 24, None)


# --- weather ----------------------------------------------------------------


def test_weather_responses(spark):
    full = {
        "latitude": 52.37, "current_units": {"temperature_2m": "C"},
        "current": {"time": "2026-06-24T10:00", "temperature_2m": 15.3, "wind_speed_10m": 3.2, "precipitation": 0},
    }
    short = {"current": {"time": "2026-06-24T10:00", "temperature_2m": 9.0}}
    odd = {"current": {"time": "t", "temperature_2m": "9.0", "wind_speed_10m": "NaN", "precipitation": 0.7}}
    bodies = [("one", full), ("list", [short, odd]), ("none", []), ("many", [full] * 10), ("bare", {"latitude": 1.0})]
    df = spark.createDataFrame([(k, json.dumps(b)) for k, b in bodies], "id string, body string")
    parsed = weather.parse_responses(df)
    got = {(r.id, r.hub_id): (r.temperature, r.wind_speed, r.precipitation, r.observed_at) for r in parsed.collect()}
    assert got[("one", "AMS")] == (15.3, 3.2, 0.0, "2026-06-24T10:00")
    assert got[("list", "AMS")] == (9.0, None, None, "2026-06-24T10:00")
    assert got[("list", "RTM")] == (None, None, 0.7, "t")
    assert got[("bare", "AMS")] == (None, None, None, None)
    assert sorted(h for k, h in got if k == "many") == sorted(S.HUB_IDS)
    assert len(got) == 12
    missing = weather.uncovered(weather.parse_responses(df, keep_empty=True), "id")
    counts = dict(rows(missing.groupBy("id").count()))
    assert counts == {"one": 7, "list": 6, "none": 8, "bare": 7}


def test_weather_limits(spark):
    data = [("a", 12.0, 0.0), ("b", 2.0, 1.0), ("c", 2.0, 0.0), ("d", None, None), ("e", 10.0, None), ("f", None, 0.5)]
    df = spark.createDataFrame(data, "hub_id string, wind_speed double, precipitation double")
    assert dict(rows(weather.flags(df).select("hub_id", "weather_bad"))) == {
        "a": True, "b": True, "c": False, "d": False, "e": True, "f": True,
    }
    assert not any(r.weather_bad for r in weather.flags(df, None, None).collect())


def test_weather_files(spark, scratch):
    assert files.read_weather_snapshot(spark, f"{scratch}/none.json") is None
    with open(f"{scratch}/snapshot.json", "w") as out:
        json.dump({"fetched_at": "x", "observations": {"AMS": {"hub_id": "AMS", "bad": True}, "UTR": {"hub_id": "UTR"}}}, out, indent=2)
    snapshot = files.read_weather_snapshot(spark, f"{scratch}/snapshot.json")
    assert rows(snapshot) == [("AMS", True), ("UTR", False)]
    files.write_weather(snapshot, f"{scratch}/weather")
    assert rows(files.read_weather(spark, f"{scratch}/weather"), "hub_id", "weather_bad") == [("AMS", True), ("UTR", False)]
    files.write_weather(snapshot.filter("weather_bad"), f"{scratch}/weather")
    assert rows(files.read_weather(spark, f"{scratch}/weather"), "hub_id", "weather_bad") == [("AMS", True)]
    assert files.read_weather(spark, f"{scratch}/nowhere").count() == 0


def test_weather_job(spark, scratch):
    lake = Lake(f"{scratch}/lake")
    calm, storm = ({"current": {"time": "t", "wind_speed_10m": w, "precipitation": 0.0}} for w in (1.0, 20.0))
    os.mkdir(f"{scratch}/in")
    for n, body in enumerate(([storm, storm, calm], [calm, storm])):
        with open(f"{scratch}/in/{n}.json", "w") as out:
            json.dump(body, out, indent=1)
        os.utime(f"{scratch}/in/{n}.json", (1_000_000 + n, 1_000_000 + n))
    jobs.refresh_weather(spark, lake, f"{scratch}/in")
    assert rows(files.read_weather(spark, lake.weather), "hub_id", "weather_bad") == [("AMS", False), ("RTM", True), ("UTR", False)]


# --- lifecycle --------------------------------------------------------------

HAPPY = ["CREATED", "LABEL_PRINTED", "COLLECTED", "AT_SORTING_HUB", "IN_TRANSIT", "OUT_FOR_DELIVERY", "DELIVERED"]


def test_clean_lives_pass(spark):
    failed = [*HAPPY[:-1], "DELIVERY_FAILED", "RESCHEDULED", "OUT_FOR_DELIVERY", "DELIVERY_FAILED", "RETURNED"]
    data = events(spark, *[(f"{p}{v}", p, kind, v + 1, v) for p, life in (("A", HAPPY), ("B", failed)) for v, kind in enumerate(life)])
    assert lifecycle.bad_transitions(data).count() == 0
    assert lifecycle.version_gaps(data).count() == 0
    assert lifecycle.open_parcels(data).count() == 0
    assert rows(lifecycle.rates(data)) == [(2, 0.5, 0.5, False)]


def test_broken_lives_are_named(spark):
    data = events(
        spark,
        ("1", "A", "CREATED", 1, 0), ("2", "A", "DELIVERED", 2, 1), ("3", "A", "OUT_FOR_DELIVERY", 4, 2),
        ("4", "B", "CREATED", 1, 0), ("5", "B", "LABEL_PRINTED", 1, 1),
        ("6", "C", "CREATED", 2, 0),
    )
    assert rows(lifecycle.bad_transitions(data)) == [("A", 2, "CREATED", "DELIVERED"), ("A", 4, "DELIVERED", "OUT_FOR_DELIVERY")]
    assert rows(lifecycle.version_gaps(data)) == [("A", 3, 1, 4), ("B", 2, 1, 1), ("C", 1, 2, 2)]
    assert rows(lifecycle.open_parcels(data)) == [("A", "OUT_FOR_DELIVERY"), ("B", "LABEL_PRINTED"), ("C", "CREATED")]


def pairs_by_hand(data):
    """Adjacent steps of each parcel in plain Python, repeats of one step folded."""
    first = {}
    for _, p, kind, version, hours, *_ in data:
        key = (p, version, kind)
        first[key] = min(first.get(key, hours), hours)
    lives = {}
    for (p, version, kind), hours in first.items():
        lives.setdefault(p, []).append((version, hours, kind))
    bad = []
    for p, life in lives.items():
        life.sort()
        bad += [
            (p, b[0], a[2], b[2]) for a, b in zip(life, life[1:]) if (a[2], b[2]) not in S.LIFECYCLE_EDGES
        ]
    return sorted(bad, key=repr)


@pytest.mark.parametrize("slice_versions", [1, 3, 1 << 16])
def test_sliced_windows_equal_whole_windows(spark, slice_versions):
    rng = random.Random(5)
    # One parcel holds a third of all rows; versions repeat, skip and go below zero.
    data = [
        (f"e{n}", "hot" if n % 3 == 0 else f"P{rng.randrange(20)}", rng.choice(S.EVENT_TYPES), rng.randrange(-6, 30), rng.randrange(50))
        for n in range(900)
    ]
    found = lifecycle.bad_transitions(events(spark, *data), slice_versions=slice_versions)
    assert rows(found) == pairs_by_hand(data)


# --- data quality -----------------------------------------------------------


def test_checks_count_failures(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), (None, 2)], "k string, v int")
    assert rows(quality.not_null({"t": (df, ["k", "v"])})) == [("t", "k", 1), ("t", "v", 1)]
    assert rows(quality.unique({"t": (df, ["k", "v"])})) == [("t", "k", 1), ("t", "v", 1)]
    assert rows(quality.accepted({"t": (df, {"k": ["a"], "v": [1, 2]})})) == [("t", "k", 1), ("t", "v", 0)]
    dim = spark.createDataFrame([("a",)], "k string")
    assert rows(quality.orphans(df.filter("k IS NOT NULL"), dim, "k")) == [("b", 1)]


def test_contract_and_schema(spark):
    fields = ", ".join(f"{c} string" for c in S.EVENT_COLUMNS)
    good = ("e", "P", "CREATED", "AMS", "52.3", "4.9", "2024-05-01T12:00:00Z", "CREATED", "1")
    odd = ("f", None, "TELEPORTED", "AMS", "north", None, "x", "CREATED", "1.5x")
    df = spark.createDataFrame([good, odd], fields)
    assert rows(quality.contract(df)) == [
        ("f", "event_ts", "type"), ("f", "event_type", "enum"), ("f", "lat", "type"), ("f", "lon", "missing"),
        ("f", "parcel_id", "missing"), ("f", "version", "type"),
    ]
    assert quality.schema_problems(S.EVENT_SCHEMA) == []
    partial = T.StructType([f for f in df.schema if f.name != "lat"])
    assert ("lat", "missing") in quality.schema_problems(partial)
    assert ("version", "type") in quality.schema_problems(partial)


def test_promises(spark):
    off = list(parcel("P2"))
    off[-1] = at(1)
    df = spark.createDataFrame([parcel("P1"), tuple(off)], S.PARCEL_SCHEMA)
    assert rows(quality.promised_mismatch(df)) == [("P2", at(1), at(48))]


# --- files and jobs ---------------------------------------------------------


def test_parcel_lines(spark, scratch):
    data = spark.createDataFrame([parcel("P1"), parcel("P2", None)], S.PARCEL_SCHEMA)
    files.append_parcels(data, f"{scratch}/parcels")
    with open(f"{scratch}/parcels/more.json", "w") as out:
        out.write('\n\n{"parcel_id": "P3", "created_at": "2024-05-01T12:00:00+02:00"}\n\n')
    back = files.read_parcels(spark, f"{scratch}/parcels")
    assert rows(back.filter("parcel_id <> 'P3'")) == rows(data)
    assert back.filter("parcel_id = 'P3'").first().created_at == datetime(2024, 5, 1, 10, 0)
    assert files.read_parcels(spark, f"{scratch}/nothing").count() == 0


def test_reference_frames(spark):
    assert reference.hubs(spark).count() == 8 and reference.towns(spark).count() == 42
    assert reference.postcode_regions(spark).count() == 9 and reference.service_levels(spark).count() == 3
    assert reference.lifecycle_edges(spark).count() == 10


def test_warehouse_job(spark, scratch):
    lake = Lake(f"{scratch}/lake")
    data = events(
        spark, ("1", "A", "OUT_FOR_DELIVERY", 1, 0), ("2", "A", "DELIVERED", 2, 1), ("3", "orphan", "CREATED", 1, 0),
        ("3", "orphan", "CREATED", 1, 0),
    )
    bronze = ingest.with_event_date(ingest.enrich(data, None))
    bronze.write.partitionBy("event_date").parquet(f"{lake.bronze}/batch_id=0")
    files.append_parcels(spark.createDataFrame([parcel("A")], S.PARCEL_SCHEMA), lake.parcels)
    jobs.build_silver(spark, lake)
    jobs.build_warehouse(spark, lake, 1.0)
    assert spark.table("fct_parcel_events").count() == 3
    assert rows(spark.table("gold_on_time_by_region"), "region", "on_time_rate") == [("R", 1.0), ("Unknown", None)]
    failing = jobs.check_warehouse(spark).filter("failures > 0")
    assert rows(failing) == [("relationships", "fct_parcel_events", "parcel_id", "warn", 1)]
    assert jobs.check_warehouse(spark).count() == 19
    jobs.build_warehouse(spark, lake, 1.0)  # a second run replaces the first
    assert spark.table("dim_parcels").count() == 1
    pruned = files.read_silver(spark, lake.silver, from_date="2024-05-02")
    assert pruned.count() == 0
    assert "PartitionFilters: [isnotnull(event_date" in pruned._jdf.queryExecution().toString()
