"""The network as a stored table, and the nearest of many hubs."""

from __future__ import annotations

import json
import random
from datetime import datetime
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from parcelflow import schemas as S
from parcelflow.functions import geo
from parcelflow.network import DEFAULT, Network
from parcelflow.operators import ingest
from parcelflow.operators.nearest import candidate_grid, with_nearest_hub
from parcelflow.plans import jobs
from parcelflow.sources import files, reference
from parcelflow.streaming import ingest as stream_ingest
from parcelflow.streaming.lake import Lake

SMALL = Network((("N1", "North", 10.5, 20.5), ("N2", "South", -3.0, 21.0)), (-5.0, 12.0), (19.0, 23.0), (("7", "Far"),), 3.0, None)


def brute(points, hubs):
    """Positions of the nearest hubs by measuring all, in blocks; the first of equals."""
    import numpy as np

    lat, lon = (np.radians([p[i] for p in points]) for i in (0, 1))
    hlat, hlon = (np.radians([h[i] for h in hubs]) for i in (2, 3))
    out = []
    for at in range(0, len(points), 200):
        a, o = lat[at : at + 200, None], lon[at : at + 200, None]
        chord = np.sin((hlat - a) / 2) ** 2 + np.cos(a) * np.cos(hlat) * np.sin((hlon - o) / 2) ** 2
        out += list(chord)
    return out


def test_many_hubs_equal_brute_force(spark):
    noise = random.Random(5)
    spots = [(round(noise.uniform(51, 53), 4), round(noise.uniform(4, 7), 4)) for _ in range(4000)]
    spots += [(52.0 + noise.gauss(0, 0.01), 5.0 + noise.gauss(0, 0.01)) for _ in range(900)]  # a dense town
    spots += spots[:100]  # hubs at one place: the earlier one wins
    hubs = tuple((f"H{i}", "", *spot) for i, spot in enumerate(spots))
    network = Network(hubs, (51.0, 53.0), (4.0, 7.0))
    points = [(noise.uniform(51, 53), noise.uniform(4, 7)) for _ in range(1500)] + spots[:200]
    points += [(51.0, 4.0), (53.0, 7.0), (51.0, 7.0), (52.0, 5.5), (89.0, -170.0), (-60.0, 10.0), (53.0001, 5.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "n int, lat double, lon double")
    found = {r.n: r.nearest_hub for r in with_nearest_hub(df, network).collect()}
    place = {hub[0]: i for i, hub in enumerate(hubs)}
    for i, chords in enumerate(brute(points, hubs)):
        got = place[found[i]]
        assert chords[got] <= chords.min() + 1e-18, points[i]
    assert [found[1500 + i] for i in range(100)] == [f"H{i}" for i in range(100)]  # twins: H0, not H4900
    sizes = candidate_grid(spark, network).filter("cell_y >= 0").select(F.size("candidates").alias("n"))
    assert sizes.agg(F.percentile("n", 0.5)).first()[0] < 20 < 4900 and sizes.count() == 4**8


def test_ties_between_mirrored_hubs(spark):
    """Points on the meridian between two rows of hubs have two nearest ones each."""
    hubs = tuple((f"{side}{i}", "", float(i), lon) for i in range(60) for side, lon in (("E", 6.0), ("W", 4.0)))
    network = Network(hubs, (0.0, 60.0), (4.0, 6.0))
    df = spark.range(60).select(F.col("id").cast("double").alias("lat"), F.lit(5.0).alias("lon"))
    got = {r.lat: r.nearest_hub for r in with_nearest_hub(df, network).collect()}
    same = {r.lat: r.nearest_hub for r in with_nearest_hub(df, network, inline=1000).collect()}
    assert got == same and got[0.0] == "E0"


def test_rows_without_place_and_clashing_names(spark):
    df = spark.createDataFrame(
        [(None, 5.0, "a"), (52.0, None, "b"), (float("nan"), 5.0, "c"), (52.37, 4.9, "d")], "lat double, lon double, hub_id string"
    ).withColumn("candidates", F.lit(1)).withColumn("cell_x", F.lit(2))
    wide = with_nearest_hub(df, inline=0)
    assert wide.columns == [*df.columns, "nearest_hub"]
    assert rows(wide, "hub_id", "nearest_hub")[:2] == [("a", None), ("b", None)]
    assert rows(wide, "hub_id", "nearest_hub")[3] == ("d", "AMS")
    assert repr(rows(wide)) == repr(rows(with_nearest_hub(df)))
    assert with_nearest_hub(df.limit(0), inline=0).count() == 0


def test_lookup_by_cell_splits_and_has_no_nested_loop(spark):
    hubs = tuple((f"H{i}", "", 50 + i / 100, 4 + i % 7 / 10) for i in range(150))
    plan = with_nearest_hub(spark.range(10).selectExpr("double(id) lat", "double(id) lon"), Network(hubs))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_stored_network(spark, scratch):
    path = f"{scratch}/network"
    assert reference.read_network(spark, path) == DEFAULT
    reference.write_network(spark, path, SMALL)
    got = reference.read_network(spark, path)
    assert got.hubs == SMALL.hubs and got.lat_range == SMALL.lat_range and got.regions == SMALL.regions and got.wind_limit == 3.0
    one = {"hub_id": "A", "name": "a", "lat": 1.0, "lon": 2.0}
    for broken in ([], [one, one], [one | {"lat": None}]):
        folder = Path(f"{scratch}/broken{len(str(broken))}")
        folder.mkdir()
        (folder / "n.json").write_text(json.dumps({"hubs": broken}))
        with pytest.raises(ValueError):
            reference.read_network(spark, str(folder))
    folder = Path(f"{scratch}/flat")
    folder.mkdir()
    (folder / "n.json").write_text(json.dumps({"lat_range": [3.0, 3.0]}))
    with pytest.raises(ValueError):
        reference.read_network(spark, str(folder))


def test_rules_follow_the_network(spark, scratch):
    at = datetime(2024, 5, 1, 12)
    some = [("e1", "N1", 10.0, 20.0), ("e2", "AMS", 10.0, 20.0), ("e3", "N2", 52.0, 20.0), ("e4", "N2", 12.0, 23.0)]
    events = spark.createDataFrame([(e, "P1", "CREATED", h, la, lo, at, "CREATED", n) for n, (e, h, la, lo) in enumerate(some)], S.EVENT_SCHEMA)
    now = F.lit("2024-06-01").cast("timestamp")
    assert rows(ingest.judge(events, now, SMALL), "event_id", "reject_reason") == [("e1", ""), ("e2", "hub"), ("e3", "bbox"), ("e4", "")]
    assert rows(ingest.judge(events, now), "reject_reason") == [("bbox",), *[("bbox,hub",)] * 3]
    lake, inbox = Lake(f"{scratch}/lake"), f"{scratch}/inbox"
    ingest.to_frames(events).select("value").write.parquet(inbox)
    weather = spark.createDataFrame([("N1", True), ("AMS", True)], "hub_id string, weather_bad boolean")
    stream = spark.readStream.schema("value binary").parquet(inbox)
    stream_ingest.start(stream, lake, lambda s: weather, as_of=now, available_now=True, network=SMALL).awaitTermination()
    assert rows(files.read_bronze(spark, lake.bronze), "event_id", "weather_bad") == [("e1", True), ("e4", None)]


def test_weather_job_uses_limits_and_hubs_of_the_lake(spark, scratch):
    lake, inbox = Lake(f"{scratch}/lake"), Path(f"{scratch}/inbox")
    reference.write_network(spark, lake.network, SMALL)
    inbox.mkdir()
    body = [{"current": {"time": "t", "temperature_2m": 1.0, "wind_speed_10m": w, "precipitation": 0.0}} for w in (4.0, 2.0)]
    (inbox / "r.json").write_text(json.dumps(body))
    jobs.refresh_weather(spark, lake, str(inbox))
    assert rows(files.read_weather(spark, lake.weather), "hub_id", "weather_bad") == [("N1", True), ("N2", False)]


def test_regions_of_a_network(spark):
    got = spark.range(1).select(geo.postcode_region(F.lit("7000"), regions=SMALL.regions), geo.postcode_region(F.lit("1000"), regions=SMALL.regions)).first()
    assert tuple(got) == ("Far", "Unknown")
