"""Distances, nearest hub and postcode regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelflow import schemas as S


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_dlon), 2
    )
    return F.lit(2 * S.EARTH_RADIUS_KM) * F.asin(F.sqrt(chord))


def hub_chord(lat: Column, lon: Column, hub_lat: Column, hub_lon: Column) -> Column:
    """Haversine chord between a place and a hub; it grows with the distance."""
    return F.pow(F.sin(F.radians(hub_lat - lat) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(hub_lat)) * F.pow(
        F.sin(F.radians(hub_lon - lon) / 2), 2
    )


def nearest_hub(lat: Column, lon: Column, hubs: Sequence[tuple] = S.HUBS) -> Column:
    """Id of the closest hub; the earlier hub wins a tie. Null without coordinates.

    The hubs are a short literal list, so this is arithmetic on the row: no join and
    no shuffle; ``operators.nearest`` is for long lists. Distances are compared by the
    haversine chord, which leaves out the root and arc sine.
    """
    candidates = []
    for order, (hub_id, _, hub_lat, hub_lon) in enumerate(hubs):
        chord = hub_chord(lat, lon, F.lit(hub_lat), F.lit(hub_lon))
        candidates.append(
            F.struct(chord.alias("chord"), F.lit(order).alias("ord"), F.lit(hub_id).alias("hub_id"))
        )
    best = F.least(*candidates) if len(candidates) > 1 else candidates[0]
    return F.when(lat.isNotNull() & lon.isNotNull(), best["hub_id"])


def hub_coordinate(hub: Column, which: str) -> Column:
    """``lat`` or ``lon`` of a hub id, null for an unknown one."""
    position = {"lat": 2, "lon": 3}[which]
    pairs = [F.lit(value) for row in S.HUBS for value in (row[0], row[position])]
    return F.create_map(*pairs)[hub]


def postcode_region(
    postcode: Column, default: str = "Unknown", regions: Sequence[tuple[str, str]] = S.POSTCODE_REGIONS
) -> Column:
    """Region of a postcode by its first character."""
    pairs = [F.lit(value) for row in regions for value in row]
    return F.coalesce(F.create_map(*pairs)[F.substring(postcode, 1, 1)], F.lit(default))


def sla_hours(service_level: Column) -> Column:
    """Promised hours of a service level, null for an unknown one."""
    pairs = [F.lit(value) for row in S.SLA_HOURS for value in row]
    return F.create_map(*pairs)[service_level]
