"""Event validity: known hub, inside the box, not in the future."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelflow import schemas as S
from parcelflow.network import DEFAULT, Network


def known_hub(hub: Column, hubs: Sequence[str] = S.HUB_IDS) -> Column:
    return hub.isin(list(hubs))


def in_box(
    lat: Column,
    lon: Column,
    lat_range: tuple[float, float] = (S.LAT_MIN, S.LAT_MAX),
    lon_range: tuple[float, float] = (S.LON_MIN, S.LON_MAX),
) -> Column:
    """Inside the bounding box, borders included."""
    return lat.between(*lat_range) & lon.between(*lon_range)


def not_in_future(event_ts: Column, as_of: Column | None = None, tolerance: str = S.FUTURE_TOLERANCE) -> Column:
    """At most ``tolerance`` later than ``as_of``, by default the current time."""
    now = F.current_timestamp() if as_of is None else as_of
    return event_ts <= now + F.expr(f"INTERVAL {tolerance}")


def reject_reasons(as_of: Column | None = None, network: Network = DEFAULT) -> Column:
    """Sorted array of the rules an event row breaks; empty for a valid row.

    A rule that cannot be decided because a value is null counts as broken, so no
    row falls between the valid and the rejected side.
    """
    rules = {
        "bbox": in_box(F.col("lat"), F.col("lon"), network.lat_range, network.lon_range),
        "future": not_in_future(F.col("event_ts"), as_of),
        "hub": known_hub(F.col("hub_id"), network.hub_ids),
    }
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return F.array_compact(F.array(*broken))


def is_valid(as_of: Column | None = None, network: Network = DEFAULT) -> Column:
    """All rules hold. Never null."""
    holds = (
        known_hub(F.col("hub_id"), network.hub_ids)
        & in_box(F.col("lat"), F.col("lon"), network.lat_range, network.lon_range)
        & not_in_future(F.col("event_ts"), as_of)
    )
    return F.coalesce(holds, F.lit(False))
