"""Typed, deduplicated events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow import schemas as S

# Among copies of one event the smallest tuple of these survives.
SURVIVOR_ORDER = ["event_ts", "hub_id", "lat", "lon", "event_type", "status", "parcel_id", "version"]


def deduplicate(events: DataFrame, key: str = "event_id") -> DataFrame:
    """One row per key, always the same one.

    The minimum of a struct combines on the map side, so a key with any number of
    copies sends one row per map task through the shuffle.
    """
    rest = [c for c in events.columns if c != key and c not in SURVIVOR_ORDER]
    ordered = [c for c in SURVIVOR_ORDER if c in events.columns] + rest
    kept = events.groupBy(key).agg(F.min(F.struct(*ordered)).alias("kept"))
    return kept.selectExpr(*[key if c == key else f"kept.{c}" for c in events.columns])


def to_silver(bronze: DataFrame, distinct_already: bool = False) -> DataFrame:
    """The eleven Silver columns, one row per event id.

    ``distinct_already`` skips the deduplication when the caller has just done it.
    """
    typed = bronze.selectExpr(*S.casts(f for f in S.SILVER_SCHEMA if f.name != "event_date"))
    if not distinct_already:
        typed = deduplicate(typed)
    return typed.selectExpr(*[c if c != "event_date" else "to_date(event_ts) AS event_date" for c in S.SILVER_COLUMNS])
