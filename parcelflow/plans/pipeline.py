"""The batch path from raw events to marts and live views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.operators import ingest, silver


def distinct_flagged(raw: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One row per event id with ``is_valid``.

    Copies are dropped before valid and invalid rows part, so the copy that survives
    decides for all of them. The flag only looks at its own row and is set on survivors.
    """
    return ingest.validate(silver.deduplicate(raw), as_of)


def bronze(raw: DataFrame, weather: DataFrame | None, as_of: Column | None = None) -> DataFrame:
    """Valid, enriched, dated events, one row per event id."""
    valid = distinct_flagged(raw, as_of).filter("is_valid").drop("is_valid")
    return ingest.with_event_date(ingest.enrich(valid, weather))


def dead_letters(raw: DataFrame, as_of: Column | None = None) -> DataFrame:
    return ingest.reject(silver.deduplicate(raw), as_of)


def silver_events(raw: DataFrame, weather: DataFrame | None, as_of: Column | None = None) -> DataFrame:
    return silver.to_silver(bronze(raw, weather, as_of), distinct_already=True)
