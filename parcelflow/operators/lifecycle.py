"""Lifecycle checks: allowed steps, contiguous versions, terminal ends, rates.

One parcel may own a large share of all events. Everything here is either a combined
aggregation or, for the order of steps, a window over a bounded slice of a parcel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelflow import schemas as S

# Versions that share one window; a 32-bit version has at most as many slices again.
SLICE_VERSIONS = 1 << 16


def steps(events: DataFrame) -> DataFrame:
    """The distinct steps of each parcel: ``version``, ``event_type`` and the first time seen.

    Repeated scans of one step collapse on the map side, so a parcel keeps at most one
    row per version and type.
    """
    return events.groupBy("parcel_id", "version", "event_type").agg(F.min("event_ts").alias("first_ts"))


def step_pairs(events: DataFrame, slice_versions: int = SLICE_VERSIONS) -> DataFrame:
    """Each step with the type of the step before it (``from_type``, null for the first).

    Steps are ordered by version, then first time seen, then type. The window runs over
    slices of the version range instead of whole parcels; the last step of a slice is
    handed to the next slice of that parcel as an extra row, which is removed again.
    Parcels that fit one slice, the normal case, hand over nothing.
    """
    order = ["version", "first_ts", "event_type"]
    sliced = steps(events).withColumn("slice", F.floor(F.col("version") / F.lit(slice_versions)))

    last_steps = sliced.groupBy("parcel_id", "slice").agg(F.max(F.struct(*order)).alias("last"))
    by_slice = Window.partitionBy("parcel_id").orderBy("slice")
    handed_over = (
        last_steps.withColumn("next_slice", F.lead("slice").over(by_slice))
        .filter(F.col("next_slice").isNotNull())
        .select("parcel_id", F.col("next_slice").alias("slice"), "last.*", F.lit(True).alias("handed"))
    )

    in_slice = Window.partitionBy("parcel_id", "slice").orderBy(*order)
    return (
        sliced.withColumn("handed", F.lit(False))
        .unionByName(handed_over)
        .withColumn("from_type", F.lag("event_type").over(in_slice))
        .withColumn("has_previous", F.row_number().over(in_slice) > 1)
        .filter(~F.col("handed"))
        .select("parcel_id", "version", "from_type", F.col("event_type").alias("to_type"), "has_previous")
    )


def bad_transitions(
    events: DataFrame,
    edges: Sequence[tuple[str, str]] = S.LIFECYCLE_EDGES,
    slice_versions: int = SLICE_VERSIONS,
) -> DataFrame:
    """Consecutive steps that the lifecycle does not allow.

    The ten edges are literals in the filter, so the check adds no join.
    """
    pair = F.struct(F.col("from_type").alias("f"), F.col("to_type").alias("t"))
    allowed = pair.isin([F.struct(F.lit(a).alias("f"), F.lit(b).alias("t")) for a, b in edges])
    return (
        step_pairs(events, slice_versions)
        .filter(F.col("has_previous") & ~F.coalesce(allowed, F.lit(False)))
        .select("parcel_id", "version", "from_type", "to_type")
    )


def version_gaps(events: DataFrame) -> DataFrame:
    """Parcels whose versions are not exactly 1, 2, … up to the number of events."""
    return (
        events.groupBy("parcel_id")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.min("version").alias("min_version"),
            F.max("version").alias("max_version"),
            F.count_distinct("version").alias("versions"),
        )
        .filter(
            ~(
                F.col("min_version").eqNullSafe(1)
                & F.col("max_version").eqNullSafe(F.col("events"))
                & (F.col("versions") == F.col("events"))
            )
        )
        .select("parcel_id", "events", "min_version", "max_version")
    )


def last_steps(events: DataFrame) -> DataFrame:
    """The last step of each parcel and whether it ever failed."""
    return (
        events.groupBy("parcel_id")
        .agg(
            F.max(F.struct("version", "event_ts", "event_type")).alias("last"),
            F.bool_or(F.col("event_type") == "DELIVERY_FAILED").alias("failed"),
        )
        .select("parcel_id", F.col("last.event_type").alias("last_event_type"), "failed")
    )


def open_parcels(events: DataFrame) -> DataFrame:
    """Parcels whose last event is not terminal."""
    terminal = F.coalesce(F.col("last_event_type").isin(S.TERMINAL_TYPES), F.lit(False))
    return last_steps(events).filter(~terminal).select("parcel_id", "last_event_type")


def rates(
    events: DataFrame, failed_range: tuple[float, float] = (0.02, 0.09), returned_limit: float = 0.03
) -> DataFrame:
    """Share of parcels that ever failed and that ended as returned, and whether both are plausible."""
    counts = last_steps(events).agg(
        F.count(F.lit(1)).alias("parcels"),
        F.count_if("failed").alias("failed"),
        F.count_if(F.col("last_event_type") == "RETURNED").alias("returned"),
    )
    share = {c: F.when(F.col("parcels") > 0, F.col(c) / F.col("parcels")) for c in ("failed", "returned")}
    return counts.select(
        "parcels", share["failed"].alias("failed_share"), share["returned"].alias("returned_share")
    ).withColumn(
        "plausible", F.col("failed_share").between(*failed_range) & (F.col("returned_share") <= returned_limit)
    )
