"""Live questions over the current state and the parcel dimension.

Both inputs have one row per parcel, so their join has no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow import schemas as S
from parcelflow.functions.sla import hours_remaining, sla_class, worklist_rank
from parcelflow.functions.text import status_title, time_label

VIEW_COLUMNS = [
    "parcel_id",
    "status",
    "sla",
    "service_level",
    "region",
    "destination_postcode",
    "carrier",
    "origin_hub",
    "hub_id",
    "version",
    "lat",
    "lon",
    "weather_bad",
    "last_scan",
    "created_at",
    "promised_by",
    "sla_hours",
    "sim_hours_remaining",
]


def with_sla(state: DataFrame, parcels: DataFrame, as_of: Column, accel: float = S.TIME_ACCELERATION) -> DataFrame:
    """State columns plus ``sla``. Reads two columns of the dimension."""
    windows = parcels.select("parcel_id", "created_at", "sla_hours")
    return (
        state.join(windows, "parcel_id", "left")
        .withColumn("sla", sla_class(F.col("status"), F.col("created_at"), F.col("sla_hours"), as_of, accel))
        .select(*state.columns, "sla")
    )


def sla_state(state: DataFrame, parcels: DataFrame, as_of: Column, accel: float = S.TIME_ACCELERATION) -> DataFrame:
    return with_sla(state.select("parcel_id", "status"), parcels, as_of, accel)


def parcel_view(state: DataFrame, parcels: DataFrame, as_of: Column, accel: float = S.TIME_ACCELERATION) -> DataFrame:
    """The detail view: 18 columns per parcel."""
    joined = state.join(parcels, "parcel_id", "left")
    created_at, sla_hours = F.col("created_at"), F.col("sla_hours")
    return joined.select(
        "parcel_id",
        "status",
        sla_class(F.col("status"), created_at, sla_hours, as_of, accel).alias("sla"),
        "service_level",
        F.col("destination_region").alias("region"),
        "destination_postcode",
        "carrier",
        "origin_hub",
        "hub_id",
        "version",
        "lat",
        "lon",
        "weather_bad",
        F.col("event_ts").alias("last_scan"),
        "created_at",
        "promised_by",
        "sla_hours",
        hours_remaining(created_at, sla_hours, as_of, accel).alias("sim_hours_remaining"),
    )


def parcel_detail(
    state: DataFrame, parcels: DataFrame, parcel_id: str, as_of: Column, accel: float = S.TIME_ACCELERATION
) -> DataFrame:
    """One parcel, or no row for an unknown id. The key filter reaches both scans."""
    return parcel_view(
        state.filter(F.col("parcel_id") == parcel_id),
        parcels.filter(F.col("parcel_id") == parcel_id),
        as_of,
        accel,
    )


def worklist(
    state: DataFrame,
    parcels: DataFrame,
    as_of: Column,
    accel: float = S.TIME_ACCELERATION,
    sla: str | None = None,
    limit: int = 200,
) -> DataFrame:
    """The ``limit`` most urgent parcels: by class, then by hours left, then by id."""
    view = _of_class(parcel_view(state, parcels, as_of, accel), sla)
    hours = F.col("sim_hours_remaining")
    return (
        view.withColumn("status_title", status_title(F.col("status")))
        .withColumn("time_label", time_label(hours))
        .orderBy(worklist_rank(F.col("sla")), F.coalesce(hours, F.lit(1e9)), "parcel_id")
        .limit(limit)
    )


def worklist_meta(
    state: DataFrame,
    parcels: DataFrame,
    as_of: Column,
    accel: float = S.TIME_ACCELERATION,
    sla: str | None = None,
    limit: int = 200,
) -> DataFrame:
    """How many parcels match, and how many of them the worklist shows."""
    matching = _of_class(sla_state(state, parcels, as_of, accel), sla)
    return matching.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "shown", F.least("total", F.lit(limit).cast("bigint"))
    )


def _of_class(view: DataFrame, sla: str | None) -> DataFrame:
    return view.filter(F.col("sla") == sla) if sla else view


def sla_counts(state: DataFrame, parcels: DataFrame, as_of: Column, accel: float = S.TIME_ACCELERATION) -> DataFrame:
    """``sla, n`` with a row for each of the five classes, also the empty ones."""
    classes = sla_state(state, parcels, as_of, accel)
    counts = classes.agg(*[F.count_if(F.col("sla") == name).alias(name) for name in S.SLA_CLASSES])
    return counts.select(
        F.explode(
            F.array(*[F.struct(F.lit(name).alias("sla"), F.col(name).alias("n")) for name in S.SLA_CLASSES])
        ).alias("c")
    ).select("c.sla", "c.n")


def count_by_status(state: DataFrame) -> DataFrame:
    """``key, n`` per status in lifecycle order; unlisted statuses come last."""
    counts = state.groupBy(F.coalesce("status", F.lit("UNKNOWN")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*[F.lit(t) for t in S.EVENT_TYPES]), F.col("key"))
    return counts.orderBy(F.when(place == 0, 99).otherwise(place), "key")


def count_by_hub(state: DataFrame) -> DataFrame:
    """``key, n`` per hub in id order."""
    return (
        state.groupBy(F.coalesce("hub_id", F.lit("?")).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("key")
    )


def totals(state: DataFrame) -> DataFrame:
    """All parcels and those not in a terminal status. Needs no dimension."""
    done = F.count_if(F.coalesce(F.col("status").isin(S.TERMINAL_TYPES), F.lit(False)))
    return state.agg(F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - done).alias("in_flight"))


def map_points(state: DataFrame, parcels: DataFrame, as_of: Column, accel: float = S.TIME_ACCELERATION) -> DataFrame:
    located = state.select("parcel_id", "lat", "lon", "status").dropna(subset=["lat", "lon"])
    return with_sla(located, parcels, as_of, accel)


def sample_rows(state: DataFrame, n: int = 5) -> DataFrame:
    """A few rows to look at."""
    return state.select("parcel_id", "version", "status", "hub_id", "weather_bad").limit(n)
