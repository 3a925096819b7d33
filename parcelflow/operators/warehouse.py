"""Staging views, fact, dimension and gold marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow import schemas as S
from parcelflow.functions.sla import elapsed_seconds, window_seconds
from parcelflow.operators.joins import lookup_left

FACT_DIMENSION_COLUMNS = [
    "service_level",
    "sla_hours",
    "created_at",
    "promised_by",
    "destination_region",
    "carrier",
    "origin_hub",
]


def stg_parcel_events(silver: DataFrame) -> DataFrame:
    return silver.selectExpr(*S.casts(S.SILVER_SCHEMA))


def stg_parcels(raw: DataFrame) -> DataFrame:
    """The row of each parcel with the latest ``created_at``.

    Rows of equal time are told apart by the other columns. Like the event
    deduplication this is a map-side combined maximum.
    """
    order = ["created_at", *[c for c in S.PARCEL_COLUMNS if c not in ("parcel_id", "created_at")]]
    typed = raw.selectExpr(*S.casts(S.PARCEL_SCHEMA))
    latest = typed.groupBy("parcel_id").agg(F.max(F.struct(*order)).alias("latest"))
    return latest.selectExpr(*[c if c == "parcel_id" else f"latest.{c}" for c in S.PARCEL_COLUMNS])


def dim_parcels(parcels: DataFrame) -> DataFrame:
    return parcels.select(*S.PARCEL_COLUMNS)


def fct_parcel_events(events: DataFrame, parcels: DataFrame) -> DataFrame:
    """Every event with its parcel's columns, null for an event without a parcel."""
    dimension = parcels.selectExpr("parcel_id", *FACT_DIMENSION_COLUMNS)
    return lookup_left(events, dimension, "parcel_id").selectExpr(*S.SILVER_COLUMNS, *FACT_DIMENSION_COLUMNS)


def gold_delivery_funnel(events: DataFrame) -> DataFrame:
    return (
        events.groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.count_distinct("parcel_id").alias("parcels"))
        .orderBy(F.desc("parcels"), "event_type")
    )


def parcel_outcomes(events: DataFrame, parcels: DataFrame) -> DataFrame:
    """One row per parcel that has events: its outcome and the parcel columns the marts need.

    Events are reduced to one narrow row per parcel before they meet the dimension, so
    the join never sees a hot parcel and both sides share one partitioning.
    """
    outcome = events.groupBy("parcel_id").agg(
        F.max(F.when(F.col("event_type") == "DELIVERED", F.col("event_ts"))).alias("delivered_ts"),
        F.max(F.when(F.col("event_type") == "DELIVERY_FAILED", 1).otherwise(0)).alias("had_failure"),
        F.max(F.when(F.col("event_type") == "RETURNED", 1).otherwise(0)).alias("was_returned"),
    )
    dimension = parcels.select("parcel_id", "destination_region", "created_at", "sla_hours")
    return outcome.join(dimension, "parcel_id", "left")


def outcomes_of_fact(fact: DataFrame) -> DataFrame:
    """``parcel_outcomes`` from a stored fact table, where the join is done already."""
    return fact.groupBy("parcel_id").agg(
        F.max(F.when(F.col("event_type") == "DELIVERED", F.col("event_ts"))).alias("delivered_ts"),
        F.max(F.when(F.col("event_type") == "DELIVERY_FAILED", 1).otherwise(0)).alias("had_failure"),
        F.max(F.when(F.col("event_type") == "RETURNED", 1).otherwise(0)).alias("was_returned"),
        F.any_value("destination_region", True).alias("destination_region"),
        F.any_value("created_at", True).alias("created_at"),
        F.any_value("sla_hours", True).alias("sla_hours"),
    )


def _rate(part: Column, whole: Column) -> Column:
    """Share with four decimals, null when there is no whole."""
    return F.round(F.when(whole != 0, part.cast("double") / whole), 4)


def gold_on_time_by_region(outcomes: DataFrame, accel: float = S.TIME_ACCELERATION) -> DataFrame:
    in_time = elapsed_seconds(F.col("created_at"), F.col("delivered_ts"), accel) <= window_seconds(
        F.col("sla_hours")
    )
    return (
        outcomes.groupBy(F.coalesce("destination_region", F.lit("Unknown")).alias("region"))
        .agg(
            F.count(F.lit(1)).alias("parcels"),
            F.count("delivered_ts").alias("delivered"),
            F.count_if(in_time).alias("on_time"),
        )
        .withColumn("on_time_rate", _rate(F.col("on_time"), F.col("delivered")))
        .orderBy(F.desc("parcels"), "region")
    )


def gold_failure_analysis(outcomes: DataFrame) -> DataFrame:
    return (
        outcomes.groupBy(F.coalesce("destination_region", F.lit("Unknown")).alias("region"))
        .agg(
            F.count(F.lit(1)).alias("parcels"),
            F.sum("had_failure").alias("parcels_with_failure"),
            F.sum("was_returned").alias("returned"),
        )
        .withColumn("failure_rate", _rate(F.col("parcels_with_failure"), F.col("parcels")))
        .withColumn("return_rate", _rate(F.col("returned"), F.col("parcels")))
        .orderBy(F.desc("parcels"), "region")
    )


def gold_weather_impact(events: DataFrame) -> DataFrame:
    return (
        events.groupBy(F.coalesce("weather_bad", F.lit(False)).alias("bad_weather"))
        .agg(
            F.count_if(F.col("event_type") == "OUT_FOR_DELIVERY").alias("delivery_attempts"),
            F.count_if(F.col("event_type") == "DELIVERY_FAILED").alias("failures"),
        )
        .withColumn("failure_rate", _rate(F.col("failures"), F.col("delivery_attempts")))
        .orderBy("bad_weather")
    )
