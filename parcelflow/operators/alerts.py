"""Alerts on changed state and on parcels whose window ran out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow import schemas as S
from parcelflow.functions.text import alert_message, alert_subject
from parcelflow.operators.live import with_sla

ALERT_COLUMNS = ["parcel_id", "status", "breached", "subject", "message"]


def alerts(changed: DataFrame, parcels: DataFrame, as_of: Column, accel: float = S.TIME_ACCELERATION) -> DataFrame:
    """One alert per changed row that breached its SLA or was returned.

    Columns of ``changed`` beyond the alert's own are kept.
    """
    extra = [c for c in changed.columns if c not in ALERT_COLUMNS]
    return (
        with_sla(changed, parcels, as_of, accel)
        .withColumn("breached", F.col("sla") == "breached")
        .filter(F.col("breached") | F.coalesce(F.col("status") == "RETURNED", F.lit(False)))
        .withColumn("subject", alert_subject(F.col("parcel_id")))
        .withColumn("message", alert_message(F.col("parcel_id"), F.col("status"), F.col("breached")))
        .select(*ALERT_COLUMNS, *extra)
    )


def overdue(
    state: DataFrame,
    parcels: DataFrame,
    as_of: Column,
    sent: DataFrame | None = None,
    accel: float = S.TIME_ACCELERATION,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Breach alerts that no event triggers: the clock alone moved past the window.

    Run on a schedule; ``sent`` holds the alerts given out before. ``carry`` names further columns of the state to keep.
    """
    due = alerts(state.select("parcel_id", "status", *carry), parcels, as_of, accel).filter("breached")
    if sent is None:
        return due
    return due.join(sent.filter("breached").select("parcel_id"), "parcel_id", "left_anti")
