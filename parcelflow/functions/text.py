"""Labels, alert texts and ISO timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def iso_timestamp(ts: Column) -> Column:
    """ISO text with microseconds and zone offset, for exports."""
    return F.date_format(ts, ISO_FORMAT)


def status_title(status: Column) -> Column:
    """``OUT_FOR_DELIVERY`` becomes ``out for delivery``; null becomes an empty text."""
    return F.lower(F.replace(F.coalesce(status, F.lit("")), F.lit("_"), F.lit(" ")))


def time_label(hours: Column, unit: str = "h", missing: str = "") -> Column:
    """``overdue 3.5h`` or ``12h left``, without a trailing ``.0``."""
    number = F.regexp_replace(F.format_string("%.1f", F.abs(hours)), r"\.0$", "")
    return (
        F.when(hours.isNull(), F.lit(missing))
        .when(hours < 0, F.concat(F.lit("overdue "), number, F.lit(unit)))
        .otherwise(F.concat(number, F.lit(f"{unit} left")))
    )


def alert_subject(parcel_id: Column, prefix: str = "parcelflow") -> Column:
    """Subject line of an alert, at most 100 characters."""
    return F.substring(F.concat(F.lit(f"{prefix} alert: "), F.coalesce(parcel_id, F.lit("unknown"))), 1, 100)


def alert_message(parcel_id: Column, status: Column, breached: Column) -> Column:
    flag = F.when(breached, F.lit("True")).otherwise(F.lit("False"))
    return F.concat(
        F.lit("Parcel "),
        F.coalesce(parcel_id, F.lit("unknown")),
        F.lit(": status="),
        F.coalesce(status, F.lit("None")),
        F.lit(", breached="),
        flag,
        F.lit("."),
    )
