"""SLA arithmetic on the accelerated clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelflow import schemas as S


def elapsed_seconds(start: Column, end: Column, accel: float = S.TIME_ACCELERATION) -> Column:
    """Simulated seconds between two timestamps, fractions of a second kept."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6) * F.lit(float(accel))


def window_seconds(sla_hours: Column) -> Column:
    return sla_hours * F.lit(3600)


def is_terminal(status: Column) -> Column:
    return F.coalesce(status.isin(S.TERMINAL_TYPES), F.lit(False))


def sla_class(status: Column, created_at: Column, sla_hours: Column, as_of: Column, accel: float) -> Column:
    """One of on_time, at_risk, breached, delivered, unknown.

    A terminal parcel is ``delivered`` whatever its age; a parcel without its SLA data
    is ``unknown``. Both limits are strict.
    """
    elapsed = elapsed_seconds(created_at, as_of, accel)
    window = window_seconds(sla_hours)
    return (
        F.when(is_terminal(status), F.lit("delivered"))
        .when(created_at.isNull() | sla_hours.isNull(), F.lit("unknown"))
        .when(elapsed > window, F.lit("breached"))
        .when(elapsed > window * F.lit(S.AT_RISK_SHARE), F.lit("at_risk"))
        .otherwise(F.lit("on_time"))
    )


def hours_remaining(created_at: Column, sla_hours: Column, as_of: Column, accel: float) -> Column:
    """Simulated hours until the window closes, negative when overdue, one decimal."""
    elapsed = elapsed_seconds(created_at, as_of, accel)
    return F.round((window_seconds(sla_hours) - elapsed) / F.lit(3600), 1)


def promised_by(created_at: Column, sla_hours: Column) -> Column:
    return created_at + F.make_dt_interval(F.lit(0), sla_hours)


def worklist_rank(sla: Column) -> Column:
    """Position of an SLA class in the risk worklist; 9 for anything else."""
    ranked = F.when(F.lit(False), F.lit(9))
    for rank, name in enumerate(S.SLA_CLASSES):
        ranked = ranked.when(sla == name, F.lit(rank))
    return ranked.otherwise(F.lit(9))
