"""Current state of every parcel and its version-guarded merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow import schemas as S

_STORED = "_stored"


def latest(events: DataFrame) -> DataFrame:
    """The largest ``STATE_FIELDS`` tuple of each parcel: its highest version.

    Combined on the map side, so a parcel with very many events stays cheap.
    """
    best = events.groupBy("parcel_id").agg(F.max(F.struct(*S.STATE_FIELDS)).alias("best"))
    return best.select("parcel_id", "best.*")


def merge(state: DataFrame, events: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """State after ``events``, with ``changed`` telling the rows that were written.

    An event wins only with a strictly higher version than the stored one; among events
    the largest tuple wins. Ranking the stored row above events of its own version makes
    the latest-of-batch and the merge a single aggregation with one shuffle. ``carry`` names
    further columns of both inputs that the winning row keeps.
    """
    fields = [F.col(c) for c in (*S.STATE_FIELDS[1:], *carry)]

    def ranked(frame: DataFrame, stored: int) -> DataFrame:
        rank = F.struct(F.col("version"), F.lit(stored).alias(_STORED), *fields)
        return frame.select("parcel_id", rank.alias("row"))

    best = (
        ranked(state, 1)
        .unionByName(ranked(events, 0))
        .groupBy("parcel_id")
        .agg(F.max("row").alias("best"))
    )
    return best.select(
        "parcel_id",
        *[f"best.{c}" for c in (*S.STATE_FIELDS, *carry)],
        (F.col(f"best.{_STORED}") == 0).alias("changed"),
    )


def changes(state: DataFrame, events: DataFrame) -> DataFrame:
    """Only the rows ``merge`` would write, for a batch that is small beside the state.

    The state is first reduced to the parcels of the batch by a semi join. The optimizer
    broadcasts the keys of the batch while they are small and shuffles otherwise.
    """
    batch = latest(events)
    touched = (
        state.select("parcel_id", "version")
        .join(batch.select("parcel_id"), "parcel_id", "left_semi")
        .groupBy("parcel_id")
        .agg(F.max("version").alias("stored_version"))
    )
    return (
        batch.join(touched, "parcel_id", "left")
        .filter(F.col("stored_version").isNull() | (F.col("stored_version") < F.col("version")))
        .select(*S.STATE_COLUMNS)
    )
