"""Weather responses and snapshots per hub."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow import schemas as S


def parse_responses(
    responses: DataFrame,
    body_col: str = "body",
    hubs: Sequence[str] = S.HUB_IDS,
    codes: Mapping[str, str] = S.WEATHER_CODES,
    keep_empty: bool = False,
) -> DataFrame:
    """JSON responses to one row per hub; other columns of the response are kept.

    A body is a list of entries in hub order, or a single entry for the first hub. A
    value that is missing or no number becomes null and leaves the rest intact. With
    ``keep_empty`` a response without entries keeps one row with a null hub.
    """
    body = F.trim(F.col(body_col))
    as_list = F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    fields = ", ".join(f"`{code}`: double" for code in codes.values())
    entries = F.from_json(
        as_list,
        f"array<struct<current: struct<time: string, {fields}>>>",
        {"allowNonNumericNumbers": "false"},
    )
    # Entries beyond the hubs and hubs beyond the entries have no partner.
    paired = F.slice(entries, 1, len(hubs))
    explode = F.posexplode_outer if keep_empty else F.posexplode
    kept = [c for c in responses.columns if c != body_col]
    hub_names = F.array(*[F.lit(h) for h in hubs])
    return responses.select(*kept, explode(paired).alias("ord", "entry")).select(
        *kept,
        F.get(hub_names, F.col("ord")).alias("hub_id"),
        *[F.col(f"entry.current.`{code}`").alias(name) for name, code in codes.items()],
        F.col("entry.current.time").alias("observed_at"),
    )


def is_bad(
    wind: Column, precipitation: Column, wind_limit: float | None = None, precipitation_limit: float | None = None
) -> Column:
    """Wind or precipitation at or over its limit. Null values and null limits never count."""
    checks = [
        F.coalesce(value >= F.lit(limit), F.lit(False))
        for value, limit in ((wind, wind_limit), (precipitation, precipitation_limit))
        if limit is not None
    ]
    verdict = F.lit(False)
    for check in checks:
        verdict = verdict | check
    return verdict


def flags(
    observations: DataFrame,
    wind_limit: float | None = S.WIND_LIMIT,
    precipitation_limit: float | None = S.PRECIPITATION_LIMIT,
) -> DataFrame:
    """Observations with ``weather_bad``."""
    bad = is_bad(F.col("wind_speed"), F.col("precipitation"), wind_limit, precipitation_limit)
    return observations.withColumn("weather_bad", bad)


def weather_by_hub(flagged: DataFrame, time_col: str = "fetched_at") -> DataFrame:
    """``hub_id, weather_bad`` of the most recent observation of each hub; bad wins a tie.

    Two maxima of timestamps are hash-aggregated and combined before the shuffle, so a hub
    with most of the rows costs no more than the others.
    """
    seen, bad = F.col(time_col), F.col("weather_bad")
    latest = flagged.groupBy("hub_id").agg(
        F.max(F.when(bad, seen)).alias("last_bad"), F.max(F.when(~bad, seen)).alias("last_good")
    )
    verdict = F.coalesce(F.col("last_bad") >= F.col("last_good"), F.col("last_bad").isNotNull())
    return latest.select("hub_id", verdict.alias("weather_bad"))


def snapshot_flags(snapshot: DataFrame) -> DataFrame:
    """``hub_id, weather_bad`` out of a snapshot document (hub to observation)."""
    return snapshot.select(F.explode("observations").alias("hub_id", "seen")).select(
        "hub_id", F.coalesce("seen.bad", F.lit(False)).alias("weather_bad")
    )


def to_snapshot(flagged: DataFrame, fetched_at: Column) -> DataFrame:
    """Flag rows as they are stored, with the fetch time as a column."""
    return flagged.withColumn("fetched_at", fetched_at)


def uncovered(observations: DataFrame, *snapshot_key: str, hubs: Sequence[str] = S.HUB_IDS) -> DataFrame:
    """Hubs of the network without an observation, per snapshot.

    The seen hubs of a snapshot are one set of at most as many names as the network has hubs, of any number. Without
    a key, no observations at all leave every hub uncovered.
    """
    names = F.array(*[F.lit(h) for h in hubs])
    known = F.when(F.col("hub_id").isin(list(hubs)), F.col("hub_id"))
    seen = observations.groupBy(*snapshot_key).agg(F.collect_set(known).alias("seen"))
    return seen.select(*snapshot_key, F.explode(F.array_except(names, "seen")).alias("hub_id"))
