"""Decode, validate, reject and enrich events. Works on batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow import schemas as S
from parcelflow.functions.validation import is_valid, reject_reasons
from parcelflow.network import DEFAULT, Network

# A framed value starts with one magic byte and a four-byte schema id.
FRAME_HEADER_BYTES = 5
CORRUPT = "_corrupt"


def unframe(value: Column) -> Column:
    """Body of a framed binary value; empty when the value is shorter than its header."""
    start = FRAME_HEADER_BYTES + 1
    return F.substring(value, F.lit(start), F.length(value) - F.lit(FRAME_HEADER_BYTES))


def decode(framed: DataFrame, value_col: str = "value") -> DataFrame:
    """Framed JSON values to the nine event columns and ``is_decoded``; other columns are kept.

    A value that does not parse, lacks a field or has an unknown event type gives nulls
    and ``is_decoded = false``, so one bad record goes to the dead letters and never
    stops the job.
    """
    wire = T.StructType([*S.WIRE_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(
        unframe(F.col(value_col)).cast("string"),
        wire,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )
    kept = [c for c in framed.columns if c != value_col]
    whole = framed.select(*kept, parsed.alias("e")).select(*kept, "e", _whole("e").alias("is_decoded"))
    columns = {name: F.col(f"e.{name}") for name in S.EVENT_COLUMNS}
    columns["event_ts"] = F.timestamp_millis(columns["event_ts"])
    return whole.select(
        *kept,
        *[F.when(F.col("is_decoded"), column).alias(name) for name, column in columns.items()],
        "is_decoded",
    )


def _whole(struct: str) -> Column:
    """The body parsed without a fault and holds every field of the contract."""
    whole = F.col(f"{struct}.{CORRUPT}").isNull()
    for name in S.EVENT_COLUMNS:
        whole = whole & F.col(f"{struct}.{name}").isNotNull()
    return F.coalesce(whole & F.col(f"{struct}.event_type").isin(S.EVENT_TYPES), F.lit(False))


def to_frames(events: DataFrame, schema_id: int = 1) -> DataFrame:
    """Keyed, framed rows ready for a message sink: ``key`` and ``value`` as binary."""
    wire = [
        F.unix_millis(name).alias(name) if name == "event_ts" else F.col(name) for name in S.EVENT_COLUMNS
    ]
    header = F.unhex(F.lit(f"00{schema_id:08x}"))
    return events.select(
        F.encode("parcel_id", "UTF-8").alias("key"),
        F.concat(header, F.encode(F.to_json(F.struct(*wire)), "UTF-8")).alias("value"),
    )


def validate(events: DataFrame, as_of: Column | None = None, network: Network = DEFAULT) -> DataFrame:
    """Adds the never-null flag ``is_valid``."""
    return events.withColumn("is_valid", is_valid(as_of, network))


def reject(events: DataFrame, as_of: Column | None = None, network: Network = DEFAULT) -> DataFrame:
    """Rows that break a rule, with ``reject_reason`` naming every broken rule.

    Rows that already carry their reason keep it: a row is judged once.
    """
    if "reject_reason" in events.columns:
        return events.filter(F.col("reject_reason") != "").drop("is_valid", "is_decoded")
    return judge(events, as_of, network).filter(F.col("reject_reason") != "").drop("is_valid", "is_decoded")


def judge(events: DataFrame, as_of: Column | None = None, network: Network = DEFAULT) -> DataFrame:
    """Adds ``reject_reason``, empty for a valid row, and ``is_valid``, both from one look at the clock."""
    reasons = reject_reasons(as_of, network)
    if "is_decoded" in events.columns:
        reasons = F.when(F.col("is_decoded"), reasons).otherwise(F.array(F.lit("decode")))
    judged = events.withColumn("reject_reason", F.array_join(reasons, ","))
    return judged.withColumn("is_valid", F.col("reject_reason") == "")


def enrich(events: DataFrame, weather: DataFrame | None, network: Network = DEFAULT) -> DataFrame:
    """Adds ``weather_bad`` of the event's hub, null when the hub has no weather.

    Only hubs of the network count and each gives one flag, so the broadcast holds at
    most as many rows as there are hubs, whatever the size of ``weather``.
    """
    if weather is None:
        return events.withColumn("weather_bad", F.lit(None).cast("boolean"))
    flags = (
        weather.filter(F.col("hub_id").isin(network.hub_ids))
        .groupBy("hub_id")
        .agg(F.bool_or("weather_bad").alias("weather_bad"))
    )
    return events.join(F.broadcast(flags), "hub_id", "left").selectExpr(*events.columns, "weather_bad")


def with_event_date(events: DataFrame) -> DataFrame:
    return events.withColumn("event_date", F.to_date("event_ts"))
