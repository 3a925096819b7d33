"""Column layouts and fixed domain values.

Everything here is small and constant: it is inlined into plans as literals,
so it never grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. They define the domain and must stay exactly as they are.
# ---------------------------------------------------------------------------

# Lifecycle stages in their natural order.
EVENT_TYPES = [
    "CREATED",
    "LABEL_PRINTED",
    "COLLECTED",
    "AT_SORTING_HUB",
    "IN_TRANSIT",
    "OUT_FOR_DELIVERY",
    "DELIVERED",
    "DELIVERY_FAILED",
    "RESCHEDULED",
    "RETURNED",
]

# Stages that take place in the delivery area instead of at a hub.
DELIVERY_AREA_TYPES = [
    "OUT_FOR_DELIVERY",
    "DELIVERED",
    "DELIVERY_FAILED",
    "RESCHEDULED",
    "RETURNED",
]

# Stages after which a parcel does not move any more.
TERMINAL_TYPES = ["DELIVERED", "RETURNED"]

# Allowed steps of the lifecycle, as (from, to).
LIFECYCLE_EDGES = [
    ("CREATED", "LABEL_PRINTED"),
    ("LABEL_PRINTED", "COLLECTED"),
    ("COLLECTED", "AT_SORTING_HUB"),
    ("AT_SORTING_HUB", "IN_TRANSIT"),
    ("IN_TRANSIT", "OUT_FOR_DELIVERY"),
    ("OUT_FOR_DELIVERY", "DELIVERED"),
    ("OUT_FOR_DELIVERY", "DELIVERY_FAILED"),
    ("DELIVERY_FAILED", "RESCHEDULED"),
    ("DELIVERY_FAILED", "RETURNED"),
    ("RESCHEDULED", "OUT_FOR_DELIVERY"),
]

# Hubs: id, name, latitude, longitude.
HUBS = [
    ("AMS", "Amsterdam", 52.3676, 4.9041),
    ("RTM", "Rotterdam", 51.9244, 4.4777),
    ("UTR", "Utrecht", 52.0907, 5.1214),
    ("EIN", "Eindhoven", 51.4416, 5.4697),
    ("DHG", "Den Haag", 52.0705, 4.3007),
    ("GRO", "Groningen", 53.2194, 6.5665),
    ("ZWO", "Zwolle", 52.5168, 6.0830),
    ("MST", "Maastricht", 50.8514, 5.6910),
]

# First postcode digit to region.
POSTCODE_REGIONS = [
    ("1", "Noord-Holland"),
    ("2", "Zuid-Holland"),
    ("3", "Rotterdam-Utrecht"),
    ("4", "Zeeland-West-Brabant"),
    ("5", "Noord-Brabant"),
    ("6", "Limburg-Gelderland"),
    ("7", "Overijssel-Gelderland"),
    ("8", "Flevoland-Friesland"),
    ("9", "Groningen-Drenthe"),
]

# Bounding box of the network, borders included.
LAT_MIN, LAT_MAX = 50.75, 53.55
LON_MIN, LON_MAX = 3.36, 7.23

# Service level to promised hours.
SLA_HOURS = [("SAME_DAY", 6), ("NEXT_DAY", 24), ("STANDARD", 48)]

# Weather response field codes and the limits from which weather counts as bad.
WEATHER_CODES = {
    "temperature": "temperature_2m",
    "wind_speed": "wind_speed_10m",
    "precipitation": "precipitation",
}
WIND_LIMIT = 10.0
PRECIPITATION_LIMIT = 0.5

# SLA classes in worklist order, and the share of the window from which a parcel is at risk.
SLA_CLASSES = ["breached", "at_risk", "on_time", "delivered", "unknown"]
AT_RISK_SHARE = 0.8

# Simulated seconds per wall-clock second when nothing else is asked for.
TIME_ACCELERATION = 120.0

FUTURE_TOLERANCE = "5 minutes"
WATERMARK_DELAY = "30 minutes"
EARTH_RADIUS_KM = 6371.0
# ---------------------------------------------------------------------------

HUB_IDS = [hub[0] for hub in HUBS]
SERVICE_LEVELS = [level for level, _ in SLA_HOURS]

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("parcel_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("hub_id", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("version", T.IntegerType()),
    ]
)
EVENT_COLUMNS = EVENT_SCHEMA.names



def casts(fields: Iterable[T.StructField]) -> list[str]:
    """Select expressions that bring columns to the types of ``fields``."""
    return [f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in fields]


# On the wire the event time is a count of milliseconds since the epoch, in UTC.
WIRE_SCHEMA = T.StructType(
    [
        T.StructField(f.name, T.LongType() if f.name == "event_ts" else f.dataType)
        for f in EVENT_SCHEMA
    ]
)

PARCEL_SCHEMA = T.StructType(
    [
        T.StructField("parcel_id", T.StringType()),
        T.StructField("origin_hub", T.StringType()),
        T.StructField("destination_postcode", T.StringType()),
        T.StructField("destination_region", T.StringType()),
        T.StructField("carrier", T.StringType()),
        T.StructField("service_level", T.StringType()),
        T.StructField("sla_hours", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("promised_by", T.TimestampType()),
    ]
)
PARCEL_COLUMNS = PARCEL_SCHEMA.names

BRONZE_SCHEMA = T.StructType(
    [
        *EVENT_SCHEMA.fields,
        T.StructField("weather_bad", T.BooleanType()),
        T.StructField("event_date", T.DateType()),
    ]
)

SILVER_COLUMNS = [
    "event_id",
    "parcel_id",
    "event_type",
    "status",
    "hub_id",
    "lat",
    "lon",
    "event_ts",
    "version",
    "weather_bad",
    "event_date",
]
SILVER_SCHEMA = T.StructType([BRONZE_SCHEMA[name] for name in SILVER_COLUMNS])

# The order matters: inside one batch the largest tuple of these wins.
STATE_FIELDS = [
    "version",
    "event_type",
    "status",
    "event_ts",
    "hub_id",
    "lat",
    "lon",
    "weather_bad",
]
STATE_SCHEMA = T.StructType(
    [BRONZE_SCHEMA["parcel_id"], *[BRONZE_SCHEMA[name] for name in STATE_FIELDS]]
)
STATE_COLUMNS = STATE_SCHEMA.names

OBSERVATION_SCHEMA = T.StructType(
    [
        T.StructField("hub_id", T.StringType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("wind_speed", T.DoubleType()),
        T.StructField("precipitation", T.DoubleType()),
        T.StructField("bad", T.BooleanType()),
        T.StructField("source", T.StringType()),
        T.StructField("observed_at", T.StringType()),
    ]
)
SNAPSHOT_SCHEMA = T.StructType(
    [
        T.StructField("fetched_at", T.StringType()),
        T.StructField("observations", T.MapType(T.StringType(), OBSERVATION_SCHEMA)),
    ]
)

# The event contract that producers and this package share.
EVENT_AVRO_SCHEMA = {
    "type": "record",
    "name": "ParcelEvent",
    "fields": [
        {"name": "event_id", "type": "string"},
        {"name": "parcel_id", "type": "string"},
        {"name": "event_type", "type": {"type": "enum", "name": "EventType", "symbols": EVENT_TYPES}},
        {"name": "hub_id", "type": "string"},
        {"name": "lat", "type": "double"},
        {"name": "lon", "type": "double"},
        {"name": "event_ts", "type": {"type": "long", "logicalType": "timestamp-millis"}},
        {"name": "status", "type": "string"},
        {"name": "version", "type": "int"},
    ],
}
