"""Parcel inputs derived from the generated order tables.

Timestamps of those tables carry no zone; they are read as UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow import schemas as S
from parcelflow.functions.text import iso_timestamp
from parcelflow.operators.ingest import to_frames
from parcelflow.session import use_utc
from parcelflow.sources.files import deal_out

VALIDATION_AS_OF = "2001-06-01 00:00:00"
LIVE_AS_OF = "2001-07-01 00:00:00"
LIVE_ACCEL = 0.001
GOLD_ACCEL = 1.0
MILLIS_PER_HOUR = 3_600_000

# Hub, wind, precipitation; one hub has no weather.
HUB_WEATHER = """
    ('AMS', 12.0D, 0.0D),
    ('RTM', 2.0D, 1.0D),
    ('UTR', 2.0D, 0.0D),
    ('EIN', NULL, NULL),
    ('DHG', 10.0D, 0.0D),
    ('GRO', 9.9D, 0.4D),
    ('ZWO', NULL, 0.5D)
"""


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp")


# Columns the mapping reads. Stating them saves the job that reads a file footer for
# the schema. A timestamp without a zone is read as the UTC instant it stands for.
TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_returnflag string, l_linestatus string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, ts timestamp, user_id bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _array(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def parcel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan event per order line. Event ids repeat where a line number repeats."""
    lines = deal_out(table(spark, sf_dir, "lineitem"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    event_type = """CASE l_linenumber
        WHEN 1 THEN 'CREATED'
        WHEN 2 THEN 'LABEL_PRINTED'
        WHEN 3 THEN 'COLLECTED'
        WHEN 4 THEN if(l_linestatus = 'F', 'AT_SORTING_HUB', 'IN_TRANSIT')
        WHEN 5 THEN if(l_returnflag = 'R', 'RESCHEDULED', 'IN_TRANSIT')
        WHEN 6 THEN 'OUT_FOR_DELIVERY'
        ELSE CASE l_returnflag WHEN 'A' THEN 'DELIVERED' WHEN 'R' THEN 'DELIVERY_FAILED' ELSE 'RETURNED' END
    END"""
    delay_hours = "l_linenumber * (1 + int(l_quantity) % 8)"
    return lines.join(orders, F.expr("l_orderkey = o_orderkey")).selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber) AS event_id",
        "concat('P', l_orderkey) AS parcel_id",
        f"{event_type} AS event_type",
        f"get({_array([*S.HUB_IDS, 'XXX'])}, int(l_suppkey % 9)) AS hub_id",
        "50.5D + (l_partkey % 330) / 100.0D AS lat",
        "3.3D + (l_suppkey % 400) / 100.0D AS lon",
        f"timestamp_millis(unix_millis(o_orderdate) + {delay_hours} * {MILLIS_PER_HOUR}L) AS event_ts",
        f"{event_type} AS status",
        "l_linenumber AS version",
    )


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcel dimension rows; every seventh order has an older second row as well."""
    # The geography tables hold a fixed number of nations and regions; the optimizer
    # broadcasts them, and customers too while they are small.
    places = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
        .select("c_custkey", "r_name")
    )
    orders = table(spark, sf_dir, "orders").filter("o_orderkey % 20 != 0")
    carrier = f"get({_array(['PostNL', 'DHL', 'DPD', 'GLS'])}, int(o_custkey % 4))"
    return (
        orders.join(places, F.expr("o_custkey = c_custkey"))
        .selectExpr(
            "concat('P', o_orderkey) AS parcel_id",
            f"get({_array(S.HUB_IDS)}, int(o_custkey % 8)) AS origin_hub",
            "concat(1000 + o_custkey, ' AB') AS destination_postcode",
            "if(o_custkey % 10 = 9, NULL, r_name) AS destination_region",
            "CASE WHEN o_orderpriority = '1-URGENT' THEN 'SAME_DAY'"
            " WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'NEXT_DAY' ELSE 'STANDARD' END AS service_level",
            f"{carrier} AS listed_carrier",
            "o_orderdate",
            "explode(if(o_orderkey % 7 = 0, array(0, 1), array(0))) AS age",
        )
        .selectExpr("*", f"CASE service_level {_whens(S.SLA_HOURS)} END AS sla_hours")
        .selectExpr(
            "*",
            "o_orderdate - make_dt_interval(0, age) AS created_at",
            "if(age = 0, listed_carrier, 'OLD') AS carrier",
            "o_orderdate + make_dt_interval(0, sla_hours) AS promised_by",
        )
        .selectExpr(*S.PARCEL_COLUMNS)
    )


def _whens(pairs: list[tuple]) -> str:
    return " ".join(f"WHEN '{key}' THEN {value}" for key, value in pairs)


def hub_weather(spark: SparkSession) -> DataFrame:
    """Observations of the sample's hubs: at most one row per hub."""
    return spark.sql(f"SELECT * FROM VALUES {HUB_WEATHER} AS t(hub_id, wind_speed, precipitation)")


def weather_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One weather response per row of the event table: ``response_id, fetched_at, body``.

    A body lists 0 to 8 hubs, or is a single entry; values may be missing or no numbers.
    """
    n = F.col("event_id")

    def entry(i: Column) -> Column:
        def tenths(value: Column) -> Column:
            return F.concat((value / 10).cast("bigint").cast("string"), F.lit("."), (value % 10).cast("string"))

        def member(code: str, text: Column) -> Column:
            return F.concat(F.lit(f', "{code}": '), text)

        wind = (
            F.when((n + i) % 13 == 0, F.lit("null"))
            .when((n + i) % 17 == 0, F.lit('"calm"'))
            .otherwise(tenths((n * 11 + F.col("user_id") + i * 17) % 150))
        )
        rain = F.when((n + i) % 19 == 0, F.lit("")).otherwise(
            member("precipitation", tenths((n * 3 + i * 5) % 10))
        )
        return F.concat(
            F.lit('{"latitude": 52.1, "current": {"time": "'),
            F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm"),
            F.lit('"'),
            member("temperature_2m", tenths((n * 7 + i * 13) % 300)),
            member("wind_speed_10m", wind),
            rain,
            F.lit("}}"),
        )

    size = n % 9
    members = F.transform(F.sequence(F.lit(0), F.greatest(size, F.lit(1)).cast("int") - 1), entry)
    body = (
        F.when(size == 0, F.lit("[]"))
        .when(size == 1, F.element_at(members, 1))
        .otherwise(F.concat(F.lit("["), F.array_join(members, ", "), F.lit("]")))
    )
    return (
        deal_out(table(spark, sf_dir, "events"))
        .select("event_id", "user_id", F.col("ts").alias("fetched_at"))
        .select(n.alias("response_id"), "fetched_at", body.alias("body"))
    )


def framed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as framed binary messages; the body of some is cut off and does not parse."""
    frames = to_frames(parcel_events(spark, sf_dir))
    cut = F.substring(F.col("value"), F.lit(1), F.length("value") - 9)
    order_key = F.substring(F.decode("key", "UTF-8"), 2, 30).cast("bigint")
    return frames.select(F.when(order_key % 50 == 0, cut).otherwise(F.col("value")).alias("value"))


def landed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as text rows, some of which break the contract."""
    events = parcel_events(spark, sf_dir)
    order_key = F.substring("parcel_id", 2, 30).cast("bigint")
    return events.select(
        "event_id",
        F.when(order_key % 31 != 0, F.col("parcel_id")).alias("parcel_id"),
        F.when(order_key % 37 == 0, F.lit("TELEPORTED")).otherwise(F.col("event_type")).alias("event_type"),
        "hub_id",
        F.when(order_key % 41 == 0, F.lit("north")).otherwise(F.col("lat").cast("string")).alias("lat"),
        F.col("lon").cast("string").alias("lon"),
        F.when(order_key % 43 == 0, F.lit("yesterday")).otherwise(iso_timestamp(F.col("event_ts"))).alias("event_ts"),
        "status",
        F.when(order_key % 47 == 0, F.lit("first")).otherwise(F.col("version").cast("string")).alias("version"),
    )
