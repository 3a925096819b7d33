"""Reference data as small frames, for joins and reports that want tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from parcelflow import schemas as S
from parcelflow.network import DEFAULT, Network

# Fixed values. Towns of the delivery area: name, latitude, longitude, postcode, region.
TOWNS = [
    ("Amsterdam", 52.3676, 4.9041, "1011", "Noord-Holland"),
    ("Haarlem", 52.3874, 4.6462, "2011", "Noord-Holland"),
    ("Alkmaar", 52.6324, 4.7534, "1811", "Noord-Holland"),
    ("Hilversum", 52.2233, 5.1719, "1211", "Noord-Holland"),
    ("Purmerend", 52.5050, 4.9597, "1441", "Noord-Holland"),
    ("Hoorn", 52.6425, 5.0597, "1621", "Noord-Holland"),
    ("Rotterdam", 51.9244, 4.4777, "3011", "Zuid-Holland"),
    ("Den Haag", 52.0705, 4.3007, "2511", "Zuid-Holland"),
    ("Leiden", 52.1601, 4.4970, "2311", "Zuid-Holland"),
    ("Delft", 52.0116, 4.3571, "2611", "Zuid-Holland"),
    ("Dordrecht", 51.8133, 4.6901, "3311", "Zuid-Holland"),
    ("Zoetermeer", 52.0575, 4.4931, "2711", "Zuid-Holland"),
    ("Gouda", 52.0115, 4.7104, "2801", "Zuid-Holland"),
    ("Schiedam", 51.9197, 4.3889, "3111", "Zuid-Holland"),
    ("Utrecht", 52.0907, 5.1214, "3511", "Utrecht"),
    ("Amersfoort", 52.1561, 5.3878, "3811", "Utrecht"),
    ("Veenendaal", 52.0286, 5.5581, "3901", "Utrecht"),
    ("Eindhoven", 51.4416, 5.4697, "5611", "Noord-Brabant"),
    ("Tilburg", 51.5555, 5.0913, "5011", "Noord-Brabant"),
    ("Breda", 51.5719, 4.7683, "4811", "Noord-Brabant"),
    ("Den Bosch", 51.6978, 5.3037, "5211", "Noord-Brabant"),
    ("Helmond", 51.4793, 5.6570, "5701", "Noord-Brabant"),
    ("Oss", 51.7650, 5.5237, "5341", "Noord-Brabant"),
    ("Roosendaal", 51.5306, 4.4654, "4701", "Noord-Brabant"),
    ("Groningen", 53.2194, 6.5665, "9711", "Groningen"),
    ("Leeuwarden", 53.2012, 5.7999, "8911", "Friesland"),
    ("Assen", 52.9925, 6.5649, "9401", "Drenthe"),
    ("Emmen", 52.7850, 6.8970, "7811", "Drenthe"),
    ("Zwolle", 52.5168, 6.0830, "8011", "Overijssel"),
    ("Enschede", 52.2215, 6.8937, "7511", "Overijssel"),
    ("Deventer", 52.2552, 6.1639, "7411", "Overijssel"),
    ("Hengelo", 52.2659, 6.7931, "7551", "Overijssel"),
    ("Almere", 52.3508, 5.2647, "1315", "Flevoland"),
    ("Lelystad", 52.5185, 5.4714, "8211", "Flevoland"),
    ("Nijmegen", 51.8126, 5.8372, "6511", "Gelderland"),
    ("Arnhem", 51.9851, 5.8987, "6811", "Gelderland"),
    ("Apeldoorn", 52.2112, 5.9699, "7311", "Gelderland"),
    ("Ede", 52.0402, 5.6649, "6711", "Gelderland"),
    ("Maastricht", 50.8514, 5.6910, "6211", "Limburg"),
    ("Heerlen", 50.8882, 5.9795, "6411", "Limburg"),
    ("Venlo", 51.3704, 6.1724, "5911", "Limburg"),
    ("Sittard", 51.0017, 5.8690, "6131", "Limburg"),
]


def hubs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(S.HUBS, "hub_id string, name string, lat double, lon double")


def towns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        TOWNS, "name string, lat double, lon double, postcode string, region string"
    )


def postcode_regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(S.POSTCODE_REGIONS, "digit string, region string")


def service_levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(S.SLA_HOURS, "service_level string, sla_hours int")


def lifecycle_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(S.LIFECYCLE_EDGES, "from_type string, to_type string")


HUB_TYPE = "struct<hub_id:string,name:string,lat:double,lon:double>"
NETWORK_SCHEMA = (
    f"hubs array<{HUB_TYPE}>, lat_range array<double>, lon_range array<double>, "
    "regions array<struct<digit:string,region:string>>, wind_limit double, precipitation_limit double"
)


def write_network(spark: SparkSession, path: str, network: Network = DEFAULT) -> None:
    """Replaces the stored network: one row, one file."""
    row = (network.hubs, network.lat_range, network.lon_range, network.regions, network.wind_limit, network.precipitation_limit)
    spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in row)], NETWORK_SCHEMA).coalesce(1).write.mode(
        "overwrite"
    ).json(path)


def read_network(spark: SparkSession, path: str) -> Network:
    """The stored network; the built-in one where there is none. Fields that are left out have their built-in values.

    A hub keeps the place it has in the list, which decides ties. Raises ``ValueError`` for a network that no rule could
    be decided by: no hubs, a hub without id or place, an id twice, a range that is no pair in order.
    """
    try:
        row = spark.read.schema(T.StructType.fromDDL(NETWORK_SCHEMA)).json(path).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        row = None
    if row is None:
        return DEFAULT
    given = {name: value for name, value in row.asDict().items() if value is not None}
    network = Network(**{k: tuple(tuple(v) if isinstance(v, T.Row) else v for v in x) if isinstance(x, list) else x for k, x in given.items()})
    ids = network.hub_ids
    if not ids or len(set(ids)) < len(ids) or any(None in (hub[0], hub[2], hub[3]) for hub in network.hubs):
        raise ValueError(f"hubs of {path} need an id of their own and a place")
    if any(len(pair) != 2 or None in pair or pair[0] >= pair[1] for pair in (network.lat_range, network.lon_range)):
        raise ValueError(f"ranges of {path} must be two rising numbers")
    return network
