"""Message-topic source and sink. They need the Kafka and Avro modules on the classpath."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow import schemas as S
from parcelflow.operators.ingest import to_frames, unframe


def read_topic(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    """A stream of framed values from the start of the topic; ``max_offsets`` bounds a batch."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select("value")


def decode_avro(framed: DataFrame, value_col: str = "value", schema: dict = S.EVENT_AVRO_SCHEMA) -> DataFrame:
    """Avro counterpart of ``ingest.decode``: the event columns and ``is_decoded``."""
    from pyspark.sql.avro.functions import from_avro

    body = from_avro(unframe(F.col(value_col)), json.dumps(schema), {"mode": "PERMISSIVE"})
    decoded = framed.withColumn("e", body)
    kept = [c for c in framed.columns if c != value_col]
    return decoded.select(
        *kept, *[f"e.{name}" for name in S.EVENT_COLUMNS], F.col("e.event_id").isNotNull().alias("is_decoded")
    )


def write_topic(events: DataFrame, servers: str, topic: str) -> None:
    """Publishes events keyed by parcel, so the events of one parcel stay in order."""
    to_frames(events).write.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "topic", topic
    ).save()
