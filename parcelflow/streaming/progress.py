"""What each micro-batch of a stream did, stored beside the lake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from parcelflow.sources.files import read_or_empty
from parcelflow.streaming.lake import Lake, batch_dir

PROGRESS = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("input_rows", T.LongType()),
        T.StructField("late_rows", T.LongType()),
        T.StructField("state_rows", T.LongType()),
        T.StructField("watermark", T.StringType()),
        T.StructField("batch_ms", T.LongType()),
    ]
)


class ProgressLog(StreamingQueryListener):
    """Stores one row per micro-batch of the queries named; a replayed batch replaces its row.

    ``late_rows`` are the rows that stateful steps dropped because they were older than the watermark.
    """

    def __init__(self, spark: SparkSession, lake: Lake, queries: tuple[str, ...] = ("ingest",)):
        self.spark, self.lake, self.queries = spark, lake, queries

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        told = event.progress
        if told.name not in self.queries:
            return
        late = sum(step.numRowsDroppedByWatermark for step in told.stateOperators)
        kept = sum(step.numRowsTotal for step in told.stateOperators)
        row = (told.name, told.batchId, told.numInputRows, late, kept, told.eventTime.get("watermark"), told.batchDuration)
        one = self.spark.createDataFrame([row], PROGRESS).coalesce(1)
        one.write.mode("overwrite").parquet(batch_dir(f"{self.lake.progress}/{told.name}", told.batchId))


def read_progress(spark: SparkSession, lake: Lake, query: str = "ingest") -> DataFrame:
    return read_or_empty(spark, f"{lake.progress}/{query}", PROGRESS)
