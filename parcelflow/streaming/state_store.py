"""Current state of all parcels in hash buckets, each a generation of files that a manifest names.

A batch reads and rewrites only the buckets of its parcels. A batch that has its manifest is done: a replay skips it,
and one that was cut short is written anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow import schemas as S
from parcelflow.operators import state as state_ops
from parcelflow.sources import storage
from parcelflow.sources.generations import NONE, Generations
from parcelflow.streaming.lake import batch_dir

CHANGED_IN = T.StructField("changed_in", T.LongType())
STORED = T.StructType([*S.STATE_SCHEMA, CHANGED_IN, T.StructField("bucket", T.IntegerType())])


@dataclass(frozen=True)
class StateStore:
    """The store below ``root``. ``buckets`` counts only until the first batch; from then on the manifest decides."""

    spark: SparkSession
    root: str
    buckets: int = 64

    @property
    def files(self) -> Generations:
        return Generations(self.spark, self.root, STORED, "bucket")

    @property
    def incoming(self) -> str:
        """Folder of the batch that is being merged, one row per parcel; gone when it is in the store."""
        return f"{self.root}/incoming"

    def newest(self) -> int | None:
        """The last batch that is in the store."""
        return self.files.newest()

    def read(self, manifest: Mapping[str, int] | None = None, buckets: Iterable[str] | None = None) -> DataFrame:
        """State rows with ``changed_in``, the batch that wrote them, of all buckets or of some."""
        return self.files.read(manifest, buckets).drop("bucket")

    def current(self) -> DataFrame:
        """One row per parcel."""
        return self.read().select(*S.STATE_COLUMNS)

    def lookup(self, *parcel_ids: str) -> DataFrame:
        """The rows of some parcels; an unknown one has none.

        Only the files of their buckets are listed. Within these the row groups without the ids are skipped by
        their Bloom filters and bounds.
        """
        manifest = self.files.manifest()
        if not manifest or not parcel_ids:
            return self.spark.createDataFrame([], S.STATE_SCHEMA)
        ids = self.spark.createDataFrame([(i,) for i in parcel_ids], "parcel_id string")
        found = self.read(manifest, buckets_of(ids, len(manifest)))
        return found.filter(F.col("parcel_id").isin(list(parcel_ids))).select(*S.STATE_COLUMNS)

    def changed_since(self, batch_id: int) -> DataFrame:
        """Rows that batches after ``batch_id`` wrote, in the form they have now."""
        manifest = self.files.manifest()
        touched = [b for b, generation in manifest.items() if generation > batch_id]
        return self.read(manifest, touched).filter(F.col("changed_in") > batch_id).select(*S.STATE_COLUMNS)

    def apply(
        self,
        events: DataFrame,
        batch_id: int,
        changes: str | None = None,
        before: Callable[[], DataFrame] | None = None,
    ) -> int | None:
        """Merges a batch, by version; the number of rows it changed, None if the batch was there already.

        ``changes`` is the folder that gets the changed rows, written before the manifest. ``before`` gives the state
        that a store without batches starts from. Batches must come in rising order.
        """
        known = self.newest()
        if known is not None and batch_id <= known:
            return None
        manifest = {str(b): NONE for b in range(self.buckets)} if known is None else self.files.manifest(known)
        mark = lambda n: F.lit(n).cast("long").alias(CHANGED_IN.name)
        batch = state_ops.latest(events).select(*S.STATE_COLUMNS, mark(batch_id))
        if known is not None:
            # Written once, as it is read twice: for its buckets and for the merge.
            batch.write.mode("overwrite").parquet(batch_dir(self.incoming, batch_id))
            batch = self.spark.read.schema(batch.schema).parquet(batch_dir(self.incoming, batch_id))
            stored = self.read(manifest, buckets_of(batch, len(manifest)))
        elif before is None:
            stored = self.read(manifest, [])
        else:
            stored = state_ops.latest(before()).select(*S.STATE_COLUMNS, mark(NONE))
        merged = state_ops.merge(stored, batch, carry=[CHANGED_IN.name]).drop("changed")
        merged = merged.withColumn("bucket", bucket_of(F.col("parcel_id"), len(manifest)))
        bloom = {"parquet.bloom.filter.enabled#parcel_id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        written = self.files.write(merged, batch_id, "parcel_id", **bloom)
        manifest |= dict.fromkeys(written, batch_id)
        changed, count = self.read(manifest, written).filter(F.col(CHANGED_IN.name) == batch_id), Observation()
        changed = changed.select(*S.STATE_COLUMNS).observe(count, F.count(F.lit(1)).alias("rows"))
        if changes:
            changed.write.mode("overwrite").parquet(batch_dir(changes, batch_id))
        else:
            changed.write.format("noop").mode("overwrite").save()
        self.files.publish(manifest, batch_id)
        storage.delete(self.spark, self.incoming)
        return count.get["rows"]

    def vacuum(self, keep: int = 2) -> int:
        """Removes generations that only manifests before the newest ``keep`` name."""
        return self.files.vacuum(keep)


def bucket_of(parcel_id: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(parcel_id), F.lit(count)).cast("int")


def buckets_of(parcels: DataFrame, count: int) -> set[str]:
    """Buckets of some parcels: at most ``count`` numbers come to the driver."""
    return {str(r.bucket) for r in parcels.select(bucket_of(F.col("parcel_id"), count).alias("bucket")).distinct().collect()}
