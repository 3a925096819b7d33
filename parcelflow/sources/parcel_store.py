"""The parcel dimension as a bucketed, sorted table, so that joins by parcel do not shuffle it."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from parcelflow import schemas as S
from parcelflow.operators import warehouse
from parcelflow.sources import files
from parcelflow.sources.generations import Generations

KEY = "parcel_id"


@dataclass(frozen=True)
class ParcelStore:
    """One row per parcel below ``root``, made from the landed parcel lines at ``landed``.

    Each ``publish`` writes a whole generation; readers follow the newest finished one, and the lines themselves while
    there is none. ``buckets`` is the number of a new generation; a bucket should hold some hundred megabytes.
    """

    spark: SparkSession
    root: str
    landed: str
    buckets: int = 64

    @property
    def files(self) -> Generations:
        return Generations(self.spark, self.root, S.PARCEL_SCHEMA, "buckets")

    def publish(self) -> int:
        """Reads the landed lines, keeps the newest row of each parcel and makes it count. Returns the generation.

        Rows are dealt out as the buckets want them, so a bucket is one file.
        """
        table = self.files
        newest = table.newest()
        run = 0 if newest is None else newest + 1
        rows = warehouse.stg_parcels(files.read_parcels(self.spark, self.landed))
        rows = rows.filter(rows[KEY].isNotNull()).repartition(self.buckets, KEY)
        path = self._path(run, self.buckets)
        writer = rows.write.mode("overwrite").option("path", path)
        writer.bucketBy(self.buckets, KEY).sortBy(KEY).saveAsTable(_name(path))
        table.publish({str(self.buckets): run}, run)
        return run

    def read(self) -> DataFrame:
        """The newest generation. A row without an id is in none of them, since nothing can join it."""
        manifest = self.files.manifest()
        if not manifest:
            return warehouse.stg_parcels(files.read_parcels(self.spark, self.landed))
        ((buckets, run),) = manifest.items()
        path = self._path(run, int(buckets))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in S.PARCEL_SCHEMA)
        # The table is known to the session that wrote it; any other learns of it here.
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {_name(path)} ({columns}) USING parquet "
            f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        return self.spark.table(_name(path)).select(*S.PARCEL_COLUMNS)

    def vacuum(self, keep: int = 2) -> int:
        """Removes generations before the newest ``keep``."""
        return self.files.vacuum(keep)

    def _path(self, run: int, buckets: int) -> str:
        return f"{self.files.folder(run)}/buckets={buckets}"


def _name(path: str) -> str:
    """Table name of a generation: its path tells it from those of other lakes in the same catalog."""
    return f"parcels_{hashlib.md5(path.encode()).hexdigest()}"
