"""Tables in parts, where each part is a generation of files and a manifest names the ones that count.

A write adds the parts it touches below ``data/batch_id=n/<key>=<part>``; the manifest of ``n``, one row per part, comes
last, as a single file. Readers follow the newest manifest, so they see a write as a whole or not at all, and parts that
a write does not touch keep their files. What is left of a write that was cut short is never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from parcelflow.sources import storage

BATCH = T.StructField("batch_id", T.LongType())
MANIFEST = T.StructType([T.StructField("part", T.StringType()), T.StructField("generation", T.LongType())])
#: Generation of a part that is known and empty.
NONE = -1


@dataclass(frozen=True)
class Generations:
    """The table below ``root`` with the columns of ``schema``, in parts by the column ``key``."""

    spark: SparkSession
    root: str
    schema: T.StructType
    key: str

    @property
    def data(self) -> str:
        return f"{self.root}/data"

    @property
    def manifests(self) -> str:
        return f"{self.root}/manifests"

    def folder(self, batch_id: int) -> str:
        return f"{self.data}/batch_id={batch_id}"

    def batches(self) -> list[int]:
        """Writes whose manifest is finished and still kept."""
        return storage.numbered(self.spark, self.manifests, "batch_id")

    def newest(self) -> int | None:
        return storage.newest(self.spark, self.manifests, "batch_id")

    def manifest(self, batch_id: int | None = None) -> dict[str, int]:
        """Generation of each part: one number per part comes to the driver. Empty before the first write."""
        batch_id = self.newest() if batch_id is None else batch_id
        if batch_id is None:
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.manifests}/batch_id={batch_id}")
        return {r.part: r.generation for r in rows.collect()}

    def read(self, manifest: Mapping[str, int] | None = None, parts: Iterable[str] | None = None) -> DataFrame:
        """All parts or some, as the newest or a given manifest has them. Only their folders are listed."""
        manifest = self.manifest() if manifest is None else manifest
        chosen = sorted(manifest if parts is None else parts)
        folders = [f"{self.folder(manifest[p])}/{self.key}={p}" for p in chosen if manifest.get(p, NONE) != NONE]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        # The folders' names give the key, and the batch, which is not part of the table.
        whole = T.StructType([*[f for f in self.schema if f.name != BATCH.name], BATCH])
        rows = self.spark.read.schema(whole).option("basePath", self.data).parquet(*folders)
        return rows.select(*self.schema.names)

    def write(self, rows: DataFrame, batch_id: int, *order: str, **options: str) -> set[str]:
        """Writes the parts of ``rows`` as a generation and names those it wrote. Nothing counts before ``publish``.

        The rebalance splits large parts over tasks and joins small ones in a task. Rows are sorted by ``order``.
        """
        writer = rows.hint("rebalance", self.key).sortWithinPartitions(self.key, *order).write.mode("overwrite")
        for name, value in options.items():
            writer = writer.option(name, value)
        writer.partitionBy(self.key).parquet(self.folder(batch_id))
        mark = f"{self.key}="
        return {n.removeprefix(mark) for n in storage.names(self.spark, self.folder(batch_id)) if n.startswith(mark)}

    def publish(self, manifest: Mapping[str, int], batch_id: int) -> None:
        rows = self.spark.createDataFrame(sorted(manifest.items()), MANIFEST).coalesce(1)  # one file: appears at once
        rows.write.mode("overwrite").parquet(f"{self.manifests}/batch_id={batch_id}")

    def vacuum(self, keep: int = 2) -> int:
        """Removes what only manifests before the newest ``keep`` name; returns the number of folders removed.

        A reader that follows a manifest removed here fails, so ``keep`` must cover the writes of the longest query.
        """
        if keep < 1:
            raise ValueError("the newest manifest must stay")
        known = self.batches()
        old, kept = known[:-keep], known[-keep:]
        if not kept:
            return 0
        used = {(g, part) for n in kept for part, g in self.manifest(n).items()}
        for n in old:
            storage.delete(self.spark, f"{self.manifests}/batch_id={n}")
        removed, mark = 0, f"{self.key}="
        for name in storage.names(self.spark, self.data):
            number = int(name.split("=")[1])
            if number > kept[-1]:
                continue  # being written
            inner = [n for n in storage.names(self.spark, f"{self.data}/{name}") if n.startswith(mark)]
            dead = [n for n in inner if (number, n.removeprefix(mark)) not in used]
            for n in [""] if len(dead) == len(inner) else dead:
                storage.delete(self.spark, f"{self.data}/{name}/{n}".rstrip("/"))
                removed += 1
        return removed
