"""Bronze events: the batch folders that the ingest writes, and the date files that they are compacted into.

A stream leaves a folder of small files per micro-batch. Compaction brings finished batches into slices, a slice being
some of a date's events. Slices of a date are merged as a binary counter counts: a new one has level 0, two of a level
become one of the next. So a date has at most as many slices as the number of compactions has binary digits, and an
event is rewritten as often at most. The manifest of the slices and the ledger of the batches they cover count at once;
readers take covered batches from the slices and all others from their folders, so each event is seen once.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow import schemas as S
from parcelflow.sources import storage
from parcelflow.sources.generations import BATCH, NONE, Generations

SOURCE_BATCH = T.StructField("bronze_batch", T.LongType())
SLICE = T.StructField("slice", T.StringType())
#: Slice date of events without a date.
NO_DATE = "none"


def table(spark: SparkSession, path: str) -> Generations:
    """The slices of the Bronze table at ``path``."""
    return Generations(spark, f"{path}_compacted/slices", T.StructType([*S.BRONZE_SCHEMA, SOURCE_BATCH, SLICE]), SLICE.name)


def _ledger(path: str) -> str:
    return f"{path}_compacted/covered"


def _covered(spark: SparkSession, path: str, run: int | None) -> set[int]:
    """Batches that the slices of ``run`` hold: a number per batch comes to the driver, as in a listing."""
    if run is None:
        return set()
    ledger = spark.read.schema(T.StructType([SOURCE_BATCH, BATCH])).parquet(_ledger(path))
    return {r[0] for r in ledger.filter(F.col(BATCH.name) <= run).select(SOURCE_BATCH.name).collect()}


@dataclass(frozen=True)
class Snapshot:
    """What a reader sees: slices with their generations, the batches they cover, and finished batches besides."""

    manifest: dict[str, int]
    covered: frozenset[int]
    live: tuple[int, ...]

    @property
    def batches(self) -> list[int]:
        return sorted(self.covered.union(self.live))


def snapshot(spark: SparkSession, path: str) -> Snapshot:
    """The manifest is read before the folders are listed, so a batch compacted meanwhile is still found in its folder."""
    slices = table(spark, path)
    run = slices.newest()
    manifest, covered = slices.manifest(run) if run is not None else {}, _covered(spark, path, run)
    numbers = [int(n.split("=")[1]) for n in storage.names(spark, path) if n.startswith("batch_id=")]
    fresh = sorted(set(numbers) - covered)
    live = tuple(n for n in fresh if storage.finished(spark, f"{path}/batch_id={n}"))
    return Snapshot(manifest, frozenset(covered), live)


def read(
    spark: SparkSession,
    path: str,
    batches: Iterable[int] | None = None,
    from_date: str | None = None,
    to_date: str | None = None,
    seen: Snapshot | None = None,
) -> DataFrame:
    """Events of all batches or some, with their ``batch_id``. The dates select slices and folders, not rows."""
    seen = seen or snapshot(spark, path)
    wanted = set(seen.batches if batches is None else batches)
    names = T.StructType([*S.BRONZE_SCHEMA, BATCH]).names
    parts = []
    if folders := [f"{path}/batch_id={b}" for b in seen.live if b in wanted]:
        rows = spark.read.schema(T.StructType([*S.BRONZE_SCHEMA, BATCH])).option("basePath", path).parquet(*folders)
        parts.append(rows.select(*names))
    if old := wanted & seen.covered:
        days = {s: s.rpartition("_")[0] for s in seen.manifest}
        slices = [
            s for s, day in days.items()
            if not (from_date or to_date)
            or (day != NO_DATE and (from_date or day) <= day <= (to_date or day))
        ]
        rows = table(spark, path).read(seen.manifest, slices).withColumnRenamed(SOURCE_BATCH.name, BATCH.name)
        if old != seen.covered:
            # Bounds reach the files, which are sorted by batch; the list of numbers is as long as the caller's.
            rows = rows.filter(F.col(BATCH.name).between(min(old), max(old)) & F.col(BATCH.name).isin(sorted(old)))
        parts.append(rows.select(*names))
    if not parts:
        return spark.createDataFrame([], T.StructType([*S.BRONZE_SCHEMA, BATCH]))
    events = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if from_date:
        events = events.filter(F.col("event_date") >= F.lit(from_date).cast("date"))
    if to_date:
        events = events.filter(F.col("event_date") <= F.lit(to_date).cast("date"))
    return events


def compact(spark: SparkSession, path: str) -> int:
    """Brings all finished batches but the newest into slices; returns their number.

    The newest may still be replaced by a replay. Only slices that meet another of their level are read again. A run cut
    short covers nothing. One compaction runs at a time. Folders stay until ``vacuum``.
    """
    slices, seen = table(spark, path), snapshot(spark, path)
    newest = max(seen.batches, default=None)
    fresh = [b for b in seen.live if b != newest]
    if not fresh:
        return 0
    run = slices.newest()
    run = 0 if run is None else run + 1
    day = F.coalesce(F.col("event_date").cast("string"), F.lit(NO_DATE)).alias("day")
    events = read(spark, path, fresh, seen=seen).withColumnRenamed(BATCH.name, SOURCE_BATCH.name)
    target, merged = {}, []
    for r in events.select(day).distinct().collect():  # a row per date
        level = 0
        while f"{r.day}_{level}" in seen.manifest:
            merged.append(f"{r.day}_{level}")
            level += 1
        target[r.day] = f"{r.day}_{level}"
    rows = events.unionByName(slices.read(seen.manifest, merged).drop(SLICE.name))
    goes_to = spark.createDataFrame(sorted(target.items()), T.StructType([T.StructField("day", T.StringType()), SLICE]))
    rows = rows.withColumn("day", day).join(goes_to, "day", "left").select(*slices.schema.names)
    written = slices.write(rows, run, SOURCE_BATCH.name)
    ledger = spark.createDataFrame([(b,) for b in fresh], T.StructType([SOURCE_BATCH]))
    ledger.coalesce(1).write.mode("overwrite").parquet(f"{_ledger(path)}/batch_id={run}")
    kept = {s: g for s, g in seen.manifest.items() if s not in merged}
    slices.publish(kept | dict.fromkeys(written, run), run)
    return len(fresh)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes what no reader of the newest ``keep`` manifests needs: old slices, and folders of batches they all cover."""
    slices = table(spark, path)
    removed = slices.vacuum(keep)
    oldest = min(slices.batches(), default=NONE)
    covered = _covered(spark, path, oldest) if oldest != NONE else set()
    for name in storage.names(spark, path):
        if name.startswith("batch_id=") and int(name.split("=")[1]) in covered:
            storage.delete(spark, f"{path}/{name}")
            removed += 1
    return removed
