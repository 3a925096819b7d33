"""The stream of state changes as a data source whose offsets are batch numbers.

A read starts at the first batch, at a given one, or at the latest, and never lists folders of batches before it: the
next batch is looked for by its name. Batches are read by the executors, a file a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from parcelflow import schemas as S
from parcelflow.streaming.lake import Lake, batch_dir

NAME = "parcel_changes"
SCHEMA = T.StructType([*S.STATE_SCHEMA, T.StructField("changed_in", T.LongType())])


@dataclass
class ChangedFile(InputPartition):
    path: str
    batch_id: int


class ChangeFeed(DataSource):
    """Options: ``path`` of the change log, and ``start``: ``earliest``, ``latest`` or the number of a batch."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return SCHEMA

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return ChangeReader(self.options)


class ChangeReader(DataSourceStreamReader):
    """Offsets are the number of the next batch to read. A restart goes on from the checkpoint's offset."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.start = options.get("start", "earliest")
        if self.start not in ("earliest", "latest") and not self.start.lstrip("-").isdigit():
            raise ValueError(f"start must be earliest, latest or a batch, not {self.start!r}")
        self.next: int | None = None

    def storage(self):
        """File system and folder of the log, by whatever Arrow can open."""
        from pyarrow import fs

        if "://" in self.path:
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path.removeprefix("file:")

    def files_of(self, batch_id: int) -> list[str] | None:
        """Data files of a batch in order; None while it is not finished."""
        from pyarrow import fs

        files, root = self.storage()
        found = files.get_file_info(fs.FileSelector(batch_dir(root, batch_id), allow_not_found=True))
        names = sorted(f.path for f in found if f.type == fs.FileType.File)
        if not any(n.endswith("/_SUCCESS") for n in names):
            return None
        return [n for n in names if n.rsplit("/", 1)[1].startswith("part-")]

    def numbers(self) -> list[int]:
        """Numbers of all batches; looked at once, when a stream starts without a checkpoint."""
        from pyarrow import fs

        files, root = self.storage()
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(int(f.base_name.split("=")[1]) for f in found if f.base_name.startswith("batch_id="))

    def initialOffset(self) -> dict:  # noqa: N802
        if self.start not in ("earliest", "latest"):
            return {"next": int(self.start)}
        known = [n for n in self.numbers() if n >= 0]
        if self.start == "earliest":
            return {"next": known[0] if known else 0}
        while known and self.files_of(known[-1]) is None:
            known.pop()
        return {"next": known[-1] + 1 if known else 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """Follows finished batches one by one from where it stopped before."""
        if self.next is None:
            self.next = self.initialOffset()["next"]
        while self.files_of(self.next) is not None:
            self.next += 1
        return {"next": self.next}

    def partitions(self, start: dict, end: dict) -> list[ChangedFile]:
        self.next = max(self.next or 0, end["next"])
        return [ChangedFile(f, n) for n in range(start["next"], end["next"]) for f in self.files_of(n) or []]

    def read(self, partition: ChangedFile) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        files, _ = self.storage()
        target = to_arrow_schema(S.STATE_SCHEMA)
        with files.open_input_file(partition.path) as source:
            for batch in pq.ParquetFile(source).iter_batches(columns=S.STATE_COLUMNS):
                columns = [batch.column(f.name).cast(f.type) for f in target]
                number = pa.array([partition.batch_id] * len(batch), pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, number], names=SCHEMA.names)

    def commit(self, end: dict) -> None:
        pass


def read_changes(spark: SparkSession, lake: Lake, start: str | int = "earliest") -> DataFrame:
    """A stream of the rows that each ingest batch changed, with ``changed_in``, from ``start`` on.

    Batches must be numbered without gaps, as the ingest numbers them. A batch that is replaced after it was read is
    not read again.
    """
    spark.dataSource.register(ChangeFeed)
    return spark.readStream.format(NAME).option("path", lake.changes).option("start", str(start)).load()
