"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of the contracts, ``[\x20\x09-\x0D]``: what ``bytes.split()`` splits at.
BLANKS = " \t\n\x0b\x0c\r"

#: Whole texts that go to a Python worker at once. Spark's own 10,000 rows of long texts take hundreds of megabytes, in the
#: executor's Arrow buffers and again in the worker, and neither gives them back.
TEXT_BATCH = 1000


def text_batches(spark: SparkSession) -> None:
    """From now on at most ``TEXT_BATCH`` rows go to Python at once in this session; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_BATCH:
        spark.conf.set(key, str(TEXT_BATCH))


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors share, from ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, which cuts its lineage.

    The table outlives lost executors. It is left in the shared folder, whose owner clears it.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str, text_col: str):
    """Digest that tells rows of one id apart by their texts; equal rows share it and get equal results."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("row_digest")


def split_join(long: DataFrame, short: DataFrame, key: str) -> DataFrame:
    """Inner join of rows of which many may share a key with an aggregate that has one row per key.

    The aggregate is partitioned by the key already and would be joined in place, where adaptive execution cannot split
    a hot partition. Asking for the key and its hash shuffles both sides for the join, which makes them splittable.
    """
    spread = "__key_hash"
    left, right = (df.withColumn(spread, F.xxhash64(key)) for df in (long, short))
    return left.join(right, [key, spread]).drop(spread)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, root)`` per node, root the smallest node.

    Alternates large-star and small-star steps until no edge changes. Each step is a minimum per node, which combines
    before the shuffle, and a ``split_join``, whose hub adaptive execution can split. Each round is a written table,
    so lineage stays short.
    """
    edges = stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )

    def tally(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = tally(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = split_join(both.filter("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = split_join(large, least, "a")
        small = small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
        edges = stored(small.filter("a <> b").distinct(), "edges")
        now = tally(edges)
        if now == before:
            break
        before = now
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def paired_chunks(
    rows: DataFrame, key: str, member: str, chunk: int, payload: DataFrame | None = None
) -> DataFrame:
    """Deals bucket rows to tasks so that any two members of a bucket meet, whatever the bucket's size.

    Buckets of one row go. A bucket of n rows is cut into ``ceil(n / chunk)`` chunks by a hash of the member, and each
    pair of chunks ``(lo, hi)`` is a group of at most about ``2 * chunk`` rows. Adds ``lo``, ``hi`` and ``mine``, the
    row's own chunk. Rows come out sorted by ``(key, lo, hi)`` with each group in one task. ``payload`` has what a task
    needs of each member; it joins late, so its columns are shuffled with the dealt rows only.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    live = (
        split_join(rows, sizes, key)
        .withColumn("mine", F.pmod(F.xxhash64(F.col(member), F.lit("chunk")), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("lo", F.least("mine", "other"))
        .withColumn("hi", F.greatest("mine", "other"))
        .drop("n", "other")
    )
    if payload is not None:
        live = live.join(payload, member)
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return live.repartition(count, key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def whole_groups(batches, keys: list[str]):
    """Cuts sorted pandas batches so that no group of equal ``keys`` spans two of them."""
    import pandas as pd

    rest = None
    for batch in batches:
        if rest is not None and len(rest):
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        last = batch.iloc[-1]
        tail = (batch[keys] == last[keys]).all(axis=1).to_numpy()
        start = len(batch) - int(tail[::-1].cumprod().sum())
        rest = batch.iloc[start:]
        if start:
            yield batch.iloc[:start]
    if rest is not None and len(rest):
        yield rest


def group_bounds(frame, keys: list[str]):
    """Start positions of the runs of equal ``keys`` and the end position, as one array."""
    import numpy as np

    change = np.zeros(len(frame), bool)
    change[0] = True
    for k in keys:
        v = frame[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), len(frame))
