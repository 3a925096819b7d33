"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm.common import BLANKS, row_key, stored

RUN_SCHEMA = "k1 long, k2 long, doc long, n long"


def line_key(line):
    """Trimmed line with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def key_hash(key) -> list:
    """128 bits of a key in two independent columns."""
    return [F.xxhash64(key).alias("k1"), F.xxhash64(F.lit("second"), key).alias("k2")]


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_points: int) -> DataFrame:
    """``(id, row_digest, at, k1, k2)``: the lines long enough to count, with their position in the text."""
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col), F.posexplode(split).alias("at", "line"))
    rows = rows.filter(F.length(F.btrim("line", F.lit(BLANKS))) >= min_points)
    return rows.select("id", "row_digest", "at", line_key(F.col("line")).alias("key")).select(
        "id", "row_digest", "at", *key_hash(F.col("key"))
    )


class LineRuns:
    """Levelled index of line hashes.

    A run is a written table sorted by hash with at most one row per hash: the document that keeps the line and the
    number of documents seen with it. A batch is first reduced to one row per hash and then merged with the runs:
    hashes that some run holds are known, so an anti join leaves the fresh ones with their keeper, and known ones add
    only to the count (their keeper is null). When a level has ``fan_out`` runs they are merged into one run of the
    next level. Batches must come in the order of preference: the first batch that holds a line keeps it.
    """

    def __init__(self, spark: SparkSession, fan_out: int = 3):
        self.spark, self.fan_out, self.levels = spark, fan_out, [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        everything = reduce(DataFrame.union, runs, self.spark.createDataFrame([], RUN_SCHEMA))
        return everything.groupBy("k1", "k2").agg(F.max("doc").alias("doc"), F.sum("n").alias("n"))

    def write(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(stored(run.select("k1", "k2", "doc", "n").sortWithinPartitions("k1", "k2"), "run"))

    def add(self, lines: DataFrame) -> None:
        """Adds a batch of ``(id, k1, k2)`` lines and compacts full levels."""
        batch = (
            lines.groupBy("k1", "k2", "id")
            .agg(F.lit(1).alias("one"))
            .groupBy("k1", "k2")
            .agg(F.max("id").alias("doc"), F.count("*").alias("n"))
        )
        known = reduce(DataFrame.union, [r.select("k1", "k2") for r in self.runs()]) if self.runs() else None
        if known is not None:
            batch = stored(batch, "batch")
            fresh = batch.join(known, ["k1", "k2"], "left_anti")
            again = batch.join(known, ["k1", "k2"], "left_semi").withColumn("doc", F.lit(None).cast("long"))
            batch = fresh.unionByName(again)
        self.write(batch, 0)
        level = 0
        while len(self.levels[level]) >= self.fan_out:
            full, self.levels[level] = self.levels[level], []
            self.write(self.merged(full), level + 1)
            level += 1

    def totals(self) -> DataFrame:
        """One row per hash: ``(k1, k2, doc, n)``."""
        return self.merged(self.runs())


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_points: int = 40,
    min_docs: int = 5,
    batches: int = 3,
    fan_out: int = 2,
) -> DataFrame:
    """Drops repeated lines from whole texts and keeps every column of ``docs``.

    A line whose key has at least ``min_points`` code points and occurs in at least ``min_docs`` documents stays only
    in the document with the largest id that holds it. Batches are ranges of ids, largest first, so the first batch
    that holds a line keeps it. Adds ``n_lines`` and ``n_dropped`` and replaces the text.

    A null or empty text is one empty line and its new text is empty. Rows with equal ids count as one document; each
    keeps its own lines. Rows with a null id count as one document too, older than any other. An empty table gives no
    rows. Columns of ``docs`` may have any names but ``n_lines``, ``n_dropped``.
    """
    spark = docs.sparkSession
    lines = stored(lines_of(docs, id_col, text_col, min_points), "lines")
    low, high = lines.agg(F.min("id"), F.max("id")).first()
    index = LineRuns(spark, fan_out)
    if high is None:
        index.add(lines)
    else:
        step = max(1, -(-(high - low + 1) // batches))
        for top in range(high, low - 1, -step):
            inside = (F.col("id") <= top) & (F.col("id") > top - step)
            index.add(lines.filter(inside | F.col("id").isNull() if top - step < low else inside))
    frequent = index.totals().filter(F.col("n") >= min_docs).select("k1", "k2", "doc")
    dropped = lines.join(frequent, ["k1", "k2"]).filter(~F.col("id").eqNullSafe(F.col("doc")))
    drops = dropped.groupBy("id", "row_digest").agg(F.collect_set("at").alias("__drops"))
    drops = drops.select(F.col("id").alias("__id"), F.col("row_digest").alias("__digest"), "__drops")
    keyed = docs.withColumn("__row", row_key(id_col, text_col))
    joined = keyed.join(
        drops, keyed[id_col].eqNullSafe(drops["__id"]) & (keyed["__row"] == drops["__digest"]), "left"
    ).withColumn("__lines", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))
    n_dropped = F.when(F.col("__drops").isNull(), 0).otherwise(F.size("__drops")).cast("long")
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drops"))
    text = F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    return joined.select(
        *[c for c in docs.columns if c != text_col],
        F.size("__lines").cast("long").alias("n_lines"),
        n_dropped.alias("n_dropped"),
        F.when(F.col("__drops").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(text).alias(text_col),
    )
