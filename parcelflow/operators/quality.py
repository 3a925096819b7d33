"""Declarative data-quality checks. Each gives the rows or counts that fail."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow import schemas as S
from parcelflow.functions.sla import promised_by

Checks = Mapping[str, tuple[DataFrame, Sequence[str]]]


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _per_column(table: str, counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of counters, named like the columns, to rows (table, column, failures)."""
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("failures")) for c in columns]
    return counts.select(F.lit(table).alias("table"), F.explode(F.array(*rows)).alias("r")).select("table", "r.*")


def not_null(tables: Checks) -> DataFrame:
    """Null values per (table, column). All columns of a table share one scan."""
    return _stack(
        [
            _per_column(name, df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]), columns)
            for name, (df, columns) in tables.items()
        ]
    )


def unique(tables: Checks) -> DataFrame:
    """Values that occur more than once per (table, column); nulls are left to ``not_null``."""
    return _stack(
        [
            df.filter(F.col(c).isNotNull())
            .groupBy(c)
            .agg(F.count(F.lit(1)).alias("copies"))
            .agg(F.count_if(F.col("copies") > 1).alias("failures"))
            .select(F.lit(name).alias("table"), F.lit(c).alias("column"), "failures")
            for name, (df, columns) in tables.items()
            for c in columns
        ]
    )


def accepted(tables: Mapping[str, tuple[DataFrame, Mapping[str, Sequence[str]]]]) -> DataFrame:
    """Rows with a value outside its list, per (table, column). Nulls pass."""
    return _stack(
        [
            _per_column(
                name,
                df.agg(*[F.count_if(~F.col(c).isin(list(values))).alias(c) for c, values in columns.items()]),
                list(columns),
            )
            for name, (df, columns) in tables.items()
        ]
    )


def orphans(fact: DataFrame, dim: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Keys of ``fact`` without a row in ``dim``, with their number of events.

    Events are counted per key first, so the anti join meets each key once.
    """
    counted = fact.groupBy(key).agg(F.count(F.lit(1)).alias("events"))
    return counted.join(dim.select(key), key, "left_anti")


def promised_mismatch(parcels: DataFrame) -> DataFrame:
    """Parcels whose promise is not the creation time plus the SLA hours."""
    return (
        parcels.withColumn("expected", promised_by(F.col("created_at"), F.col("sla_hours")))
        .filter(~F.col("promised_by").eqNullSafe(F.col("expected")))
        .select("parcel_id", "promised_by", "expected")
    )


def contract(
    landed: DataFrame,
    schema: T.StructType = S.EVENT_SCHEMA,
    enums: Mapping[str, Sequence[str]] | None = None,
    id_col: str = "event_id",
) -> DataFrame:
    """Fields of landed text rows that break the contract: (event_id, field, problem).

    ``missing``: no value; ``type``: does not cast; ``enum``: not a listed symbol.
    Row-local, without a shuffle.
    """
    enums = {"event_type": S.EVENT_TYPES} if enums is None else enums
    problems = []
    for field in schema:
        value = F.col(field.name)
        problem = F.when(value.isNull(), F.lit("missing"))
        if not isinstance(field.dataType, T.StringType):
            problem = problem.when(value.try_cast(field.dataType).isNull(), F.lit("type"))
        if field.name in enums:
            problem = problem.when(~value.isin(list(enums[field.name])), F.lit("enum"))
        problems.append(
            F.when(
                problem.isNotNull(), F.struct(F.lit(field.name).alias("field"), problem.alias("problem"))
            )
        )
    found: Column = F.array_compact(F.array(*problems))
    return landed.select(F.col(id_col).alias("event_id"), F.explode(found).alias("p")).select(
        "event_id", "p.field", "p.problem"
    )


def schema_problems(found: T.StructType, expected: T.StructType = S.EVENT_SCHEMA) -> list[tuple[str, str]]:
    """(field, ``missing`` or ``type``) for each field a table's schema gets wrong."""
    types = {f.name: f.dataType for f in found}
    return [
        (f.name, "missing" if f.name not in types else "type")
        for f in expected
        if types.get(f.name) != f.dataType
    ]
