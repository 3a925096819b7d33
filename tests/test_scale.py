"""Plans that must hold on skewed and large inputs: one key owns a third of all rows."""

from __future__ import annotations

import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from parcelflow import schemas as S
from parcelflow.operators import lifecycle, live, quality, silver, state, warehouse
from parcelflow.sources import files

N = 60_000


@pytest.fixture(scope="module")
def skewed(spark):
    """Silver-like events; parcel ``P0`` and event id ``dup`` each own a third of the rows."""
    n = F.col("id")
    return spark.range(0, N, 1, 6).select(
        F.when(n % 3 == 1, F.lit("dup")).otherwise(F.concat(F.lit("e"), n)).alias("event_id"),
        F.when(n % 3 == 0, F.lit("P0")).otherwise(F.concat(F.lit("P"), n % 5000)).alias("parcel_id"),
        F.element_at(F.array(*[F.lit(t) for t in S.EVENT_TYPES]), (n % 10 + 1).cast("int")).alias("event_type"),
        F.lit("AMS").alias("hub_id"),
        F.lit(52.3).alias("lat"),
        F.lit(4.9).alias("lon"),
        F.timestamp_seconds(F.lit(1714564800) + n).alias("event_ts"),
        F.lit("x").alias("status"),
        (n / 3).cast("int").alias("version"),
        F.lit(False).alias("weather_bad"),
        F.lit("2024-05-01").cast("date").alias("event_date"),
    )


@pytest.fixture(scope="module")
def dimension(spark):
    n = F.col("id")
    return warehouse.stg_parcels(
        spark.range(5000).select(
            F.concat(F.lit("P"), n).alias("parcel_id"),
            *[F.lit("v").alias(c) for c in S.PARCEL_COLUMNS[1:6]],
            F.lit(48).alias("sla_hours"),
            F.timestamp_seconds(F.lit(1714564800) + n).alias("created_at"),
            F.timestamp_seconds(F.lit(1714564800) + n).alias("promised_by"),
        )
    )


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def with_conf(spark, **conf):
    class Scope:
        def __enter__(self):
            self.before = {k: spark.conf.get(k, None) for k in conf}
            for k, v in conf.items():
                spark.conf.set(k, v)

        def __exit__(self, *_):
            for k, v in self.before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    return Scope()


def test_fact_join_splits_a_hot_parcel(spark, skewed, dimension):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    with with_conf(spark, **settings):
        fact = warehouse.fct_parcel_events(skewed, dimension)
        assert fact.count() == N
        fact = warehouse.fct_parcel_events(skewed, dimension)
        fact.collect()
        assert "skew=true" in plan(fact)


def exchanges_after_partial(df) -> list[str]:
    """For each hash exchange of the plan, the operator that feeds it."""
    lines = [re.sub(r"^[\s:+\-*()\d]*", "", line) for line in plan(df).split("\n")]
    return [
        next(below for below in lines[i + 1 :] if not below.startswith("Project"))
        for i, line in enumerate(lines)
        if line.startswith("Exchange hashpartitioning")
    ]


@pytest.mark.parametrize(
    "build",
    [
        lambda e: silver.deduplicate(e),
        lambda e: state.latest(e),
        lambda e: state.merge(e.select(*S.STATE_COLUMNS), e),
        lambda e: warehouse.gold_delivery_funnel(e),
        lambda e: warehouse.gold_weather_impact(e),
        lambda e: lifecycle.steps(e),
        lambda e: lifecycle.version_gaps(e),
        lambda e: lifecycle.open_parcels(e),
        lambda e: quality.unique({"t": (e, ["event_id"])}),
        lambda e: live.count_by_hub(e),
    ],
)
def test_hot_keys_are_combined_before_they_are_shuffled(skewed, build):
    feeders = exchanges_after_partial(build(skewed))
    assert feeders and all("Aggregate" in f for f in feeders), feeders


def test_marts_reduce_events_before_the_join(spark, skewed, dimension):
    with with_conf(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        outcomes = warehouse.parcel_outcomes(skewed, dimension)
        text = plan(outcomes)
    # One exchange per input; the join uses the partitioning of both aggregations.
    assert text.count("Exchange hashpartitioning") == 2
    assert "HashAggregate" in text


def test_deduplicate_keeps_every_id(skewed):
    assert silver.deduplicate(skewed).count() == skewed.select("event_id").distinct().count()


def test_no_window_holds_a_whole_hot_parcel(skewed):
    pairs = lifecycle.step_pairs(skewed, slice_versions=500)
    assert pairs.count() == lifecycle.steps(skewed).count()
    assert rows(pairs.filter("NOT has_previous").groupBy().count()) == [
        (skewed.select("parcel_id").distinct().count(),)
    ]
    assert "hashpartitioning(parcel_id#" in plan(pairs) and ", slice#" in plan(pairs)


def test_silver_scan_reads_only_what_a_mart_needs(spark, scratch, skewed):
    files.write_by_date(skewed.select(*S.SILVER_COLUMNS), f"{scratch}/silver")
    stored = files.read_silver(spark, f"{scratch}/silver")
    text = plan(warehouse.gold_delivery_funnel(stored))
    assert "ReadSchema: struct<parcel_id:string,event_type:string>" in text or (
        "ReadSchema: struct<event_type:string,parcel_id:string>" in text
    )
    detail = plan(live.parcel_detail(state.latest(stored), stored.select(*[F.lit(None).alias(c) if c not in stored.columns else c for c in S.PARCEL_COLUMNS]), "P7", F.current_timestamp()))
    assert detail.count("EqualTo(parcel_id,P7)") == 2


def test_worklist_is_a_distributed_top_k(skewed, dimension):
    text = plan(live.worklist(state.latest(skewed), dimension, F.current_timestamp()))
    assert "TakeOrderedAndProject(limit=200" in text
    assert "Exchange rangepartitioning" not in text
