"""Registered queries: name to ``f(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow import schemas as S
from parcelflow.functions.geo import haversine_km as haversine
from parcelflow.functions.geo import hub_coordinate, postcode_region as region_of
from parcelflow.functions.geo import nearest_hub as closest
from parcelflow.functions.geo import sla_hours as hours_of
from parcelflow.operators import alerts as alert_ops
from parcelflow.operators import ingest, lifecycle, live, quality, silver, state, warehouse, weather
from parcelflow.operators.nearest import with_nearest_hub
from parcelflow.plans import pipeline
from parcelflow.sources import sample, storage
from parcelflow.streaming.state_store import StateStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- inputs shared by several queries --------------------------------------


def _silver(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.silver_events(
        sample.parcel_events(spark, sf),
        weather.flags(sample.hub_weather(spark)),
        sample.instant(sample.VALIDATION_AS_OF),
    )


def _stg_events(spark: SparkSession, sf: str) -> DataFrame:
    return warehouse.stg_parcel_events(_silver(spark, sf))


def _stg_parcels(spark: SparkSession, sf: str) -> DataFrame:
    return warehouse.stg_parcels(sample.parcels(spark, sf))


def _fact(spark: SparkSession, sf: str) -> DataFrame:
    return warehouse.fct_parcel_events(_stg_events(spark, sf), _stg_parcels(spark, sf))


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return warehouse.parcel_outcomes(_stg_events(spark, sf), _stg_parcels(spark, sf))


def _scans(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct event, valid or not, for state and lifecycle questions."""
    raw = silver.deduplicate(sample.parcel_events(spark, sf))
    return ingest.enrich(raw, weather.flags(sample.hub_weather(spark)))


def _state(spark: SparkSession, sf: str) -> DataFrame:
    return state.latest(_scans(spark, sf))


def _live(spark: SparkSession, sf: str) -> dict:
    return {
        "state": _state(spark, sf),
        "parcels": _stg_parcels(spark, sf),
        "as_of": sample.instant(sample.LIVE_AS_OF),
        "accel": sample.LIVE_ACCEL,
    }


def _observations(spark: SparkSession, sf: str, keep_empty: bool = False) -> DataFrame:
    return weather.parse_responses(sample.weather_responses(spark, sf), keep_empty=keep_empty)


# --- ingest -----------------------------------------------------------------


@_query
def decode_events(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.decode(sample.framed_events(spark, sf))


@_query
def validate_events(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.validate(sample.parcel_events(spark, sf), sample.instant(sample.VALIDATION_AS_OF))


@_query
def dead_letter(spark: SparkSession, sf: str) -> DataFrame:
    rejected = pipeline.dead_letters(
        sample.parcel_events(spark, sf), sample.instant(sample.VALIDATION_AS_OF)
    )
    return rejected.select("event_id", "parcel_id", "reject_reason")


@_query
def enrich_weather(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.enrich(sample.parcel_events(spark, sf), weather.flags(sample.hub_weather(spark)))


@_query
def silver_events(spark: SparkSession, sf: str) -> DataFrame:
    return _silver(spark, sf)


# --- warehouse --------------------------------------------------------------


@_query
def stg_parcel_events(spark: SparkSession, sf: str) -> DataFrame:
    return _stg_events(spark, sf)


@_query
def stg_parcels(spark: SparkSession, sf: str) -> DataFrame:
    return _stg_parcels(spark, sf)


@_query
def dim_parcels(spark: SparkSession, sf: str) -> DataFrame:
    return warehouse.dim_parcels(_stg_parcels(spark, sf))


@_query
def fct_parcel_events(spark: SparkSession, sf: str) -> DataFrame:
    return _fact(spark, sf)


@_query
def gold_delivery_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return warehouse.gold_delivery_funnel(_stg_events(spark, sf))


@_query
def gold_on_time_by_region(spark: SparkSession, sf: str) -> DataFrame:
    return warehouse.gold_on_time_by_region(_outcomes(spark, sf), sample.GOLD_ACCEL)


@_query
def gold_failure_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return warehouse.gold_failure_analysis(_outcomes(spark, sf))


@_query
def gold_weather_impact(spark: SparkSession, sf: str) -> DataFrame:
    return warehouse.gold_weather_impact(_stg_events(spark, sf))


# --- state and alerts -------------------------------------------------------


@_query
def current_state(spark: SparkSession, sf: str) -> DataFrame:
    return _state(spark, sf)


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    """Even versions are what was stored before, odd ones arrive as the batch."""
    scans = _scans(spark, sf)
    stored = state.latest(scans.filter(F.col("version") % 2 == 0))
    return state.merge(stored, scans.filter(F.col("version") % 2 != 0))


@_query
def upsert_state(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf)


def _store(spark: SparkSession, *batches: DataFrame) -> StateStore:
    """A bucketed store in the shared folder, after some batches of events."""
    store = StateStore(spark, storage.scratch_folder(spark, "state"), buckets=16)
    for number, events in enumerate(batches):
        store.apply(events, number)
    return store


@_query
def upsert_state_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """``upsert_state`` through the stored buckets: even versions are one batch, odd ones the next."""
    path = storage.scratch_folder(spark, "scans")
    _scans(spark, sf).write.parquet(path)  # both batches come from one join and one deduplication
    scans = spark.read.parquet(path)
    store = _store(spark, scans.filter(F.col("version") % 2 == 0), scans.filter(F.col("version") % 2 != 0))
    return store.read().select(*S.STATE_COLUMNS, (F.col("changed_in") == 1).alias("changed"))


@_query
def alerts(spark: SparkSession, sf: str) -> DataFrame:
    changed = _merged(spark, sf).filter("changed").select("parcel_id", "status")
    return alert_ops.alerts(
        changed, _stg_parcels(spark, sf), sample.instant(sample.LIVE_AS_OF), sample.LIVE_ACCEL
    )


# --- live views -------------------------------------------------------------


@_query
def sla_state(spark: SparkSession, sf: str) -> DataFrame:
    return live.sla_state(**_live(spark, sf))


@_query
def live_summary_sla(spark: SparkSession, sf: str) -> DataFrame:
    return live.sla_counts(**_live(spark, sf))


@_query
def live_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return live.count_by_status(_state(spark, sf))


@_query
def live_by_hub(spark: SparkSession, sf: str) -> DataFrame:
    return live.count_by_hub(_state(spark, sf))


@_query
def live_totals(spark: SparkSession, sf: str) -> DataFrame:
    return live.totals(_state(spark, sf))


@_query
def live_parcels(spark: SparkSession, sf: str) -> DataFrame:
    return live.worklist(**_live(spark, sf))


@_query
def live_parcels_at_risk(spark: SparkSession, sf: str) -> DataFrame:
    return live.worklist(**_live(spark, sf), sla="at_risk")


@_query
def live_parcels_meta(spark: SparkSession, sf: str) -> DataFrame:
    return live.worklist_meta(**_live(spark, sf))


@_query
def live_map(spark: SparkSession, sf: str) -> DataFrame:
    return live.map_points(**_live(spark, sf))


@_query
def parcel_detail(spark: SparkSession, sf: str) -> DataFrame:
    return live.parcel_detail(**_live(spark, sf), parcel_id="P77")


@_query
def parcel_detail_stored(spark: SparkSession, sf: str) -> DataFrame:
    """``parcel_detail`` from the stored buckets: only the files of the parcel's bucket are read."""
    found = {**_live(spark, sf), "state": _store(spark, _scans(spark, sf)).lookup("P77")}
    return live.parcel_detail(**found, parcel_id="P77")


# --- geography --------------------------------------------------------------


@_query
def haversine_km(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of every scan to its hub, null for an unknown hub."""
    hub = F.col("hub_id")
    km = haversine(F.col("lat"), F.col("lon"), hub_coordinate(hub, "lat"), hub_coordinate(hub, "lon"))
    return sample.parcel_events(spark, sf).select("event_id", F.round(km, 6).alias("km"))


@_query
def nearest_hub(spark: SparkSession, sf: str) -> DataFrame:
    """The hub closest to each scan of the delivery area."""
    return (
        sample.parcel_events(spark, sf)
        .filter(F.col("event_type").isin(S.DELIVERY_AREA_TYPES))
        .select("event_id", closest(F.col("lat"), F.col("lon")).alias("hub_id"))
    )


@_query
def nearest_hub_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The same through the grid of candidates that long lists of hubs use."""
    area = sample.parcel_events(spark, sf).filter(F.col("event_type").isin(S.DELIVERY_AREA_TYPES)).select("event_id", "lat", "lon")
    return with_nearest_hub(area, out="hub_id", inline=0).select("event_id", "hub_id")


@_query
def postcode_region(spark: SparkSession, sf: str) -> DataFrame:
    return _stg_parcels(spark, sf).select(
        "parcel_id",
        region_of(F.col("destination_postcode")).alias("region"),
        hours_of(F.col("service_level")).alias("sla_hours"),
    )


# --- weather ----------------------------------------------------------------


@_query
def weather_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _observations(spark, sf).drop("fetched_at")


@_query
def weather_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Flag of each hub by its most recent observation."""
    return weather.weather_by_hub(weather.flags(_observations(spark, sf)), "fetched_at")


# --- lifecycle --------------------------------------------------------------


@_query
def lifecycle_violations(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.bad_transitions(_silver(spark, sf))


@_query
def version_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.version_gaps(_silver(spark, sf))


@_query
def open_parcels(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.open_parcels(_silver(spark, sf))


@_query
def lifecycle_rates(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.rates(_silver(spark, sf))


# --- data quality -----------------------------------------------------------


def _models(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    events, parcels = _stg_events(spark, sf), _stg_parcels(spark, sf)
    outcomes = warehouse.parcel_outcomes(events, parcels)
    return {
        "stg_parcel_events": events,
        "stg_parcels": parcels,
        "dim_parcels": warehouse.dim_parcels(parcels),
        "fct_parcel_events": warehouse.fct_parcel_events(events, parcels),
        "gold_delivery_funnel": warehouse.gold_delivery_funnel(events),
        "gold_on_time_by_region": warehouse.gold_on_time_by_region(outcomes, sample.GOLD_ACCEL),
        "gold_failure_analysis": warehouse.gold_failure_analysis(outcomes),
        "gold_weather_impact": warehouse.gold_weather_impact(events),
    }


# Which columns each model promises.
NOT_NULL = {
    "stg_parcel_events": ["event_id", "parcel_id", "version"],
    "stg_parcels": ["parcel_id", "sla_hours"],
    "dim_parcels": ["parcel_id"],
    "fct_parcel_events": ["event_id"],
    "gold_delivery_funnel": ["event_type"],
    "gold_on_time_by_region": ["region"],
    "gold_failure_analysis": ["region"],
    "gold_weather_impact": ["bad_weather"],
}
UNIQUE = {
    "stg_parcel_events": ["event_id"],
    "stg_parcels": ["parcel_id"],
    "dim_parcels": ["parcel_id"],
    "fct_parcel_events": ["event_id"],
    "gold_delivery_funnel": ["event_type"],
}
ACCEPTED = {
    "stg_parcel_events": {"event_type": S.EVENT_TYPES},
    "stg_parcels": {"service_level": S.SERVICE_LEVELS},
}


@_query
def dq_not_null(spark: SparkSession, sf: str) -> DataFrame:
    models = _models(spark, sf)
    return quality.not_null({name: (models[name], columns) for name, columns in NOT_NULL.items()})


@_query
def dq_unique(spark: SparkSession, sf: str) -> DataFrame:
    """The promised keys, and the raw inputs they were made from, which do repeat."""
    models = _models(spark, sf)
    checks = {name: (models[name], columns) for name, columns in UNIQUE.items()}
    checks["raw_parcel_events"] = (sample.parcel_events(spark, sf), ["event_id"])
    checks["raw_parcels"] = (sample.parcels(spark, sf), ["parcel_id"])
    return quality.unique(checks)


@_query
def dq_accepted_values(spark: SparkSession, sf: str) -> DataFrame:
    models = _models(spark, sf)
    checks = {name: (models[name], columns) for name, columns in ACCEPTED.items()}
    checks["landed_events"] = (sample.landed_events(spark, sf), {"event_type": S.EVENT_TYPES})
    return quality.accepted(checks)


@_query
def dq_orphan_events(spark: SparkSession, sf: str) -> DataFrame:
    # A left join keeps each event once, so the fact's events per parcel are those of staging.
    return quality.orphans(_stg_events(spark, sf), _stg_parcels(spark, sf))


@_query
def dq_promised_by(spark: SparkSession, sf: str) -> DataFrame:
    return quality.promised_mismatch(sample.parcels(spark, sf))


@_query
def dq_weather_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Hubs that each weather response leaves out."""
    return weather.uncovered(_observations(spark, sf, keep_empty=True), "response_id")


@_query
def contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    return quality.contract(sample.landed_events(spark, sf))
