"""Command line: ``python -m parcelflow <job> --lake <folder> [options]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from parcelflow import schemas as S
from parcelflow.operators import live
from parcelflow.plans import jobs
from parcelflow.session import build_session
from parcelflow.sources import bronze, files, kafka, reference
from parcelflow.streaming import alerts, ingest
from parcelflow.streaming.lake import Lake
from parcelflow.streaming.progress import ProgressLog
from parcelflow.streaming.state_store import StateStore

MARTS = ["gold_delivery_funnel", "gold_on_time_by_region", "gold_failure_analysis", "gold_weather_impact"]


def _arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="parcelflow")
    parser.add_argument(
        "job",
        choices=["ingest", "alerts", "compact", "weather", "parcels", "silver", "warehouse", "overdue", "live", "history", "parcel"],
    )
    parser.add_argument("--lake", required=True, help="root folder of the lake")
    parser.add_argument("--accel", type=float, default=S.TIME_ACCELERATION, help="simulated seconds per second")
    parser.add_argument("--kafka", help="bootstrap servers; without it ingest reads files")
    parser.add_argument("--topic", default="parcel.events")
    parser.add_argument("--inbox", help="input folder: Parquet files with a binary value, or weather responses")
    parser.add_argument("--rebuild", action="store_true", help="silver: from all batches, not only new ones")
    parser.add_argument("--exact-dedup", action="store_true", help="remember every event id for ever")
    parser.add_argument("--keep-late", action="store_true", help="store late events with the dead letters")
    parser.add_argument("--start-at", default="earliest", help="alerts: earliest, latest or a batch of the ingest")
    parser.add_argument("--available-now", action="store_true", help="stop when the input is used up")
    parser.add_argument("--sla", choices=S.SLA_CLASSES, help="only this class in the worklist")
    parser.add_argument("--id", help="parcel of the detail view")
    parser.add_argument("--buckets", type=int, default=64, help="state buckets of a new lake, parcel buckets of a new generation")
    parser.add_argument("--limit", type=int, default=200, help="rows of the worklist")
    return parser.parse_args()


def _ingest(spark: SparkSession, lake: Lake, args: argparse.Namespace) -> None:
    spark.streams.addListener(ProgressLog(spark, lake))
    if args.kafka:
        source, decode = kafka.read_topic(spark, args.kafka, args.topic), kafka.decode_avro
    else:
        source, decode = spark.readStream.schema("value binary").parquet(args.inbox), None
    ingest.start(
        source,
        lake,
        weather=lambda session: files.read_weather(session, lake.weather),
        mode="exact" if args.exact_dedup else "bounded",
        decode=decode,
        available_now=args.available_now,
        buckets=args.buckets,
        keep_late=args.keep_late,
        network=reference.read_network(spark, lake.network),
        on_metrics=lambda batch, counts: print(f"batch {batch}: {counts}", flush=True),
    ).awaitTermination()


def _live(spark: SparkSession, lake: Lake, args: argparse.Namespace) -> None:
    question = {
        "state": jobs.current_state(spark, lake),
        "parcels": jobs.parcel_store(spark, lake).read(),
        "as_of": F.current_timestamp(),
        "accel": args.accel,
    }
    live.totals(question["state"]).show()
    live.count_by_status(question["state"]).show()
    hubs = live.count_by_hub(question["state"])
    hubs.show(hubs.count())
    live.sla_counts(**question).show()
    live.worklist(**question, sla=args.sla, limit=args.limit).show(args.limit, truncate=False)


def _parcel(spark: SparkSession, lake: Lake, args: argparse.Namespace) -> None:
    state = StateStore(spark, lake.state).lookup(args.id)
    parcels = jobs.parcel_store(spark, lake).read()
    live.parcel_detail(state, parcels, args.id, F.current_timestamp(), args.accel).show(vertical=True, truncate=False)


def main() -> None:
    args = _arguments()
    lake = Lake(args.lake)
    spark = build_session(f"parcelflow-{args.job}")
    if args.job == "ingest":
        _ingest(spark, lake, args)
    elif args.job == "alerts":
        alerts.start(
            spark,
            lake,
            lambda session: jobs.parcel_store(session, lake).read(),
            accel=args.accel,
            available_now=args.available_now,
            start_at=args.start_at,
        ).awaitTermination()
    elif args.job == "compact":
        print(bronze.compact(spark, lake.bronze), "Bronze batches compacted")
        tables = [StateStore(spark, lake.state).files, files.silver_table(spark, lake.silver), jobs.mart_table(spark, lake)]
        tables.append(jobs.parcel_store(spark, lake).files)
        removed = sum(table.vacuum() for table in tables) + bronze.vacuum(spark, lake.bronze)
        print(removed, "old folders removed")
    elif args.job == "weather":
        jobs.refresh_weather(spark, lake, args.inbox)
    elif args.job == "parcels":
        print("generation", jobs.parcel_store(spark, lake, args.buckets).publish())
    elif args.job == "silver":
        rows = jobs.build_silver(spark, lake) if args.rebuild else jobs.update_silver(spark, lake)
        print(rows, "Silver rows written")
    elif args.job == "warehouse":
        try:
            report = jobs.build_warehouse(spark, lake, args.accel)
        except jobs.BrokenPromise as broken:
            raise SystemExit(f"not published: {broken}") from broken
        for r in report:
            print(r.severity, r.check, f"{r.table}.{r.column}", r.failures)
    elif args.job == "overdue":
        print(jobs.send_overdue(spark, lake, accel=args.accel), "alerts stored in", lake.alerts)
    elif args.job == "live":
        _live(spark, lake, args)
    elif args.job == "parcel":
        _parcel(spark, lake, args)
    elif args.job == "history":
        for name in MARTS:
            mart = jobs.read_mart(spark, lake, name)
            mart.show(mart.count(), truncate=False)


if __name__ == "__main__":
    main()
