"""Command line of the batch run, for spark-submit.

    python -m tallyforge run    --lake PATH --source PATH [--contracts FILE] [--start D --end D]
    python -m tallyforge upload --lake PATH --file PATH --kind csv|json --table NAME
    python -m tallyforge review --lake PATH --transaction ID --status Approved|Dismissed|Pending
    python -m tallyforge erase  --lake PATH --customers FILE
    python -m tallyforge report --lake PATH --name overview|trend|segments|inventory|fraud|health
"""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.contracts import CONTRACTS, load_contracts
from tallyforge.plans import fraud, kpis, medallion, privacy, staging, upload
from tallyforge.session import build_session
from tallyforge.sources.exports import export_csv
from tallyforge.sources.layers import Lakehouse, read_source


def run(lake: Lakehouse, args: argparse.Namespace) -> None:
    run_id = str(uuid.uuid4())
    contracts = load_contracts(args.contracts) if args.contracts else CONTRACTS

    marks = dict(m.split("=", 1) for m in args.mark)

    def read(table: str) -> DataFrame | None:
        return read_source(lake.spark, f"{args.source.rstrip('/')}/{table}", args.format)

    for table, outcome in medallion.ingest_all(lake, read, run_id, marks=marks, overlap=args.overlap).items():
        print(f"{table}: {outcome}")
    medallion.clean_all(lake, run_id, contracts)
    if args.publish or args.publish_url:
        print("published", *medallion.publish_silver(lake, **({"url": args.publish_url} if args.publish_url else {})))
    medallion.build_star(lake, args.start, args.end)
    names = ("transactions", "products", "returns", "customers")
    silver = {name: medallion.current_silver(lake, name) for name in names}
    if all(df is not None for df in silver.values()):
        products = silver["products"].withColumnRenamed("id", "product_id")
        medallion.refresh_analytics(
            lake, silver["transactions"], products, silver["returns"], silver["customers"]
        )
    lake.prune_all(args.keep)


def report(lake: Lakehouse, args: argparse.Namespace) -> DataFrame:
    def silver(name: str) -> DataFrame:
        return medallion.current_silver(lake, name)

    if args.name == "health":
        return kpis.run_health(lake.read_audit())
    if args.name == "fraud":
        queue = lake.read("gold", "fact_fraud_queue")
        if args.csv:  # CSV keeps the reasons as text
            return queue.where(queue.risk_tier == args.tier) if args.tier else queue
        return fraud.fraud_queue(queue, args.tier)
    if args.name == "segments":
        return kpis.rfm_summary(kpis.rfm_segments(silver("transactions")))
    products = silver("products").withColumnRenamed("id", "product_id")
    if args.name == "inventory":
        stores = staging.stg_stores(silver("stores"))
        return kpis.inventory_alerts(silver("inventory_movements"), products, stores)
    if args.name == "trend":
        forecast = lake.read("gold", "fact_sales_forecast")
        return kpis.sales_trend(silver("transactions"), products, forecast, args.channel, args.category)
    return kpis.overview(
        silver("transactions"), silver("returns"), products, lake.read_audit(), args.channel
    )


def main() -> None:
    parser = argparse.ArgumentParser(prog="tallyforge")
    commands = parser.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--lake", required=True)
    common.add_argument("--master")

    batch = commands.add_parser("run", parents=[common])
    batch.add_argument("--source", required=True)
    batch.add_argument("--format", default="parquet")
    batch.add_argument("--contracts")
    batch.add_argument("--start", help="first day of the calendar; the first day of the facts by default")
    batch.add_argument("--end", help="last day of the calendar; the last day of the facts by default")

    batch.add_argument("--mark", action="append", default=[], metavar="TABLE=COLUMN", help="extract a table by this time column, not whole")
    batch.add_argument("--overlap", default="1 day", help="how far an extract reads back behind the last mark")
    batch.add_argument("--keep", type=int, default=2, help="versions of each table that stay after the run")
    batch.add_argument("--publish", action="store_true", help="also write silver tables to the session's catalog")
    batch.add_argument("--publish-url", help="also write silver tables over JDBC")

    review = commands.add_parser("review", parents=[common])
    review.add_argument("--transaction", required=True)
    review.add_argument("--status", required=True)

    erase = commands.add_parser("erase", parents=[common])
    erase.add_argument("--customers", required=True, help="CSV file with a customer_id column")

    load = commands.add_parser("upload", parents=[common])
    load.add_argument("--file", required=True)
    load.add_argument("--kind", choices=("csv", "json"), default="csv")
    load.add_argument("--table", required=True)
    load.add_argument("--upload-id", help="repeat the printed id to retry an upload; a new one by default")
    load.add_argument("--split", action="store_true", help="read a large file in parallel; no line breaks inside values")

    show = commands.add_parser("report", parents=[common])
    show.add_argument("--name", choices=("overview", "trend", "segments", "inventory", "fraud", "health"), required=True)
    show.add_argument("--channel")
    show.add_argument("--category")
    show.add_argument("--tier")
    show.add_argument("--limit", type=int, help="print the first rows only")
    show.add_argument("--csv", help="folder to export to instead of printing")

    args = parser.parse_args()
    lake = Lakehouse(build_session(master=args.master), args.lake)
    if args.command == "run":
        run(lake, args)
    elif args.command == "review":
        decision = lake.spark.createDataFrame([(args.transaction, args.status)], "transaction_id string, status string")
        medallion.record_review(lake, decision.withColumn("decided_at", F.current_timestamp()))
    elif args.command == "erase":
        privacy.erase_customers(lake, lake.spark.read.option("header", True).csv(args.customers))
    elif args.command == "upload":
        upload_id = args.upload_id or str(uuid.uuid4())
        print(f"upload {upload_id}")
        upload.ingest_upload(lake, args.file, args.kind, args.table, upload_id, multi_line=not args.split)
    else:
        result = report(lake, args)
        if args.csv:
            export_csv(result, args.csv)
        else:
            # everything, a partition at a time; --limit or --csv for large reports
            shown = result.limit(args.limit) if args.limit is not None else result
            print("\t".join(shown.columns))
            for row in shown.toLocalIterator():
                print("\t".join("" if v is None else str(v) for v in row))


if __name__ == "__main__":
    main()
