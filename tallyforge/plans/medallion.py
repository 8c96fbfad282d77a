"""The batch run: sources to bronze to silver to star schema to gold tables."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyforge.contracts import CONTRACTS, Contract
from tallyforge.operators.bronze import SOURCES, SourceSpec, to_bronze
from tallyforge.operators.latest import latest_by
from tallyforge.plans import dims, facts, forecast, fraud
from tallyforge.plans.silver import DEDUP_KEYS, VERSION_KEYS, audit_row, current_rows, deduplicate, split, tag
from tallyforge.plans.staging import STAGING
from tallyforge.sources.layers import Lakehouse, publish, same_keys

log = logging.getLogger(__name__)

# tables whose silver keeps every version, so that dimensions have a history
VERSIONED = ("customers", "products")


def ingest(
    lake: Lakehouse, source: DataFrame | None, spec: SourceSpec, run_id: str, as_of: Column | None = None
) -> bool:
    """Source rows to bronze. False, and nothing written, for an empty source."""
    if source is None or source.isEmpty():
        return False
    lake.write(to_bronze(source, spec, run_id, as_of=as_of), "bronze", spec.table)
    return True


EXTRACTS, MARKS = "extracts", "marks"


def ingest_since(
    lake: Lakehouse,
    source: DataFrame | None,
    spec: SourceSpec,
    run_id: str,
    mark: str,
    overlap: str = "1 day",
    as_of: Column | None = None,
) -> bool:
    """Appends the envelopes of what changed since the last extract: rows whose ``mark`` (a time or date) is at most
    ``overlap`` older than the highest mark extracted so far, and rows without one. The first extract reads everything.

    The filter is a plain comparison with a constant, so file and database sources prune with it. The overlap catches rows that
    were committed late; what it reads again is settled by ``extracted``. A run appends its rows before its mark: a lost or repeated
    run reads from the older mark and replaces its own rows. False, and nothing written, where nothing is new.
    """
    if source is None:
        return False
    known = lake.read_runs(MARKS, spec.table)
    high = None if known is None else known.where(F.col("run_id") != run_id).agg(F.max("high")).first()[0]
    rows = source
    if high is not None:
        since = (F.lit(high).cast("timestamp_ntz") - F.expr(f"INTERVAL {overlap}")).cast(source.schema[mark].dataType)
        rows = source.where((F.col(mark) >= since) | F.col(mark).isNull())
    if rows.isEmpty():
        return False
    lake.append_run(to_bronze(rows, spec, run_id, as_of=as_of), EXTRACTS, spec.table, run_id)
    reached = rows.agg(F.max(F.col(mark).cast("timestamp_ntz")).alias("high")).where("high IS NOT NULL")
    lake.append_run(reached, MARKS, spec.table, run_id)
    return True


def extracted(lake: Lakehouse, table: str) -> DataFrame | None:
    """The envelopes of all extracts, each version of a row (its event id and time) once, as it was read last."""
    log_ = lake.read_runs(EXTRACTS, table)
    if log_ is None:
        return None
    return latest_by(log_.drop("run_id"), ["event_id", "event_timestamp"], ["ingestion_timestamp"])


def bronze_rows(lake: Lakehouse, table: str) -> DataFrame | None:
    """Bronze of a table: its extracts where it is extracted by mark, else its last full copy."""
    rows = extracted(lake, table)
    return rows if rows is not None else lake.read("bronze", table)


def ingest_all(
    lake: Lakehouse,
    read: Callable[[str], DataFrame | None],
    run_id: str,
    specs: Iterable[SourceSpec] = SOURCES,
    as_of: Column | None = None,
    marks: Mapping[str, str] | None = None,
    overlap: str = "1 day",
) -> dict[str, str]:
    """Every source table; one that fails is reported and does not stop the others. Tables named in ``marks`` are
    extracted by their high-water mark, the others copied whole."""
    outcome = {}
    for spec in specs:
        try:
            mark = (marks or {}).get(spec.table)
            source = read(spec.table)
            came = ingest_since(lake, source, spec, run_id, mark, overlap, as_of) if mark else ingest(lake, source, spec, run_id, as_of)
            outcome[spec.table] = "written" if came else "empty"
        except Exception as error:  # noqa: BLE001 - a broken source must not stop the run
            log.exception("ingest of %s failed", spec.table)
            outcome[spec.table] = f"failed: {error}"
    return outcome


def clean_table(
    lake: Lakehouse,
    contract: Contract,
    run_id: str,
    *,
    keys: Sequence[str] | None = None,
    as_of: Column | None = None,
) -> bool:
    """Bronze to silver for one table, with quarantine and audit. False where bronze has nothing.

    The tagged rows are written once, split by outcome. Silver and quarantine then read that table, so the JSON is parsed a single
    time and a lost executor costs no re-parse. Rows are counted while they are written, in the stage that writes them, where
    each task counts once: nothing is read again for the audit.
    """
    bronze = bronze_rows(lake, contract.table)
    if bronze is None:
        return False
    keys = keys or (VERSION_KEYS if contract.table in VERSIONED else DEDUP_KEYS)
    tagged = tag(bronze, contract).withColumn("is_valid", F.col("quarantine_reason").isNull())
    came, kept = Observation(), Observation()
    outcomes = {"bronze_count": F.count(F.lit(1)), "_valid": F.count_if("is_valid"), "quarantine_count": F.count_if(~F.col("is_valid"))}
    counted = tagged.observe(came, *[c.alias(name) for name, c in outcomes.items()])
    staged_path = lake.write(counted, "staged", contract.table, partition_by=("is_valid",))
    staged = lake.spark.read.schema(tagged.schema).format(lake.fmt).load(staged_path)

    valid, quarantined = split(staged)
    distinct = deduplicate(valid.drop("is_valid"), keys).observe(kept, F.count(F.lit(1)).alias("silver_count"))
    lake.write(distinct, "silver", contract.table)
    counts = {name: 0 for name in outcomes} | came.get
    counts["silver_count"] = kept.get.get("silver_count", 0)
    if counts["quarantine_count"]:
        lake.append_run(quarantined.drop("is_valid"), "quarantine", contract.table, run_id)

    row = (*(counts[c] for c in ("bronze_count", "silver_count", "quarantine_count", "_valid")), counts["_valid"] - counts["silver_count"])
    columns = "bronze_count long, silver_count long, quarantine_count long, _valid long, duplicate_count long"
    entry = lake.spark.createDataFrame([row], columns)
    lake.append_audit(audit_row(entry, contract.table, as_of), f"{run_id}-{contract.table}")
    return True


def clean_all(
    lake: Lakehouse,
    run_id: str,
    contracts: Mapping[str, Contract] = CONTRACTS,
    as_of: Column | None = None,
) -> dict[str, bool]:
    return {name: clean_table(lake, c, run_id, as_of=as_of) for name, c in contracts.items()}


def current_silver(lake: Lakehouse, name: str) -> DataFrame | None:
    """Silver rows for serving: one per member, also where silver keeps the history."""
    silver = lake.read("silver", name)
    return current_rows(silver) if silver is not None and name in VERSIONED else silver


def publish_silver(lake: Lakehouse, **jdbc: str) -> list[str]:
    """Publishes the current rows of every silver table; returns the warehouse tables."""
    tables = {name: current_silver(lake, name) for name in STAGING}
    return [publish(df, name, **jdbc) for name, df in tables.items() if df is not None]


def record_review(lake: Lakehouse, decisions: DataFrame) -> None:
    """Stores the fraud queue with the reviewers' decisions. Only the customers whose transactions were decided are written again."""
    queue = lake.read("gold", "fact_fraud_queue")
    if queue is None:
        raise ValueError("there is no fraud queue to review")
    concerned = same_keys(queue, decisions, ["transaction_id"], "left_semi").select("customer_id").distinct()
    rows = lake.read_keys("gold", "fact_fraud_queue", concerned, ["customer_id"])
    if rows is not None:
        lake.replace_keys("gold", "fact_fraud_queue", concerned, fraud.apply_review(rows, decisions), ["customer_id"])


def staged_tables(lake: Lakehouse) -> dict[str, DataFrame]:
    """Staging projections of every silver table that exists."""
    silver = {name: lake.read("silver", name) for name in STAGING}
    return {name: STAGING[name](df) for name, df in silver.items() if df is not None}


def build_star(
    lake: Lakehouse, start: str | None = None, end: str | None = None, as_of: Column | None = None
) -> dict[str, DataFrame]:
    """Dimensions, then facts over the stored dimensions, each written to the gold layer.

    The calendar runs from ``start`` to ``end``, by default from the first to the last day that sales or movements have.
    Stock counts all movements, those before the calendar as its opening balance.

    Writing dimensions first keeps their windows from being planned again inside every fact.
    Facts lie in one folder per day, so a query over some days reads those days only; stock lies in one per month.
    """
    stg = staged_tables(lake)
    today = as_of if as_of is not None else F.current_date()
    star: dict[str, DataFrame] = {}

    def store(name: str, df: DataFrame, by: str = "date_day") -> DataFrame:
        folders = (by,) if name.startswith("fact_") else ()
        path = lake.write(df, "gold", name, partition_by=folders, cluster=bool(folders))
        # with its schema: a table may have no rows, and then no files
        star[name] = lake.spark.read.schema(df.schema).format(lake.fmt).load(path)
        return star[name]

    if start is None or end is None:
        dated = [stg["transactions"].select(F.to_date("transaction_timestamp").alias("date_day"))]
        if "inventory_movements" in stg:
            dated.append(stg["inventory_movements"].select(F.to_date("movement_timestamp").alias("date_day")))
        low, high = reduce(DataFrame.unionByName, dated).agg(F.min("date_day"), F.max("date_day")).first()
        start, end = start or str(low), end or str(high)
    store("dim_date", dims.dim_date(lake.spark, start, end))
    customer = store("dim_customer", dims.dim_customer(stg["customers"]))
    product = store("dim_product", dims.dim_product(stg["products"]))
    shop = store("dim_store", dims.dim_store(stg["stores"]))
    tx = stg["transactions"]
    store("dim_channel", dims.dim_channel(tx))
    store("dim_promotion", dims.dim_promotion(tx))
    store("fact_sales_line", facts.fact_sales_line(tx, customer, product, shop))
    if "returns" in stg:
        store("fact_return_line", facts.fact_return_line(stg["returns"], product))
    if "support_tickets" in stg:
        store("fact_support_ticket", facts.fact_support_ticket(stg["support_tickets"], customer))
    if "marketing_campaigns" in stg:
        campaign = store("dim_campaign", dims.dim_campaign(stg["marketing_campaigns"]))
        store("fact_marketing_daily", facts.fact_marketing_daily(stg["marketing_campaigns"], campaign))
    if "inventory_movements" in stg:
        moves = store(
            "fact_inventory_movement",
            facts.fact_inventory_movement(stg["inventory_movements"], product, shop),
        )
        # the daily snapshot is unrolled on demand from its changes and the balances of its months
        changes = store("fact_inventory_change", facts.monthly_changes(moves), "month")
        openings = store("fact_inventory_opening", facts.opening_balances(changes), "month")
        last = lake.spark.range(1).select(F.least(F.lit(end).cast("date"), today.cast("date"))).first()[0]
        star["fact_inventory_daily_snapshot"] = facts.snapshot_range(changes, openings, date.fromisoformat(start), last)
    activity = facts.fact_customer_activity(tx, stg.get("returns"), stg.get("support_tickets"), customer)
    store("fact_customer_activity", activity)
    return star


def refresh_analytics(
    lake: Lakehouse,
    sales: DataFrame,
    products: DataFrame,
    returns: DataFrame,
    customers: DataFrame,
    as_of: Column | None = None,
) -> None:
    """Replaces the forecast and fraud tables of the gold layer.

    ``sales``, ``returns`` and ``customers`` are silver rows (with ``id``); ``products`` is staged.
    """
    features = forecast.forecast_features(sales, products)
    feature_path = lake.write(features, "staged", "forecast_features")
    stored = lake.spark.read.format(lake.fmt).load(feature_path)
    lake.write(forecast.forecast(stored, as_of=as_of), "gold", "fact_sales_forecast")
    lake.write(fraud.score_fraud(sales, returns, customers, as_of=as_of), "gold", "fact_fraud_queue")
