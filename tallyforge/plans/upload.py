"""Upload of one file: adapt, upsert into the source table, refresh silver and the analytics."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.operators.latest import upsert_by_key
from tallyforge.plans import forecast, fraud
from tallyforge.plans.silver import light_silver
from tallyforge.sources.layers import Lakehouse, same_keys
from tallyforge.sources.uploads import TABLE_COLUMNS, adapt_upload, read_upload, target_schema

LIGHT_TABLES = ("transactions", "products", "customers", "stores", "returns")


def shaped_types(target: DataFrame | None, table: str) -> dict[str, T.DataType]:
    """The table's columns: those it has keep their type, the others of its definition have the contract's."""
    have = {f.name: f.dataType for f in target.schema} if target is not None else {}
    return {**have, **{f.name: f.dataType for f in target_schema(table) if f.name not in have}}


def shaped_rows(target: DataFrame | None, rows: DataFrame, table: str) -> DataFrame:
    """Uploaded rows with every column of the table. Values that do not fit their type become NULL and are left to the
    contract's checks."""
    return rows.select(
        *[
            rows[c].try_cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c)
            for c, t in shaped_types(target, table).items()
        ]
    )


def merge_upload(target: DataFrame | None, rows: DataFrame, table: str) -> DataFrame:
    """The source table with the uploaded rows in place of their earlier versions.

    The table has every column of its definition from its first upload on, so files of different shapes meet.
    """
    shaped = shaped_rows(target, rows, table)
    if target is None:
        return shaped
    missing = {c: F.lit(None).cast(t) for c, t in shaped_types(target, table).items() if c not in target.columns}
    return upsert_by_key(target.withColumns(missing), shaped, ["id"])


def ingest_upload(
    lake: Lakehouse,
    path: str,
    kind: str,
    table: str,
    upload: str | None = None,
    as_of: Column | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Runs the upload and returns the new source table.

    ``upload`` identifies the upload, not the file: repeat it to retry, leave it out for a new one.
    """
    upload = upload or str(uuid.uuid4())
    if table not in TABLE_COLUMNS:
        raise ValueError(f"unknown table {table}")
    raw = read_upload(lake.spark, path, kind, multi_line)
    if raw.isEmpty():
        raise ValueError("uploaded file contains no rows")
    target = lake.read("source", table)
    shaped = shaped_rows(target, adapt_upload(raw, table, upload, as_of), table)
    # the file is read once; what follows costs as much as the rows it changes
    rows = lake.spark.read.schema(shaped.schema).format(lake.fmt).load(lake.write(shaped, "staged", f"upload_{table}"))
    ids = rows.select("id")
    lake.replace_keys("source", table, ids, rows, ["id"])

    if table in LIGHT_TABLES:
        fresh = light_silver(table, rows)
        before = lake.read_keys("light", table, ids, ["id"])
        if before is None and lake.read("light", table) is None:
            everything = light_silver(table, lake.read("source", table))
            lake.replace_keys("light", table, everything.select("id"), everything, ["id"])
        else:
            lake.replace_keys("light", table, ids, fresh, ["id"])
        changed = fresh if before is None else before.unionByName(fresh, allowMissingColumns=True)
        refresh_changed(lake, table, changed, as_of)
    return lake.read("source", table)


def affected_customers(lake: Lakehouse, table: str, changed: DataFrame) -> DataFrame | None:
    """Customers whose scores depend on the changed rows, old and new; None where no score does."""
    if table == "transactions":
        return changed.select("customer_id").distinct()
    if table == "customers":
        return changed.select(F.col("id").cast("string").alias("customer_id")).distinct()
    if table == "returns":
        bought = same_keys(lake.read("light", "transactions"), changed, ["transaction_id"], "left_semi")
        return bought.select("customer_id").distinct()
    return None


def refresh_changed(lake: Lakehouse, table: str, changed: DataFrame, as_of: Column | None = None) -> None:
    """Brings forecast and fraud scores up to date after rows of one table changed; ``changed`` has them as they were and as they are.

    Only the customers concerned are scored again, over all their sales, and only the days concerned are summed again. The
    forecast is fitted anew from the stored daily sums, a few rows a day. Customers who are not concerned keep their scores and
    their reviews. Nothing happens until all tables are there; then all customers and days count once.
    """
    light = {t: lake.read("light", t) for t in ("transactions", "products", "returns", "customers")}
    if any(df is None for df in light.values()):
        return
    sales, returns, customers = light["transactions"], light["returns"], light["customers"]
    products = light["products"].withColumnRenamed("id", "product_id")

    queue = lake.read("gold", "fact_fraud_queue")
    concerned = affected_customers(lake, table, changed) if queue is not None else sales.select("customer_id").distinct()
    if concerned is not None:
        concerned = lake.spark.read.format(lake.fmt).load(lake.write(concerned, "staged", "concerned_customers"))
        if queue is not None:
            sales = same_keys(sales, concerned, ["customer_id"], "left_semi")
            returns = same_keys(returns, sales, ["transaction_id"], "left_semi")
            people = concerned.withColumnRenamed("customer_id", "id")
            customers = same_keys(customers, people, ["id"], "left_semi")
        scores = fraud.score_fraud(sales, returns, customers, as_of=as_of)
        lake.replace_keys("gold", "fact_fraud_queue", concerned, scores, ["customer_id"])

    days = lake.read("staged", "daily_sales")
    if table == "transactions" or days is None or table == "products":
        sold = light["transactions"].withColumn("date_day", F.to_date("transaction_timestamp"))
        dates = sold.select("date_day")
        if days is not None and table == "transactions":
            dates = changed.select(F.to_date("transaction_timestamp").alias("date_day"))
            sold = same_keys(sold, dates, ["date_day"], "left_semi")
        lake.replace_keys("staged", "daily_sales", dates, forecast.labelled_sales(sold, products), ["date_day"])
        stored = lake.read("staged", "daily_sales")
        if stored is not None:
            features = lake.write(forecast.features_of(stored), "staged", "forecast_features")
            features = lake.spark.read.format(lake.fmt).load(features)
            lake.write(forecast.forecast(features, as_of=as_of), "gold", "fact_sales_forecast")
