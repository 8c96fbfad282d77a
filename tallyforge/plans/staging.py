"""Staging projections: silver columns renamed and cast for the star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.measures import MONEY


def _time(silver: DataFrame, name: str) -> Column:
    # envelope times are text and get parsed; real timestamps pass without a detour through text
    text = isinstance(silver.schema[name].dataType, T.StringType)
    column = F.col(name)
    return column.try_cast("timestamp_ntz") if text else column.cast("timestamp_ntz")


def stg_customers(silver: DataFrame) -> DataFrame:
    return silver.select(
        F.col("id").alias("customer_id"),
        "first_name",
        "last_name",
        "email",
        "phone",
        "gender",
        "state",
        "birth_date",
        _time(silver, "event_timestamp").alias("updated_at"),
    )


def stg_products(silver: DataFrame) -> DataFrame:
    return silver.select(
        F.col("id").alias("product_id"),
        "sku",
        "name",
        "category",
        F.col("price").cast(MONEY).alias("price"),
        F.col("cost").cast(MONEY).alias("cost"),
        _time(silver, "event_timestamp").alias("updated_at"),
    )


def stg_stores(silver: DataFrame) -> DataFrame:
    return silver.select(
        F.col("id").alias("store_id"), F.col("name").alias("store_name"), "city", "state", "country"
    )


def stg_transactions(silver: DataFrame) -> DataFrame:
    return silver.select(
        F.col("id").alias("transaction_line_id"),
        "transaction_id",
        "customer_id",
        "store_id",
        "channel",
        "product_id",
        F.col("quantity").cast("int").alias("quantity"),
        F.col("unit_price").cast(MONEY).alias("unit_price"),
        F.col("discount").cast(MONEY).alias("discount"),
        _time(silver, "transaction_timestamp").alias("transaction_timestamp"),
    )


def stg_returns(silver: DataFrame) -> DataFrame:
    return silver.select(
        F.col("id").alias("return_id"),
        "transaction_id",
        "product_id",
        F.col("quantity").cast("int").alias("quantity"),
        F.col("refund_amount").cast(MONEY).alias("refund_amount"),
        "return_reason",
        _time(silver, "return_timestamp").alias("return_timestamp"),
    )


def stg_inventory_movements(silver: DataFrame) -> DataFrame:
    return silver.select(
        F.col("id").alias("movement_id"),
        "product_id",
        "store_id",
        "movement_type",
        F.col("quantity").cast("int").alias("quantity"),
        _time(silver, "movement_timestamp").alias("movement_timestamp"),
    )


def stg_marketing_campaigns(silver: DataFrame) -> DataFrame:
    counts = [F.col(c).cast("int").alias(c) for c in ("impressions", "clicks", "conversions")]
    return silver.select(
        F.col("id").alias("campaign_id"),
        "campaign_name",
        "channel",
        F.col("cost").cast(MONEY).alias("cost"),
        *counts,
        F.col("campaign_date").try_cast("date").alias("campaign_date"),
    )


def stg_support_tickets(silver: DataFrame) -> DataFrame:
    return silver.select(
        F.col("id").alias("ticket_id"),
        "customer_id",
        "issue_category",
        "status",
        "priority",
        _time(silver, "ticket_timestamp").alias("ticket_timestamp"),
        _time(silver, "resolution_timestamp").alias("resolution_timestamp"),
    )


STAGING: dict[str, Callable[[DataFrame], DataFrame]] = {
    "customers": stg_customers,
    "products": stg_products,
    "stores": stg_stores,
    "transactions": stg_transactions,
    "returns": stg_returns,
    "inventory_movements": stg_inventory_movements,
    "marketing_campaigns": stg_marketing_campaigns,
    "support_tickets": stg_support_tickets,
}


def register_staging(silver: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Staging frames of the given silver tables, also registered as views ``stg_<name>``."""
    staged = {name: STAGING[name](df) for name, df in silver.items()}
    for name, df in staged.items():
        df.createOrReplaceTempView(f"stg_{name}")
    return staged
