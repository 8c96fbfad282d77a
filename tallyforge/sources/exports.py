"""CSV exports of serving queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forecast_export(trend: DataFrame) -> DataFrame:
    return trend.select(
        F.col("date_day").cast("string").alias("Date"),
        F.coalesce("actual", F.lit(0)).alias("Actual Sales"),
        F.coalesce("forecast", F.lit(0.0)).alias("Forecast Sales"),
    )


def inventory_export(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        F.coalesce("store_name", "store_id").alias("Store"),
        F.col("product_id").alias("Product ID"),
        F.coalesce("name", F.lit("")).alias("Product Name"),
        F.col("stock_on_hand").alias("Stock Level"),
        F.col("avg_daily_sales").alias("Avg Daily Sales"),
        F.col("sell_through_pct").alias("Sell Through %"),
        F.col("days_of_supply").alias("Days of Supply"),
        F.col("risk_tier").alias("Risk Status"),
        F.col("reorder_suggestion").alias("Reorder Suggestion"),
    )


def export_csv(df: DataFrame, path: str) -> None:
    """Header plus rows; one file per partition, in the order of the frame."""
    df.write.mode("overwrite").option("header", True).csv(path)
