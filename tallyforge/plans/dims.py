"""Dimensions of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.keys import surrogate_key, version_key
from tallyforge.functions.measures import promotion_name, promotion_rate, promotion_tier
from tallyforge.functions.temporal import iso_day_of_week
from tallyforge.operators.series import date_series
from tallyforge.operators.timeline import neighbour_time, scd2

# Validity bounds of open versions.
FOREVER = "9999-12-31 23:59:59"
FOREVER_DATE = "9999-12-31"
BEGINNING = "1970-01-01 00:00:00"


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def dim_date(spark: SparkSession, start: str = "2026-01-01", end: str = "2026-12-31") -> DataFrame:
    day = F.col("date_day")
    weekday = iso_day_of_week(day)
    return date_series(spark, start, end).select(
        day,
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.dayofmonth(day).alias("day"),
        weekday.alias("day_of_week"),
        F.date_format(day, "EEEE").alias("day_name"),
        F.quarter(day).alias("quarter"),
        weekday.isin(6, 7).alias("is_weekend"),
    )


def _versions(stg: DataFrame, key: str, name: str, gap_seconds: int, whole: int) -> DataFrame:
    attributes = [c for c in stg.columns if c not in (key, "updated_at")]
    versions = scd2(
        stg, key, "updated_at", gap_seconds=gap_seconds, open_end=_ntz(FOREVER), ties=attributes, whole=whole
    )
    return versions.select(
        version_key(key, "updated_at").alias(name), key, *attributes, "valid_from", "valid_to", "is_current"
    )


def dim_customer(stg: DataFrame, gap_seconds: int = 1, whole: int = 0) -> DataFrame:
    return _versions(stg, "customer_id", "customer_key", gap_seconds, whole)


def dim_product(stg: DataFrame, gap_seconds: int = 1, whole: int = 0) -> DataFrame:
    return _versions(stg, "product_id", "product_key", gap_seconds, whole)


def dim_campaign(stg: DataFrame) -> DataFrame:
    """Versions per campaign day, distinct after the look-ahead.

    Copies of a campaign day only matter as "one" or "several" (several leave an empty interval
    behind), so they are counted before the window and at most two are laid out again.
    """
    attributes = ["campaign_id", "campaign_name", "channel", "campaign_date"]
    counted = stg.groupBy(*attributes).agg(F.least(F.count(F.lit(1)), F.lit(2)).alias("_n"))
    laid_out = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    following = neighbour_time(
        laid_out, "campaign_id", "campaign_date", "_next", ties=["campaign_name", "channel", "_copy"]
    )
    versions = following.drop("_copy", "_n").distinct()
    return versions.select(
        version_key("campaign_id", "campaign_date").alias("campaign_key"),
        "campaign_id",
        "campaign_name",
        "channel",
        F.col("campaign_date").alias("valid_from"),
        F.coalesce("_next", F.lit(FOREVER_DATE).cast("date")).alias("valid_to"),
        F.col("_next").isNull().alias("is_current"),
    )


def dim_store(stg: DataFrame) -> DataFrame:
    return stg.select(
        surrogate_key(F.col("store_id"), F.lit("_1970-01-01")).alias("store_key"),
        "store_id",
        "store_name",
        "city",
        "state",
        "country",
        _ntz(BEGINNING).alias("valid_from"),
        _ntz(FOREVER).alias("valid_to"),
        F.lit(True).alias("is_current"),
    )


def dim_channel(stg_transactions: DataFrame) -> DataFrame:
    channels = stg_transactions.select("channel").distinct()
    return channels.select(F.md5("channel").alias("channel_key"), F.col("channel").alias("channel_name"))


def dim_promotion(stg_transactions: DataFrame) -> DataFrame:
    tiers = stg_transactions.select(
        promotion_tier("discount").alias("promotion_id"),
        promotion_name("discount").alias("promotion_name"),
        promotion_rate("discount").alias("discount_rate"),
    ).distinct()
    return tiers.select(F.md5("promotion_id").alias("promotion_key"), *tiers.columns)
