"""Serving queries: executive overview, sales trend, segments, inventory risk, run health, BI measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.measures import MONEY, lenient_net_sales
from tallyforge.functions.temporal import whole_days_between
from tallyforge.operators.series import last_n
from tallyforge.plans.facts import PAIR

# Score shown while no audit exists, and the score of an empty system.
DEFAULT_QUALITY = 98.4
EMPTY_QUALITY = 100.0

# Inventory planning.
SALES_DAYS = 30
FALLBACK_RATE = 0.1
HIGH_RISK_DAYS = 5
MEDIUM_RISK_DAYS = 15


def one_slice(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Rows of one slice; no value or ALL means no filter."""
    return df if value in (None, "", "ALL") else df.where(F.col(column) == value)


def align_returns(returns: DataFrame, sales: DataFrame) -> DataFrame:
    """Returns whose transaction is among the sales."""
    return returns.join(sales.select("transaction_id").distinct(), "transaction_id", "left_semi")


def with_cost(sales: DataFrame, products: DataFrame) -> DataFrame:
    costs = products.select("product_id", "cost")
    return sales.join(costs, "product_id", "left").withColumn("cost", F.coalesce("cost", F.lit(0)))


def with_category(sales: DataFrame, products: DataFrame) -> DataFrame:
    return sales.join(products.select("product_id", "category"), "product_id", "left")


def total_cost(sales: DataFrame, products: DataFrame) -> DataFrame:
    """One row: quantity times product cost. Quantities are summed per product before the join."""
    quantities = sales.groupBy("product_id").agg(F.sum("quantity").alias("quantity"))
    costed = with_cost(quantities, products)
    return costed.agg(F.coalesce(F.sum(F.col("quantity") * F.col("cost")), F.lit(0)).alias("total_cost"))


def quality_score(audit: DataFrame | None, default: float = DEFAULT_QUALITY) -> Column:
    if audit is None:
        return F.lit(default)
    return F.coalesce(audit.agg(F.avg("quality_score").alias("q")).scalar(), F.lit(default))


def _percent(part: Column, whole: Column) -> Column:
    ratio = F.try_divide(part.cast("double"), whole.cast("double")) * 100
    return F.when(whole > 0, F.bround(ratio, 2)).otherwise(F.lit(0.0))


def overview(
    sales: DataFrame,
    returns: DataFrame,
    products: DataFrame,
    audit: DataFrame | None = None,
    channel: str | None = None,
) -> DataFrame:
    """One row of headline figures, optionally for one channel.

    Each input is reduced to one row by its own partial aggregation; the rows meet as scalar
    subqueries.
    """
    picked = sales
    if channel:
        picked = sales.where(F.col("channel") == channel)
        returns = align_returns(returns, picked)
    net = (F.col("quantity") * F.col("unit_price") - F.col("discount")).cast(MONEY)
    figures = picked.agg(
        F.coalesce(F.sum(net), F.lit(0)).alias("revenue"),
        F.count_distinct("customer_id").alias("active_customers"),
        F.count_if(F.col("quantity") < 0).alias("alert_count"),
    )
    refunds = returns.agg(F.coalesce(F.sum("refund_amount"), F.lit(0)).alias("refunds"))
    any_sale = sales.agg(F.count(F.lit(1)).alias("n"))
    filled = figures.select(
        "*",
        total_cost(picked, products).scalar().alias("_cost"),
        refunds.scalar().alias("_refunds"),
        any_sale.scalar().alias("_n"),
        quality_score(audit).alias("_quality"),
    )
    quality = F.when(F.col("_n") == 0, F.lit(EMPTY_QUALITY)).otherwise(F.col("_quality"))
    return filled.select(
        F.col("revenue").cast("decimal(38,2)").alias("revenue"),
        _percent(F.col("revenue") - F.col("_cost"), F.col("revenue")).alias("margin_pct"),
        _percent(F.col("_refunds"), F.col("revenue")).alias("return_rate_pct"),
        "active_customers",
        F.bround(quality, 1).alias("dq_score"),
        "alert_count",
    )


def daily_sales(sales: DataFrame) -> DataFrame:
    """Net sales per day; rows without a readable time have no day and drop out."""
    return (
        sales.select(F.to_date("transaction_timestamp").alias("date_day"), lenient_net_sales().alias("net"))
        .where(F.col("date_day").isNotNull())
        .groupBy("date_day")
        .agg(F.sum("net").cast("decimal(38,2)").alias("actual"))
    )


def forecast_slice(forecast: DataFrame, channel: str | None, category: str | None) -> DataFrame:
    """Forecast rows of the slice, or of ALL/ALL when the slice has none."""
    wanted = (F.col("channel") == (channel or "ALL")) & (F.col("category") == (category or "ALL"))
    total = (F.col("channel") == "ALL") & (F.col("category") == "ALL")
    ranked = forecast.where(wanted | total).withColumn("_exact", wanted)
    best = ranked.agg(F.max("_exact").alias("m")).scalar()
    return ranked.where(F.col("_exact") == best).drop("_exact")


def actual_vs_forecast(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    both = actual.join(
        forecast.select("date_day", F.col("forecast_sales").alias("forecast")), "date_day", "full_outer"
    )
    return both.select(
        "date_day",
        F.coalesce("actual", F.lit(0)).cast("decimal(38,2)").alias("actual"),
        F.coalesce("forecast", F.lit(0)).cast("double").alias("forecast"),
    )


def sales_trend(
    sales: DataFrame,
    products: DataFrame,
    forecast: DataFrame,
    channel: str | None = None,
    category: str | None = None,
    days: int = 20,
) -> DataFrame:
    """The last days of actual against forecast sales of a slice, oldest first."""
    picked = one_slice(sales, "channel", channel)
    if category not in (None, "", "ALL"):
        picked = one_slice(with_category(picked, products), "category", category)
    series = actual_vs_forecast(daily_sales(picked), forecast_slice(forecast, channel, category))
    return last_n(series, "date_day", days)


def trend_metrics(
    forecast: DataFrame, channel: str | None = None, category: str | None = None
) -> DataFrame:
    """MAE, RMSE and WAPE recorded with the forecast of the slice, zeros where there is none."""
    picked = forecast_slice(forecast, channel, category).agg(F.min("metrics_json").alias("m"))
    parsed = F.from_json("m", "mae double, rmse double, wape double")
    return picked.select(
        *[F.coalesce(parsed.getField(k), F.lit(0.0)).alias(k) for k in ("mae", "rmse", "wape")]
    )


def rfm(sales: DataFrame) -> DataFrame:
    """Recency in whole days to the newest sale of anyone, distinct transactions, net sales."""
    newest = sales.agg(F.max("transaction_timestamp").alias("t")).scalar()
    per_customer = (
        sales.where(F.col("customer_id").isNotNull())
        .select("customer_id", "transaction_id", "transaction_timestamp", lenient_net_sales().alias("net"))
        .groupBy("customer_id")
        .agg(
            F.max("transaction_timestamp").alias("_last"),
            F.count_distinct("transaction_id").alias("frequency"),
            F.sum("net").cast("decimal(38,2)").alias("monetary"),
        )
    )
    return per_customer.withColumn("_newest", newest).select(
        "customer_id",
        whole_days_between("_last", "_newest").alias("recency"),
        "frequency",
        "monetary",
    )


def rfm_segments(sales: DataFrame) -> DataFrame:
    r, f, m = F.col("recency"), F.col("frequency"), F.col("monetary")
    # Segment thresholds, first match wins.
    segment = (
        F.when((r <= 7) & (f >= 5) & (m >= 1000), "Champions")
        .when((r <= 14) & (f >= 3), "Loyal Customers")
        .when((r > 20) & (f >= 3), "At Risk")
        .when((r <= 10) & (f == 1), "New Customers")
        .otherwise("Hibernating")
    )
    return rfm(sales).withColumn("segment", segment)


def rfm_summary(segments: DataFrame) -> DataFrame:
    """Customers per segment, with the share of repeat buyers and the total of all segments."""
    per_segment = segments.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("frequency") > 1).alias("_repeat"),
    )
    totals = per_segment.agg(F.sum("customers").alias("n"), F.sum("_repeat").alias("r"))
    rate = totals.select((F.col("r") * 100).cast("double") / F.col("n").cast("double"))
    return per_segment.select(
        "segment",
        "customers",
        F.bround(rate.scalar(), 2).alias("retention_rate"),
        totals.select("n").scalar().alias("total_scored"),
    )


def stock_with_rate(movements: DataFrame, days: int = SALES_DAYS) -> DataFrame:
    """Stock on hand and average daily sales per (product, store) in one aggregation."""
    sold = F.sum(F.when(F.col("movement_type") == "SALE", F.abs("quantity")))
    return movements.groupBy("product_id", "store_id").agg(
        F.greatest(F.sum("quantity"), F.lit(0)).alias("stock_on_hand"),
        F.coalesce(sold.cast("double") / F.lit(float(days)), F.lit(FALLBACK_RATE)).alias("avg_daily_sales"),
    )


def with_names(df: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    named = df.join(products.select("product_id", "name", "price"), "product_id", "left")
    return named.join(stores.select("store_id", "store_name"), "store_id", "left")


def inventory_levels(movements: DataFrame) -> DataFrame:
    """Supply, sell-through, risk tier and reorder quantity per (product, store)."""
    stock = F.col("stock_on_hand").cast("double")
    rate = F.col("avg_daily_sales")
    demand = rate * SALES_DAYS
    # a pair with SALE rows of zero quantity has no rate: endless supply, or none to speak of
    days = (
        F.when(rate > 0, F.try_divide(stock, rate))
        .when(stock > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("nan")))
    )
    tier = (
        F.when(days < HIGH_RISK_DAYS, "High").when(days < MEDIUM_RISK_DAYS, "Medium").otherwise("Low")
    )
    sell_through = F.coalesce(F.try_divide(demand, demand + stock) * 100, F.lit(0.0))
    finite = days < F.lit(float("inf"))
    return stock_with_rate(movements).select(
        "product_id",
        "store_id",
        "stock_on_hand",
        F.bround(rate, 2).alias("avg_daily_sales"),
        F.when(finite, F.bround(F.when(finite, days), 1)).otherwise(days).alias("days_of_supply"),
        F.bround(sell_through, 1).alias("sell_through_pct"),
        tier.alias("risk_tier"),
        F.bround(F.greatest(demand - stock, F.lit(0.0)), 0).cast("bigint").alias("reorder_suggestion"),
    )


def sort_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy("days_of_supply", "product_id", "store_id")


def inventory_alerts(movements: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    return sort_alerts(with_names(inventory_levels(movements), products, stores))


def run_health(audit: DataFrame) -> DataFrame:
    """Audit rows with a derived status and the incident text of tables with held-back rows."""
    held = F.col("quarantine_count")
    status = (
        F.when(~F.col("reconciled"), "Failed").when(held > 0, "Degraded").otherwise("Healthy")
    )
    incident = F.concat(
        held.cast("string"),
        F.lit(" records failed null checks or format enums and were quarantined."),
    )
    return audit.withColumns({"status": status, "incident": F.when(held > 0, incident)})


def incidents(audit: DataFrame) -> DataFrame:
    return run_health(audit).where(F.col("quarantine_count") > 0)


def _sum_by(df: DataFrame, by: Sequence[str], column: str, out: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(column).alias(out))


def bi_measures(
    sales: DataFrame, returns: DataFrame, by: Sequence[str], forecast: DataFrame | None = None
) -> DataFrame:
    """Revenue, cost, margin, refunds and forecast variance sliced by shared columns.

    Each fact is aggregated to the slice first; the joins only see one row per slice.
    """
    by = list(by)
    figures = sales.groupBy(*by).agg(
        F.sum("net_sales").alias("total_revenue"), F.sum("total_cost").alias("total_cost")
    )
    figures = figures.join(_sum_by(returns, by, "refund_amount", "total_refund"), by, "full_outer")
    if forecast is not None:
        figures = figures.join(_sum_by(forecast, by, "forecast_sales", "forecast_sales"), by, "full_outer")
    else:
        figures = figures.withColumn("forecast_sales", F.lit(0.0))
    money = {
        c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,2)")
        for c in ("total_revenue", "total_cost", "total_refund")
    }
    figures = figures.withColumns({**money, "forecast_sales": F.coalesce("forecast_sales", F.lit(0.0))})
    revenue = F.col("total_revenue").cast("double")

    def divide(part: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), revenue), F.lit(0.0))

    return figures.withColumns(
        {
            "gross_margin_pct": divide(F.col("total_revenue") - F.col("total_cost")),
            "return_rate_pct": divide(F.col("total_refund")),
            "forecast_variance": revenue - F.col("forecast_sales"),
        }
    )


def current_stock(levels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stock on the last date of the context: the last level of every pair, from the stock changes or any snapshot. Stock
    does not add up over time, and no calendar has to be unrolled for one day."""
    last_day = levels.agg(F.max("date_day").alias("d")).scalar()
    newest = levels.groupBy(*PAIR).agg(F.max_by("stock_on_hand", "date_day").alias("stock_on_hand"))
    summed = newest.groupBy(*by).agg(F.sum("stock_on_hand").alias("current_stock"))
    return summed.select(last_day.alias("date_day"), *by, "current_stock")


def revenue_by(sales: DataFrame, dim: DataFrame, key: str, label: str) -> DataFrame:
    """Revenue per dimension label; facts are summed per key before they meet the dimension."""
    per_key = _sum_by(sales, [key], "net_sales", "revenue")
    named = per_key.join(dim.select(key, label), key)
    return named.groupBy(label).agg(F.sum("revenue").cast("decimal(38,2)").alias("revenue"))


def customers_by(dim: DataFrame, segment: str) -> DataFrame:
    return dim.groupBy(segment).agg(F.count_distinct("customer_id").alias("customers"))
