"""Explainable fraud scoring and the review queue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.measures import MONEY
from tallyforge.operators.latest import latest_by
from tallyforge.operators.timeline import trailing_counts


@dataclass(frozen=True)
class FraudRules:
    """Thresholds and points of the scoring rules."""

    high_value: int = 1500
    high_value_points: int = 35
    medium_value: int = 800
    medium_value_points: int = 15
    window_seconds: int = 3600
    high_velocity: int = 5
    high_velocity_points: int = 40
    elevated_velocity: int = 3
    elevated_velocity_points: int = 20
    email_points: int = 15
    trusted_domain: str = "@example.com"
    bad_email_mark: str = "malformed"
    gender_points: int = 10
    genders: tuple[str, ...] = ("M", "F", "OTHER", "UNKNOWN")
    min_lines: int = 3
    return_ratio: float = 0.4
    return_points: int = 20
    cap: int = 100
    high_tier: int = 70
    medium_tier: int = 35
    version: str = "1.0.0"
    window_name: str = "hour"


REVIEW_STATUSES = ("Approved", "Dismissed", "Pending")


def returned_quantity(returns: DataFrame) -> DataFrame:
    return returns.groupBy("transaction_id").agg(F.sum("quantity").alias("returned_qty"))


def with_returned_qty(sales: DataFrame, returns: DataFrame) -> DataFrame:
    """Sales lines with the quantity returned on their transaction, 0 for none."""
    joined = sales.join(returned_quantity(returns), "transaction_id", "left")
    return joined.withColumn("returned_qty", F.coalesce("returned_qty", F.lit(0)))


def return_ratio(sales: DataFrame, returns: DataFrame) -> DataFrame:
    """Per customer: sales lines, return rows on the customer's transactions and their ratio.

    A transaction shared by two customers counts for both. Lines and returns are reduced to one
    row per (customer, transaction) and per transaction before they meet.
    """
    visits = (
        sales.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id", "transaction_id")
        .agg(F.count(F.lit(1)).alias("_lines"))
    )
    per_transaction = returns.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("_returns"))
    joined = visits.join(per_transaction, "transaction_id", "left")
    return (
        joined.groupBy("customer_id")
        .agg(
            F.sum("_lines").alias("line_count"),
            F.coalesce(F.sum("_returns"), F.lit(0)).alias("return_count"),
        )
        .withColumn("return_ratio", F.col("return_count").cast("double") / F.col("line_count").cast("double"))
    )


def first_profile(customers: DataFrame) -> DataFrame:
    """One profile per customer id."""
    profile = customers.select(F.col("id").alias("customer_id"), "email", "gender")
    return latest_by(profile, ["customer_id"], ["email", "gender"])


def _append(points: int, text: Column) -> Column:
    return F.struct(F.lit(points).alias("points"), text.alias("text"))


def score_fraud(
    sales: DataFrame,
    returns: DataFrame,
    customers: DataFrame,
    rules: FraudRules | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """Score, tier and reasons of every sales line.

    Everything a rule needs about a customer is worked out per (customer, time) on narrow
    columns, so the sales lines themselves are shuffled once, on a key that spreads a busy
    customer over time.
    """
    rules = rules or FraudRules()
    now = (as_of if as_of is not None else F.current_timestamp()).cast("timestamp_ntz")
    ts = "transaction_timestamp"

    profiles = first_profile(customers).withColumn("_known", F.lit(True))
    about = return_ratio(sales, returns).join(profiles, "customer_id", "left")
    undated = (
        sales.where(F.col("customer_id").isNotNull() & F.col(ts).isNull())
        .select("customer_id", ts, F.lit(None).cast("bigint").alias("_velocity"))
        .distinct()
    )
    context = (
        trailing_counts(sales, "customer_id", ts, rules.window_seconds, "_velocity")
        .unionByName(undated)
        .join(about, "customer_id", "left")
        .select(
            F.col("customer_id").alias("_customer"),
            F.col(ts).alias("_at"),
            *["_velocity", "line_count", "return_ratio", "email", "gender", "_known"],
        )
    )

    price = F.coalesce(F.col("unit_price"), F.lit(0))
    quantity = F.coalesce(F.col("quantity"), F.lit(0))
    value = (price * quantity - F.coalesce(F.col("discount"), F.lit(0))).cast(MONEY)
    lines = sales.select(
        F.col("id").alias("transaction_line_id"), "transaction_id", "customer_id", ts, value.alias("net_sales")
    ).join(
        context,
        (F.col("customer_id") == F.col("_customer")) & F.col(ts).eqNullSafe(F.col("_at")),
        "left",
    )

    amount = F.format_string("%.2f", F.col("net_sales").cast("double"))
    count = F.col("_velocity").cast("string")
    percent = F.bround(F.col("return_ratio") * 100, 0).cast("bigint").cast("string")
    email = F.coalesce(F.col("email"), F.lit(""))

    by_value = F.when(
        F.col("net_sales") > rules.high_value,
        _append(
            rules.high_value_points,
            F.concat(
                F.lit("High order value of $"), amount, F.lit(f" (exceeds threshold of ${rules.high_value})")
            ),
        ),
    ).when(
        F.col("net_sales") > rules.medium_value,
        _append(rules.medium_value_points, F.concat(F.lit("Medium-high order value of $"), amount)),
    )
    suffix = F.lit(f" transactions in the last {rules.window_name}")
    by_velocity = F.when(
        F.col("_velocity") >= rules.high_velocity,
        _append(
            rules.high_velocity_points, F.concat(F.lit("High transaction velocity: "), count, suffix)
        ),
    ).when(
        F.col("_velocity") >= rules.elevated_velocity,
        _append(
            rules.elevated_velocity_points, F.concat(F.lit("Elevated transaction velocity: "), count, suffix)
        ),
    )
    by_email = F.when(
        F.col("_known") & ~email.contains(rules.trusted_domain) & email.contains(rules.bad_email_mark),
        _append(rules.email_points, F.lit("Customer profile has invalid/malformed email syntax")),
    )
    by_gender = F.when(
        F.col("_known") & ~F.coalesce(F.col("gender").isin(list(rules.genders)), F.lit(False)),
        _append(
            rules.gender_points,
            F.concat(
                F.lit("Customer profile has unrecognized gender code '"),
                F.coalesce("gender", F.lit("None")),
                F.lit("'"),
            ),
        ),
    )
    by_returns = F.when(
        (F.col("line_count") >= rules.min_lines) & (F.col("return_ratio") > rules.return_ratio),
        _append(
            rules.return_points,
            F.concat(F.lit("Customer has a high return frequency ratio ("), percent, F.lit("%)")),
        ),
    )

    fired = F.array_compact(F.array(by_value, by_velocity, by_email, by_gender, by_returns))
    scored = lines.withColumn("_fired", fired).withColumn(
        "fraud_score",
        F.least(
            F.aggregate("_fired", F.lit(0), lambda total, f: total + f["points"]), F.lit(rules.cap)
        ),
    )
    tier = (
        F.when(F.col("fraud_score") >= rules.high_tier, "High")
        .when(F.col("fraud_score") >= rules.medium_tier, "Medium")
        .otherwise("Low")
    )
    texts = F.when(F.size("_fired") > 0, F.transform("_fired", lambda f: f["text"])).otherwise(
        F.array(F.lit("Normal purchase indicators"))
    )
    return scored.select(
        "transaction_line_id",
        "transaction_id",
        "customer_id",
        ts,
        "net_sales",
        "fraud_score",
        tier.alias("risk_tier"),
        F.to_json(texts).alias("risk_factors"),
        F.lit(rules.version).alias("score_version"),
        F.when(tier == "Low", "Approved").otherwise("Pending").alias("review_status"),
        now.alias("created_at"),
    )


def fraud_queue(queue: DataFrame, tier: str | None = None) -> DataFrame:
    """The queue with its reasons as an array; text that is no JSON list becomes a list of one."""
    picked = queue.where(F.col("risk_tier") == tier) if tier else queue
    decoded = F.from_json("risk_factors", "array<string>")
    return picked.withColumn("risk_factors", F.coalesce(decoded, F.array("risk_factors")))


def apply_review(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Queue with the latest decision of each transaction on all of its lines.

    ``decisions`` has transaction_id, status and decided_at. A status that is not allowed fails
    the job instead of being skipped.
    """
    allowed = F.col("status").isin(list(REVIEW_STATUSES))
    message = F.concat(
        F.lit("Invalid status. Must be Approved, Dismissed, or Pending: "),
        F.coalesce("status", F.lit("NULL")),
    )
    checked = decisions.withColumn(
        "status", F.when(allowed, F.col("status")).otherwise(F.raise_error(message))
    )
    latest = latest_by(
        checked.select("transaction_id", "decided_at", "status"), ["transaction_id"], ["decided_at"]
    )
    joined = queue.join(latest.select("transaction_id", "status"), "transaction_id", "left")
    decided = joined.withColumn("review_status", F.coalesce("status", "review_status"))
    return decided.select(*queue.columns)
