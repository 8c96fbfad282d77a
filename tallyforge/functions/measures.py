"""Business measures shared by facts and serving queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

# Tier id, tier name, nominal rate and highest discount of the tier.
PROMOTION_TIERS = (
    ("PROMO-NONE", "No Promotion", "0.00", "0"),
    ("PROMO-SEASONAL", "Seasonal Sale (Up to $5)", "0.10", "5"),
    ("PROMO-LOYALTY", "Loyalty Rewards Tier", "0.20", "15"),
    ("PROMO-FLASH", "Flash Sale Special", "0.35", None),
)


def _tier_choice(discount: Column, values: list[Column]) -> Column:
    none, seasonal, loyalty, flash = values
    # a missing discount satisfies none of the comparisons and so lands in the last tier
    return (
        F.when(discount == 0, none)
        .when(discount <= int(PROMOTION_TIERS[1][3]), seasonal)
        .when(discount <= int(PROMOTION_TIERS[2][3]), loyalty)
        .otherwise(flash)
    )


def promotion_tier(discount: Column | str) -> Column:
    discount = F.col(discount) if isinstance(discount, str) else discount
    return _tier_choice(discount, [F.lit(t[0]) for t in PROMOTION_TIERS])


def promotion_name(discount: Column | str) -> Column:
    discount = F.col(discount) if isinstance(discount, str) else discount
    return _tier_choice(discount, [F.lit(t[1]) for t in PROMOTION_TIERS])


def promotion_rate(discount: Column | str) -> Column:
    discount = F.col(discount) if isinstance(discount, str) else discount
    return _tier_choice(discount, [F.lit(t[2]).cast("decimal(3,2)") for t in PROMOTION_TIERS])


def net_sales(quantity: str = "quantity", price: str = "unit_price", discount: str = "discount") -> Column:
    return (F.col(quantity) * F.col(price) - F.col(discount)).cast(MONEY)


def lenient_net_sales() -> Column:
    """Net sales with unreadable or missing quantity as 1, price and discount as 0."""
    quantity = F.coalesce(F.col("quantity").try_cast(MONEY), F.lit(1))
    price = F.coalesce(F.col("unit_price").try_cast(MONEY), F.lit(0))
    discount = F.coalesce(F.col("discount").try_cast(MONEY), F.lit(0))
    return (quantity * price - discount).cast(MONEY)


def sales_measures(df: DataFrame, cost: str = "cost") -> DataFrame:
    """Adds net_sales, total_cost and gross_margin; a missing cost counts as zero."""
    net = net_sales()
    total_cost = (F.col("quantity") * F.coalesce(F.col(cost), F.lit(0))).cast(MONEY)
    return df.withColumns(
        {"net_sales": net, "total_cost": total_cost, "gross_margin": (net - total_cost).cast(MONEY)}
    )


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient, 0 unless the denominator is positive."""
    return F.when(
        denominator > 0, numerator.cast("double") / denominator.cast("double")
    ).otherwise(F.lit(0.0))
