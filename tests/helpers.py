from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F


def ts(text):
    return datetime.fromisoformat(text)


def money(text):
    return Decimal(text)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def as_of(text="2026-07-01 00:00:00"):
    return F.lit(text).cast("timestamp_ntz")


TX = (
    "id string, transaction_id string, customer_id string, store_id string, channel string, product_id string,"
    " quantity int, unit_price decimal(18,2), discount decimal(18,2), transaction_timestamp timestamp_ntz"
)


def sale(i, customer, when, *, tx=None, qty=1, price="10.00", discount="0.00", product="P1", channel="POS", store="S1"):
    return (
        i,
        tx or f"T{i}",
        customer,
        store,
        channel,
        product,
        qty,
        None if price is None else money(price),
        money(discount) if discount is not None else None,
        ts(when),
    )
