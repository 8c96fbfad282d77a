"""Bronze to silver: parse, standardise, validate, split, deduplicate, reconcile."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.contracts import Contract, quarantine_reason
from tallyforge.functions.temporal import parse_ntz, to_second_text
from tallyforge.operators.bronze import parse_bronze
from tallyforge.operators.latest import delete_keys, latest_by

# Columns whose text is upper-cased.
UPPER_COLUMNS = ("gender", "state")

DEDUP_KEYS = ("event_id",)
# keeps every version of a dimension member instead of the newest only
VERSION_KEYS = ("event_id", "event_timestamp")
RECENCY = ("event_timestamp", "bronze_ingestion_time")


@dataclass(frozen=True)
class CleanResult:
    tagged: DataFrame
    valid: DataFrame
    quarantined: DataFrame
    audit: DataFrame


def standardize(df: DataFrame, contract: Contract) -> DataFrame:
    """Trims text, upper-cases the code columns and parses the timestamp columns."""
    changes = {}
    for rule in contract.columns:
        value = F.col(rule.name)
        if rule.type == "string":
            value = F.trim(value)
            if rule.name in UPPER_COLUMNS:
                value = F.upper(value)
        if rule.name in contract.timestamps:
            value = parse_ntz(value)
        changes[rule.name] = value
    return df.withColumns(changes)


def tag(bronze: DataFrame, contract: Contract, patterns: bool = False) -> DataFrame:
    """Every bronze row, cleaned, with the reason it must be held back or NULL."""
    cleaned = standardize(parse_bronze(bronze, contract), contract)
    return cleaned.withColumn("quarantine_reason", quarantine_reason(contract, patterns))


def split(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined); the valid side loses the reason column."""
    bad = F.col("quarantine_reason").isNotNull()
    return tagged.where(~bad).drop("quarantine_reason"), tagged.where(bad)


def deduplicate(
    valid: DataFrame, keys: Sequence[str] = DEDUP_KEYS, order: Sequence[str] = RECENCY
) -> DataFrame:
    return latest_by(valid, keys, order)


def current_rows(silver: DataFrame) -> DataFrame:
    """The newest version of every member of a table that keeps versions."""
    return latest_by(silver, DEDUP_KEYS, RECENCY)


def reconcile(
    tagged: DataFrame, table: str, *, keys: Sequence[str] = DEDUP_KEYS, as_of: Column | None = None
) -> DataFrame:
    """One audit row: what came in, what was kept, held back or dropped as a duplicate."""
    valid = F.col("quarantine_reason").isNull()
    counts = tagged.agg(
        F.count(F.lit(1)).alias("bronze_count"),
        F.count_if(valid).alias("_valid"),
        F.count_if(~valid).alias("quarantine_count"),
        F.count_distinct(F.when(valid, F.struct(*keys))).alias("silver_count"),
    )
    return audit_row(
        counts.withColumn("duplicate_count", F.col("_valid") - F.col("silver_count")), table, as_of
    )


def audit_row(counts: DataFrame, table: str, as_of: Column | None = None) -> DataFrame:
    """Audit columns from bronze, silver, quarantine and duplicate counts."""
    now = (as_of if as_of is not None else F.current_timestamp()).cast("timestamp_ntz")
    accounted = F.col("silver_count") + F.col("quarantine_count") + F.col("duplicate_count")
    share = F.bround(
        F.try_divide((F.col("silver_count") * 100).cast("double"), F.col("bronze_count").cast("double")), 2
    )
    return counts.select(
        to_second_text(now).alias("timestamp"),
        F.lit(table).alias("table_name"),
        "bronze_count",
        "silver_count",
        "quarantine_count",
        "duplicate_count",
        (F.col("bronze_count") == accounted).alias("reconciled"),
        F.coalesce(share, F.lit(100.0)).alias("quality_score"),
    )


def clean(
    bronze: DataFrame,
    contract: Contract,
    *,
    keys: Sequence[str] = DEDUP_KEYS,
    patterns: bool = False,
    as_of: Column | None = None,
) -> CleanResult:
    """The whole step, lazily. ``plans.medallion`` runs it with a staged tagged table."""
    tagged = tag(bronze, contract, patterns)
    valid, quarantined = split(tagged)
    return CleanResult(
        tagged=tagged,
        valid=deduplicate(valid, keys),
        quarantined=quarantined,
        audit=reconcile(tagged, contract.table, keys=keys, as_of=as_of),
    )


def upsert_audit(audit: DataFrame, new: DataFrame) -> DataFrame:
    """Audit with the entries of the same tables replaced."""
    return delete_keys(audit, new, ["table_name"]).unionByName(new)


def light_silver(name: str, df: DataFrame) -> DataFrame:
    """Shortcut from a source table to silver without envelopes."""
    # Columns kept per table.
    columns = {
        "transactions": (
            "id", "transaction_id", "customer_id", "store_id", "channel", "product_id", "quantity", "unit_price", "discount",
            "transaction_timestamp",
        ),
        "products": ("id", "sku", "name", "category", "price", "cost"),
        "customers": ("id", "first_name", "last_name", "email", "phone", "gender", "state", "birth_date"),
        "stores": ("id", "name", "city", "state", "country", "square_footage", "open_date"),
        "returns": (
            "id", "transaction_id", "product_id", "quantity", "refund_amount", "return_reason", "return_timestamp",
        ),
    }
    if name not in columns:
        raise ValueError(f"no shortcut for table {name}")
    if name == "transactions":
        df = df.where((F.col("quantity").try_cast("double") > 0) & (F.col("unit_price").try_cast("double") > 0))
    elif name == "customers":
        df = df.where(F.col("email").like("%@%"))
    return df.select(*[c for c in columns[name] if c in df.columns])
