"""Uploaded files: reading, column harmonisation, defaults and ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.contracts import CONTRACTS, TIMESTAMP_COLUMNS
from tallyforge.functions.temporal import parse_any, to_second_text

# Accepted header spellings per canonical column.
_SPELLINGS = {
    "transaction_id": ["order id", "order_id", "invoiceno", "invoice_no", "invoice"],
    "transaction_timestamp": ["order date", "order_date", "invoicedate", "date", "timestamp"],
    "customer_id": ["customer id", "customer_id", "customerno"],
    "product_id": ["product id", "product_id", "item_id", "stockcode"],
    "store_id": ["store id", "store_id", "store"],
    "unit_price": ["sales", "price", "amount", "total_amount"],
    "quantity": ["quantity", "qty", "quantity_ordered"],
    "discount": ["discount", "discount_rate"],
    "channel": ["ship mode", "channel", "sales_channel"],
    "name": ["product name", "product_name", "item_name", "description"],
    "category": ["sub-category", "sub_category", "category"],
    "cost": ["cost"],
    "first_name": ["customer name", "customer_name", "full_name"],
    "email": ["email"],
    "phone": ["phone"],
    "gender": ["gender"],
    "state": ["state"],
}

# Columns of the target tables.
TABLE_COLUMNS = {
    "customers": (
        "id", "first_name", "last_name", "email", "phone", "gender", "state", "birth_date", "created_at", "updated_at",
    ),
    "products": ("id", "sku", "name", "category", "price", "cost", "created_at", "updated_at"),
    "stores": ("id", "name", "city", "state", "country", "square_footage", "open_date"),
    "transactions": (
        "id", "transaction_id", "customer_id", "store_id", "channel", "product_id", "quantity", "unit_price", "discount",
        "transaction_timestamp", "created_at",
    ),
    "returns": ("id", "transaction_id", "product_id", "quantity", "refund_amount", "return_reason", "return_timestamp"),
    "inventory_movements": ("id", "product_id", "store_id", "movement_type", "quantity", "movement_timestamp"),
    "marketing_campaigns": (
        "id", "campaign_name", "channel", "cost", "impressions", "clicks", "conversions", "campaign_date",
    ),
    "support_tickets": (
        "id", "customer_id", "issue_category", "status", "priority", "ticket_timestamp", "resolution_timestamp",
    ),
}

TYPES = {"integer": T.IntegerType(), "decimal": T.DecimalType(18, 2), "double": T.DoubleType(), "date": T.DateType()}

# Headers that name the row id of these tables.
_OWN_ID = {
    "customers": ["customer_id", "customer id", "customerno"],
    "products": ["product_id", "product id"],
    "stores": ["store_id", "store id"],
}


def synonyms(table: str) -> dict[str, str]:
    """Header to canonical column for one target table.

    A header that is a column of the table itself keeps its name (``price`` of products is not a
    ``unit_price``), and a customers or products file's own id column becomes ``id``.
    """
    own = set(TABLE_COLUMNS.get(table, ()))
    mapping = {s: c for c, spellings in _SPELLINGS.items() for s in spellings}
    mapping.update({s: "id" for s in _OWN_ID.get(table, [])})
    return {s: c for s, c in mapping.items() if s not in own or s == c}


def target_schema(table: str) -> T.StructType:
    """Column names and types of a source table: the contract's, timestamps read, everything else text."""
    contract = CONTRACTS[table]
    types = {r.name: TYPES.get(r.type, T.StringType()) for r in contract.columns}
    types.update({c: T.TimestampNTZType() for c in TIMESTAMP_COLUMNS if c != "birth_date"})
    return T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in TABLE_COLUMNS[table]])


def read_upload(spark: SparkSession, path: str, kind: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header (columns as text) or JSON records; bad bytes are replaced.

    With ``multi_line`` quoted values may hold line breaks, and a JSON file may be one array; such a file is one task.
    Without it files are split and read in parallel, JSON has a record a line, and a CSV row that does not
    have the header's number of values fails the upload rather than shifting columns.
    """
    if kind == "csv":
        mode = "PERMISSIVE" if multi_line else "FAILFAST"
        return spark.read.options(header=True, mode=mode, encoding="UTF-8", escape='"', multiLine=multi_line).csv(path)
    if kind == "json":
        return spark.read.option("multiLine", multi_line).json(path)
    raise ValueError(f"unsupported upload kind {kind}")


def harmonize_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Lower-cased, trimmed headers, known spellings renamed, later duplicates dropped.

    A spelling is only renamed while the canonical column is not in the file itself.
    """
    headers = [c.strip().lower() for c in df.columns]
    canonical = [mapping[h] if h in mapping and mapping[h] not in headers else h for h in headers]
    plain = df.toDF(*[f"_c{i}" for i in range(len(headers))])
    first = {}
    for i, name in enumerate(canonical):
        first.setdefault(name, i)
    return plain.select(*[F.col(f"_c{i}").alias(name) for name, i in first.items()])


def apply_defaults(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Missing transaction columns filled in, unreadable times replaced by now."""
    now = to_second_text((as_of if as_of is not None else F.current_timestamp()).cast("timestamp_ntz"))
    # Defaults of an uploaded transaction.
    defaults = {
        "quantity": F.lit(1),
        "unit_price": F.lit(100.0),
        "discount": F.lit(0.0),
        "channel": F.lit("WEBSITE"),
    }
    filled = df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})
    if "transaction_timestamp" in df.columns:
        parsed = to_second_text(parse_any(F.col("transaction_timestamp").cast("string")))
        return filled.withColumn("transaction_timestamp", F.coalesce(parsed, now))
    return filled.withColumn("transaction_timestamp", now)


def ensure_id(df: DataFrame, upload: str) -> DataFrame:
    """Keeps the ids when every row has its own, else gives all rows new ones.

    New ids hash the upload's id with the row's place in the file split, so a retried task or a repeated
    upload under the same id repeats them, and no two uploads share one. NULL ids count as equal to each other.
    """
    fresh = F.md5(F.concat_ws("-", F.lit(upload), F.monotonically_increasing_id().cast("string")))
    if "id" not in df.columns:
        return df.withColumn("id", fresh)
    per_id = df.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    repeated = per_id.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).scalar() > 1
    return df.withColumn("_fresh", fresh).withColumn(
        "id", F.when(repeated, F.col("_fresh")).otherwise(F.col("id").cast("string"))
    ).drop("_fresh")


def project_to(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the target's columns, in file order."""
    return df.select(*[c for c in df.columns if c in set(columns)])


def adapt_upload(df: DataFrame, table: str, upload: str, as_of: Column | None = None) -> DataFrame:
    """Harmonised, completed and identified rows, ready for the target table."""
    shaped = harmonize_columns(df, synonyms(table))
    if table == "transactions":
        shaped = apply_defaults(shaped, as_of)
    return project_to(ensure_id(shaped, upload), TABLE_COLUMNS[table])
