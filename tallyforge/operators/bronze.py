"""Raw rows to immutable event envelopes and back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.contracts import Contract, contract_schema
from tallyforge.functions.temporal import to_second_text

# Columns that may carry the event time, first match wins.
EVENT_TIME_COLUMNS = (
    "transaction_timestamp",
    "updated_at",
    "created_at",
    "ticket_timestamp",
    "return_timestamp",
    "movement_timestamp",
    "campaign_date",
)

ENVELOPE = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("business_key", T.StringType()),
        T.StructField("raw_payload", T.StringType()),
        T.StructField("source_system", T.StringType()),
        T.StructField("topic_table", T.StringType()),
        T.StructField("operation_type", T.StringType()),
        T.StructField("event_timestamp", T.StringType()),
        T.StructField("ingestion_timestamp", T.TimestampNTZType()),
        T.StructField("schema_version", T.StringType()),
        T.StructField("kafka_partition", T.IntegerType()),
        T.StructField("kafka_offset", T.LongType()),
        T.StructField("pipeline_run_id", T.StringType()),
    ]
)


@dataclass(frozen=True)
class SourceSpec:
    table: str
    system: str
    business_key: str = "id"


# Source tables and the systems they come from.
SOURCES = (
    SourceSpec("customers", "CRM"),
    SourceSpec("products", "INVENTORY"),
    SourceSpec("stores", "STORES"),
    SourceSpec("transactions", "POS_WEB_APP"),
    SourceSpec("returns", "RETURNS"),
    SourceSpec("inventory_movements", "INVENTORY"),
    SourceSpec("marketing_campaigns", "MARKETING"),
    SourceSpec("support_tickets", "CRM"),
)


def _payload_value(field: T.StructField) -> Column:
    value = F.col(field.name)
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        value = to_second_text(value)
    elif isinstance(field.dataType, (T.DecimalType, T.DoubleType, T.FloatType, T.DateType)):
        value = value.cast("string")
    return value.alias(field.name)


def to_payload(df: DataFrame) -> Column:
    """The row as JSON: times to the second, fractional numbers as text, NULLs kept."""
    return F.to_json(F.struct(*[_payload_value(f) for f in df.schema.fields]), {"ignoreNullFields": "false"})


def event_time(payload: Column | str, fallback: Column, candidates: Sequence[str] = EVENT_TIME_COLUMNS) -> Column:
    """First non-empty candidate field of a JSON payload, parsed once; else ``fallback``."""
    payload = F.col(payload) if isinstance(payload, str) else payload
    fields = T.StructType([T.StructField(c, T.StringType()) for c in candidates])
    # the lambda binds the parsed struct, so the JSON is read once and not once per field
    found = F.transform(
        F.array(F.from_json(payload, fields)),
        lambda row: F.coalesce(*[F.nullif(row.getField(c), F.lit("")) for c in candidates]),
    )
    return F.coalesce(found.getItem(0), to_second_text(fallback))


def _column_time(df: DataFrame, fallback: Column, candidates: Sequence[str]) -> Column:
    # same rule on a frame whose columns are still at hand: no JSON to parse
    present = {f.name: f for f in df.schema.fields}
    found = [
        F.nullif(_payload_value(present[c]).cast("string"), F.lit("")) for c in candidates if c in present
    ]
    return F.coalesce(*found, to_second_text(fallback))


def to_bronze(
    df: DataFrame,
    spec: SourceSpec,
    run_id: str,
    *,
    as_of: Column | None = None,
    operation: Column | None = None,
    candidates: Sequence[str] = EVENT_TIME_COLUMNS,
) -> DataFrame:
    """Wraps source rows into envelopes; ``as_of`` fixes the ingestion time for reruns."""
    now = (as_of if as_of is not None else F.current_timestamp()).cast("timestamp_ntz")
    key = F.col(spec.business_key).cast("string")
    enveloped = df.select(
        F.md5(F.concat_ws("-", F.lit(spec.system), F.lit(spec.table), key)).alias("event_id"),
        key.alias("business_key"),
        to_payload(df).alias("raw_payload"),
        F.lit(spec.system).alias("source_system"),
        F.lit(spec.table).alias("topic_table"),
        (operation if operation is not None else F.lit("C")).alias("operation_type"),
        _column_time(df, now, candidates).alias("event_timestamp"),
        now.alias("ingestion_timestamp"),
        F.lit("1.0").alias("schema_version"),
        F.lit(0).alias("kafka_partition"),
        F.lit(0).cast("bigint").alias("kafka_offset"),
        F.lit(run_id).alias("pipeline_run_id"),
    )
    return enveloped


def parse_bronze(bronze: DataFrame, contract: Contract) -> DataFrame:
    """Payload columns of the contract next to the envelope columns; a field that does not fit is NULL.

    The struct is unpacked by a generator: as plain field references Catalyst would copy the parse
    into every column and into every rule that is pushed down as a filter.
    """
    return bronze.select(
        "event_id",
        "operation_type",
        "event_timestamp",
        F.col("ingestion_timestamp").alias("bronze_ingestion_time"),
        F.col("pipeline_run_id").alias("bronze_run_id"),
        F.inline_outer(F.array(F.from_json("raw_payload", contract_schema(contract)))),
    )
