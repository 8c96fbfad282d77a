"""Micro-batch ingestion: change events to bronze, bronze to silver with quarantine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyforge.contracts import Contract
from tallyforge.operators.bronze import ENVELOPE, SourceSpec, event_time, to_bronze
from tallyforge.operators.latest import apply_changes, latest_by
from tallyforge.plans.silver import RECENCY, tag
from tallyforge.session import shuffles_dropped
from tallyforge.sources.layers import Lakehouse, complete, remove

#: payloads and keys in hex take about half the room that Spark's default, snappy, leaves them
PACKED = {"compression": "zstd"}


def file_source(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options: str
) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def kafka_source(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Raw payloads of a topic with their partition and offset."""
    raw = spark.readStream.format("kafka").options(
        **{"kafka.bootstrap.servers": servers, "subscribe": topic, **options}
    )
    return raw.load().select(
        F.col("value").cast("string").alias("raw_payload"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
    )


def payload_envelope(
    raw: DataFrame, spec: SourceSpec, run_id: str, as_of: Column | None = None
) -> DataFrame:
    """Envelopes of payloads that arrive as JSON text, with the operation in field ``op`` (default C).

    Change-capture events are unwrapped: the row is ``after``, or ``before`` of a deletion, below ``payload`` if there is
    one; operations c, r, u and d count as C, C, U and D. An event without a key is identified by its payload.
    """
    now = (as_of if as_of is not None else F.current_timestamp()).cast("timestamp_ntz")
    root = F.coalesce(F.get_json_object("raw_payload", "$.payload"), F.col("raw_payload"))
    raw = raw.withColumn("_root", root)
    code = F.upper(F.substring(F.get_json_object("_root", "$.op"), 1, 1))
    images = [F.get_json_object("_root", f"$.{name}") for name in ("after", "before")]
    row = F.coalesce(*images, F.col("_root"))
    raw = raw.withColumn("_op", F.coalesce(F.when(code == "R", "C").otherwise(code), F.lit("C")))
    raw = raw.withColumn("_row", F.when(F.col("_op") == "D", F.coalesce(images[1], row)).otherwise(row))
    key = F.get_json_object("_row", f"$.{spec.business_key}")
    raw = raw.withColumn("_identity", F.coalesce(key, F.md5("raw_payload"))).withColumn("raw_payload", F.col("_row"))
    return raw.select(
        F.md5(F.concat_ws("-", F.lit(spec.system), F.lit(spec.table), F.col("_identity"))).alias("event_id"),
        key.alias("business_key"),
        "raw_payload",
        F.lit(spec.system).alias("source_system"),
        F.lit(spec.table).alias("topic_table"),
        F.col("_op").alias("operation_type"),
        event_time("raw_payload", now).alias("event_timestamp"),
        now.alias("ingestion_timestamp"),
        F.lit("1.0").alias("schema_version"),
        F.col("kafka_partition").cast("int").alias("kafka_partition"),
        F.col("kafka_offset").cast("bigint").alias("kafka_offset"),
        F.lit(run_id).alias("pipeline_run_id"),
    )


def stream_bronze(
    envelopes: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"
) -> StreamingQuery:
    """Appends every envelope, late ones included; bronze is never rewritten."""
    return (
        envelopes.writeStream.format(fmt)
        .outputMode("append")
        .options(**(PACKED if fmt == "parquet" else {}))
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_rows_to_bronze(
    rows: DataFrame,
    spec: SourceSpec,
    run_id: str,
    path: str,
    checkpoint: str,
    as_of: Column | None = None,
    operation: Column | None = None,
) -> StreamingQuery:
    return stream_bronze(to_bronze(rows, spec, run_id, as_of=as_of, operation=operation), path, checkpoint)


def stream_unique(
    df: DataFrame, keys: Sequence[str], path: str, checkpoint: str, event_time: str, delay: str = "1 hour"
) -> StreamingQuery:
    """Stores what ``unique_rows`` needs to give the latest copy of every key, by event time.

    Exact repeats that arrive within ``delay`` of each other are dropped by state. Its watermark follows the arrival of
    rows, not their event time: the state is bounded by what arrives within the delay, and no row is ever late for it.

    What gets past it is stored in two lanes. Rows in time, those at most ``delay`` behind the newest event time of the
    batches before, are appended. Late rows, whatever their age, meet the stored rows and are stored unless a newer copy of
    their key is there; batches without late rows never read the history.

    A batch owns the folder of its number and only looks at batches before it, so a replay writes the same rows again.
    """
    spark = df.sparkSession
    arriving = df.withColumn("_arrival", F.current_timestamp()).withWatermark("_arrival", delay)
    once = arriving.dropDuplicatesWithinWatermark(df.columns).drop("_arrival")

    def store(batch: DataFrame, batch_id: int) -> None:
        newest = latest_by(batch, keys, [event_time]).persist()
        before = [n for n in complete(spark, f"{path}/_marks", "batch_id") if n < batch_id]
        late = F.lit(False)
        if before:
            marks = spark.read.parquet(*[f"{path}/_marks/batch_id={n}" for n in before])
            newest_known = marks.agg(F.max("newest")).first()[0]
            if newest_known is not None:
                bound = F.lit(newest_known).cast(df.schema[event_time].dataType) - F.expr(f"INTERVAL {delay}")
                late = F.coalesce(F.col(event_time) < bound, F.lit(False))
        in_time, old = newest.where(~late), newest.where(late)
        if before and not old.isEmpty():
            stored = spark.read.schema(newest.schema).parquet(*[f"{path}/batch_id={n}" for n in before])
            known = stored.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(event_time).alias("_known"))
            beaten = F.col("_known") > F.col(event_time)
            for k in keys:
                beaten = beaten & F.col(k).eqNullSafe(F.col(f"_{k}"))
            in_time = in_time.unionByName(old.join(known, beaten, "left_anti"))
        in_time.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        newest.agg(F.max(event_time).alias("newest")).write.mode("overwrite").parquet(f"{path}/_marks/batch_id={batch_id}")
        newest.unpersist()

    return (
        once.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def unique_rows(spark: SparkSession, path: str, keys: Sequence[str], event_time: str) -> DataFrame:
    """The copy of every key with the latest event time, however late it came; ties by the other columns."""
    folders = [f"{path}/batch_id={n}" for n in complete(spark, f"{path}/_marks", "batch_id")]
    return latest_by(spark.read.parquet(*folders), keys, [event_time])


def stream_silver(
    bronze: DataFrame, contract: Contract, path: str, checkpoint: str, patterns: bool = False
) -> StreamingQuery:
    """Validates each micro-batch and stores it, valid and held-back rows apart.

    A batch owns the folder of its number, so a replay overwrites its own rows only, and a batch
    costs what it brought: latest-wins is settled on read and by ``compact``.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        tagged = tag(batch, contract, patterns)
        tagged = tagged.withColumn("is_valid", F.col("quarantine_reason").isNull())
        tagged.write.mode("overwrite").options(**PACKED).partitionBy("is_valid").parquet(f"{path}/batch_id={batch_id}")

    return (
        bronze.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def silver_schema(spark: SparkSession, contract: Contract) -> T.StructType:
    return tag(spark.createDataFrame([], ENVELOPE), contract).schema


def stored_batches(spark: SparkSession, contract: Contract, path: str, after: int = -1) -> DataFrame:
    """What ``stream_silver`` wrote in the batches after a number, with the schema of the batch step."""
    schema = silver_schema(spark, contract).add("batch_id", T.LongType()).add("is_valid", T.BooleanType())
    folders = [f"{path}/batch_id={n}" for n in complete(spark, path, "batch_id") if n > after]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders)


def silver_state(
    spark: SparkSession, contract: Contract, path: str, keys: Sequence[str] = ("event_id",)
) -> DataFrame:
    """The latest valid event per key, deletions included: the newest compacted state and the batches after it.

    Earlier batches are not opened, so a read costs the state and what came since, not the history.
    """
    compacted = complete(spark, f"{path}/_compacted", "upto")
    upto = compacted[-1] if compacted else -1
    valid = stored_batches(spark, contract, path, upto).where("is_valid").drop("batch_id", "is_valid", "quarantine_reason")
    if compacted:
        valid = compacted_state(spark, contract, path, upto).unionByName(valid)
    return latest_by(valid, keys, RECENCY)


def compacted_state(spark: SparkSession, contract: Contract, path: str, upto: int) -> DataFrame:
    """One state that ``compact`` wrote: a row per key."""
    schema = silver_schema(spark, contract)
    wanted = T.StructType([f for f in schema.fields if f.name != "quarantine_reason"])
    return spark.read.schema(wanted).parquet(f"{path}/_compacted/upto={upto}")


def streamed_silver(
    spark: SparkSession, contract: Contract, path: str, keys: Sequence[str] = ("event_id",)
) -> DataFrame:
    """Current silver rows: the latest valid event per key over all batches, deletions removed."""
    return silver_state(spark, contract, path, keys).where(F.col("operation_type") != "D")


def streamed_quarantine(spark: SparkSession, contract: Contract, path: str) -> DataFrame:
    return stored_batches(spark, contract, path).where(~F.col("is_valid")).drop("batch_id", "is_valid")


def stream_changes(
    changes: DataFrame, keys: Sequence[str], sequence: Sequence[str], path: str, checkpoint: str
) -> StreamingQuery:
    """Stores the last change per key of every micro-batch; ``current_state`` merges them."""

    def store(batch: DataFrame, batch_id: int) -> None:
        latest_by(batch, keys, sequence).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        changes.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_state(
    base: DataFrame, changes: DataFrame, keys: Sequence[str], sequence: Sequence[str]
) -> DataFrame:
    """Base plus all stored changes, in sequence order however they were batched."""
    return apply_changes(base, changes, keys, sequence)


def compact(lake: Lakehouse, contract: Contract, path: str, keys: Sequence[str] = ("event_id",), keep: int = 2) -> str:
    """Folds all complete batches into one state and writes its current rows as a new version of the silver table.

    The state, below ``_compacted``, keeps deletions, so that an older change that comes later does not bring a row back. Its
    folder is named after the last batch in it and counts once it is complete; a lost job leaves the one before in
    place. The newest ``keep`` states stay, for reads under way.
    """
    spark, batches = lake.spark, complete(lake.spark, path, "batch_id")
    done = complete(spark, f"{path}/_compacted", "upto")
    options = PACKED if lake.fmt == "parquet" else {}
    with shuffles_dropped(spark):
        if batches and (not done or done[-1] < batches[-1]):
            state = silver_state(spark, contract, path, keys)
            state.write.mode("overwrite").options(**PACKED).parquet(f"{path}/_compacted/upto={batches[-1]}")
            for old in done[: 1 - keep] if keep > 1 else done:
                remove(spark, f"{path}/_compacted/upto={old}")
            # has a row per key already: nothing is left to deduplicate
            current = compacted_state(spark, contract, path, batches[-1]).where(F.col("operation_type") != "D")
        else:
            current = streamed_silver(spark, contract, path, keys)
        return lake.write(current, "silver", contract.table, **options)
