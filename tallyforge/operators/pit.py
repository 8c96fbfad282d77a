"""Point-in-time joins of facts to versioned dimensions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.temporal import hour_chunk

_WINDOW_COLS = ("_from", "_to")
#: what a version carries anyway: taken columns that are a bound do not travel twice
_BOUNDS = dict(zip(("valid_from", "valid_to"), _WINDOW_COLS))


def _dimension(dim: DataFrame, key: str, take: Mapping[str, str]) -> DataFrame:
    return dim.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"),
        F.col("valid_from").alias("_from"),
        F.col("valid_to").alias("_to"),
        *[F.col(source).alias(f"_take_{name}") for name, source in take.items() if source not in _BOUNDS],
    )


def _finish(fact: DataFrame, joined: DataFrame, take: Mapping[str, str]) -> DataFrame:
    return joined.select(*fact.columns, *[F.col(_BOUNDS.get(source, f"_take_{n}")).alias(n) for n, source in take.items()])


def interval_join(
    fact: DataFrame, dim: DataFrame, *, key: str, ts: str, take: Mapping[str, str], dim_key: str | None = None
) -> DataFrame:
    """Left join on the key with ``valid_from <= ts < valid_to`` as a residual condition.

    For dimensions with few versions per key. Spark broadcasts the dimension when its size
    allows and otherwise sort-merges on the key, where AQE splits a dominant fact key.
    """
    versions = _dimension(dim, dim_key or key, take)
    inside = (F.col(ts) >= F.col("_from")) & (F.col(ts) < F.col("_to"))
    return _finish(fact, fact.join(versions, (F.col(key) == F.col("_key")) & inside, "left"), take)


def _chunk_of(ts: Column, level: Column) -> Column:
    """Running number of the year, month, day or hour the time falls in."""
    return (
        F.when(level == 0, F.year(ts).cast("bigint"))
        .when(level == 1, (F.year(ts) * 12 + F.month(ts)).cast("bigint"))
        .when(level == 2, F.unix_date(F.to_date(ts)).cast("bigint"))
        .otherwise(hour_chunk(ts))
    )


def pit_join(
    fact: DataFrame,
    dim: DataFrame,
    *,
    key: str,
    ts: str,
    take: Mapping[str, str],
    dim_key: str | None = None,
) -> DataFrame:
    """Left as-of join for dimensions with any number of versions per key.

    The versions of a key must not overlap, as ``scd2`` guarantees. Facts and versions meet on (key, chunk), every version in all
    chunks it is valid in. A key's chunks are years, or the finest of months, days and hours of which the dimension's calendar has no more
    than the key has versions: each version then has about two rows, a fact is compared with the few versions of its chunk, never with the
    key's whole history, and a key with many versions spreads over its chunks. Only the keys with other chunks than years are
    broadcast, fewer than a twelfth of the versions for each year. What lies behind the year of the last version is one chunk.
    ``take`` maps output names to dimension columns.
    """
    versions = _dimension(dim, dim_key or key, take)
    payload = [c for c in versions.columns if c != "_key"]
    usable = versions.where(F.col("_from").isNotNull() & (F.col("_from") < F.col("_to")))
    began = usable.agg(F.min(F.year("_from")).alias("first"), F.max(F.year("_from")).alias("last"))
    years = began.select(F.col("last") - F.col("first") + 1).scalar()
    end = began.select(F.make_timestamp_ntz(F.col("last") + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))).scalar()

    def chunk(time: str) -> Column:
        return _chunk_of(F.least(F.col(time).cast("timestamp_ntz"), end), F.coalesce("_level", F.lit(0)))

    n = F.col("_n")
    level = F.when(n >= years * 8784, 3).when(n >= years * 366, 2).when(n >= years * 12, 1)
    fine = usable.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_key").alias("_fine"), level.alias("_level"))
    fine = F.broadcast(fine.where(F.col("_level").isNotNull()))
    spread = usable.join(fine, F.col("_key") == F.col("_fine"), "left")
    candidates = spread.select(
        F.col("_key").alias("_dim_key"), *payload, F.explode(F.sequence(chunk("_from"), chunk("_to"))).alias("_dim_chunk")
    )

    # rows without a key match nothing and spread over their hours
    place = F.when(F.col(key).isNull(), hour_chunk(ts)).otherwise(chunk(ts))
    placed = fact.join(fine, F.col(key) == F.col("_fine"), "left").withColumn("_fact_chunk", place)
    # merged, not broadcast: the size of stored versions, some bytes a row, says little of what they take in memory
    joined = placed.drop("_fine", "_level").join(
        candidates.hint("merge"),
        (F.col(key) == F.col("_dim_key"))
        & (F.col("_fact_chunk") == F.col("_dim_chunk"))
        & (F.col(ts) >= F.col("_from"))
        & (F.col(ts) < F.col("_to")),
        "left",
    )
    return _finish(fact, joined, take)
