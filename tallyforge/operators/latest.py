"""Keyed latest-wins operators: deduplication, upsert, change application."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``order``, ties settled by the remaining columns.

    ``row_number = 1`` plans as a group limit that each task applies before the shuffle, so a
    key with any number of copies sends one row per task.
    """
    rest = [c for c in df.columns if c not in set(keys) | set(order)]
    ranking = [F.col(c).desc_nulls_last() for c in [*order, *rest]]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*ranking)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def delete_keys(target: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Target rows whose key is not listed."""
    return target.join(keys.select(*on).distinct(), list(on), "left_anti").select(*target.columns)


def append(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(rows, allowMissingColumns=True).select(*target.columns)


def upsert_by_key(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target without the updated keys, plus every update row."""
    return append(delete_keys(target, updates, keys), updates)


def apply_changes(
    base: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    sequence: Sequence[str],
    operation: str = "operation_type",
) -> DataFrame:
    """State after a change log with operations C, U and D, in either case.

    Per key the change that is last in ``sequence`` decides: D removes the row, C and U replace
    it. Late changes lose to newer ones already in the log, so replays are harmless.
    """
    last = latest_by(changes, keys, sequence)
    kept = delete_keys(base, last, keys)
    return append(kept, last.where(F.coalesce(F.upper(operation), F.lit("U")) != "D"))


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def check_freshness(df: DataFrame, ts: str, max_hours: int, as_of: Column) -> DataFrame:
    """Newest event, its age in hours at ``as_of`` and whether the promise is kept."""
    from tallyforge.functions.temporal import hours_between

    newest = df.agg(F.max(ts).alias("newest"))
    age = hours_between(F.col("newest"), as_of)
    return newest.select(
        "newest",
        age.alias("age_hours"),
        F.coalesce(age <= max_hours, F.lit(False)).alias("is_fresh"),
    )
