"""Per-key timelines that stay parallel when one key dominates.

A window partitioned by the key alone puts a key's whole history into one task. Here the window is
partitioned by key and time chunk, and what crosses a chunk boundary comes from a narrow summary
with one row per key and non-empty chunk, whose length is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.temporal import hour_chunk, wall_micros, wall_seconds

#: chunk of rows without a time, behind all others
NO_TIME = (1 << 62)
#: the chunk of all other rows of a key that is not cut
WHOLE = NO_TIME - 1


def neighbour_time(
    df: DataFrame,
    key: str,
    ts: str,
    out: str,
    *,
    step: int = 1,
    ties: Sequence[str] = (),
    whole: int = 0,
) -> DataFrame:
    """Adds the ``ts`` of the next (``step=1``) or previous (``step=-1``) row of the same key.

    Rows of equal time are ordered by ``ties``; rows without a time come last. A NULL key is no
    key: such rows have no neighbour, and spread over the window's tasks by their content.

    Keys with at most ``whole`` rows are one chunk, so nothing of theirs crosses a boundary and only the other keys have a summary.
    That reads ``df`` once more, to count the rows of the keys; it pays where ``df`` is stored and most keys have few rows.
    """
    if step not in (1, -1):
        raise ValueError("step is 1 or -1")
    shift = F.lead if step == 1 else F.lag
    edge_of = F.min if step == 1 else F.max
    order = [F.col(c).asc_nulls_last() for c in [ts, *ties]]
    # one chunk column for the window and the join: both then share one shuffle of the rows
    alone = F.when(F.col(key).isNull(), F.xxhash64(*df.columns))
    chunk, cut, split = F.coalesce(alone, hour_chunk(ts), F.lit(NO_TIME)), df, F.col(key).isNotNull()
    if whole:
        sizes = df.where(split).groupBy(F.col(key).alias("_long")).agg(F.count(F.lit(1)).alias("_n"))
        # fewer keys than a ``whole``-th of the rows
        cut = df.join(F.broadcast(sizes.where(F.col("_n") > whole).select("_long")), F.col(key) == F.col("_long"), "left")
        chunk = F.when(split & F.col("_long").isNull() & F.col(ts).isNotNull(), F.lit(WHOLE)).otherwise(chunk)
        split = F.col("_long").isNotNull()
    chunked = cut.withColumn("_chunk", chunk)

    edges = chunked.where(split).groupBy(key, "_chunk").agg(edge_of(ts).alias("_edge"))
    over_chunks = Window.partitionBy(key).orderBy("_chunk")
    edges = edges.select(
        F.col(key).alias("_edge_key"),
        F.col("_chunk").alias("_edge_chunk"),
        shift("_edge").over(over_chunks).alias("_beyond"),
    ).where(F.col("_beyond").isNotNull() & (F.col("_edge_chunk") != NO_TIME))

    inside = Window.partitionBy(key, "_chunk").orderBy(*order)
    local = chunked.drop("_long").withColumn("_inside", F.when(F.col(key).isNotNull(), shift(ts).over(inside)))
    joined = local.join(
        edges,
        (F.col(key) == F.col("_edge_key")) & (F.col("_chunk") == F.col("_edge_chunk")),
        "left",
    )
    return joined.withColumn(out, F.coalesce("_inside", "_beyond")).select(*df.columns, out)


def time_since_previous(
    df: DataFrame, key: str, ts: str, out: str = "seconds_since_previous", ties: Sequence[str] = ()
) -> DataFrame:
    """Seconds since the previous row of the same key, NULL for the first."""
    previous = neighbour_time(df, key, ts, "_previous", step=-1, ties=ties)
    elapsed = (wall_micros(ts) - wall_micros("_previous")).cast("double") / F.lit(1e6)
    return previous.withColumn(out, elapsed).drop("_previous")


def trailing_counts(df: DataFrame, key: str, ts: str, seconds: int, out: str = "velocity") -> DataFrame:
    """Per (key, time): rows of the key in the trailing window, both ends included.

    Rows are first counted per (key, time). Each count is filed under its own chunk of window
    length and, as context only, under the next one; a window looks back no further than that.
    """
    counts = (
        df.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
        .groupBy(key, ts)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    chunk = F.floor(wall_seconds(ts) / F.lit(seconds)).cast("bigint")
    filed = counts.select(
        key, ts, "_n", F.posexplode(F.array(chunk, chunk + 1)).alias("_context", "_chunk")
    )
    trailing = (
        Window.partitionBy(key, "_chunk")
        .orderBy(wall_micros(ts))
        .rangeBetween(-seconds * 1000000, Window.currentRow)
    )
    counted = filed.withColumn(out, F.sum("_n").over(trailing))
    return counted.where(F.col("_context") == 0).select(key, ts, out)


def velocity(df: DataFrame, key: str, ts: str, seconds: int = 3600, out: str = "velocity") -> DataFrame:
    """Adds the trailing count to every row; NULL where the key or the time is missing."""
    counts = trailing_counts(df, key, ts, seconds, out)
    return df.join(counts, [key, ts], "left").select(*df.columns, out)


def scd2(
    df: DataFrame,
    key: str,
    ts: str,
    *,
    gap_seconds: int = 1,
    open_end: Column,
    ties: Sequence[str] = (),
    whole: int = 0,
) -> DataFrame:
    """Adds valid_from, valid_to and is_current to the versions of a dimension.

    ``valid_to`` is the next version time less ``gap_seconds`` (0 for gap-free intervals). Equal
    version times leave the earlier rows with an empty interval. ``whole`` is that of ``neighbour_time``.
    """
    following = neighbour_time(df, key, ts, "_next", ties=ties, whole=whole)
    end = F.col("_next")
    if gap_seconds:
        end = end - F.expr(f"interval '{int(gap_seconds)}' second")
    return following.withColumns(
        {
            "valid_from": F.col(ts),
            "valid_to": F.coalesce(end, open_end),
            "is_current": F.col("_next").isNull(),
        }
    ).drop("_next")
