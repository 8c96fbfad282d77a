"""Calendars, dense daily series and features over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def date_series(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day, both ends included."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return spark.range(1).select(F.explode(days).alias("date_day"))


def day_bounds(df: DataFrame, date: str = "date_day") -> tuple[Column, Column]:
    """First and last day of the data, read once: two values."""
    first, last = df.agg(F.min(date), F.max(date)).first()
    return F.lit(first).cast("date"), F.lit(last).cast("date")


def calendar_grid(keys: DataFrame, start: Column, end: Column, date: str = "date_day") -> DataFrame:
    """Every key on every day of the range, unrolled in place instead of cross joined."""
    return keys.withColumn(date, F.explode(F.when(start <= end, F.sequence(start, end))))


def fill_grid(grid: DataFrame, daily: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Grid with the daily value, 0 on days without one."""
    return grid.join(daily.select(*on, value), list(on), "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(0))
    )


def densify(daily: DataFrame, by: Sequence[str], date: str, value: str) -> DataFrame:
    """Days from the first to the last of each slice, missing days as 0.

    ``daily`` holds one row per slice and day, so each row only has to unroll the gap up to the
    next one: a single window pass, no calendar join.
    """
    following = F.lead(date).over(Window.partitionBy(*by).orderBy(date))
    zero = F.lit(0).cast(daily.schema[value].dataType)
    return (
        daily.withColumn("_until", F.coalesce(F.date_sub(following, 1), F.col(date)))
        .select(
            *by,
            value,
            F.posexplode(F.sequence(F.col(date), F.col("_until"))).alias("_offset", date),
        )
        .select(*by, date, F.when(F.col("_offset") == 0, F.col(value)).otherwise(zero).alias(value))
    )


def sales_slices(sales: DataFrame, value: str = "net_sales", rows: str | None = None) -> DataFrame:
    """Daily totals over all sales, per channel and per category in one pass.

    Columns channel, category, date_day, the summed value and ``n_rows``, which adds up ``rows``
    where the input is already aggregated. The label ALL comes from the grouping id, so a genuine
    NULL keeps its own slice.
    """
    grouped = sales.groupingSets(
        [
            [F.col("date_day")],
            [F.col("date_day"), F.col("channel")],
            [F.col("date_day"), F.col("category")],
        ],
        F.col("date_day"),
        F.col("channel"),
        F.col("category"),
    ).agg(
        F.sum(value).alias(value),
        (F.sum(rows) if rows else F.count(F.lit(1))).alias("n_rows"),
        F.grouping("channel").alias("_all_channels"),
        F.grouping("category").alias("_all_categories"),
    )
    return grouped.select(
        F.when(F.col("_all_channels") == 1, "ALL").otherwise(F.col("channel")).alias("channel"),
        F.when(F.col("_all_categories") == 1, "ALL").otherwise(F.col("category")).alias("category"),
        "date_day",
        value,
        "n_rows",
    )


def add_lags(df: DataFrame, by: Sequence[str], date: str, value: str, lags: Sequence[int]) -> DataFrame:
    ordered = Window.partitionBy(*by).orderBy(date)
    return df.withColumns({f"lag_{n}": F.lag(value, n).over(ordered) for n in lags})


def add_rolling_mean(
    df: DataFrame, by: Sequence[str], date: str, value: str, sizes: Sequence[int]
) -> DataFrame:
    """Mean of up to n previous days. The sum stays in the exact type of ``value``."""
    ordered = Window.partitionBy(*by).orderBy(date)
    means = {}
    for n in sizes:
        frame = ordered.rowsBetween(-n, -1)
        means[f"rolling_mean_{n}"] = F.try_divide(
            F.sum(value).over(frame).cast("double"), F.count(value).over(frame).cast("double")
        )
    return df.withColumns(means)


def add_rolling_std(df: DataFrame, by: Sequence[str], date: str, value: str, size: int) -> DataFrame:
    """Sample standard deviation of up to n previous days, 0 below two days.

    The moments are summed as exact numbers, so large levels lose nothing to cancellation.
    """
    frame = Window.partitionBy(*by).orderBy(date).rowsBetween(-size, -1)
    exact = F.col(value).cast("decimal(19,0)")
    n = F.count(value).over(frame)
    total = F.sum(exact).over(frame).cast("decimal(38,0)")
    squares = F.sum((exact * exact).cast("decimal(38,0)")).over(frame)
    spread = (n * squares).cast("decimal(38,0)") - (total * total).cast("decimal(38,0)")
    std = F.sqrt(spread.cast("double") / (n * (n - 1)).cast("double"))
    return df.withColumn(f"rolling_std_{size}", F.when(n > 1, std).otherwise(F.lit(0.0)))


def holdout(df: DataFrame, by: Sequence[str], date: str, max_rows: int = 7, fraction: int = 3) -> DataFrame:
    """Adds ``is_test``: the last min(max_rows, n div fraction) rows of each slice."""
    newest_first = Window.partitionBy(*by).orderBy(F.col(date).desc())
    size = F.least(
        F.lit(max_rows), F.floor(F.count(F.lit(1)).over(Window.partitionBy(*by)) / fraction)
    )
    return df.withColumn("is_test", F.row_number().over(newest_first) <= size)


def accuracy(df: DataFrame, by: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE and WAPE (in percent, 0 without positive sales) per slice."""
    error = F.col(actual) - F.col(predicted)
    total = F.sum(actual)
    return df.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(total > 0, F.sum(F.abs(error)) / total * 100).otherwise(F.lit(0.0)).alias("wape"),
    )


def last_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The n greatest rows in ascending order."""
    return df.orderBy(F.col(order).desc()).limit(n).orderBy(order)


def rename_values(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """NULLs of each named column replaced by its label."""
    return df.fillna(dict(labels))
