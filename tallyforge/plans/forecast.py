"""Daily sales forecast: features, a ridge fit and the recursive projection, all in column expressions.

Slices are all sales, each channel and each category. Sales are reduced to one row per slice and
day before any window runs. One aggregation per slice then takes the exact sums behind the normal equations, the
hold-out days and the last days; systems of 16 unknowns are solved, and days projected, within that row.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.measures import lenient_net_sales
from tallyforge.functions.temporal import is_payday, is_retail_event
from tallyforge.operators.series import (
    accuracy,
    add_lags,
    add_rolling_mean,
    add_rolling_std,
    densify,
    holdout,
    rename_values,
    sales_slices,
)

SLICE = ["channel", "category"]

# The model's inputs in order, and the sizes below which a slice is skipped.
FEATURES = [
    "day_of_week",
    "day_of_month",
    "month",
    "is_weekend",
    "is_payday",
    "is_retail_event",
    "lag_1",
    "lag_2",
    "lag_7",
    "lag_14",
    "rolling_mean_7",
    "rolling_mean_14",
    "rolling_std_14",
    "marketing_spend_7d",
    "avg_discount_pct",
    "stockout_rate",
]
LAGS = (1, 2, 7, 14)
MIN_SALES_ROWS = 14
MIN_USABLE_DAYS = 7


def labelled_sales(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Net sales in cents per day, channel and category, reduced before the product join.

    The label for a missing channel is POS, for a missing category General.
    """
    daily = (
        sales.select(
            F.to_date("transaction_timestamp").alias("date_day"),
            "channel",
            "product_id",
            (lenient_net_sales() * 100).cast("bigint").alias("cents"),
        )
        .where(F.col("date_day").isNotNull())
        .groupBy("date_day", "channel", "product_id")
        .agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n_rows"))
    )
    labelled = daily.join(products.select("product_id", "category"), "product_id", "left")
    return rename_values(labelled, {"channel": "POS", "category": "General"})


def daily_slices(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Dense daily cents per slice that has enough sales rows."""
    return dense_slices(labelled_sales(sales, products))


def dense_slices(labelled: DataFrame) -> DataFrame:
    slices = sales_slices(labelled, "cents", "n_rows")
    raw_rows = F.sum("n_rows").over(Window.partitionBy(*SLICE))
    kept = slices.withColumn("_rows", raw_rows).where(F.col("_rows") >= MIN_SALES_ROWS)
    return densify(kept, SLICE, "date_day", "cents")


def _money(cents: Column) -> Column:
    return cents.cast("double") / F.lit(100.0)


def forecast_features(sales: DataFrame, products: DataFrame) -> DataFrame:
    """The feature rows of every slice; days without a full history are dropped, and so are slices
    with too few days left."""
    return features_of(labelled_sales(sales, products))


def features_of(labelled: DataFrame) -> DataFrame:
    """The same from sales per day, channel and category, as ``labelled_sales`` gives them and a lake may store them."""
    daily = dense_slices(labelled)
    featured = add_lags(daily, SLICE, "date_day", "cents", LAGS)
    featured = add_rolling_mean(featured, SLICE, "date_day", "cents", (7, 14))
    featured = add_rolling_std(featured, SLICE, "date_day", "cents", 14)
    day = F.col("date_day")
    columns = {
        "net_sales": _money(F.col("cents")),
        "day_of_week": F.weekday(day).cast("double"),
        "day_of_month": F.dayofmonth(day).cast("double"),
        "month": F.month(day).cast("double"),
        "is_weekend": F.weekday(day).isin(5, 6).cast("double"),
        "is_payday": is_payday(day).cast("double"),
        "is_retail_event": is_retail_event(day).cast("double"),
        **{f"lag_{n}": _money(F.col(f"lag_{n}")) for n in LAGS},
        **{c: F.col(c) / F.lit(100.0) for c in ("rolling_mean_7", "rolling_mean_14", "rolling_std_14")},
        **{c: F.lit(0.0) for c in ("marketing_spend_7d", "avg_discount_pct", "stockout_rate")},
    }
    complete = featured.where(F.col(f"lag_{max(LAGS)}").isNotNull()).withColumns(columns)
    usable = F.count(F.lit(1)).over(Window.partitionBy(*SLICE))
    return (
        complete.withColumn("_usable", usable)
        .where(F.col("_usable") >= MIN_USABLE_DAYS)
        .select(*SLICE, "date_day", "net_sales", *FEATURES)
    )


#: a column of ones: its products with the others are their sums, its square the number of rows
ONE = "one"


def _pairs(columns: list[str]) -> list[tuple[int, int]]:
    return list(combinations_with_replacement(range(len(columns)), 2))


def _exact(columns: list[str]) -> dict[str, Column]:
    """Columns _x0, _x1, ...: the values to four decimals, so that their products sum up exactly, in any order."""
    return {f"_x{i}": (F.lit(1) if c == ONE else F.col(c)).cast("decimal(18,4)") for i, c in enumerate(columns)}


def _gram(columns: list[str]) -> Column:
    """Sums of the products of all pairs of ``_exact`` columns, in the order of ``_pairs``."""
    return F.expr(f"array({', '.join(f'CAST(sum(_x{i} * _x{j}) AS DECIMAL(38, 8))' for i, j in _pairs(columns))})")


def forecast_gram(features: DataFrame) -> DataFrame:
    """Sums behind the normal equations: one row per slice and pair of columns (target included)."""
    columns = [*FEATURES, "net_sales"]
    wide = features.withColumns(_exact(columns)).groupBy(*SLICE).agg(_gram(columns).alias("_totals"))
    cells = [
        F.struct(
            F.lit(columns[i]).alias("left_column"),
            F.lit(columns[j]).alias("right_column"),
            F.col("_totals")[k].alias("total"),
        )
        for k, (i, j) in enumerate(_pairs(columns))
    ]
    return wide.select(*SLICE, F.inline(F.array(*cells)))


RECENT = 14


def slice_summary(features: DataFrame, max_test_rows: int = 7) -> DataFrame:
    """One row per slice: ``train`` and ``whole`` (sums behind the normal equations without the hold-out and over all
    days, as doubles), ``tests`` (hold-out days with their inputs), ``recent`` (the last sales, oldest first) and ``last_day``.

    A single aggregation; what it gathers is bounded by the hold-out and the longest lag.
    """
    columns = [ONE, *FEATURES, "net_sales"]
    newest_first = Window.partitionBy(*SLICE).orderBy(F.col("date_day").desc())
    tagged = holdout(features, SLICE, "date_day", max_test_rows).withColumn("_age", F.row_number().over(newest_first))
    test = F.struct("date_day", F.col("net_sales").alias("actual"), F.array(*FEATURES).alias("inputs"))
    # little data but much arithmetic, which adaptive execution would leave to one task; sums are exact, so they can be dealt out
    tasks = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tagged.withColumns(_exact(columns)).repartition(tasks, *SLICE, F.trunc("date_day", "month"))
    parts = dealt.groupBy(*SLICE, "is_test").agg(
        _gram(columns).alias("_totals"),
        F.collect_list(F.when(F.col("is_test"), test)).alias("_tests"),
        F.collect_list(F.when(F.col("_age") <= RECENT, F.struct("date_day", "net_sales"))).alias("_recent"),
        F.max("date_day").alias("_last"),
    )
    both = parts.groupBy(*SLICE).agg(
        F.max(F.when(~F.col("is_test"), F.col("_totals"))).alias("_train"),
        F.max(F.when(F.col("is_test"), F.col("_totals"))).alias("_held"),
        F.sort_array(F.flatten(F.collect_list("_tests"))).alias("tests"),
        F.sort_array(F.flatten(F.collect_list("_recent")))["net_sales"].alias("recent"),
        F.max("_last").alias("last_day"),
    )
    whole = F.coalesce(F.zip_with("_train", "_held", lambda a, b: a + b), F.col("_train"))
    return both.select(
        *SLICE,
        F.col("_train").cast("array<double>").alias("train"),
        whole.cast("array<double>").alias("whole"),
        "tests",
        "recent",
        "last_day",
    )


def _sum(values: str) -> str:
    return f"aggregate({values}, 0D, (total, x) -> total + x)"


def _dot(left: str, right: str) -> str:
    return _sum(f"zip_with({left}, {right}, (a, b) -> a * b)")


def ridge(df: DataFrame, totals: str, alpha: float = 1.0) -> DataFrame:
    """Adds ``weights`` (array, in the order of ``FEATURES``) and ``intercept`` from the sums in column ``totals``.

    The sums are centred, which leaves the intercept free of the penalty; ``alpha`` > 0 goes on the diagonal, so the system
    is positive definite and elimination needs no pivoting.
    """
    m = len(FEATURES)
    # the first m + 2 sums are those of the columns themselves; a pair i <= j stands at i * (2m + 3 - i) / 2 + j
    product = f"{totals}[CAST(least(i, j) * ({2 * m + 3} - least(i, j)) DIV 2 + greatest(i, j) AS INT)]"
    centred = f"{product} - {totals}[i] * {totals}[j] / {totals}[0]"
    entry = f"IF(i = j, {centred} + {float(alpha)}D, {centred})"
    system = f"transform(sequence(1, {m}), i -> transform(sequence(1, {m + 1}), j -> {entry}))"
    without = "IF(i = k, r, zip_with(r, s[k], (x, p) -> x - r[k] / s[k][k] * p))"
    solved = f"aggregate(sequence(0, {m - 1}), _system, (s, k) -> transform(s, (r, i) -> {without}))"
    means = f"transform(sequence(1, {m}), i -> {totals}[i] / {totals}[0])"
    return (
        df.withColumn("_system", F.expr(system))
        .withColumn("weights", F.expr(f"transform({solved}, (r, i) -> r[{m}] / r[i])"))
        .withColumn("intercept", F.expr(f"{totals}[{m + 1}] / {totals}[0] - {_dot(means, 'weights')}"))
        .drop("_system")
    )


def _predicted(inputs: str) -> str:
    return f"greatest({_dot(inputs, 'weights')} + intercept, 0D)"


def _unrolled(df: DataFrame, kept: list[str], column: str) -> DataFrame:
    """A row for each struct of an array, which has a date_day. The outer form, as Catalyst would else put a filter on the array's size below
    and work the whole fit out for it once more."""
    return df.select(*kept, F.inline_outer(column)).where("date_day IS NOT NULL")


def holdout_predictions(summary: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Fit on the older days of each slice, predict its hold-out days from their actual lags. Further columns are kept."""
    fitted = ridge(summary, "train", alpha)
    kept = [c for c in summary.columns if c not in ("train", "tests")]
    rows = _unrolled(fitted, [*kept, "weights", "intercept"], "tests")
    return rows.withColumn("predicted", F.expr(_predicted("inputs"))).drop("inputs", "intercept")


def forecast_fit(
    summary: DataFrame, alpha: float = 1.0, as_of: Column | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Accuracy of each slice on its hold-out, with the coefficients, also as JSON. ``keep`` names columns, one value a slice."""
    now = (as_of if as_of is not None else F.current_timestamp()).cast("timestamp_ntz")
    predictions = holdout_predictions(summary, alpha)
    # the coefficients are one value a slice, so grouping by them as well spares a join
    scores = accuracy(predictions, [*SLICE, "weights", *keep], "actual", "predicted")
    impacts = F.map_from_arrays(
        F.array(*[F.lit(f) for f in FEATURES]), F.transform("weights", lambda w: F.bround(w, 4))
    )
    rounded = [F.bround(c, 2).alias(c) for c in ("mae", "rmse", "wape")]
    joined = scores.select(*SLICE, *keep, *rounded, impacts.alias("feature_impacts"))
    metrics = F.to_json(
        F.struct(
            "mae",
            "rmse",
            "wape",
            "channel",
            "category",
            F.date_format(now, "yyyy-MM-dd HH:mm:ss").alias("evaluated_at"),
            "feature_impacts",
        )
    )
    return joined.withColumn("metrics_json", metrics)


def _coming_days(horizon: int) -> Column:
    """The days after ``last_day`` with the inputs that the calendar gives."""

    def coming(ahead: Column) -> Column:
        day = F.date_add(F.col("last_day"), ahead)
        calendar = (F.weekday(day), F.dayofmonth(day), F.month(day), F.weekday(day).isin(5, 6), is_payday(day), is_retail_event(day))
        return F.struct(day.alias("day"), F.array(*[c.cast("double") for c in calendar]).alias("calendar"))

    return F.transform(F.sequence(F.lit(1), F.lit(horizon)), coming)


def with_projection(summary: DataFrame, horizon: int = 7, alpha: float = 1.0) -> DataFrame:
    """Adds ``days``, an array of (date_day, forecast_sales): refit on all days, then predicted day by day.

    A fold over the coming days; its state is the last sales, each prediction becoming one of them, and the days so far.
    """
    mean = f"{_sum('s.known')} / size(s.known)"
    week = f"{_sum('slice(s.known, -7, 7)')} / 7"
    spread = f"transform(array({mean}), m -> {_sum('transform(s.known, x -> (x - m) * (x - m))')})[0]"
    inputs = f"""concat(a.calendar, array(
        element_at(s.known, -1), element_at(s.known, -2), element_at(s.known, -7),
        coalesce(try_element_at(s.known, -{RECENT}), element_at(s.known, -7)), {week}, {mean},
        IF(size(s.known) >= {RECENT}, sqrt({spread} / (size(s.known) - 1)), 0D), 0D, 0D, 0D))"""
    newest = f"IF(size(s.known) >= {RECENT}, slice(s.known, 2, {RECENT} - 1), s.known)"
    # the prediction is named v, so that it is worked out once
    step = f"""transform(array({_predicted(inputs)}), v -> named_struct(
        'known', concat({newest}, array(v)),
        'days', concat(s.days, array(named_struct('date_day', a.day, 'forecast_sales', bround(v, 2))))))[0]"""
    start = "named_struct('known', recent, 'days', CAST(array() AS array<struct<date_day:date,forecast_sales:double>>))"
    fitted = ridge(summary, "whole", alpha).withColumn("_coming", _coming_days(horizon))
    days = F.expr(f"aggregate(_coming, {start}, (s, a) -> {step}, s -> s.days)")
    return fitted.withColumn("days", days).drop("weights", "intercept", "_coming")


def forecast_steps(summary: DataFrame, horizon: int = 7, alpha: float = 1.0) -> DataFrame:
    """The predicted days of each slice."""
    return _unrolled(with_projection(summary, horizon, alpha), SLICE, "days")


def forecast(
    features: DataFrame, horizon: int = 7, alpha: float = 1.0, as_of: Column | None = None
) -> DataFrame:
    """The forecast table: predicted days of each slice with the model's name and metrics.

    The features are read once; both fits, the hold-out and the projection follow from one row per slice, without a join.
    """
    now = (as_of if as_of is not None else F.current_timestamp()).cast("timestamp_ntz")
    name = F.concat(
        F.lit("Ridge Multi-Forecast ("), F.col("channel"), F.lit("/"), F.col("category"), F.lit(")")
    )
    projected = with_projection(slice_summary(features), horizon, alpha)
    scored = forecast_fit(projected, alpha, as_of, keep=("days",))
    return _unrolled(scored, [*SLICE, "metrics_json"], "days").select(
        "date_day",
        *SLICE,
        "forecast_sales",
        name.alias("model_name"),
        "metrics_json",
        now.alias("created_at"),
    )


def last_week_forecast(daily: DataFrame) -> DataFrame:
    """Baseline per slice: each day repeats the same weekday of the week before."""
    ordered = Window.partitionBy(*SLICE).orderBy("date_day")
    return daily.withColumn("predicted_cents", F.lag("cents", 7).over(ordered)).where(
        F.col("predicted_cents").isNotNull()
    )
