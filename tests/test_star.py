"""Dimensions and facts on literal rows."""

import os
from datetime import date, timedelta

import pytest
from helpers import TX, as_of, money, rows, sale, ts
from pyspark.sql import functions as F

from tallyforge.functions.measures import promotion_tier
from tallyforge.plans import dims, facts, staging


def md5(spark, text):
    return spark.sql(f"select md5('{text}') h").first()["h"]


def day(text):
    return F.lit(text).cast("date")


@pytest.mark.parametrize(
    ("discount", "tier"),
    [("0", "NONE"), ("5", "SEASONAL"), ("5.01", "LOYALTY"), ("15", "LOYALTY"), ("15.01", "FLASH"), (None, "FLASH")],
)
def test_promotion_tiers(spark, discount, tier):
    df = spark.createDataFrame([(None if discount is None else money(discount),)], "d decimal(18,2)")
    assert df.select(promotion_tier("d").alias("t")).first()["t"] == f"PROMO-{tier}"


def test_calendar(spark):
    got = {str(r.date_day): r for r in dims.dim_date(spark).collect()}
    assert len(got) == 365
    sunday = got["2026-03-01"]
    assert (sunday.month_name, sunday.day_name, sunday.day_of_week, sunday.quarter) == ("March", "Sunday", 7, 1)
    assert sunday.is_weekend and not got["2026-03-02"].is_weekend


def customers(spark):
    data = [("C1", "Ann", "2026-01-01 00:00:00"), ("C1", "Anna", "2026-02-01 00:00:00")]
    df = spark.createDataFrame(data, "id string, first_name string, event_timestamp string")
    filler = {c: F.lit("x") for c in ("last_name", "email", "phone", "gender", "state", "birth_date")}
    return dims.dim_customer(staging.stg_customers(df.withColumns(filler)))


def products(spark):
    data = [("P1", money("4.00"), "2026-01-01 00:00:00"), ("P1", money("6.00"), "2026-02-01 00:00:00")]
    df = spark.createDataFrame(data, "id string, cost decimal(18,2), event_timestamp string")
    return dims.dim_product(
        staging.stg_products(
            df.withColumns({"sku": F.lit("s"), "name": F.lit("n"), "category": F.lit("c"), "price": F.col("cost") * 2})
        )
    )


def stores(spark):
    return dims.dim_store(
        staging.stg_stores(
            spark.createDataFrame([("S1", "Main", "X", "NY", "US")], "id string, name string, city string, state string, country string")
        )
    )


def test_sales_line(spark):
    data = [
        sale("a", "C1", "2026-01-15 12:00:00", qty=3, price="10.00", discount="2.00"),
        sale("b", "C1", "2026-02-15 12:00:00", qty=3, price="10.00", discount="2.00"),
        sale("c", None, "2026-02-15 12:00:00", store=None, product="P9"),
        sale("d", "C1", "2025-12-31 23:00:00"),
    ]
    tx = staging.stg_transactions(spark.createDataFrame(data, TX))
    fact = facts.fact_sales_line(tx, customers(spark), products(spark), stores(spark))
    got = {r.transaction_line_id: r for r in fact.collect()}
    assert len(got) == 4
    assert got["a"].total_cost == money("12.00") and got["b"].total_cost == money("18.00")
    assert (got["a"].net_sales, got["a"].gross_margin) == (money("28.00"), money("16.00"))
    assert got["a"].customer_key == md5(spark, "C1_2026-01-01 00:00:00")
    assert got["b"].customer_key == md5(spark, "C1_2026-02-01 00:00:00")
    assert got["a"].store_key == md5(spark, "S1_1970-01-01")
    unknown = [md5(spark, f"{t}-UNKNOWN") for t in ("CUST", "PRD", "ST")]
    assert [got["c"].customer_key, got["c"].product_key, got["c"].store_key] == unknown
    assert got["c"].total_cost == 0 and got["d"].customer_key == unknown[0]
    assert got["a"].date_day == date(2026, 1, 15)
    for r in got.values():
        assert r.gross_margin == r.net_sales - r.total_cost


def test_sales_line_without_dimensions_keeps_lines_and_measures(spark):
    data = [
        sale("a", "C1", "2026-01-15 12:00:00", qty=3, price="10.00", discount="2.00"),
        sale("b", "C1", "2026-02-15 12:00:00", qty=3, price=None, discount="2.00"),
        sale("c", None, "2026-02-15 12:00:00", store=None, product="P9"),
        sale("c", None, "2026-02-15 12:00:00", store=None, product=None),
    ]
    tx = staging.stg_transactions(spark.createDataFrame(data, TX))
    whole = facts.fact_sales_line(tx, customers(spark), products(spark), stores(spark))
    costed = facts.fact_sales_line(tx, None, products(spark), None)
    assert set(whole.columns) - set(costed.columns) == {"customer_key", "store_key"}
    order = ["transaction_line_id", "total_cost", "product_key"]
    assert rows(costed, *order) == rows(whole.select(*costed.columns), *order)
    plain = facts.fact_sales_line(tx, None, None, None)
    assert set(costed.columns) - set(plain.columns) == {"product_key", "total_cost", "gross_margin"}
    order = ["transaction_line_id", "net_sales"]
    assert rows(plain, *order) == rows(whole.select(*plain.columns), *order)


def test_measures_by_day_and_channel_join_no_unused_dimension(spark):
    from tallyforge.checks.queries import QUERIES

    def versions_read(name):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        return {d for d in ("dim_customer-", "dim_product-", "dim_store-") if d in plan}

    assert versions_read("pit_join_revenue") == versions_read("bi_measures") == {"dim_product-"}
    assert versions_read("revenue_by_channel") == set()


def test_sales_lines_are_stored_between_their_joins(spark, tmp_path):
    from tallyforge.checks.queries import QUERIES

    # the last plan starts from lines whose customers are resolved; bounds of versions travel once
    plan = QUERIES["fact_sales_line"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "sales_lines-" in plan and "dim_customer-" not in plan and "_take__pk" not in plan

    data = [
        sale("a", "C1", "2026-01-15 12:00:00", qty=3, price="10.00", discount="2.00"),
        sale("a", "C1", "2026-01-15 12:00:00", qty=3, price="10.00", discount="2.00"),
        sale("b", "C1", "2026-02-15 12:00:00", price=None),
        sale("c", None, "2026-02-15 12:00:00", store=None, product=None),
        sale("d", "C1", "2025-12-31 23:00:00"),
    ]
    tx = staging.stg_transactions(spark.createDataFrame(data, TX))

    def stored(df):
        df.write.parquet(str(tmp_path / "lines"))
        return spark.read.schema(df.schema).parquet(str(tmp_path / "lines"))

    dimensions = customers(spark), products(spark), stores(spark)
    want, got = facts.fact_sales_line(tx, *dimensions), facts.fact_sales_line(tx, *dimensions, stored=stored)
    assert (tmp_path / "lines").exists() and got.columns == want.columns
    assert rows(got, "transaction_line_id") == rows(want, "transaction_line_id")


def test_stored_bronze_takes_less_room_than_the_default(spark, tmp_path):
    from urllib.parse import urlparse

    from tallyforge.checks.adapters import Retail
    from tallyforge.checks.queries import bronze_transactions

    r = Retail(spark, "/root/testdata/sf0.001")
    stored = r.stored("bronze", lambda: bronze_transactions(r))
    plain = str(tmp_path / "plain")
    bronze_transactions(r).write.parquet(plain)

    def size(df):
        return sum(os.path.getsize(urlparse(f).path) for f in df.inputFiles())

    assert size(stored) < 0.7 * size(spark.read.parquet(plain))
    assert stored.exceptAll(bronze_transactions(r)).count() == 0 and stored.count() == r.table("lineitem").count()


def test_customer_versions_do_not_depend_on_attributes(spark):
    data = [("C1", n, t) for n, t in [("b", "2026-01-01 00:00:00"), ("a", "2026-01-01 00:00:00"), ("c", "2026-02-01 00:00:00"), ("d", None)]]
    df = spark.createDataFrame(data, "customer_id string, first_name string, t string")
    stg = df.select("customer_id", "first_name", F.col("t").cast("timestamp_ntz").alias("updated_at"))
    read = ["customer_id", F.col("valid_from").cast("string"), F.col("valid_to").cast("string")]
    whole, narrow = (sorted(map(str, dims.dim_customer(x).select(*read).collect())) for x in (stg, stg.drop("first_name")))
    assert whole == narrow and len(whole) == 4


def test_campaign_versions(spark):
    data = [("c", "n", "EMAIL", "2026-01-01"), ("c", "n", "EMAIL", "2026-01-01"), ("c", "n", "EMAIL", "2026-01-05")]
    stg = spark.createDataFrame(data, "campaign_id string, campaign_name string, channel string, d string")
    dim = dims.dim_campaign(stg.withColumn("campaign_date", F.col("d").cast("date")).drop("d"))
    got = rows(dim.select("valid_from", "valid_to", "is_current"), "valid_from", "valid_to")
    first, second = date(2026, 1, 1), date(2026, 1, 5)
    assert got == [(first, first, False), (first, second, False), (second, date(9999, 12, 31), True)]


def test_marketing_uses_the_version_of_the_day(spark):
    stg = spark.createDataFrame(
        [("c", "n", "EMAIL", money("5"), 10, 4, 1, date(2026, 1, 3)), ("z", "n", "EMAIL", money("5"), 10, 0, 1, date(2026, 1, 3))],
        "campaign_id string, campaign_name string, channel string, cost decimal(18,2), impressions int, clicks int,"
        " conversions int, campaign_date date",
    )
    dim = spark.createDataFrame(
        [("k", "c", date(2026, 1, 1), date(2026, 1, 9))],
        "campaign_key string, campaign_id string, valid_from date, valid_to date",
    )
    got = {r.campaign_id: r for r in facts.fact_marketing_daily(stg, dim).collect()}
    assert (got["c"].campaign_key, got["c"].click_to_conv_rate) == ("k", 0.25)
    assert (got["z"].campaign_key, got["z"].click_to_conv_rate) == (md5(spark, "CAMP-UNKNOWN"), 0.0)


def test_ticket_hours(spark):
    data = [("1", "C1", ts("2026-01-15 00:00:00"), ts("2026-01-15 01:30:00")), ("2", "C1", ts("2026-01-15 00:00:00"), None)]
    stg = spark.createDataFrame(data, "ticket_id string, customer_id string, ticket_timestamp timestamp_ntz, resolution_timestamp timestamp_ntz")
    stg = stg.withColumns({c: F.lit("x") for c in ("issue_category", "status", "priority")})
    got = rows(facts.fact_support_ticket(stg, customers(spark)).select("ticket_id", "resolution_time_hours"), "ticket_id")
    assert got == [("1", 1.5), ("2", None)]


MOVES = [
    ("p", "s", "2026-01-02", 10),
    ("p", "s", "2026-01-02", -3),
    ("p", "s", "2026-01-04", -2),
    ("q", "s", "2025-12-30", 7),
    ("q", "s", "2026-01-03", 1),
    ("r", "s", "2026-02-01", 5),
]


@pytest.mark.parametrize("opening", [False, True])
@pytest.mark.parametrize("as_of_day", ["2026-01-03", "2026-01-31", "2025-12-01"])
def test_snapshot_against_brute_force(spark, opening, as_of_day):
    moves = spark.createDataFrame(MOVES, "product_key string, store_key string, d string, quantity int")
    moves = moves.withColumn("date_day", F.col("d").cast("date")).drop("d")
    got = facts.fact_inventory_daily_snapshot(
        moves, day("2026-01-01"), day("2026-01-05"), day(as_of_day), opening_balance=opening
    )
    got = rows(got.select("product_key", "date_day", "stock_on_hand"), "product_key", "date_day")
    want = []
    for pair in ("p", "q", "r"):
        for d in range(1, 6):
            today = f"2026-01-0{d}"
            if today <= as_of_day:
                low = "" if opening else "2026-01-01"
                level = sum(q for p, _, at, q in MOVES if p == pair and low <= at <= today)
                want.append((pair, date(2026, 1, d), level))
    assert got == want


@pytest.mark.parametrize(
    ("start", "end"), [("2025-12-29", "2026-01-03"), ("2026-01-01", "2026-02-02"), ("2026-02-03", "2026-02-04"), ("2026-05-30", "2026-06-01"), ("2025-01-01", "2025-01-02")]
)
def test_range_of_days_from_stored_months(spark, tmp_path, start, end):
    """Before, within and beyond the months that are stored; only those of the range are opened."""
    moves = spark.createDataFrame(MOVES, "product_key string, store_key string, d string, quantity int")
    stored = {}
    for name, build in (("changes", lambda: facts.monthly_changes(moves.withColumn("date_day", F.col("d").cast("date")))), ("openings", lambda: facts.opening_balances(stored["changes"]))):
        df = build()
        df.write.partitionBy("month").parquet(str(tmp_path / name))
        stored[name] = spark.read.schema(df.schema).parquet(str(tmp_path / name))
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    got = facts.snapshot_range(stored["changes"], stored["openings"], first, last)
    want = []
    for pair in ("p", "q", "r"):
        if any(p == pair and at <= end for p, _, at, _ in MOVES):
            for d in range((last - first).days + 1):
                today = first + timedelta(days=d)
                want.append((pair, today, sum(q for p, _, at, q in MOVES if p == pair and at <= str(today))))
    assert rows(got.select("product_key", "date_day", "stock_on_hand"), "product_key", "date_day") == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(month") >= 2 or "LocalTableScan" in plan


def test_stored_balances_do_not_grow_with_the_calendar(spark):
    """Two changes ten years apart: quiet months add no row, and the open year is not summed."""
    rows_ = [("p", "s", date(2016, 5, 3), 4, date(2016, 5, 1)), ("p", "s", date(2026, 2, 2), -1, date(2026, 2, 1))]
    changes = spark.createDataFrame(rows_, "product_key string, store_key string, date_day date, net_movement long, month date")
    openings = facts.opening_balances(changes)
    assert rows(openings, "month") == [("p", "s", 4, date(2017, 1, 1))]
    got = facts.snapshot_range(changes, openings, date(2026, 1, 31), date(2026, 2, 2))
    assert [r.stock_on_hand for r in got.orderBy("date_day").collect()] == [4, 4, 3]


def test_last_change_is_the_sum_of_movements(spark):
    moves = spark.createDataFrame(MOVES, "product_key string, store_key string, d string, quantity int")
    moves = moves.withColumn("date_day", F.col("d").cast("date")).drop("d")
    changes = facts.stock_changes(moves).groupBy("product_key").agg(F.max_by("stock_on_hand", "date_day").alias("s"))
    assert rows(changes, "product_key") == [("p", 5), ("q", 8), ("r", 5)]


def test_returns_fan_out_per_line(spark):
    tx = spark.createDataFrame([("T1", "C1"), ("T1", "C1"), ("T1", "C2"), ("T1", None)], "transaction_id string, customer_id string")
    back = spark.createDataFrame([("R1", "T1"), ("R2", "T2")], "return_id string, transaction_id string")
    got = facts.returns_with_customer(back, tx).select("return_id", "customer_id")
    assert rows(got, "customer_id") == [("R1", "C1"), ("R1", "C1"), ("R1", "C2")]


def test_copies_of_a_return_do_not_travel(spark):
    """One row per return and customer is resolved; the copies are laid out behind the join, also of very many lines."""
    columns = "transaction_line_id string, transaction_id string, customer_id string, transaction_timestamp timestamp_ntz"
    lines = [("1", "T1", "C1", ts("2026-01-15")), ("2", "T1", "C1", ts("2026-01-16")), ("3", "T1", None, ts("2026-01-16"))]
    lines += [(str(i), "T2", "C9", ts("2026-01-17")) for i in range(10, 2511)]
    tx = spark.createDataFrame(lines, columns)
    schema = "return_id string, transaction_id string, return_timestamp timestamp_ntz"
    back = spark.createDataFrame([("R1", "T1", ts("2026-02-15")), ("R2", "T2", ts("2026-02-16")), ("R3", "T3", ts("2026-02-16"))], schema)
    counted = facts.counted_returns(back, tx).select("return_id", "customer_id", "times")
    assert rows(counted, "return_id") == [("R1", "C1", 2), ("R2", "C9", 2501)]
    got = facts.fact_customer_activity(tx, back, None, customers(spark))
    of = got.groupBy("activity_type", "activity_details", "customer_key").count()
    unknown, first, second = md5(spark, "CUST-UNKNOWN"), md5(spark, "C1_2026-01-01 00:00:00"), md5(spark, "C1_2026-02-01 00:00:00")
    assert rows(of, "activity_type", "activity_details") == [
        ("PURCHASE", "Completed a transaction: T1", first, 2),
        ("PURCHASE", "Completed a transaction: T2", unknown, 2501),
        ("RETURN", "Returned product in transaction: T1", second, 2),
        ("RETURN", "Returned product in transaction: T2", unknown, 2501),
    ]
    assert got.columns == ["activity_key", "customer_key", "activity_timestamp", "date_day", "activity_type", "activity_details"]


def test_staging_views(spark):
    df = spark.createDataFrame([("S1", "Main", "X", "NY", "US")], "id string, name string, city string, state string, country string")
    staging.register_staging({"stores": df})
    assert spark.table("stg_stores").columns == ["store_id", "store_name", "city", "state", "country"]
    assert as_of() is not None
