"""KPIs, fraud rules, forecast, privacy and exports."""

import json
from datetime import date, timedelta

import numpy as np
import pytest
from helpers import TX, as_of, money, rows, sale
from pyspark.sql import functions as F

from tallyforge.contracts import CONTRACTS
from tallyforge.operators.series import accuracy, densify, sales_slices
from tallyforge.plans import forecast, fraud, kpis, privacy
from tallyforge.sources import exports


def sales(spark, data):
    return spark.createDataFrame(data, TX)


NO_RETURNS = "transaction_id string, quantity int, refund_amount decimal(18,2)"
CATALOG = "product_id string, category string, cost decimal(18,2)"


# -- overview -------------------------------------------------------------------------------


def test_overview(spark):
    data = [
        sale("1", "C1", "2026-05-01 10:00:00", qty=2, price="50.00", discount="10.00"),
        sale("2", "C2", "2026-05-01 10:00:00", qty=1, price="10.00", channel="WEBSITE"),
        sale("3", None, "2026-05-01 10:00:00", qty=-1, price="10.00", product="P9"),
    ]
    back = spark.createDataFrame([("T1", 1, money("8.00")), ("T2", 1, money("1.00"))], NO_RETURNS)
    catalog = spark.createDataFrame([("P1", "A", money("20.00"))], CATALOG)
    audit = spark.createDataFrame([(90.0,), (95.5,)], "quality_score double")
    row = kpis.overview(sales(spark, data), back, catalog, audit).first()
    assert (row.revenue, row.active_customers, row.alert_count, row.dq_score) == (money("90.00"), 2, 1, 92.8)
    assert (row.margin_pct, row.return_rate_pct) == (33.33, 10.0)
    web = kpis.overview(sales(spark, data), back, catalog, None, channel="WEBSITE").first()
    assert (web.revenue, web.return_rate_pct, web.dq_score) == (money("10.00"), 10.0, 98.4)
    none = kpis.overview(sales(spark, data).where("false"), back, catalog, audit).first()
    assert tuple(none) == (money("0.00"), 0.0, 0.0, 0, 100.0, 0)


def test_overview_adds_up_by_hand(spark):
    """Gross 3*40 + 25 + 2*7.50 + 60 = 220, discounts 20 + 5 = 25, so 195; cost 3*10 + 4 sold units elsewhere without one."""
    lines = [("P1", 3, "40.00", "20.00", "C1"), ("P2", 1, "25.00", "0.00", "C2"), ("P3", 2, "7.50", "5.00", "C2"), ("P4", 1, "60.00", "0.00", "C3")]
    data = [sale(str(i), c, "2026-03-09 08:30:00", qty=q, price=p, discount=d, product=k) for i, (k, q, p, d, c) in enumerate(lines)]
    catalog = spark.createDataFrame([("P1", "A", money("10.00"))], CATALOG)
    back = spark.createDataFrame([], NO_RETURNS)
    row = kpis.overview(sales(spark, data), back, catalog).first()
    assert (row.revenue, row.margin_pct, row.active_customers) == (money("195.00"), 84.62, 3)


# -- trend ----------------------------------------------------------------------------------


def test_trend_joins_slices_and_falls_back(spark):
    data = [sale(str(i), "C1", f"2026-05-{i:02d} 10:00:00", price=f"{i}.00") for i in range(1, 26)]
    fc = spark.createDataFrame(
        [(date(2026, 5, 25), "ALL", "ALL", 7.0), (date(2026, 5, 26), "ALL", "ALL", 8.0), (date(2026, 5, 26), "POS", "ALL", 9.0)],
        "date_day date, channel string, category string, forecast_sales double",
    )
    catalog = spark.createDataFrame([("P1", "A", money("1"))], CATALOG)
    total = rows(kpis.sales_trend(sales(spark, data), catalog, fc))
    assert len(total) == 20 and total[0][0] == date(2026, 5, 7)
    assert total[-2:] == [(date(2026, 5, 25), money("25.00"), 7.0), (date(2026, 5, 26), money("0.00"), 8.0)]
    assert rows(kpis.sales_trend(sales(spark, data), catalog, fc, channel="POS"))[-1][2] == 9.0
    both = rows(kpis.sales_trend(sales(spark, data), catalog, fc, channel="POS", category="A"))
    assert both[-1][2] == 8.0
    assert [r[0] for r in rows(exports.forecast_export(kpis.sales_trend(sales(spark, data), catalog, fc)))][-1] == "2026-05-26"


def test_trend_metrics(spark):
    fc = spark.createDataFrame(
        [("ALL", "ALL", '{"mae": 1.5, "rmse": 2.5, "wape": 3.5}')], "channel string, category string, metrics_json string"
    )
    assert tuple(kpis.trend_metrics(fc, "POS").first()) == (1.5, 2.5, 3.5)
    assert tuple(kpis.trend_metrics(fc.where("false")).first()) == (0.0, 0.0, 0.0)


# -- segments -------------------------------------------------------------------------------


def test_segments(spark):
    def visits(customer, last, n, price="100.00"):
        first = date.fromisoformat(last) - timedelta(days=n - 1)
        return [
            sale(f"{customer}{i}", customer, f"{first + timedelta(days=i)} 12:00:00", price=price) for i in range(n)
        ]

    data = [
        *visits("champion", "2026-06-28", 5, "200.00"),
        *visits("loyal", "2026-06-18", 3),
        *visits("risk", "2026-06-01", 3),
        *visits("new", "2026-06-25", 1),
        *visits("idle", "2026-06-12", 2),
        sale("x", None, "2026-06-30 12:00:00"),
    ]
    got = {r.customer_id: r for r in kpis.rfm_segments(sales(spark, data)).collect()}
    assert {c: r.segment for c, r in got.items()} == {
        "champion": "Champions",
        "loyal": "Loyal Customers",
        "risk": "At Risk",
        "new": "New Customers",
        "idle": "Hibernating",
    }
    assert got["champion"].recency == 2
    summary = kpis.rfm_summary(kpis.rfm_segments(sales(spark, data))).collect()
    assert {(r.retention_rate, r.total_scored) for r in summary} == {(80.0, 5)}


def test_recency_counts_whole_days_and_defaults_fill_in(spark):
    data = [
        sale("1", "a", "2026-06-01 13:00:00", price=None, discount=None),
        sale("2", "b", "2026-06-03 12:00:00"),
    ]
    got = {r.customer_id: r for r in kpis.rfm(sales(spark, data)).collect()}
    assert (got["a"].recency, got["a"].monetary) == (1, money("0.00"))


# -- inventory ------------------------------------------------------------------------------


def test_inventory_alerts(spark):
    moves = [
        ("a", "s", "RESTOCK", 180),
        ("a", "s", "SALE", -30),
        ("b", "s", "SALE", -60),
        ("c", "s", "RESTOCK", 1),
        ("d", "s", "RESTOCK", 44),
        ("d", "s", "SALE", -30),
        ("e", "s", "SALE", 0),
        ("e", "s", "RESTOCK", 3),
        ("f", "s", "SALE", 0),
    ]
    df = spark.createDataFrame(moves, "product_id string, store_id string, movement_type string, quantity int")
    names = spark.createDataFrame([("a", "Apple", money("1"))], "product_id string, name string, price decimal(18,2)")
    shops = spark.createDataFrame([], "store_id string, store_name string")
    alerts = kpis.inventory_alerts(df, names, shops)
    got = {r.product_id: r for r in alerts.collect()}
    pick = lambda p: (got[p].stock_on_hand, got[p].days_of_supply, got[p].risk_tier, got[p].reorder_suggestion)
    assert pick("a") == (150, 150.0, "Low", 0)
    assert pick("b") == (0, 0.0, "High", 60)
    assert pick("c") == (1, 10.0, "Medium", 2)
    assert pick("d") == (14, 14.0, "Medium", 16)
    assert (got["e"].days_of_supply, got["e"].risk_tier, got["e"].sell_through_pct) == (float("inf"), "Low", 0.0)
    assert (got["f"].risk_tier, got["f"].sell_through_pct) == ("Low", 0.0)
    assert got["b"].sell_through_pct == 100.0
    assert [r.product_id for r in alerts.collect()][0] == "b"
    exported = exports.inventory_export(alerts).collect()
    assert {r["Store"] for r in exported} == {"s"}
    assert {r["Product Name"] for r in exported if r["Product ID"] != "a"} == {""}


@pytest.mark.parametrize(("stock", "tier"), [(49, "High"), (50, "Medium"), (149, "Medium"), (150, "Low")])
def test_supply_tiers(spark, stock, tier):
    df = spark.createDataFrame(
        [("a", "s", "SALE", -300), ("a", "s", "RESTOCK", 300 + stock)],
        "product_id string, store_id string, movement_type string, quantity int",
    )
    assert kpis.inventory_levels(df).first()["risk_tier"] == tier


# -- run health and BI ----------------------------------------------------------------------


def test_run_health(spark):
    audit = spark.createDataFrame(
        [("a", 3, True), ("b", 0, True), ("c", 0, False)], "table_name string, quarantine_count long, reconciled boolean"
    )
    got = rows(kpis.run_health(audit).select("table_name", "status", "incident"), "table_name")
    text = "3 records failed null checks or format enums and were quarantined."
    assert got == [("a", "Degraded", text), ("b", "Healthy", None), ("c", "Failed", None)]
    assert kpis.incidents(audit).count() == 1


def test_bi_measures_keep_unmatched_slices(spark):
    d1, d2 = date(2026, 1, 1), date(2026, 1, 2)
    sold = spark.createDataFrame([(d1, money("100"), money("60"))], "date_day date, net_sales decimal(18,2), total_cost decimal(18,2)")
    back = spark.createDataFrame([(d2, money("5"))], "date_day date, refund_amount decimal(18,2)")
    fc = spark.createDataFrame([(d1, 80.0)], "date_day date, forecast_sales double")
    got = {r.date_day: r for r in kpis.bi_measures(sold, back, ["date_day"], fc).collect()}
    assert (got[d1].gross_margin_pct, got[d1].forecast_variance, got[d1].return_rate_pct) == (0.4, 20.0, 0.0)
    assert (got[d2].total_revenue, got[d2].total_refund, got[d2].return_rate_pct) == (0, money("5.00"), 0.0)


def test_current_stock_takes_the_last_day(spark):
    snap = spark.createDataFrame(
        [("p", date(2026, 1, 1), "s", 9), ("p", date(2026, 1, 2), "s", 4), ("q", date(2026, 1, 1), "s", 1)],
        "product_key string, date_day date, store_key string, stock_on_hand long",
    )
    assert rows(kpis.current_stock(snap, ["store_key"])) == [(date(2026, 1, 2), "s", 5)]


# -- fraud ----------------------------------------------------------------------------------

PEOPLE = "id string, email string, gender string"
RETURNS = "transaction_id string, quantity int"


def score(spark, data, back=(), people=(), rules=None):
    return {
        r.transaction_line_id: r
        for r in fraud.score_fraud(
            sales(spark, data),
            spark.createDataFrame(list(back), RETURNS),
            spark.createDataFrame(list(people), PEOPLE),
            rules,
            as_of(),
        ).collect()
    }


def test_value_rule(spark):
    prices = {"1500.00": 15, "1500.01": 35, "800.00": 0, "800.01": 15, "2000.00": 35}
    data = [sale(p, f"C{p}", "2026-05-01 10:00:00", price=p) for p in prices]
    got = score(spark, data)
    assert {i: r.fraud_score for i, r in got.items()} == prices
    assert json.loads(got["800.00"].risk_factors) == ["Normal purchase indicators"]
    assert json.loads(got["1500.01"].risk_factors) == ["High order value of $1500.01 (exceeds threshold of $1500)"]
    assert (got["1500.01"].risk_tier, got["1500.01"].review_status) == ("Medium", "Pending")
    assert (got["1500.00"].risk_tier, got["1500.00"].review_status) == ("Low", "Approved")


def test_burst_and_missing_customer(spark):
    data = [sale(f"b{i:02d}", "C1", f"2026-05-01 10:{2 * i:02d}:00") for i in range(12)]
    data += [sale(f"n{i}", None, "2026-05-01 10:00:00") for i in range(6)]
    got = score(spark, data)
    assert [got[f"b{i:02d}"].fraud_score for i in range(12)] == [0, 0, 20, 20] + [40] * 8
    assert all(got[f"n{i}"].fraud_score == 0 for i in range(6))
    assert json.loads(got["b11"].risk_factors) == ["High transaction velocity: 12 transactions in the last hour"]


def test_profile_and_return_rules(spark):
    data = [sale(f"a{i}", "C1", f"2026-05-0{i} 10:00:00") for i in (1, 2, 3, 4, 5, 6, 7, 8)]
    data += [sale("b1", "C2", "2026-05-01 10:00:00"), sale("c1", "C3", "2026-05-01 10:00:00")]
    back = [(f"Ta{i}", 1) for i in (1, 2, 3, 4, 5)]
    people = [("C1", "x-malformed", "F"), ("C2", "malformed@example.com", "X"), ("C2", "a@example.com", None)]
    got = score(spark, data, back, people)
    assert got["a1"].fraud_score == 35
    assert json.loads(got["a1"].risk_factors) == [
        "Customer profile has invalid/malformed email syntax",
        "Customer has a high return frequency ratio (62%)",
    ]
    assert json.loads(got["b1"].risk_factors) == ["Customer profile has unrecognized gender code 'X'"]
    assert got["c1"].fraud_score == 0


def test_a_line_without_a_time_still_has_a_customer(spark):
    line = list(sale("a", "C1", "2026-05-01 10:00:00"))
    line[-1] = None
    got = score(spark, [tuple(line), sale("b", "C1", "2026-05-01 10:00:00")], (), [("C1", "malformed", "F")])
    assert {i: r.fraud_score for i, r in got.items()} == {"a": 15, "b": 15}


def test_tiers_and_cap(spark):
    data = [sale(f"a{i}", "C1", f"2026-05-01 10:0{i}:00", price="9000.00") for i in range(6)]
    back = [(f"Ta{i}", 1) for i in range(6)]
    got = score(spark, data, back, [("C1", "malformed", "Q")])
    assert got["a5"].fraud_score == 100 and got["a5"].risk_tier == "High"
    assert got["a0"].fraud_score == 80


def test_queue_and_review(spark):
    queue = spark.createDataFrame(
        [("l1", "T1", "High", '["a", "b"]', "Pending"), ("l2", "T1", "Low", "plain", "Approved"), ("l3", "T2", "High", "[]", "Pending")],
        "transaction_line_id string, transaction_id string, risk_tier string, risk_factors string, review_status string",
    )
    assert [r.risk_factors for r in fraud.fraud_queue(queue).orderBy("transaction_line_id").collect()] == [["a", "b"], ["plain"], []]
    assert fraud.fraud_queue(queue, "High").count() == 2
    schema = "transaction_id string, status string, decided_at long"
    decisions = spark.createDataFrame([("T1", "Approved", 1), ("T1", "Dismissed", 2)], schema)
    got = fraud.apply_review(queue, decisions).select("transaction_line_id", "review_status")
    assert rows(got, "transaction_line_id") == [("l1", "Dismissed"), ("l2", "Dismissed"), ("l3", "Pending")]
    with pytest.raises(Exception, match="Invalid status"):
        fraud.apply_review(queue, spark.createDataFrame([("T1", "Maybe", 1)], schema)).collect()


def test_returned_quantity(spark):
    back = spark.createDataFrame([("T1", 2), ("T1", 3)], RETURNS)
    got = fraud.with_returned_qty(spark.createDataFrame([("T1",), ("T2",)], "transaction_id string"), back)
    assert rows(got, "transaction_id") == [("T1", 5), ("T2", 0)]


# -- forecast -------------------------------------------------------------------------------


def daily_sales(spark, days, rows_per_day=1, level=100):
    data = []
    for i in range(days):
        at = date(2026, 1, 1) + timedelta(days=i)
        for j in range(rows_per_day):
            data.append(sale(f"{i}-{j}", "C", f"{at} 10:00:00", price=f"{level + 7 * (i % 7) + i}.00"))
    return sales(spark, data), spark.createDataFrame([("P1", "A", money("1"))], CATALOG)


@pytest.mark.parametrize(("days", "usable"), [(13, 0), (20, 0), (21, 7), (40, 26)])
def test_short_slices_are_skipped(spark, days, usable):
    features = forecast.forecast_features(*daily_sales(spark, days))
    counts = {(r.channel, r.category): r["count"] for r in features.groupBy("channel", "category").count().collect()}
    assert counts == ({} if not usable else dict.fromkeys([("ALL", "ALL"), ("POS", "ALL"), ("ALL", "A")], usable))


def test_features_against_pandas(spark):
    df, catalog = daily_sales(spark, 40)
    got = forecast.forecast_features(df, catalog).where("channel = 'ALL' and category = 'ALL'").toPandas()
    got = got.sort_values("date_day").reset_index(drop=True)
    values = np.array([100 + 7 * (i % 7) + i for i in range(40)], dtype=float)
    for pos, i in enumerate(range(14, 40)):
        r = got.iloc[pos]
        assert r.net_sales == values[i] and r.lag_1 == values[i - 1] and r.lag_14 == values[i - 14]
        assert r.rolling_mean_7 == pytest.approx(values[i - 7 : i].mean())
        assert r.rolling_std_14 == pytest.approx(values[i - 14 : i].std(ddof=1))
        day = date(2026, 1, 1) + timedelta(days=i)
        assert (r.day_of_week, r.is_weekend) == (day.weekday(), float(day.weekday() >= 5))
        assert r.is_payday == float(day.day in (1, 15, 30, 31))
        assert (r.marketing_spend_7d, r.avg_discount_pct, r.stockout_rate) == (0, 0, 0)


def plain_ridge(x, y, alpha=1.0):
    """The penalised normal equations with a free intercept."""
    ones = np.hstack([x, np.ones((len(x), 1))])
    solution = np.linalg.solve(ones.T @ ones + alpha * np.diag([1.0] * x.shape[1] + [0.0]), ones.T @ y)
    return solution[:-1], solution[-1]


def summed(spark, x, y):
    """The sums of the products of all pairs of (one, inputs, target), as ``ridge`` takes them."""
    columns = np.hstack([np.ones((len(x), 1)), x, y[:, None]])
    sums = columns.T @ columns
    return spark.createDataFrame([([float(sums[i, j]) for i in range(18) for j in range(i, 18)],)], "t array<double>")


@pytest.mark.parametrize("alpha", [1.0, 0.01, 50.0])
def test_ridge_matches_the_penalised_normal_equations(spark, alpha):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 16)) + 3, rng.normal(size=60)
    x[:, 13:] = 0  # columns without any value take no weight
    weights, intercept = plain_ridge(x, y, alpha)
    got = forecast.ridge(summed(spark, x, y), "t", alpha).first()
    assert np.allclose(got.weights, weights, atol=1e-9) and np.isclose(got.intercept, intercept) and got.weights[13:] == [0, 0, 0]


def test_ridge_with_fewer_rows_than_inputs(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(5, 16)), rng.normal(size=5)
    weights, intercept = plain_ridge(x, y)
    got = forecast.ridge(summed(spark, x, y), "t").first()
    assert np.allclose(got.weights, weights) and np.isclose(got.intercept, intercept)


def test_gram_and_pandas_sums_agree(spark):
    features = forecast.forecast_features(*daily_sales(spark, 60)).where("channel = 'POS'")
    pdf = features.toPandas()
    for r in forecast.forecast_gram(features).collect():
        assert float(r.total) == pytest.approx((pdf[r.left_column] * pdf[r.right_column]).sum(), rel=1e-4)  # four decimals


def test_forecast_table(spark):
    features = forecast.forecast_features(*daily_sales(spark, 60))
    got = forecast.forecast(features, as_of=as_of()).where("channel = 'POS'").orderBy("date_day").collect()
    assert [r.date_day for r in got] == [date(2026, 3, 2) + timedelta(days=i) for i in range(7)]
    assert all(r.forecast_sales >= 0 for r in got)
    assert got[0].model_name == "Ridge Multi-Forecast (POS/ALL)"
    metrics = json.loads(got[0].metrics_json)
    assert set(metrics) == {"mae", "rmse", "wape", "channel", "category", "evaluated_at", "feature_impacts"}
    assert list(metrics["feature_impacts"]) == forecast.FEATURES
    assert all(metrics["feature_impacts"][c] == 0 for c in forecast.FEATURES[-3:])
    assert metrics["evaluated_at"] == "2026-07-01 00:00:00"
    held_out = forecast.holdout_predictions(forecast.slice_summary(features)).where("channel = 'POS'").count()
    assert held_out == 7


def test_holdout_is_predicted_from_the_older_days(spark):
    features = forecast.forecast_features(*daily_sales(spark, 60)).where("channel = 'POS'")
    pdf = features.toPandas().sort_values("date_day")
    x, y = pdf[forecast.FEATURES].to_numpy(float), pdf["net_sales"].to_numpy(float)
    weights, intercept = plain_ridge(x[:-7], y[:-7])
    got = forecast.holdout_predictions(forecast.slice_summary(features)).orderBy("date_day").collect()
    assert [r.actual for r in got] == list(y[-7:])
    assert np.allclose([r.predicted for r in got], np.maximum(x[-7:] @ weights + intercept, 0), rtol=1e-3)


@pytest.mark.parametrize("days", [21, 24, 60])
def test_projection_feeds_on_itself(spark, days):
    """All seven days against a plain loop, also where the history is shorter than the longest lag."""
    features = forecast.forecast_features(*daily_sales(spark, days)).where("channel = 'POS'")
    pdf = features.toPandas().sort_values("date_day")
    weights, intercept = plain_ridge(pdf[forecast.FEATURES].to_numpy(float), pdf["net_sales"].to_numpy(float))
    known, day = list(pdf["net_sales"].to_numpy()[-14:]), pdf["date_day"].iloc[-1]
    for got in forecast.forecast_steps(forecast.slice_summary(features)).orderBy("date_day").collect():
        day += timedelta(days=1)
        full, event = len(known) >= 14, (day.month, day.day) in {(1, 1), (7, 4), (12, 24), (12, 25), (12, 31)}
        x = [day.weekday(), day.day, day.month, day.weekday() >= 5, day.day in (1, 15, 30, 31), event]
        x += [known[-1], known[-2], known[-7], known[-14] if full else known[-7], np.mean(known[-7:]), np.mean(known[-14:])]
        x += [np.std(known[-14:], ddof=1) if full else 0, 0, 0, 0]
        known.append(max(float(np.dot(x, weights) + intercept), 0))
        assert got.date_day == day and got.forecast_sales == pytest.approx(known[-1], rel=1e-3)


def test_first_step_follows_from_the_fit(spark):
    features = forecast.forecast_features(*daily_sales(spark, 60)).where("channel = 'POS'")
    pdf = features.toPandas().sort_values("date_day")
    weights, intercept = plain_ridge(pdf[forecast.FEATURES].to_numpy(float), pdf["net_sales"].to_numpy(float))
    known = pdf["net_sales"].to_numpy()
    day = date(2026, 3, 2)
    x = [day.weekday(), 2, 3, 0.0, 0.0, 0.0, known[-1], known[-2], known[-7], known[-14]]
    x += [known[-7:].mean(), known[-14:].mean(), known[-14:].std(ddof=1), 0, 0, 0]
    first = forecast.forecast_steps(forecast.slice_summary(features)).orderBy("date_day").first()["forecast_sales"]
    assert first == pytest.approx(max(float(np.dot(x, weights) + intercept), 0.0), abs=0.02)  # inputs count to four decimals


def test_slices_keep_a_real_null_apart(spark):
    df = spark.createDataFrame(
        [(date(2026, 1, 1), None, "A", 1), (date(2026, 1, 1), "POS", "A", 2)],
        "date_day date, channel string, category string, v long",
    )
    got = rows(sales_slices(df, "v").select("channel", "category", "v"))
    assert sorted(got, key=str) == sorted([("ALL", "ALL", 3), (None, "ALL", 1), ("POS", "ALL", 2), ("ALL", "A", 3)], key=str)


def test_densify(spark):
    df = spark.createDataFrame([("a", date(2026, 1, 1), 5), ("a", date(2026, 1, 4), 7), ("b", date(2026, 2, 1), 1)], "k string, d date, v long")
    got = rows(densify(df, ["k"], "d", "v"), "k", "d")
    assert [(k, d.day, v) for k, d, v in got] == [("a", 1, 5), ("a", 2, 0), ("a", 3, 0), ("a", 4, 7), ("b", 1, 1)]


def test_accuracy(spark):
    df = spark.createDataFrame([("a", 10.0, 8.0), ("a", 0.0, 1.0), ("b", 0.0, 1.0)], "k string, y double, p double")
    got = {r.k: r for r in accuracy(df, ["k"], "y", "p").collect()}
    assert (got["a"].mae, got["a"].wape) == (1.5, 30.0)
    assert got["a"].rmse == pytest.approx(np.sqrt(2.5))
    assert got["b"].wape == 0.0


# -- privacy --------------------------------------------------------------------------------


def test_masking(spark):
    df = spark.createDataFrame(
        [("1", "Alexander", "Ng", "joe@host.com", "+1-555-0123", "1985-05-17")],
        "id string, first_name string, last_name string, email string, phone string, birth_date string",
    )
    row = privacy.mask_pii(df, CONTRACTS["customers"]).first()
    assert tuple(row) == ("1", "A***ander", "N***", "j***@host.com", "***-***-0123", date(1985, 5, 1))


def test_erasure_leaves_everyone_else_alone(spark):
    df = spark.createDataFrame(
        [("1", "Ann", "Lee", "a@b.c", "5", "k1"), ("1", "Anna", "Lee", "a@b.c", "5", "k2"), ("2", "Bo", "Ng", "b@b.c", None, "k3")],
        "customer_id string, first_name string, last_name string, email string, phone string, customer_key string",
    )
    asked = spark.createDataFrame([("1",), ("1",), (None,)], "customer_id string")
    got = rows(privacy.forget(df, asked), "customer_key")
    gone = ("1", "DELETED_USER", "DELETED_USER", "forgotten@compliance.com", "")
    assert got == [(*gone, "k1"), (*gone, "k2"), ("2", "Bo", "Ng", "b@b.c", None, "k3")]
    assert privacy.forget(df, asked).columns == df.columns
    assert df.where(F.col("first_name") == "Ann").count() == 1


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"long " * 40])
def test_tokens_are_hmac_sha256(spark, key):
    import hashlib
    import hmac

    df = spark.createDataFrame([(" Änne@Example.com ", "+1-555"), (None, ""), ("änne@example.com", None)], "email string, phone string")

    def token(value):
        return None if value is None else hmac.new(key, value.encode(), hashlib.sha256).hexdigest()

    got = privacy.tokenize(df, key)
    assert rows(got) == [(token("änne@example.com"), token("+1-555")), (None, token("")), (token("änne@example.com"), None)]
    vault = privacy.token_vault(df, key)
    assert sorted((r.kind, r.value) for r in vault.collect()) == [("email", "änne@example.com"), ("phone", ""), ("phone", "+1-555")]
    back = privacy.reidentify(got, vault.where("value <> ''"))
    assert sorted(rows(back), key=str) == sorted([("änne@example.com", "+1-555"), (None, token("")), ("änne@example.com", None)], key=str)
