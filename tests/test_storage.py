"""Uploads, layered storage and the whole batch run."""

import json
from pathlib import Path

import pytest
from helpers import TX, as_of, money, rows, sale, ts
from pyspark.sql import functions as F

from tallyforge.contracts import CONTRACTS
from tallyforge.operators.bronze import SourceSpec
from tallyforge.operators.latest import apply_changes, upsert_by_key
from tallyforge.plans import forecast, fraud, medallion, privacy, upload
from tallyforge.plans.silver import upsert_audit
from tallyforge.sources import exports, uploads
from tallyforge.sources.layers import Lakehouse, materialize, publish, read_source


def csv_file(tmp_path, name, *lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture
def lake(spark, tmp_path):
    return Lakehouse(spark, str(tmp_path / "lake"))


# -- uploads --------------------------------------------------------------------------------


def test_foreign_sales_file(spark, tmp_path):
    path = csv_file(
        tmp_path,
        "s.csv",
        "Row ID,Order ID,Order Date,Ship Mode,Customer ID,Segment,Category,Sub-Category,Product Name,Sales",
        '1,N-71,03/11/2026,Bicycle,C1,Club,Garden,Pots,"Pot, blue",48.25',
        "2,N-72,27/02/2026,POS,C2,Club,Kitchen,Knives,Paring knife,7.40",
        "3,N-73,whenever,POS,C2,Club,Kitchen,Knives,Bread knife,1.00",
    )
    raw = uploads.read_upload(spark, path, "csv")
    shaped = uploads.harmonize_columns(raw, uploads.synonyms("transactions"))
    assert "category" in shaped.columns and "sub-category" in shaped.columns
    got = uploads.adapt_upload(raw, "transactions", "u1", as_of()).orderBy("transaction_id").collect()
    assert [r.transaction_timestamp for r in got] == [
        "2026-03-11 00:00:00",
        "2026-02-27 00:00:00",
        "2026-07-01 00:00:00",
    ]
    assert (got[0].unit_price, got[0].channel, got[0].quantity, got[0].discount) == ("48.25", "Bicycle", 1, 0.0)
    assert len({r.id for r in got}) == 3
    assert set(got[0].asDict()) <= set(uploads.TABLE_COLUMNS["transactions"])


def test_missing_columns_get_defaults(spark):
    df = spark.createDataFrame([("T1",)], "invoiceno string")
    row = uploads.adapt_upload(df, "transactions", "u", as_of()).first()
    assert (row.transaction_id, row.quantity, row.unit_price, row.discount, row.channel, row.transaction_timestamp) == (
        "T1",
        1,
        100.0,
        0.0,
        "WEBSITE",
        "2026-07-01 00:00:00",
    )


def test_synonyms_respect_the_target_table(spark):
    df = spark.createDataFrame([("P1", "1.5", "x")], "product_id string, price string, description string")
    assert uploads.adapt_upload(df, "products", "u").columns == ["id", "price", "name"]
    assert uploads.adapt_upload(df, "products", "u").first()["id"] == "P1"
    customers = spark.createDataFrame([("C1", "Ann", "now")], "customer_id string, first_name string, signup_timestamp string")
    assert uploads.adapt_upload(customers, "customers", "u").columns == ["id", "first_name"]


def test_a_spelling_yields_to_the_real_column_and_to_the_first(spark):
    df = spark.createDataFrame([("1", "2", "3")], ["quantity", "QTY", "Sales"])
    got = uploads.harmonize_columns(df, uploads.synonyms("transactions"))
    assert got.columns == ["quantity", "qty", "unit_price"]
    df = spark.createDataFrame([("1", "2")], ["price", "amount"])
    got = uploads.harmonize_columns(df, uploads.synonyms("transactions"))
    assert (got.columns, tuple(got.first())) == (["unit_price"], ("1",))


def test_ids_are_all_kept_or_all_replaced(spark):
    unique = spark.createDataFrame([("a",), ("b",)], "id string")
    assert rows(uploads.ensure_id(unique, "u"), "id") == [("a",), ("b",)]
    repeated = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    fresh = {r.id for r in uploads.ensure_id(repeated, "u").collect()}
    assert len(fresh) == 3 and not fresh & {"a", "b"}
    assert {r.id for r in uploads.ensure_id(repeated, "u").collect()} == fresh


def test_uploads_of_one_file_name_keep_each_other(spark, lake, tmp_path):
    """Two folders, one file name, different columns; then the second upload again under its own id."""
    first = csv_file(tmp_path, "orders.csv", "Order ID,Customer ID,Sales", "T1,C1,5.00", "T2,C2,6.00")
    (tmp_path / "b").mkdir()
    second = csv_file(tmp_path / "b", "orders.csv", "Order ID,Store ID,Qty", "T8,S1,2.5", "T9,S1,4")
    upload.ingest_upload(lake, first, "csv", "transactions", as_of=as_of())
    for _ in range(2):
        upload.ingest_upload(lake, second, "csv", "transactions", "again", as_of())
    got = lake.read("source", "transactions").orderBy("transaction_id").collect()
    assert [(r.transaction_id, r.customer_id, r.store_id, r.quantity) for r in got] == [
        ("T1", "C1", None, 1), ("T2", "C2", None, 1), ("T8", None, "S1", None), ("T9", None, "S1", 4),
    ]
    assert [r.transaction_id for r in lake.read("light", "transactions").orderBy("transaction_id").collect()] == ["T1", "T2", "T9"]


def test_csv_line_breaks_and_short_rows(spark, tmp_path):
    path = csv_file(tmp_path, "q.csv", "order id,description", 'T1,"two', 'lines"', "T2,plain")
    assert rows(uploads.read_upload(spark, path, "csv"), "order id") == [("T1", "two\nlines"), ("T2", "plain")]
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        uploads.read_upload(spark, path, "csv", multi_line=False).collect()


def test_json_upload(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text(json.dumps([{"id": "1", "qty": 3}, {"id": "2", "qty": 4}]))
    got = uploads.harmonize_columns(uploads.read_upload(spark, str(path), "json"), uploads.synonyms("transactions"))
    assert rows(got.select("id", "quantity"), "id") == [("1", 3), ("2", 4)]
    with pytest.raises(ValueError):
        uploads.read_upload(spark, str(path), "xlsx")


# -- keyed writes ---------------------------------------------------------------------------


def test_upsert_replaces_and_appends(spark):
    target = spark.createDataFrame([("1", "a", 1), ("2", "b", 2)], "id string, v string, n int")
    new = spark.createDataFrame([("2", "x"), ("3", "y"), ("3", "z")], "id string, v string")
    assert rows(upsert_by_key(target, new, ["id"]), "id", "v") == [("1", "a", 1), ("2", "x", None), ("3", "y", None), ("3", "z", None)]


def test_changes_apply_in_sequence_whatever_their_arrival(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (9, "z")], "id int, v string")
    log = [(1, "U", "a2", 5), (1, "U", "late", 3), (2, "D", None, 4), (3, "C", "c", 1), (4, "C", "d", 1), (4, "D", None, 2)]
    changes = spark.createDataFrame(log, "id int, operation_type string, v string, seq int")
    assert rows(apply_changes(base, changes, ["id"], ["seq"]), "id") == [(1, "a2"), (3, "c"), (9, "z")]
    twice = changes.union(changes)
    assert rows(apply_changes(base, twice, ["id"], ["seq"]), "id") == [(1, "a2"), (3, "c"), (9, "z")]


def test_audit_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "table_name string, n int")
    new = spark.createDataFrame([("b", 3)], "table_name string, n int")
    assert rows(upsert_audit(old, new), "table_name") == [("a", 1), ("b", 3)]


# -- layers ---------------------------------------------------------------------------------


def test_a_table_may_be_rewritten_from_itself(spark, lake):
    assert lake.read("silver", "t") is None
    lake.write(spark.range(3), "silver", "t")
    lake.write(lake.read("silver", "t").where("id > 0"), "silver", "t")
    assert lake.read("silver", "t").count() == 2
    lake.write(spark.range(0), "silver", "t")
    assert lake.read("silver", "t") is None


def test_an_unfinished_version_does_not_count(spark, lake, tmp_path):
    lake.write(spark.range(3), "silver", "t")
    (tmp_path / "lake" / "silver" / "t" / "v=000002").mkdir()
    assert lake.read("silver", "t").count() == 3
    lake.write(spark.range(5), "silver", "t")
    assert lake.read("silver", "t").count() == 5


def test_repeating_a_run_replaces_its_rows(spark, lake):
    lake.append_run(spark.range(3), "quarantine", "t", "r1")
    lake.append_run(spark.range(4), "quarantine", "t", "r2")
    lake.append_run(spark.range(3), "quarantine", "t", "r1")
    assert lake.read_runs("quarantine", "t").count() == 7


def test_publish_and_materialize(spark):
    df = spark.sql("select 1 id, cast(1.25 as decimal(18,2)) price, timestamp'2026-01-01 00:00:00' at")
    table = publish(df, "things")
    assert dict(spark.table(table).dtypes) == {"id": "int", "price": "decimal(18,2)", "at": "timestamp_ntz"}
    stored = materialize(df, "mart_things", "id")
    assert stored.count() == 1
    joined = stored.join(spark.table("mart_things").withColumnRenamed("price", "p"), "id").hint("merge")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_read_source(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "p"))
    assert read_source(spark, str(tmp_path / "p")).count() == 10
    with pytest.raises(ValueError, match="bounds"):
        read_source(spark, "t", "jdbc", url="jdbc:none")
    spark.range(0).write.parquet(str(tmp_path / "none"))
    assert read_source(spark, str(tmp_path / "none")) is None


def test_csv_export(spark, tmp_path):
    exports.export_csv(spark.sql("select 1 `Stock Level`, 'a,b' Store"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert text == 'Stock Level,Store\n1,"a,b"\n'


# -- whole run ------------------------------------------------------------------------------


def source_tables(spark):
    sales = [
        sale(f"L{i}", f"C{i % 3}" if i % 5 else None, f"2026-05-{1 + i % 28:02d} 10:00:00", qty=1 + i % 3, price="20.00",
             product=f"P{i % 4}", channel=("POS", "WEBSITE")[i % 2])
        for i in range(120)
    ]
    sales.append(sale("bad", "C1", "2026-05-01 10:00:00", qty=-2, price="-10.00"))
    people = [(f"C{i}", "Ann", "Lee", f"u{i}@example.com", "+1-555-0123", "f", "ny", "1990-01-01", ts(f"2026-0{v}-01 00:00:00")) for i in range(3) for v in (1, 3)]
    goods = [(f"P{i}", f"sku{i}", f"n{i}", "Apparel", money("30.00"), money("12.00"), ts("2026-01-01 00:00:00")) for i in range(4)]
    moves = [(f"M{i}", f"P{i % 4}", "S1", ("RESTOCK", "SALE")[i % 2], (9, -2)[i % 2], ts(f"2026-05-{1 + i:02d} 08:00:00")) for i in range(8)]
    return {
        "transactions": spark.createDataFrame(sales, TX),
        "customers": spark.createDataFrame(
            people,
            "id string, first_name string, last_name string, email string, phone string, gender string, state string,"
            " birth_date string, updated_at timestamp_ntz",
        ),
        "products": spark.createDataFrame(
            goods, "id string, sku string, name string, category string, price decimal(10,2), cost decimal(10,2), updated_at timestamp_ntz"
        ),
        "stores": spark.createDataFrame([("S1", "Main", "X", "NY", "US")], "id string, name string, city string, state string, country string"),
        "returns": spark.createDataFrame(
            [("R1", "TL1", "P1", 1, money("20.00"), "DEFECTIVE", ts("2026-05-20 00:00:00"))],
            "id string, transaction_id string, product_id string, quantity int, refund_amount decimal(10,2), return_reason string, return_timestamp timestamp_ntz",
        ),
        "inventory_movements": spark.createDataFrame(
            moves, "id string, product_id string, store_id string, movement_type string, quantity int, movement_timestamp timestamp_ntz"
        ),
        "marketing_campaigns": spark.createDataFrame(
            [("K1", "Spring", "EMAIL", money("100.00"), 50, 10, 2, "2026-05-02")],
            "id string, campaign_name string, channel string, cost decimal(10,2), impressions int, clicks int, conversions int, campaign_date string",
        ),
        "support_tickets": spark.createDataFrame(
            [("X1", "C1", "DELIVERY", "OPEN", "HIGH", ts("2026-05-02 00:00:00"), None)],
            "id string, customer_id string, issue_category string, status string, priority string, ticket_timestamp timestamp_ntz, resolution_timestamp timestamp_ntz",
        ),
    }


def test_batch_run_end_to_end(spark, lake):
    tables = source_tables(spark)

    def read(name):
        if name == "stores_broken":
            raise RuntimeError("no connection")
        return tables.get(name)

    outcome = medallion.ingest_all(
        lake, read, "run1", [*medallion.SOURCES, medallion.SourceSpec("stores_broken", "X"), medallion.SourceSpec("nowhere", "X")], as_of()
    )
    assert outcome["transactions"] == "written" and outcome["nowhere"] == "empty"
    assert outcome["stores_broken"].startswith("failed")

    for _ in range(2):  # a rerun changes nothing
        done = medallion.clean_all(lake, "run1", as_of=as_of())
        assert all(done[name] for name in tables)
    audit = {r.table_name: r for r in lake.read_audit().collect()}
    assert set(audit) == set(CONTRACTS) and all(r.reconciled for r in audit.values())
    assert (audit["transactions"].bronze_count, audit["transactions"].quarantine_count) == (121, 1)
    held = lake.read_runs("quarantine", "transactions")
    assert rows(held.select("id", "quarantine_reason")) == [("bad", "quantity is below min value 1")]
    assert lake.read("silver", "customers").count() == 6

    star = medallion.build_star(lake, "2026-05-01", "2026-05-31", F.lit("2026-05-20").cast("date"))
    assert star["fact_sales_line"].count() == 120
    assert star["dim_customer"].where("is_current").count() == 3
    assert star["fact_inventory_daily_snapshot"].count() == 4 * 20
    assert star["fact_marketing_daily"].first()["click_to_conv_rate"] == 0.2
    assert star["fact_customer_activity"].count() == 96 + 1 + 1
    unknown = spark.sql("select md5('CUST-UNKNOWN') k").first()["k"]
    assert star["fact_sales_line"].where(F.col("customer_key") == unknown).count() == 24

    assert medallion.current_silver(lake, "customers").count() == 3
    silver = {n: medallion.current_silver(lake, n) for n in ("transactions", "products", "returns", "customers")}
    products = silver["products"].withColumnRenamed("id", "product_id")
    medallion.refresh_analytics(lake, silver["transactions"], products, silver["returns"], silver["customers"], as_of())
    assert lake.read("gold", "fact_fraud_queue").count() == 120
    assert lake.read("gold", "fact_sales_forecast").count() == 7 * 4


def test_erasure_leaves_no_name_in_any_layer(spark, lake, tmp_path):
    tables = source_tables(spark)
    for name, df in tables.items():
        lake.write(df, "source", name)
    medallion.ingest_all(lake, lambda t: tables.get(t), "r1", as_of=as_of())
    medallion.clean_all(lake, "r1", as_of=as_of())
    lake.write(upload.light_silver("customers", lake.read("source", "customers")), "light", "customers")
    medallion.build_star(lake, as_of=F.lit("2026-05-20").cast("date"))
    person = lake.read("source", "customers").where("id = 'C1'").first()
    held = lake.read("silver", "customers").select("id", "first_name", "last_name", "email", "phone").limit(1)
    lake.append_run(held.withColumn("id", F.lit("C1")).withColumn("first_name", F.lit(person.first_name)), "quarantine", "customers", "r0")
    medallion.ingest_since(lake, tables["customers"], SourceSpec("customers", "CRM"), "r1", "updated_at", as_of=as_of())
    spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    privacy.erase_customers(lake, spark.createDataFrame([("C1",), (None,)], "customer_id string"))
    for layer, name, key in privacy.CUSTOMER_TABLES:
        rows_of = lake.read(layer, name).where(F.col(key) == "C1").collect()
        assert rows_of and all(r.first_name == privacy.ERASED_NAME and r.email == privacy.ERASED_EMAIL for r in rows_of), (layer, name)
        assert len(lake._versions(layer, name)) == 1
    raw = lake.read("bronze", "customers").where("business_key = 'C1'").collect()
    assert raw and all(person.email not in r.raw_payload and privacy.ERASED_NAME in r.raw_payload for r in raw)
    assert all(r.first_name == privacy.ERASED_NAME for r in lake.read_runs("quarantine", "customers").where("id = 'C1'").collect())
    read_by_mark = lake.read_runs("extracts", "customers").where("business_key = 'C1'").collect()
    assert read_by_mark and all(person.email not in r.raw_payload and privacy.ERASED_NAME in r.raw_payload for r in read_by_mark)
    others = lake.read("silver", "customers").where("id <> 'C1'").collect()
    assert others and all(r.first_name != privacy.ERASED_NAME for r in others)


def test_reviews_are_stored_and_silver_published(spark, lake):
    lines = [("L1", "T1", "C1", "Pending"), ("L2", "T2", None, "Pending"), ("L3", "T3", None, "Approved")]
    queue = spark.createDataFrame(lines, "transaction_line_id string, transaction_id string, customer_id string, review_status string")
    with pytest.raises(ValueError):
        medallion.record_review(lake, queue)
    lake.write(queue, "gold", "fact_fraud_queue")
    for number, (transaction, status) in enumerate((("T1", "Approved"), ("T1", "Dismissed"), ("T2", "Approved"), ("T9", "Approved"))):
        decision = spark.createDataFrame([(transaction, status, number)], "transaction_id string, status string, decided_at int")
        medallion.record_review(lake, decision)
    stored = lake.read("gold", "fact_fraud_queue").orderBy("transaction_id").collect()
    assert [r.review_status for r in stored] == ["Dismissed", "Approved", "Approved"]
    lake.write(spark.createDataFrame([("S1", "Shop")], "id string, name string"), "silver", "stores")
    assert medallion.publish_silver(lake) == ["silver_stores"]
    assert spark.table("silver_stores").first().name == "Shop"
    assert lake.prune("gold", "fact_fraud_queue")[0] == 1 and lake.read("gold", "fact_fraud_queue").count() == 3


def test_upload_run(spark, lake, tmp_path):
    for name, df in source_tables(spark).items():
        lake.write(df, "source", name)
    for name in ("customers", "products", "returns"):
        lake.write(upload.light_silver(name, lake.read("source", name)), "light", name)
    path = csv_file(
        tmp_path,
        "u.csv",
        "id,transaction_id,customer_id,channel,product_id,quantity,unit_price,discount,transaction_timestamp",
        "L1,TL1,C1,POS,P1,7,5.00,0.00,2026-05-02 10:00:00",
        "N1,TN1,C1,POS,P1,0,5.00,0.00,2026-05-02 10:00:00",
    )
    merged = upload.ingest_upload(lake, path, "csv", "transactions", "u1", as_of())
    got = {r.id: r for r in merged.collect()}
    assert len(got) == 122 and got["L1"].quantity == 7
    light = {r.id for r in lake.read("light", "transactions").collect()}
    assert "L1" in light and "N1" not in light and "bad" not in light
    assert lake.read("gold", "fact_fraud_queue").count() == len(light)
    with pytest.raises(ValueError):
        upload.ingest_upload(lake, path, "csv", "nothing", "u1")
    empty = csv_file(tmp_path, "e.csv", "id,quantity")
    with pytest.raises(ValueError):
        upload.ingest_upload(lake, empty, "csv", "transactions", "u1")


def files_of(lake, layer, name):
    root = lake.path(layer, name).removeprefix("file://")
    return {p.relative_to(root) for p in Path(root).rglob("part-*.parquet") if "_buckets" not in p.parts}


def test_changes_by_key_write_touched_buckets_only(spark, lake):
    table = spark.sql("select 'k' || id id, id v from range(500)")
    lake.write(table, "silver", "t")
    key = spark.createDataFrame([("k7",)], "id string")
    assert lake.replace_keys("silver", "t", key, spark.createDataFrame([("k7", 700)], "id string, v long"), ["id"], 16) == list(range(16))
    before = files_of(lake, "silver", "t")
    changes = spark.createDataFrame([("k7", 701, "x"), ("new", 1, "y")], "id string, v long, note string")
    gone = spark.createDataFrame([("k9",)], "id string")
    touched = lake.replace_keys("silver", "t", changes.select("id").unionByName(gone), changes, ["id"])
    written = files_of(lake, "silver", "t") - before
    assert 1 <= len(touched) <= 3 and {p.parts[0] for p in written} == {"v=000003"}
    assert {p.parts[1] for p in written} <= {f"_bucket={b}" for b in touched}
    got = lake.read("silver", "t")
    assert got.columns == ["id", "v", "note"] and got.count() == 500
    assert rows(got.where("id in ('k7', 'k9', 'new', 'k8')"), "id") == [("k7", 701, "x"), ("k8", 8, None), ("new", 1, "y")]
    assert rows(lake.read_keys("silver", "t", key, ["id"])) == [("k7", 701, "x")]
    opened = {f.split("/_bucket=")[1].split("/")[0] for f in lake.read_keys("silver", "t", key, ["id"]).inputFiles() if "_bucket=" in f}
    assert len(opened) == 1
    with pytest.raises(ValueError):
        lake.replace_keys("silver", "t", changes, changes, ["v"])
    # older versions go, but for the buckets that nothing newer has
    assert lake.prune("silver", "t") == [1]
    assert lake.read("silver", "t").count() == 500 and rows(lake.read_keys("silver", "t", key, ["id"])) == [("k7", 701, "x")]
    assert len(files_of(lake, "silver", "t")) < len(before | written)
    lake.write(table, "silver", "t")
    assert lake.read("silver", "t").count() == 500 and lake.read("silver", "t").columns == ["id", "v"]


def test_a_change_counts_once_it_is_complete(spark, lake):
    lake.replace_keys("silver", "t", spark.sql("select id from range(9)"), spark.sql("select id, 1 v from range(9)"), ["id"], 4)
    lake.replace_keys("silver", "t", spark.sql("select id from range(2)"), spark.sql("select id, 2 v from range(2)"), ["id"])
    newest = Path(lake.path("silver", "t").removeprefix("file://")) / "v=000002" / "_SUCCESS"
    newest.unlink()  # as if the job had been lost while it wrote
    assert lake.read("silver", "t").where("v = 1").count() == 9
    lake.replace_keys("silver", "t", spark.sql("select id from range(2)"), spark.sql("select id, 3 v from range(2)"), ["id"])
    assert rows(lake.read("silver", "t").groupBy("v").count(), "v") == [(1, 7), (3, 2)]
    # all rows of all keys removed
    lake.replace_keys("silver", "t", spark.sql("select id from range(9)"), spark.sql("select id, 1 v from range(0)"), ["id"])
    assert lake.read("silver", "t") is None or lake.read("silver", "t").count() == 0


def test_null_keys_are_replaced_too(spark, lake):
    first = spark.createDataFrame([(None, 1), ("a", 2)], "id string, v int")
    lake.replace_keys("silver", "t", first, first, ["id"], 4)
    second = spark.createDataFrame([(None, 3)], "id string, v int")
    lake.replace_keys("silver", "t", second, second, ["id"])
    assert sorted((r.id or "", r.v) for r in lake.read("silver", "t").collect()) == [("", 3), ("a", 2)]


def test_an_upload_costs_what_it_changes(spark, lake, tmp_path):
    """After the first upload, a second one leaves other buckets, customers and days alone, and the result is that of a full run."""
    for name, df in source_tables(spark).items():
        lake.write(df, "source", name)
    for name in ("customers", "products", "returns"):
        lake.write(upload.light_silver(name, lake.read("source", name)), "light", name)
    header = "id,transaction_id,customer_id,channel,product_id,quantity,unit_price,discount,transaction_timestamp"

    def load(name, *lines):
        upload.ingest_upload(lake, csv_file(tmp_path, name, header, *lines), "csv", "transactions", name, as_of())

    load("a.csv", "L1,TL1,C1,POS,P1,7,5.00,0.00,2026-05-02 10:00:00")
    tables = [("source", "transactions"), ("light", "transactions"), ("gold", "fact_fraud_queue"), ("staged", "daily_sales")]
    medallion.record_review(lake, spark.createDataFrame([("TL1", "Dismissed", 1)], "transaction_id string, status string, decided_at int"))
    before = {t: files_of(lake, *t) for t in tables}
    # a changed line moves from one customer to another, on one day
    load("b.csv", "L1,TL1,C2,POS,P1,9,5.00,0.00,2026-05-02 11:00:00", "N2,TN2,,POS,P1,1,5.00,0.00,2026-05-03 11:00:00")
    for t in tables:
        written = files_of(lake, *t) - before[t]
        assert 1 <= len({p.parts[1] for p in written}) <= 3, t  # C1, C2 and no customer at most
    queue = {r.transaction_line_id: r for r in lake.read("gold", "fact_fraud_queue").collect()}
    light = {n: lake.read("light", n) for n in ("transactions", "products", "returns", "customers")}
    want = fraud.score_fraud(light["transactions"], light["returns"], light["customers"], as_of=as_of()).collect()
    assert {r.transaction_line_id: (r.customer_id, r.fraud_score, r.risk_factors) for r in want} == {
        k: (r.customer_id, r.fraud_score, r.risk_factors) for k, r in queue.items()
    }
    products = light["products"].withColumnRenamed("id", "product_id")
    features = forecast.forecast_features(light["transactions"], products)
    again = forecast.forecast(features, as_of=as_of())
    columns = ["date_day", "channel", "category", "forecast_sales", "metrics_json"]
    assert rows(lake.read("gold", "fact_sales_forecast").select(*columns), *columns[:3]) == rows(again.select(*columns), *columns[:3])
    # a third upload touches the queue's buckets of its customers only
    before = files_of(lake, "gold", "fact_fraud_queue")
    load("c.csv", "N3,TN3,C1,POS,P1,1,5.00,0.00,2026-05-04 11:00:00")
    assert len({p.parts[1] for p in files_of(lake, "gold", "fact_fraud_queue") - before}) == 1


def test_extracts_read_behind_the_mark(spark, lake):
    spec = SourceSpec("stores", "STORES")

    def extract(run, *rows_, **options):
        source = spark.createDataFrame([(i, name, d and ts(f"2026-05-{d:02d} 00:00:00")) for i, name, d in rows_], "id string, name string, updated_at timestamp_ntz")
        return medallion.ingest_since(lake, source, spec, run, "updated_at", "2 days", as_of(), **options)

    def known():
        return sorted((r.business_key, json.loads(r.raw_payload)["name"]) for r in medallion.extracted(lake, "stores").collect())

    assert medallion.extracted(lake, "stores") is None and not medallion.ingest_since(lake, None, spec, "r0", "updated_at")
    assert extract("r1", ("a", "one", 1), ("b", "two", 10))
    # c was committed late within the overlap, d too late for it, e has no time, a is no longer read
    again = [("a", "changed", 1), ("b", "two", 10), ("c", "late", 8), ("d", "too late", 7), ("e", "no time", None), ("f", "new", 12)]
    assert extract("r2", *again) and extract("r2", *again)
    assert known() == [("a", "one"), ("b", "two"), ("c", "late"), ("e", "no time"), ("f", "new")]
    assert not extract("r3", ("a", "one", 1))
    # the mark of r2 counts now; a run that was lost before its mark starts from there again
    assert extract("r4", ("c", "late", 8), ("f", "newer", 13))
    assert known() == [("a", "one"), ("b", "two"), ("c", "late"), ("e", "no time"), ("f", "new"), ("f", "newer")]
    assert medallion.bronze_rows(lake, "stores").count() == 6
    assert medallion.clean_table(lake, CONTRACTS["stores"], "r4", as_of=as_of())


def test_counting_reads_nothing_again(spark, lake):
    """Cleaning a table runs as many jobs as it has writes, reads of bronze and of the listing of files; none of them counts."""
    tables = source_tables(spark)
    medallion.ingest_all(lake, lambda t: tables.get(t), "r1", as_of=as_of())
    tracker, group = spark.sparkContext.statusTracker(), "counting"
    spark.sparkContext.setJobGroup(group, "")
    assert medallion.clean_table(lake, CONTRACTS["transactions"], "r1", as_of=as_of())
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    entry = lake.read_audit().where("table_name = 'transactions'").first()
    staged, silver = lake.read("staged", "transactions"), lake.read("silver", "transactions")
    assert (entry.bronze_count, entry.silver_count, entry.quarantine_count) == (
        staged.count(), silver.count(), staged.where("not is_valid").count(),
    )
    assert jobs <= 10
