"""Envelopes, contracts, quarantine, deduplication and reconciliation on literal rows."""

import json

import pytest
from helpers import as_of, rows, ts
from pyspark.sql import functions as F

from tallyforge.contracts import CONTRACTS, contract_from_mapping, contract_schema, load_contracts
from tallyforge.operators.bronze import SOURCES, event_time, to_bronze
from tallyforge.operators.latest import check_freshness, check_unique
from tallyforge.plans import silver

SPEC = {s.table: s for s in SOURCES}
TX = CONTRACTS["transactions"]


def envelopes(spark, payloads, table="transactions"):
    data = [
        (f"e{k}", p if isinstance(p, (str, type(None))) else json.dumps(p), t, ts(n))
        for k, p, t, n in payloads
    ]
    df = spark.createDataFrame(
        data, "event_id string, raw_payload string, event_timestamp string, ingestion_timestamp timestamp_ntz"
    )
    return df.withColumns({"operation_type": F.lit("C"), "pipeline_run_id": F.lit("r")})


def tx(**changes):
    row = {
        "id": "1",
        "transaction_id": "T1",
        "customer_id": "C1",
        "store_id": "S1",
        "channel": "POS",
        "product_id": "P1",
        "quantity": 2,
        "unit_price": "10.00",
        "discount": "0.00",
        "transaction_timestamp": "2026-05-01 10:00:00",
    }
    return {**row, **changes}


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, None),
        ({"unit_price": None}, "unit_price is null"),
        ({"unit_price": "-10.00"}, "unit_price is below min value 0.0"),
        ({"unit_price": "-10.00", "quantity": -2}, "quantity is below min value 1"),
        ({"unit_price": "nan"}, "unit_price is null"),
        ({"quantity": "abc"}, "quantity is null"),
        ({"quantity": 2.0}, "quantity is null"),
        ({"channel": "KIOSK"}, "channel not in accepted values"),
        ({"channel": " POS "}, None),
        ({"customer_id": None}, None),
        ({"store_id": None}, None),
        ({"transaction_timestamp": "soon"}, "transaction_timestamp is null"),
        ({"id": None, "quantity": -1}, "id is null"),
    ],
)
def test_first_violation_wins(spark, change, reason):
    bronze = envelopes(spark, [(1, tx(**change), "2026-05-01 10:00:00", "2026-05-02 00:00:00")])
    assert silver.tag(bronze, TX).first()["quarantine_reason"] == reason


def test_unreadable_payload_fails_the_first_rule(spark):
    bronze = envelopes(
        spark,
        [(i, p, "2026-05-01", "2026-05-02 00:00:00") for i, p in enumerate(["not json", None, "[]"])],
    )
    assert {r.quarantine_reason for r in silver.tag(bronze, TX).collect()} == {"id is null"}


def test_customer_rules_and_standardisation(spark):
    base = {
        "id": "1",
        "first_name": " Ann ",
        "last_name": "Lee",
        "email": "ann.example.com",
        "phone": None,
        "gender": "f",
        "state": "ny",
        "birth_date": "1990-02-03",
    }
    payloads = [
        (1, base, "2026-05-01", "2026-05-02 00:00:00"),
        (2, {**base, "state": "NYC"}, "2026-05-01", "2026-05-02 00:00:00"),
        (3, {**base, "gender": "x"}, "2026-05-01", "2026-05-02 00:00:00"),
    ]
    bronze = envelopes(spark, payloads)
    plain = {r.event_id: r for r in silver.tag(bronze, CONTRACTS["customers"]).collect()}
    assert plain["e1"].quarantine_reason is None
    assert (plain["e1"].first_name, plain["e1"].gender, plain["e1"].state) == ("Ann", "F", "NY")
    assert plain["e1"].birth_date == ts("1990-02-03 00:00:00")
    assert plain["e2"].quarantine_reason == "state length does not equal 2"
    assert plain["e3"].quarantine_reason == "gender not in accepted values"
    strict = silver.tag(bronze, CONTRACTS["customers"], patterns=True)
    assert strict.where("event_id = 'e1'").first()["quarantine_reason"] == "email does not match pattern"


def test_latest_event_survives_and_counts_reconcile(spark):
    payloads = [
        (1, tx(quantity=1), "2026-05-01 10:00:00", "2026-05-02 00:00:00"),
        (1, tx(quantity=5), "2026-05-03 10:00:00", "2026-05-02 00:00:00"),
        (2, tx(id="2"), "2026-05-01 10:00:00", "2026-05-02 00:00:00"),
        (2, tx(id="2"), "2026-05-01 10:00:00", "2026-05-02 00:00:00"),
        (3, tx(id="3", quantity=0), "2026-05-01 10:00:00", "2026-05-02 00:00:00"),
        (3, tx(id="3", quantity=0), "2026-05-01 10:00:00", "2026-05-02 00:00:00"),
    ]
    result = silver.clean(envelopes(spark, payloads), TX, as_of=as_of())
    assert rows(result.valid.select("event_id", "quantity"), "event_id") == [("e1", 5), ("e2", 2)]
    audit = result.audit.first()
    assert (audit.bronze_count, audit.silver_count, audit.quarantine_count, audit.duplicate_count) == (6, 2, 2, 2)
    assert audit.reconciled and audit.quality_score == 33.33
    assert audit.timestamp == "2026-07-01 00:00:00"
    versions = silver.clean(envelopes(spark, payloads), TX, keys=silver.VERSION_KEYS)
    assert versions.valid.count() == 3


def test_audit_of_nothing_scores_full_marks(spark):
    empty = silver.tag(envelopes(spark, [(1, tx(), "x", "2026-05-02 00:00:00")]).where("false"), TX)
    assert silver.reconcile(empty, "transactions").first()["quality_score"] == 100.0


def test_envelope(spark):
    df = spark.sql(
        "select 'a' id, cast(1.5 as decimal(10,2)) price, 2.5D score, 7 n, cast(null as string) gone,"
        " timestamp_ntz'2026-01-02 03:04:05.678' updated_at"
    )
    row = to_bronze(df, SPEC["products"], "run", as_of=as_of()).first()
    assert json.loads(row.raw_payload) == {
        "id": "a",
        "price": "1.50",
        "score": "2.5",
        "n": 7,
        "gone": None,
        "updated_at": "2026-01-02 03:04:05",
    }
    assert row.event_timestamp == "2026-01-02 03:04:05"
    assert (row.business_key, row.operation_type, row.schema_version) == ("a", "C", "1.0")
    expected = spark.sql("select md5('INVENTORY-products-a') h").first()["h"]
    assert row.event_id == expected


def test_event_time_takes_the_first_filled_candidate(spark):
    payloads = [
        '{"created_at": "c", "updated_at": "u"}',
        '{"created_at": "c", "updated_at": ""}',
        '{"campaign_date": "d"}',
        "{}",
        "broken",
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string")
    found = df.select("i", event_time("p", as_of()).alias("t"))
    now = "2026-07-01 00:00:00"
    assert [t for _, t in rows(found, "i")] == ["u", "c", "d", now, now]


def test_uniqueness_and_freshness(spark):
    df = spark.sql("select * from values ('a', timestamp_ntz'2026-06-30 12:00:00'), ('a', null) t(id, at)")
    assert rows(check_unique(df, ["id"])) == [("a", 2)]
    fresh = check_freshness(df, "at", 12, as_of()).first()
    assert (fresh.age_hours, fresh.is_fresh) == (12.0, True)
    assert not check_freshness(df, "at", 11, as_of()).first()["is_fresh"]
    assert not check_freshness(df.where("false"), "at", 11, as_of()).first()["is_fresh"]


def test_contract_files(tmp_path):
    path = tmp_path / "contracts.json"
    spec = {"contracts": {"stores": {"columns": {"id": {"type": "string", "nullable": False, "pii": True}}}}}
    path.write_text(json.dumps(spec))
    loaded = load_contracts(str(path))
    assert loaded["stores"].names == ["id"] and loaded["stores"].pii == ["id"]
    assert set(loaded) == set(CONTRACTS)
    assert CONTRACTS["customers"].pii == ["first_name", "last_name", "email", "phone", "birth_date"]
    assert CONTRACTS["transactions"].primary_key == ["id"]


def test_contract_types():
    contract = contract_from_mapping(
        "t", {"columns": {c: {"type": c} for c in ("integer", "decimal", "double", "date", "string")}}
    )
    assert [f.dataType.simpleString() for f in contract_schema(contract)] == [
        "int",
        "decimal(18,2)",
        "double",
        "string",
        "string",
    ]
    assert all(f.nullable for f in contract_schema(contract))


def test_light_silver(spark):
    sales = spark.sql("select * from values ('a', 0, 1.0), ('b', 1, null), ('c', 1, 0.0), ('d', 1, 1.0) t(id, quantity, unit_price)")
    assert rows(silver.light_silver("transactions", sales).select("id")) == [("d",)]
    people = spark.sql("select * from values ('a', 'x@y'), ('b', 'xy'), ('c', null) t(id, email)")
    assert rows(silver.light_silver("customers", people).select("id")) == [("a",)]
    with pytest.raises(ValueError):
        silver.light_silver("nothing", people)
