"""Streams give the batch result however the input is cut into micro-batches."""

import json
import time
from pathlib import Path

import pytest
from helpers import as_of, rows
from pyspark.sql import functions as F

from tallyforge.checks import queries
from tallyforge.contracts import CONTRACTS
from tallyforge.operators.bronze import ENVELOPE, SOURCES
from tallyforge.operators.latest import apply_changes, latest_by
from tallyforge.plans import silver
from tallyforge.session import shuffles_dropped
from tallyforge.sources.layers import Lakehouse
from tallyforge.streaming import ingest

SPEC = {s.table: s for s in SOURCES}
TX = CONTRACTS["transactions"]


def payloads():
    out = []
    for i in range(60):
        row = {
            "id": str(i % 20),
            "op": "D" if i == 59 else "U" if i >= 20 else "C",
            "transaction_id": f"T{i % 20}",
            "customer_id": None,
            "store_id": "S",
            "channel": "POS" if i % 7 else "KIOSK",
            "product_id": "P",
            "quantity": i + 1,
            "unit_price": "1.00",
            "discount": "0.00",
            # every third event is back-dated by days
            "transaction_timestamp": f"2026-05-{(1 + i // 3) if i % 3 else 1:02d} 10:{i % 60:02d}:00",
        }
        out.append((json.dumps(row), i))
    return out


def raw_frame(spark):
    df = spark.createDataFrame(payloads(), "raw_payload string, kafka_offset int")
    return df.withColumn("kafka_partition", F.lit(0))


def comparable(df):
    return rows(df.select("event_id", "operation_type", "event_timestamp", "quantity", "channel"), "event_id")


@pytest.mark.parametrize("files", [1, 7])
def test_bronze_and_silver_stream(spark, tmp_path, files):
    raw_frame(spark).repartition(files).write.parquet(str(tmp_path / "topic"))
    source = ingest.file_source(spark, str(tmp_path / "topic"), raw_frame(spark).schema, maxFilesPerTrigger="1")
    enveloped = ingest.payload_envelope(source, SPEC["transactions"], "run", as_of())
    ingest.stream_bronze(enveloped, str(tmp_path / "bronze"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "bronze")).count() == 60

    bronze = ingest.file_source(spark, str(tmp_path / "bronze"), ENVELOPE, maxFilesPerTrigger="2")
    for _ in range(2):  # the second start finds nothing new
        ingest.stream_silver(bronze, TX, str(tmp_path / "silver"), str(tmp_path / "c2")).awaitTermination()

    batch = silver.clean(ingest.payload_envelope(raw_frame(spark), SPEC["transactions"], "run", as_of()), TX)
    streamed = ingest.streamed_silver(spark, TX, str(tmp_path / "silver"))
    assert comparable(streamed) == comparable(batch.valid.where("operation_type <> 'D'"))
    held = ingest.streamed_quarantine(spark, TX, str(tmp_path / "silver"))
    assert comparable(held) == comparable(batch.quarantined)

    lake = Lakehouse(spark, str(tmp_path / "lake"))
    ingest.compact(lake, TX, str(tmp_path / "silver"))
    assert comparable(lake.read("silver", "transactions")) == comparable(streamed)


def deduplicated(spark, tmp_path, frames, delay="1 hour"):
    """Each frame arrives as a file of its own, in order; returns the stored path and the latest rows."""
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = ingest.file_source(spark, str(tmp_path / "in"), frames[0].schema, maxFilesPerTrigger="1")
    args = (["event_id"], str(tmp_path / "out"), str(tmp_path / "c"), "at", delay)
    for _ in range(2):  # the second start finds nothing new
        ingest.stream_unique(source, *args).awaitTermination()
    return ingest.unique_rows(spark, str(tmp_path / "out"), ["event_id"], "at")


def arrivals(spark, *events):
    """(event_id, day of May, note) each."""
    return spark.createDataFrame(
        [(k, f"2026-05-{d:02d} 00:00:00" if d else None, n) for k, d, n in events], "event_id string, at string, note string"
    ).withColumn("at", F.col("at").cast("timestamp"))


def noted(df):
    return [(r.event_id, r.at and r.at.day, r.note) for r in df.orderBy(F.col("event_id").asc_nulls_first()).collect()]


def test_stream_dedup_keeps_the_latest_copy_by_event_time(spark, tmp_path):
    first = arrivals(spark, ("a", 20, "old"), ("a", 21, "new"), ("b", 20, "only"), ("c", 25, "first"), (None, 3, "no key"))
    # copies that come later with older and with newer times, a late first arrival, a repeat, a row without a time
    second = arrivals(spark, ("a", 2, "older"), ("c", 26, "newer"), ("d", 1, "late"), ("b", 20, "only"), ("e", None, "no time"), (None, 4, "no key"))
    third = arrivals(spark, ("d", 2, "later"), ("d", 1, "late"), ("c", 3, "much older"), ("e", 1, "timed"))
    got = deduplicated(spark, tmp_path, [first, second, third])
    assert got.columns == ["event_id", "at", "note"]
    assert noted(got) == [(None, 4, "no key"), ("a", 21, "new"), ("b", 20, "only"), ("c", 26, "newer"), ("d", 2, "later"), ("e", 1, "timed")]
    stored = spark.read.parquet(str(tmp_path / "out")).select("event_id", "note").collect()
    # neither repeats within the delay nor late copies that lose are stored
    assert ("a", "older") not in stored and ("c", "much older") not in stored and stored.count(("b", "only")) == 1


def test_stream_dedup_is_one_whatever_the_batches(spark, tmp_path):
    rows_ = [(f"k{i % 17}", 1 + (i * 7) % 28, f"n{i % 3}") for i in range(200)]
    want = {}
    for k, d, n in rows_:
        want[k] = max(want.get(k, (0, "")), (d, n))
    for files in (1, 5):
        parts = [arrivals(spark, *rows_[i::files]) for i in range(files)]
        got = deduplicated(spark, tmp_path / str(files), parts)
        assert noted(got) == sorted((k, d, n) for k, (d, n) in want.items())


def test_stream_dedup_replays_a_batch(spark, tmp_path):
    """A batch that is stored but not committed is run again by the next start, and gives the same rows."""
    deduplicated(spark, tmp_path, [arrivals(spark, ("a", 20, "x")), arrivals(spark, ("a", 2, "late"), ("b", 3, "late"))])
    newest = max((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()
    (tmp_path / "c" / "commits" / f".{newest.name}.crc").unlink(missing_ok=True)
    source = ingest.file_source(spark, str(tmp_path / "in"), arrivals(spark, ("a", 1, "x")).schema, maxFilesPerTrigger="1")
    ingest.stream_unique(source, ["event_id"], str(tmp_path / "out"), str(tmp_path / "c"), "at").awaitTermination()
    assert noted(ingest.unique_rows(spark, str(tmp_path / "out"), ["event_id"], "at")) == [("a", 20, "x"), ("b", 3, "late")]


def silver_events(spark, *events):
    """(id, day, quantity, operation) as raw payloads."""
    rows_ = [
        (json.dumps({"id": k, "op": op, "transaction_id": "T", "customer_id": "C", "store_id": "S", "channel": "POS", "product_id": "P",
                     "quantity": q, "unit_price": "1.00", "discount": "0.00", "transaction_timestamp": f"2026-05-{d:02d} 10:00:00"}), 0, i)
        for i, (k, d, q, op) in enumerate(events)
    ]
    raw = spark.createDataFrame(rows_, "raw_payload string, kafka_partition int, kafka_offset int")
    return ingest.payload_envelope(raw, SPEC["transactions"], "run", as_of())


def test_compaction_spares_the_batches_in_it(spark, tmp_path):
    path, lake = str(tmp_path / "silver"), Lakehouse(spark, str(tmp_path / "lake"))

    def arrive(*events):
        silver_events(spark, *events).coalesce(1).write.mode("append").parquet(str(tmp_path / "bronze"))
        bronze = ingest.file_source(spark, str(tmp_path / "bronze"), ENVELOPE)
        ingest.stream_silver(bronze, TX, path, str(tmp_path / "c")).awaitTermination()

    def current():
        df = ingest.streamed_silver(spark, TX, path)
        folders = {f.split("/silver/")[1].rsplit("/", 1)[0] for f in df.inputFiles()}
        return folders, {(r.id, r.quantity) for r in df.collect()}

    assert ingest.streamed_silver(spark, TX, path).count() == 0
    arrive(("1", 1, 1, "C"), ("2", 1, 2, "C"), ("3", 1, 3, "C"))
    arrive(("1", 5, 10, "U"), ("3", 5, 3, "D"), ("4", 1, 4, "X"))
    want = {("1", 10), ("2", 2), ("4", 4)}
    folders, got = current()
    assert got == want and {f.split("/")[0] for f in folders} == {"batch_id=0", "batch_id=1"}
    ingest.compact(lake, TX, path)
    assert current() == ({"_compacted/upto=1"}, want)
    # an older change of a deleted row, an older one of a changed row, and a new row
    arrive(("3", 2, 33, "U"), ("1", 2, 11, "U"), ("5", 1, 5, "C"))
    folders, got = current()
    assert got == want | {("5", 5)} and {f.split("/")[0] for f in folders} == {"_compacted", "batch_id=2"}
    for n in (3, 4):
        arrive((str(n + 10), 1, n, "C"))
        ingest.compact(lake, TX, path)
        ingest.compact(lake, TX, path)  # nothing new: no further state
    assert sorted(p.name for p in (tmp_path / "silver" / "_compacted").iterdir()) == ["upto=3", "upto=4"]
    assert current() == ({"_compacted/upto=4"}, want | {("5", 5), ("13", 3), ("14", 4)})
    assert {(r.id, r.quantity) for r in lake.read("silver", "transactions").collect()} == want | {("5", 5), ("13", 3), ("14", 4)}


def test_change_events_are_unwrapped(spark):
    payloads = [
        '{"op": "c", "before": null, "after": {"id": "1", "v": 1}}',
        '{"payload": {"op": "u", "before": {"id": "1", "v": 1}, "after": {"id": "1", "v": 2}}}',
        '{"op": "d", "before": {"id": "1", "v": 2}, "after": null}',
        '{"op": "r", "after": {"id": "2"}}',
        '{"id": "3", "op": "D"}',
        '{"id": "4"}',
        '{"nothing": 1}',
        '{"nothing": 2}',
    ]
    raw = spark.createDataFrame([(p, 0, i) for i, p in enumerate(payloads)], "raw_payload string, kafka_partition int, kafka_offset long")
    got = ingest.payload_envelope(raw, SPEC["transactions"], "run", as_of()).orderBy("kafka_offset").collect()
    assert [(r.business_key, r.operation_type) for r in got] == [
        ("1", "C"), ("1", "U"), ("1", "D"), ("2", "C"), ("3", "D"), ("4", "C"), (None, "C"), (None, "C"),
    ]
    assert got[1].raw_payload == '{"id":"1","v":2}' and got[2].raw_payload == '{"id":"1","v":2}'
    assert got[0].event_id == got[2].event_id and got[6].event_id != got[7].event_id


@pytest.mark.parametrize("files", [1, 6])
def test_change_stream_equals_one_batch(spark, tmp_path, files):
    base = spark.createDataFrame([(i, "base") for i in range(8)], "id int, v string")
    log = [(i % 6 + 4, "DUCUU"[i % 5], f"v{i}", (i * 37) % 101) for i in range(80)]
    changes = spark.createDataFrame(log, "id int, operation_type string, v string, seq int")
    changes.repartition(files).write.parquet(str(tmp_path / "in"))
    source = ingest.file_source(spark, str(tmp_path / "in"), changes.schema, maxFilesPerTrigger="1")
    ingest.stream_changes(source, ["id"], ["seq"], str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out")).drop("batch_id")
    streamed = ingest.current_state(base, stored, ["id"], ["seq"])
    assert rows(streamed, "id") == rows(apply_changes(base, changes, ["id"], ["seq"]), "id")


def test_batches_do_not_grow_with_files(spark, tmp_path):
    """Bronze left by a join with many partitions is still one batch of silver as long as it is small."""
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        path = queries._streamed(queries.Retail(spark, "/root/testdata/sf0.001"), base=str(tmp_path))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(list((tmp_path / "bronze").glob("*.parquet"))) > 8
    assert len(list(Path(path).glob("batch_id=*"))) == 1


def test_deliveries_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "scratch_dir", lambda spark, purpose: f"{tmp_path}/{purpose}")
    queries.stream_dedup(queries.Retail(spark, "/root/testdata/sf0.001"))
    assert len(list((tmp_path / "stream-dedup" / "in").glob("*.parquet"))) > 3


def test_layers_are_packed_and_compaction_deduplicates_once(spark, tmp_path, monkeypatch):
    path, lake, ranked = str(tmp_path / "silver"), Lakehouse(spark, str(tmp_path / "lake")), []
    monkeypatch.setattr(ingest, "latest_by", lambda df, *how: ranked.append(how) or latest_by(df, *how))
    silver_events(spark, ("1", 1, 1, "C"), ("1", 2, 2, "U"), ("2", 1, 3, "C"), ("2", 2, 3, "D")).write.parquet(str(tmp_path / "in"))
    ingest.stream_bronze(ingest.file_source(spark, str(tmp_path / "in"), ENVELOPE), str(tmp_path / "bronze"), str(tmp_path / "c1")).awaitTermination()
    ingest.stream_silver(ingest.file_source(spark, str(tmp_path / "bronze"), ENVELOPE), TX, path, str(tmp_path / "c2")).awaitTermination()
    ingest.compact(lake, TX, path)
    assert len(ranked) == 1
    assert [(r.id, r.quantity) for r in lake.read("silver", "transactions").collect()] == [("1", 2)]
    assert {r.id for r in spark.read.parquet(f"{path}/_compacted/upto=0").collect()} == {"1", "2"}
    for layer in ("bronze", "silver/batch_id=0", "silver/_compacted", "lake"):
        files = [p.name for p in (tmp_path / layer).rglob("*.parquet")]
        assert files and all(name.endswith(".zstd.parquet") for name in files), layer


def test_shuffle_files_go_with_what_is_written(spark, tmp_path):
    def shuffled():
        listing = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        names = []
        while listing.hasNext():
            names.append(listing.next().getName())
        return {n for n in names if n.startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    with shuffles_dropped(spark):
        spark.range(1000).repartition(3, "id").write.parquet(str(tmp_path / "out"))
    deadline = time.time() + 20
    while shuffled() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
