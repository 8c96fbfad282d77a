"""Version intervals, point-in-time joins and trailing windows against brute force, with a hot key."""

import random
from datetime import datetime, timedelta

import pytest
from helpers import rows, ts
from pyspark.sql import functions as F

from tallyforge.operators.pit import interval_join, pit_join
from tallyforge.operators.timeline import neighbour_time, scd2, time_since_previous, velocity

START = datetime(2026, 1, 1)


def open_end():
    return F.lit("9999-12-31 23:59:59").cast("timestamp_ntz")


def feed(seed, n, keys=5, minutes=4000, hot=0.34):
    """Random (id, key, time) rows; key K0 holds a third of them, a few keys are missing."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "K0" if rnd.random() < hot else rnd.choice([f"K{j}" for j in range(keys)] + [None])
        out.append((i, key, START + timedelta(minutes=rnd.randrange(minutes), seconds=rnd.choice([0, 0, 30]))))
    return out


SCHEMA = "id int, k string, t timestamp_ntz"


@pytest.mark.parametrize("step", [1, -1])
@pytest.mark.parametrize("minutes", [30, 4000, 400000])
def test_neighbours_match_a_plain_scan(spark, step, minutes):
    data = feed(1, 400, minutes=minutes)
    got = dict(
        rows(neighbour_time(spark.createDataFrame(data, SCHEMA), "k", "t", "n", step=step, ties=["id"]).select("id", "n"))
    )
    for key in {k for _, k, _ in data if k}:
        line = sorted((t, i) for i, k, t in data if k == key)
        for pos, (_, i) in enumerate(line):
            other = pos + step
            assert got[i] == (line[other][0] if 0 <= other < len(line) else None)
    assert all(got[i] is None for i, k, _ in data if k is None)


@pytest.mark.parametrize("step", [1, -1])
@pytest.mark.parametrize("whole", [1, 60, 1000])
def test_keys_of_few_rows_are_one_chunk(spark, step, whole):
    """The same neighbours whichever keys are cut into hours; only those that are have a summary."""
    data = [*feed(1, 400, keys=20, minutes=400000), (900, "K3", None), (901, "K0", None)]
    df = spark.createDataFrame(data, SCHEMA)
    how = {"step": step, "ties": ["id"]}
    want = rows(neighbour_time(df, "k", "t", "n", **how), "id")
    assert rows(neighbour_time(df, "k", "t", "n", whole=whole, **how), "id") == want


def test_missing_times_come_last(spark):
    data = [(1, "a", ts("2026-01-01 00:00:00")), (2, "a", None)]
    got = dict(rows(neighbour_time(spark.createDataFrame(data, SCHEMA), "k", "t", "n").select("id", "n")))
    assert got == {1: None, 2: None}


@pytest.mark.parametrize("seconds", [60, 3600, 86400])
def test_velocity_counts_both_ends_and_ties(spark, seconds):
    data = feed(2, 300, minutes=600)
    got = dict(rows(velocity(spark.createDataFrame(data, SCHEMA), "k", "t", seconds).select("id", "velocity")))
    for i, k, t in data:
        low = t - timedelta(seconds=seconds)
        want = None if k is None else sum(1 for _, k2, t2 in data if k2 == k and low <= t2 <= t)
        assert got[i] == want


def test_burst_of_twelve(spark):
    data = [(i, "c", START + timedelta(minutes=2 * i)) for i in range(12)]
    got = rows(velocity(spark.createDataFrame(data, SCHEMA), "k", "t").select("id", "velocity"), "id")
    assert [v for _, v in got] == list(range(1, 13))


def test_seconds_since_previous(spark):
    data = [(1, "a", ts("2026-01-01 00:59:59")), (2, "a", ts("2026-01-01 01:00:01.500")), (3, "b", ts("2026-01-01"))]
    got = dict(rows(time_since_previous(spark.createDataFrame(data, SCHEMA), "k", "t").select("id", "seconds_since_previous")))
    assert got == {1: None, 2: 2.5, 3: None}


def versions(spark, data, **kw):
    return scd2(spark.createDataFrame(data, SCHEMA), "k", "t", open_end=open_end(), ties=["id"], **kw)


def test_versions_never_overlap_and_one_is_current(spark):
    got = versions(spark, [r for r in feed(3, 300, minutes=100000) if r[1]]).collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r.k, []).append(r)
    for group in by_key.values():
        assert sum(r.is_current for r in group) == 1
        spans = sorted((r.valid_from, r.valid_to) for r in group if r.valid_from < r.valid_to)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("gap", [0, 1])
@pytest.mark.parametrize("minutes", [50, 20000])
def test_point_in_time_join_matches_brute_force(spark, gap, minutes):
    dim = versions(spark, [r for r in feed(4, 200, minutes=minutes) if r[1]], gap_seconds=gap)
    facts = feed(5, 500, minutes=minutes)
    fact = spark.createDataFrame([(i, k, t) for i, k, t in facts], SCHEMA)
    dim = dim.select(F.col("id").alias("version"), "k", "valid_from", "valid_to")
    kw = {"key": "k", "ts": "t", "take": {"version": "version"}}
    got = sorted(rows(pit_join(fact, dim, **kw).select("id", "version")), key=str)
    spans = dim.collect()
    want = []
    for i, k, t in facts:
        hits = [s.version for s in spans if s.k == k and s.valid_from <= t < s.valid_to]
        assert len(hits) <= 1
        want.append((i, hits[0] if hits else None))
    assert got == sorted(want, key=str)
    assert sorted(rows(interval_join(fact, dim, **kw).select("id", "version")), key=str) == got


def test_point_in_time_join_moves_facts_and_versions_only(spark):
    """Facts meet versions in one shuffle each, whatever the number of hours they touch; keys differ in their chunks."""
    rnd = random.Random(6)
    sold = [(i, f"K{i % 7}", START + timedelta(hours=rnd.randrange(30000))) for i in range(600)]
    changed = [(i, "K0" if i < 150 else f"K{i % 6}", START + timedelta(hours=rnd.randrange(25000))) for i in range(200)]
    dim = versions(spark, changed, gap_seconds=0).select(F.col("id").alias("version"), "k", "valid_from", "valid_to").cache()
    joined = pit_join(spark.createDataFrame(sold, SCHEMA), dim, key="k", ts="t", take={"v": "version"})
    spans = dim.collect()
    want = {i: next((s.version for s in spans if s.k == k and s.valid_from <= t < s.valid_to), None) for i, k, t in sold}
    assert dict(rows(joined.select("id", "v"))) == want
    assert "Window" not in joined._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]


def test_boundaries_of_a_version(spark):
    dim = versions(spark, [(1, "a", ts("2026-01-01 10:00:00")), (2, "a", ts("2026-01-05 10:00:00"))])
    dim = dim.withColumnRenamed("id", "version")
    moments = [
        ("before", "2026-01-01 09:59:59", None),
        ("first", "2026-01-01 10:00:00", 1),
        ("at the end", "2026-01-05 09:59:59", None),
        ("inside the gap", "2026-01-05 09:59:59.500", None),
        ("second", "2026-01-05 10:00:00", 2),
        ("much later", "2030-01-01 00:00:00", 2),
    ]
    fact = spark.createDataFrame([(n, "a", ts(t)) for n, t, _ in moments], "n string, k string, t timestamp_ntz")
    got = dict(rows(pit_join(fact, dim, key="k", ts="t", take={"v": "version"}).select("n", "v")))
    assert got == {n: v for n, _, v in moments}


def test_facts_without_key_or_time_stay(spark):
    dim = versions(spark, [(1, "a", ts("2026-01-01 10:00:00"))]).withColumnRenamed("id", "version")
    fact = spark.createDataFrame([(1, None, ts("2026-02-01")), (2, "a", None), (3, "zz", ts("2026-02-01"))], SCHEMA)
    got = dict(rows(pit_join(fact, dim, key="k", ts="t", take={"v": "version"}).select("id", "v")))
    assert got == {1: None, 2: None, 3: None}


def test_session_time_zone_does_not_matter(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 02:30 does not exist in that zone on this day
        data = [(i, "a", ts("2026-03-08 01:30:00") + timedelta(minutes=30 * i)) for i in range(6)]
        df = spark.createDataFrame(data, SCHEMA)
        got = rows(velocity(df, "k", "t", 3600).select("id", "velocity"), "id")
        assert [v for _, v in got] == [1, 2, 3, 3, 3, 3]
        gaps = rows(time_since_previous(df, "k", "t").select("id", "seconds_since_previous"), "id")
        assert [g for _, g in gaps] == [None, 1800.0, 1800.0, 1800.0, 1800.0, 1800.0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
